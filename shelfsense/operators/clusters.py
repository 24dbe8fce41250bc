"""k-means and Gaussian mixtures for many starts and many k at once.

All fits share one scan per iteration: a task adds up what every fit still running needs of its rows
(sums per cluster or per component), and one sum per number reaches the driver, whatever the number of
rows. Rows are never copied per fit. Starting centres come from k-means++ on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that starting centres are drawn from: those with the least hash of their values.
SAMPLE_ROWS = 20_000
#: Numbers of a table of rows by centres that are worked on at a time, so that they stay in a core's cache.
CACHED = 262_144


def as_array(df: DataFrame, vector: str) -> Column:
    return vector_to_array(vector) if isinstance(df.schema[vector].dataType, VectorUDT) else F.col(vector)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of a batch as the rows of a matrix."""
    widths = np.diff(column.offsets.to_numpy())
    if column.null_count or (widths != widths[0]).any():
        raise ValueError("vectors must be present and of one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(df: DataFrame, vector: str, length: int, measure: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of a measure that gives ``length`` numbers for a batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            if len(batch):
                total += measure(_matrix(batch.column(0)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("int32")), pa.array(total[some])], ["place", "value"])

    parts = df.select(as_array(df, vector).cast("array<double>").alias("v")).mapInArrow(run, "place int, value double")
    out = np.zeros(length)
    for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r["place"]] = r["value"]
    return out


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        d += (x[:, j, None] - centres[None, :, j]) ** 2
    return d


def _pieces(rows: int, columns: int) -> Iterator[slice]:
    """Slices of so many rows that a table of them by ``columns`` stays in a core's cache."""
    step = max(1, CACHED // max(columns, 1))
    return (slice(a, a + step) for a in range(0, rows, step))


def _nearest(x: np.ndarray, sets: Sequence[np.ndarray]) -> np.ndarray:
    """Number of each row's nearest centre, the first of equally near ones, in every set.

    Matrix products compare the distances; where two of them differ by little, they are computed anew.
    """
    edges, every = np.concatenate([[0], np.cumsum([len(s) for s in sets])]), np.concatenate(sets)
    norms = (every**2).sum(axis=1)
    label = np.zeros((len(sets), len(x)), dtype=np.int64)
    for rows in _pieces(len(x), len(every)):
        part = x[rows]
        rough = norms[:, None] - 2.0 * (every @ part.T)
        # Far above the rounding error of the products.
        slack = 1e-10 * (norms.max() + (part**2).sum(axis=1))
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            own, place = rough[a:b], label[i, rows]
            near = own <= own.min(axis=0) + slack
            for c in range(1, b - a):
                np.copyto(place, c, where=near[c])
            doubt = np.flatnonzero(near.sum(axis=0, dtype=np.int32) != 1)
            if len(doubt):
                place[doubt] = _squares(part[doubt], sets[i]).argmin(axis=1)
    return label


def _square_to(columns: np.ndarray, centres: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Square distance of each row, given by columns, to the centre of its label."""
    d = np.zeros(len(label))
    for j, column in enumerate(columns):
        d += (column - centres[label, j]) ** 2
    return d


# --- k-means -----------------------------------------------------------------------------


@dataclass
class KMeansFit:
    """Centres of one start; ``cost`` is the sum of squared distances to them."""

    seed: int
    centres: np.ndarray
    cost: float = float("inf")

    @property
    def k(self) -> int:
        return len(self.centres)

    def label(self, vector: Column) -> Column:
        """Number of the nearest centre, the first of equally near ones."""
        squares = [
            F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
            for c in self.centres
        ]
        return F.transform(F.array(F.array(*squares)), lambda d: F.array_position(d, F.array_min(d)).cast("int") - 1)[0]

    def transform(self, df: DataFrame, vector: str = "parts", label: str = "raw_label") -> DataFrame:
        return df.withColumn(label, self.label(as_array(df, vector)))


def starting_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each centre is drawn by its squared distance to those before it."""
    rng = np.random.default_rng([seed, k])
    chosen = [sample[rng.integers(len(sample))]]
    near = _squares(sample, np.array(chosen))[:, 0]
    while len(chosen) < k:
        total = near.sum()
        at = rng.choice(len(sample), p=near / total) if total > 0 else rng.integers(len(sample))
        chosen.append(sample[at])
        near = np.minimum(near, _squares(sample, sample[at : at + 1])[:, 0])
    return np.array(chosen)


def drawn_sample(df: DataFrame, vector: str) -> np.ndarray:
    v = as_array(df, vector)
    rows = df.select(v.alias("v")).orderBy(F.xxhash64("v"), "v").limit(SAMPLE_ROWS).collect()
    return np.array([r["v"] for r in rows], dtype=float)


def lloyd(df: DataFrame, vector: str, starts: Sequence[KMeansFit], iterations: int = 300, tolerance: float = 1e-4) -> list[KMeansFit]:
    """Move the centres of all starts together, each until it moves by no more than ``tolerance``.

    ``df`` should be stored: it is scanned once per iteration. A cluster without rows keeps its centre.
    """
    fits = list(starts)
    moving = list(range(len(fits)))

    def measured(active: list[KMeansFit], cost: bool = False) -> tuple[np.ndarray, np.ndarray]:
        sizes = [f.k for f in active]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        width = active[0].centres.shape[1]
        centres = [f.centres for f in active]

        def measure(x: np.ndarray) -> np.ndarray:
            columns = np.ascontiguousarray(x.T)
            out = np.zeros((edges[-1], width + 2))
            for label, own, a, b in zip(_nearest(x, centres), centres, edges[:-1], edges[1:]):
                out[a:b, 0] = np.bincount(label, minlength=b - a)
                if cost:
                    out[a:b, 1] = np.bincount(label, weights=_square_to(columns, own, label), minlength=b - a)
                    continue
                for j in range(width):
                    out[a:b, 2 + j] = np.bincount(label, weights=columns[j], minlength=b - a)
            return out.ravel()

        return edges, summed(df, vector, int(edges[-1]) * (width + 2), measure).reshape(-1, width + 2)

    for _ in range(iterations):
        if not moving:
            break
        edges, sums = measured([fits[i] for i in moving])
        still = []
        for i, a, b in zip(moving, edges[:-1], edges[1:]):
            n, moved = sums[a:b, 0], fits[i].centres.copy()
            moved[n > 0] = sums[a:b, 2:][n > 0] / n[n > 0, None]
            shift = float(((moved - fits[i].centres) ** 2).sum())
            fits[i] = KMeansFit(fits[i].seed, moved)
            if shift > tolerance**2:
                still.append(i)
        moving = still
    edges, sums = measured(fits, cost=True)
    return [KMeansFit(f.seed, f.centres, float(sums[a:b, 1].sum())) for f, a, b in zip(fits, edges[:-1], edges[1:])]


def fit_kmeans(df: DataFrame, vector: str, ks: Sequence[int], seeds: Sequence[int], iterations: int = 300) -> list[KMeansFit]:
    """A fit for every k and seed, all in the same scans. ``df`` should be stored."""
    sample = drawn_sample(df, vector)
    return lloyd(df, vector, [KMeansFit(s, starting_centres(sample, k, s)) for k in ks for s in seeds], iterations)


def silhouettes(df: DataFrame, vector: str, fits: Sequence[KMeansFit]) -> list[float]:
    """Mean silhouette under squared distance of every fit, in two scans for all of them."""
    width, sizes = fits[0].centres.shape[1], [f.k for f in fits]
    edges = np.concatenate([[0], np.cumsum(sizes)])

    def labels(x: np.ndarray) -> np.ndarray:
        return _nearest(x, [f.centres for f in fits])

    def moments(x: np.ndarray) -> np.ndarray:
        out = np.zeros((edges[-1], width + 2))
        square = (x**2).sum(axis=1)
        for label, a, b in zip(labels(x), edges[:-1], edges[1:]):
            out[a:b, 0] = np.bincount(label, minlength=b - a)
            out[a:b, 1] = np.bincount(label, weights=square, minlength=b - a)
            for j in range(width):
                out[a:b, 2 + j] = np.bincount(label, weights=x[:, j], minlength=b - a)
        return out.ravel()

    m = summed(df, vector, int(edges[-1]) * (width + 2), moments).reshape(-1, width + 2)

    def total(x: np.ndarray) -> np.ndarray:
        out, square = np.zeros(len(fits)), (x**2).sum(axis=1)
        for i, (label, a, b) in enumerate(zip(labels(x), edges[:-1], edges[1:])):
            n = m[a:b, 0]
            # Sum of squared distances to all rows of each cluster.
            far = np.maximum(square[:, None] * n + m[a:b, 1] - 2.0 * x @ m[a:b, 2:].T, 0.0)
            own_n = n[label]
            rows = np.arange(len(x))
            inside = far[rows, label] / np.maximum(own_n - 1, 1)
            mean = np.where(n > 0, far / np.maximum(n, 1), np.inf)
            mean[rows, label] = np.inf
            outside = mean.min(axis=1)
            most = np.maximum(inside, outside)
            value = np.where((own_n > 1) & (most > 0) & np.isfinite(outside), (outside - inside) / np.where(most > 0, most, 1.0), 0.0)
            out[i] = value.sum()
        return out

    rows = m[: edges[1], 0].sum()
    return [float(v / max(rows, 1)) for v in summed(df, vector, len(fits), total)]


# --- mixtures ----------------------------------------------------------------------------


@dataclass
class Mixture:
    """Gaussian components with diagonal covariance."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    log_likelihood: float = -float("inf")
    rows: int = 0

    @property
    def k(self) -> int:
        return len(self.weights)

    @property
    def parameters(self) -> int:
        return 2 * self.means.size + self.k - 1

    @property
    def bic(self) -> float:
        return self.parameters * float(np.log(self.rows)) - 2 * self.log_likelihood

    @property
    def aic(self) -> float:
        return 2 * self.parameters - 2 * self.log_likelihood

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, a column per component."""
        return self.logs_by_component(np.ascontiguousarray(x.T)).T

    def logs_by_component(self, columns: np.ndarray) -> np.ndarray:
        """The same for rows given by columns, a row per component."""
        head = np.log(np.maximum(self.weights, 1e-300)) - 0.5 * np.log(2 * np.pi * self.variances).sum(axis=1)
        out = np.tile(head[:, None], columns.shape[1])
        for j, column in enumerate(columns):
            out -= 0.5 * (column - self.means[:, j, None]) ** 2 / self.variances[:, j, None]
        return out


def expectation_maximisation(
    df: DataFrame, vector: str, starts: Sequence[Mixture], iterations: int = 100, tolerance: float = 1e-3, floor: float = 1e-6
) -> list[Mixture]:
    """Improve all mixtures together, each until its mean log likelihood grows by less than ``tolerance``.

    One scan per iteration sums weights, first and second moments per component; ``floor`` is added to variances.
    """
    fits, open_ = list(starts), list(range(len(starts)))
    before: dict[int, float] = {}

    def measured(active: list[Mixture]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = active[0].means.shape[1]
        edges = np.concatenate([[0], np.cumsum([f.k for f in active])])
        cells = int(edges[-1]) * (2 * width + 1)

        def measure(x: np.ndarray) -> np.ndarray:
            out, tail = np.zeros((edges[-1], 2 * width + 1)), np.zeros(len(active) + 1)
            tail[-1] = len(x)
            columns = np.ascontiguousarray(x.T)
            # Weights, first and second moments are one product of the shares with these.
            powers = np.concatenate([np.ones((len(x), 1)), x, x**2], axis=1)
            for i, (f, a, b) in enumerate(zip(active, edges[:-1], edges[1:])):
                for rows in _pieces(len(x), f.k):
                    logs = f.logs_by_component(columns[:, rows])
                    top = logs.max(axis=0)
                    share = np.exp(logs - top)
                    whole = share.sum(axis=0)
                    tail[i] += (top + np.log(whole)).sum()
                    share /= whole
                    out[a:b] += share @ powers[rows]
            return np.concatenate([out.ravel(), tail])

        found = summed(df, vector, cells + len(active) + 1, measure)
        return edges, found[:cells].reshape(-1, 2 * width + 1), found[cells:]

    def improved(old: Mixture, own: np.ndarray) -> Mixture:
        n, width = own[:, 0] + 1e-12, old.means.shape[1]
        means = own[:, 1 : width + 1] / n[:, None]
        variances = np.maximum(own[:, width + 1 :] / n[:, None] - means**2, 0.0) + floor
        return Mixture(n / n.sum(), means, variances)

    for _ in range(iterations):
        if not open_:
            break
        edges, sums, tail = measured([fits[i] for i in open_])
        still = []
        for at, i in enumerate(open_):
            mean = tail[at] / max(tail[-1], 1)
            if i not in before or abs(mean - before[i]) >= tolerance:
                fits[i] = improved(fits[i], sums[edges[at] : edges[at + 1]])
                before[i] = mean
                still.append(i)
        open_ = still
    _, _, tail = measured(fits)
    return [Mixture(f.weights, f.means, f.variances, float(ll), int(tail[-1])) for f, ll in zip(fits, tail)]


def fit_mixtures(df: DataFrame, vector: str, ks: Sequence[int], seed: int = 42, iterations: int = 100, starts: int = 5) -> list[Mixture]:
    """A mixture for every k, begun at the best of ``starts`` k-means fits. ``df`` should be stored."""
    tried = fit_kmeans(df, vector, ks, range(seed, seed + starts))
    fits = [min((f for f in tried if f.k == k), key=lambda f: f.cost) for k in ks]
    width, edges = fits[0].centres.shape[1], np.concatenate([[0], np.cumsum([f.k for f in fits])])

    def moments(x: np.ndarray) -> np.ndarray:
        out = np.zeros((edges[-1], 2 * width + 1))
        labels = _nearest(x, [f.centres for f in fits])
        for f, label, a, b in zip(fits, labels, edges[:-1], edges[1:]):
            own = np.eye(f.k)[label]
            out[a:b, 0], out[a:b, 1 : width + 1], out[a:b, width + 1 :] = own.sum(axis=0), own.T @ x, own.T @ x**2
        return out.ravel()

    m = summed(df, vector, int(edges[-1]) * (2 * width + 1), moments).reshape(-1, 2 * width + 1)
    begun = []
    for f, a, b in zip(fits, edges[:-1], edges[1:]):
        n = np.maximum(m[a:b, 0], 1e-12)
        means = np.where(m[a:b, :1] > 0, m[a:b, 1 : width + 1] / n[:, None], f.centres)
        variances = np.maximum(m[a:b, width + 1 :] / n[:, None] - means**2, 0.0) + 1e-6
        begun.append(Mixture(n / n.sum(), means, variances))
    return expectation_maximisation(df, vector, begun, iterations)
