"""Histogram gradient boosting: many models grown together, one Spark aggregate per tree level.

Rows carry the bins of their features, written once. A pass over them lets each task sum the
gradients and hessians of its rows per (model, node, feature, bin); the sums meet in a shuffle by
(model, node, feature), a window over the bins finds the best split, and one row per (model, node)
reaches the driver. Passes per tree follow from the depth alone, never from the number of models
or rows. Every ``KEEP`` trees the margins are written with the rows.

Gradients are summed as whole numbers (units of 2**-16), so results depend neither on the
order of the sums nor on the partitions, but for the cut points of ``percentile_approx``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.session import durable, durable_even

UNIT = 65536.0
KEEP = 10
#: (model, node) pairs whose histograms a task holds at a time.
HELD = 2000


@dataclass(frozen=True)
class Loss:
    """Start margin of a mean outcome, first two derivatives by the margin, loss, and the mean a margin stands for."""

    start: Callable
    slopes: Callable
    value: Callable
    mean: Callable


def _logit(p):
    return float(np.log(p / (1.0 - p)))


def _sigmoid(m):
    return 1.0 / (1.0 + np.exp(-m))


def tweedie(power: float = 1.5) -> Loss:
    """Tweedie deviance with a log link, for outcomes of zero or more; 1 < power < 2."""
    a, b = 1.0 - power, 2.0 - power

    def slopes(y, m):
        low, high = y * np.exp(a * m), np.exp(b * m)
        return high - low, b * high - a * low

    return Loss(
        lambda mean: float(np.log(max(mean, 1e-6))),
        slopes,
        lambda y, m: np.exp(b * m) / b - y * np.exp(a * m) / a,
        np.exp,
    )


SQUARED = Loss(lambda mean: mean, lambda y, m: (m - y, np.ones(len(y))), lambda y, m: (m - y) ** 2 / 2.0, lambda m: m)
LOGISTIC = Loss(
    lambda mean: _logit(min(max(mean, 1e-6), 1.0 - 1e-6)),
    lambda y, m: (_sigmoid(m) - y, _sigmoid(m) * (1.0 - _sigmoid(m))),
    lambda y, m: np.logaddexp(0.0, m) - y * m,
    _sigmoid,
)


@dataclass
class Forest:
    """One tree per model and round, as arrays [model, node]; the children of node i are 2i+1 and 2i+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(models: int, depth: int) -> "Forest":
        nodes = 2 ** (depth + 1) - 1
        return Forest(
            np.full((models, nodes), -1, np.int16), np.zeros((models, nodes), np.int16), np.zeros((models, nodes))
        )

    def node_of(self, model: np.ndarray, bins: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(model), np.int64), np.arange(len(model))
        while True:
            f = self.feature[model, node]
            inner = f >= 0
            if not inner.any():
                return node
            right = bins[rows, np.maximum(f, 0)] > self.cut[model, node]
            node = np.where(inner, 2 * node + 1 + right, node)


def _margins(trees: list[Forest], model: np.ndarray, bins: np.ndarray, margin: np.ndarray) -> np.ndarray:
    for t in trees:
        margin = margin + t.value[model, t.node_of(model, bins)]
    return margin


def _unpack(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), width)
    return pdf["model"].to_numpy(), bins


def _add_margins(trees: list[Forest], width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                model, bins = _unpack(pdf, width)
                yield pdf.assign(margin=_margins(trees, model, bins, pdf["margin"].to_numpy()))

    return run


def _sums(trees: list[Forest], growing: Forest, level: int, width: int, most: int, loss: Loss):
    """Sums of one level: training cells (feature >= 0), and at the root the validation loss (feature -1)."""
    first = 2**level - 1

    def cells(held: dict) -> pd.DataFrame:
        out = []
        for (model, node), (g, h, n) in held.items():
            at = np.flatnonzero(n)
            out.append(
                pd.DataFrame({
                    "model": model, "node": node, "feature": at // most, "bin": at % most,
                    "g": g[at].astype(np.int64), "h": h[at].astype(np.int64), "n": n[at].astype(np.int64),
                })
            )
        return pd.concat(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        checks = np.zeros(len(growing.value))
        checked = np.zeros(len(growing.value), bool)
        offsets = np.arange(width) * most
        for pdf in batches:
            if not len(pdf):
                continue
            model, bins = _unpack(pdf, width)
            y, w, valid = pdf["y"].to_numpy(), pdf["w"].to_numpy(), pdf["valid"].to_numpy()
            margin = _margins(trees, model, bins, pdf["margin"].to_numpy())
            if level == 0 and valid.any():
                lost = np.rint(w * loss.value(y, margin) * UNIT)
                checks += np.bincount(model[valid], lost[valid], len(checks))
                checked[model[valid]] = True
            node = growing.node_of(model, bins)
            use = ~valid & (node >= first)
            if not use.any():
                continue
            g, h = loss.slopes(y, margin)
            g, h = np.rint(g * w * UNIT)[use], np.rint(h * w * UNIT)[use]
            pair = model[use].astype(np.int64) << 32 | node[use]
            found, where = np.unique(pair, return_inverse=True)
            cell = (where[:, None] * (width * most) + offsets[None, :] + bins[use]).ravel()
            size = len(found) * width * most
            many = [
                np.bincount(cell, None if v is None else np.repeat(v, width), size).reshape(len(found), -1)
                for v in (g, h, None)
            ]
            for i, key in enumerate(found):
                at = (int(key >> 32), int(key & 0xFFFFFFFF))
                old = held.get(at)
                held[at] = tuple(v[i] if old is None else old[k] + v[i] for k, v in enumerate(many))
            if len(held) > HELD:
                yield cells(held)
                held = {}
        if held:
            yield cells(held)
        if checked.any():
            at = np.flatnonzero(checked)
            yield pd.DataFrame({
                "model": at, "node": 0, "feature": -1, "bin": 0, "g": checks[at].astype(np.int64), "h": 0, "n": 0
            })

    return run


_CELLS = "model int, node int, feature int, bin int, g long, h long, n long"


def _best_splits(cells: DataFrame, shrink: float, least: int) -> DataFrame:
    """Per (model, node) its totals, and the split of highest gain that leaves ``least`` rows on either side."""
    one = cells.repartition("model", "node", "feature").groupBy("model", "node", "feature", "bin").agg(
        *[F.sum(c).alias(c) for c in ("g", "h", "n")]
    )
    along = Window.partitionBy("model", "node", "feature").orderBy("bin")
    whole = Window.partitionBy("model", "node", "feature")
    sides = one.select(
        "model", "node", "feature", "bin",
        *[F.sum(c).over(along).alias(f"l{c}") for c in ("g", "h", "n")],
        *[F.sum(c).over(whole).alias(f"t{c}") for c in ("g", "h", "n")],
    )

    def worth(g: Column, h: Column) -> Column:
        return (g / UNIT) * (g / UNIT) / (h / UNIT + shrink)

    lg, lh, ln, tg, th, tn = (F.col(c) for c in ("lg", "lh", "ln", "tg", "th", "tn"))
    gain = worth(lg, lh) + worth(tg - lg, th - lh) - worth(tg, th)
    fair = (F.col("feature") >= 0) & (ln >= least) & (tn - ln >= least)
    rated = sides.withColumn("gain", F.when(fair, gain))
    split = F.when(F.col("gain") > 1e-9, F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "lg", "lh"))
    return rated.groupBy("model", "node", (F.col("feature") < 0).alias("check")).agg(
        F.max(split).alias("split"), F.max("tg").alias("tg"), F.max("th").alias("th")
    )


@dataclass
class Boosted:
    """Fitted models: ``models`` has the value of the model column per model, or is [None] for one model."""

    loss: Loss
    edges: list[np.ndarray]
    trees: list[Forest]
    start: np.ndarray
    best: np.ndarray
    models: list

    def score(self, df: DataFrame, features: str, name: str, by: str | None = None) -> DataFrame:
        """Add the predicted mean; NULL for a model that was not trained or a row without features."""
        start, best, trees, edges, mean = self.start, self.best, self.trees, self.edges, self.loss.mean

        @F.pandas_udf("double")
        def predict(x: pd.Series, model: pd.Series) -> pd.Series:
            out = np.full(len(x), np.nan)
            known = (x.notna() & model.notna()).to_numpy()
            if known.any():
                bins = digitize(np.stack(x[known].to_numpy()), edges)
                m = model[known].to_numpy().astype(np.int64)
                margin = start[m]
                for r, t in enumerate(trees):
                    margin = margin + np.where(r < best[m], t.value[m, t.node_of(m, bins)], 0.0)
                out[known] = mean(margin)
            return pd.Series(out)

        coded = _with_model(df, by, self.models)
        found = F.nullif(predict(F.col(features), F.col("_model")), F.lit(float("nan")))
        return coded.withColumn(name, found).drop("_model")


def digitize(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of edges below it, so a value equal to an edge lies left of it. NaN is least."""
    x = np.where(np.isnan(x), -np.inf, x)
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def _with_model(df: DataFrame, by: str | None, models: list) -> DataFrame:
    if by is None:
        return df.withColumn("_model", F.lit(0))
    if not models:
        return df.withColumn("_model", F.lit(None).cast("int"))
    table = df.sparkSession.createDataFrame(
        [(k, i) for i, k in enumerate(models)], f"_by {df.schema[by].dataType.simpleString()}, _model int"
    )
    return df.join(F.broadcast(table), df[by] == table["_by"], "left").drop("_by")


def _edges(df: DataFrame, features: str, width: int, bins: int) -> list[np.ndarray]:
    shares = [(i + 1) / bins for i in range(bins - 1)]
    one = df.agg(*[F.percentile_approx(F.col(features)[i], shares, 10_000).alias(f"e{i}") for i in range(width)]).first()
    return [np.unique(np.array(one[f"e{i}"] or [], float)) for i in range(width)]


def fit(
    df: DataFrame,
    features: str,
    label: str,
    loss: Loss,
    rounds: int = 100,
    depth: int = 4,
    step: float = 0.1,
    bins: int = 64,
    least: int = 20,
    shrink: float = 1.0,
    weight: str | None = None,
    validation: str | None = None,
    patience: int = 10,
    by: str | None = None,
) -> Boosted:
    """Boosted trees on an array column of numbers, one model per value of ``by``.

    A model stops growing when ``patience`` trees have not lowered its loss on its validation
    rows and keeps its best number of trees; one without validation rows keeps all. Rows
    without features, label or model take no part; NULL or NaN in an array is the least value.
    A model needs training rows. The number of models, not that of the rows, bounds what the
    driver holds.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    valid = F.coalesce(F.col(validation).cast("boolean"), F.lit(False)) if validation else F.lit(False)
    clean = F.transform(F.col(features), lambda v: F.nanvl(F.coalesce(v.cast("double"), F.lit(float("-inf"))), F.lit(float("-inf"))))
    used = df.select(
        *([F.col(by).alias("by")] if by else []),
        clean.alias("x"),
        F.col(label).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        valid.alias("valid"),
    ).dropna(subset=["x", "y", "w", *(["by"] if by else [])])
    used = durable(used)
    train = used.filter("not valid")
    total = F.sum(F.col("w") * F.col("y")) / F.sum("w")
    means = train.groupBy(*(["by"] if by else [])).agg(total.alias("mean"), F.max(F.size("x")).alias("width")).collect()
    means = sorted((r for r in means if r["mean"] is not None), key=lambda r: r["by"] if by else 0)
    models = [r["by"] if by else None for r in means]
    start = np.array([loss.start(r["mean"]) for r in means])
    count = len(models)
    if not count:
        return Boosted(loss, [], [], start, np.zeros(0, int), models)
    width = means[0]["width"]
    edges = _edges(train, "x", width, bins)

    def bin_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                codes = digitize(np.stack(pdf["x"].to_numpy()), edges)
                yield pd.DataFrame({
                    "model": pdf["_model"], "bins": [c.tobytes() for c in codes], "y": pdf["y"], "w": pdf["w"],
                    "valid": pdf["valid"], "margin": start[pdf["_model"].to_numpy()],
                })

    schema = "model int, bins binary, y double, w double, valid boolean, margin double"
    coded = _with_model(used, "by" if by else None, models).filter("_model is not null")
    rows = durable_even(coded.mapInPandas(bin_up, schema))

    trees: list[Forest] = []
    fresh: list[Forest] = []  # not yet in the written margins
    best, low = np.full(count, rounds), np.full(count, np.inf)
    waited, alive = np.zeros(count, int), np.ones(count, bool)
    for r in range(rounds + 1):
        growing = Forest.empty(count, depth)
        for level in range(depth):
            cells = rows.mapInPandas(_sums(fresh, growing, level, width, bins, loss), _CELLS)
            found = _best_splits(cells, shrink, least).collect()
            if level == 0:
                for c in (c for c in found if c["check"]):
                    m = c["model"]
                    if alive[m] and c["tg"] < low[m]:
                        low[m], best[m], waited[m] = c["tg"], r, 0
                    elif alive[m]:
                        waited[m] += 1
                        alive[m] = waited[m] < patience
                if r == rounds or not alive.any():
                    break
            grown = False
            for c in (c for c in found if not c["check"] and alive[c["model"]] and c["split"] is not None):
                m, node, s = c["model"], c["node"], c["split"]
                growing.feature[m, node], growing.cut[m, node] = -s["f"], -s["b"]
                for child, g, h in ((1, s["lg"], s["lh"]), (2, c["tg"] - s["lg"], c["th"] - s["lh"])):
                    growing.value[m, 2 * node + child] = -step * (g / UNIT) / (h / UNIT + shrink)
                grown = True
            if not grown:
                break
        if r == rounds or not alive.any() or not (growing.feature >= 0).any():
            break
        trees.append(growing)
        fresh.append(growing)
        if len(fresh) == KEEP:
            rows = durable(rows.mapInPandas(_add_margins(fresh, width), schema))
            fresh = []
    return Boosted(loss, edges, trees, start, best, models)


__all__ = ["Boosted", "LOGISTIC", "Loss", "SQUARED", "digitize", "fit", "tweedie"]
