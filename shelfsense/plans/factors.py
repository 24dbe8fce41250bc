"""Matrix factors of the interaction scores and top-k scoring of every user."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.operators import ordered
from shelfsense.operators.blocks import as_vectors, cells_of, gathered, read_block, vectors, whole_block, write_blocks
from shelfsense.session import durable, durable_path

USER, ITEM = "customer_id", "product_id"
ALPHA = 0.8


@dataclass
class Factors:
    """``users``: customer_id, f (already scaled); ``items``: product_id, f; singular values."""

    users: DataFrame
    items: DataFrame
    values: list[float]


#: Rows of either side of the matrix that a task holds at once.
MATRIX_ROWS = 200_000
_DENSE = "n long, x array<double>"


@dataclass
class _Side:
    """Rows of one side, numbered from 0: a folder of names by block, how many blocks there are, and rows in each."""

    key: str
    numbered: DataFrame
    names: str
    blocks: int
    height: int
    #: Number of the row without an id, which takes sums but gives none; -1 if there is none.
    nameless: int


@dataclass
class _Matrix:
    """Vectors of a side, a folder by block, to be multiplied by ``m`` when read."""

    side: _Side
    path: str
    m: np.ndarray


def _side(scores: DataFrame, key: str) -> _Side:
    spark = scores.sparkSession
    numbered = ordered.row_number(scores.select(key).distinct(), [], [key], "_n")
    numbered = durable(numbered.select(key, (F.col("_n") - 1).alias("n")))
    total = numbered.count()
    nameless = numbered.filter(F.col(key).isNull()).first()
    height = min(MATRIX_ROWS, max(1_000, -(-total // spark.sparkContext.defaultParallelism)))
    blocks = max(1, -(-total // height))
    return _Side(key, numbered, write_blocks(numbered.withColumn("b", F.floor(F.col("n") / height).cast("int")), "b"), blocks, height, -1 if nameless is None else nameless["n"])


def _per_block(spark, blocks: int, run, schema: str) -> DataFrame:
    """``run(block)``, an iterator of record batches, in a task per block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                yield from run(block)

    return spark.range(0, blocks, 1, blocks).mapInArrow(each, schema)


def _dense_block(v: _Matrix, block: int) -> np.ndarray:
    """The rows of one block, times the matrix's ``m``."""
    out = np.zeros((v.side.height, v.m.shape[1]))
    for batch in read_block(v.path, ["n", "x"], b=block):
        out[batch.column("n").to_numpy() - block * v.side.height] = vectors(batch.column("x")) @ v.m
    return out


def _written(spark, side: _Side, k: int, rows) -> _Matrix:
    """Vectors of a side from ``rows(block)``: numbers and vectors of a block's rows."""

    def run(block: int) -> Iterator[pa.RecordBatch]:
        n, x = rows(block)
        for at in range(0, len(n), 10_000):
            part = x[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(n[at : at + 10_000], pa.int64()), as_vectors(part), pa.array(np.full(len(part), block, dtype=np.int32))], ["n", "x", "b"])

    path = durable_path(spark)
    # A task's rows are of one block, so each folder gets one file and nothing is shuffled.
    _per_block(spark, side.blocks, run, f"{_DENSE}, b int").write.partitionBy("b").parquet(path)
    return _Matrix(side, path, np.eye(k))


def _product(spark, cells: str, v: _Matrix, to: _Side) -> _Matrix:
    """Sparse times dense: a task has a block of the result and walks the blocks of ``v`` and the cells between."""
    # Plain values, as a task cannot take a data frame along.
    source, k = _Matrix(_Side(v.side.key, None, "", v.side.blocks, v.side.height, v.side.nameless), v.path, v.m), v.m.shape[1]
    high, mine, theirs = to.height, to.key, v.side.key

    def rows(block: int) -> tuple[np.ndarray, np.ndarray]:
        out, met = np.zeros((high, k)), np.zeros(high, dtype=bool)
        for other in range(source.side.blocks):
            x = None
            for batch in read_block(cells, [f"{mine}_n", f"{theirs}_n", "score"], **{f"{USER}_b": block if mine == USER else other, f"{ITEM}_b": block if mine == ITEM else other}):
                x = _dense_block(source, other) if x is None else x
                if source.side.nameless >= 0:
                    batch = batch.filter(pc.not_equal(batch.column(1), source.side.nameless))
                    if not batch.num_rows:
                        continue
                t = batch.column(0).to_numpy() - block * high
                order = np.argsort(t, kind="stable")
                t = t[order]
                first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                terms = x[batch.column(1).to_numpy()[order] - other * source.side.height] * batch.column(2).to_numpy()[order][:, None]
                out[t[first]] += np.add.reduceat(terms, first, axis=0)
                met[t[first]] = True
        n = np.flatnonzero(met)
        return n + block * high, out[n]

    return _written(spark, to, k, rows)


def _gram(spark, v: _Matrix) -> np.ndarray:
    """The k x k matrix of column dot products, summed per block and then over blocks."""
    k, path = v.m.shape[1], v.path

    def run(block: int) -> Iterator[pa.RecordBatch]:
        g = np.zeros((k, k))
        for batch in read_block(path, ["x"], b=block):
            x = vectors(batch.column("x"))
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k)), pa.array(np.tile(np.arange(k), k)), pa.array(g.ravel())], ["i", "j", "v"])

    out = np.zeros((k, k))
    for r in _per_block(spark, v.side.blocks, run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # k * k rows
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2.0


def _orthonormal(spark, v: _Matrix) -> _Matrix:
    lam, q = np.linalg.eigh(_gram(spark, v))
    top = max(float(lam.max()), 1e-300)
    scale = np.where(lam > top * 1e-12, 1.0 / np.sqrt(np.maximum(lam, top * 1e-12)), 0.0)
    return _Matrix(v.side, v.path, v.m @ (q * scale[None, :]))


def _named(spark, v: _Matrix) -> DataFrame:
    """Vectors by name instead of number."""
    key, path, names, m, height = v.side.key, v.path, v.side.names, v.m, v.side.height

    def run(block: int) -> Iterator[pa.RecordBatch]:
        held = whole_block(names, [key, "n"], b=block)
        if held is not None:
            named = np.empty(height, dtype=object)
            named[held.column("n").to_numpy() - block * height] = held.column(key).to_numpy()
            for batch in read_block(path, ["n", "x"], b=block):
                part = named[batch.column("n").to_numpy() - block * height]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), as_vectors(vectors(batch.column("x")) @ m)], [key, "f"])

    return _per_block(spark, v.side.blocks, run, f"{key} string, f array<double>")


def truncated_svd(scores: DataFrame, rank: int, extra: int = 10, rounds: int = 5, seed: int = 42) -> Factors:
    """Leading singular triplets of the (customer, product, score) matrix by subspace iteration.

    Both sides are numbered and cut into blocks, and the cells are shuffled once into the grid of these. A
    product is a pass of a task per block of its result over the written blocks of the other side, so what a
    round writes are the vectors of both sides alone; only k x k matrices reach the driver.
    """
    spark = scores.sparkSession
    scores = durable(scores.select(USER, ITEM, F.col("score").cast("double").alias("score")))
    users, items = _side(scores, USER), _side(scores, ITEM)
    k = rank + extra
    if scores.isEmpty():
        none = scores.select(USER, ITEM, F.array().cast("array<double>").alias("f"))
        return Factors(none.select(USER, "f"), none.select(ITEM, "f"), [])
    cells = scores
    for side in (users, items):
        n = F.col(f"{side.key}_n")
        named = side.numbered.select(F.col(side.key).alias("_key"), F.col("n").alias(f"{side.key}_n"))
        cells = cells.join(named, F.col(side.key).eqNullSafe(F.col("_key"))).drop(side.key, "_key").withColumn(f"{side.key}_b", F.floor(n / side.height).cast("int"))
    cells = write_blocks(cells, f"{USER}_b", f"{ITEM}_b")
    start = F.array(*[(F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col(ITEM)), F.lit(2)) * 2 - 1).cast("double") for i in range(k)])
    begun = items.numbered.select("n", start.alias("x"), F.floor(F.col("n") / items.height).cast("int").alias("b"))
    v = _orthonormal(spark, _Matrix(items, write_blocks(begun, "b"), np.eye(k)))
    for _ in range(rounds):
        v = _orthonormal(spark, _product(spark, cells, _product(spark, cells, v, users), items))
    b = _product(spark, cells, v, users)
    lam, w = np.linalg.eigh(_gram(spark, b))
    order = np.argsort(lam)[::-1][:rank]
    order = order[lam[order] > max(float(lam.max()), 1e-300) * 1e-12]
    w = w[:, order]
    values = np.sqrt(np.maximum(lam[order], 0.0))
    # Rows of B W are the left vectors times the singular values.
    vectors_of = lambda x: durable(_named(spark, _Matrix(x.side, x.path, x.m @ w)))
    return Factors(vectors_of(b), vectors_of(v), [float(x) for x in values])


def spectrum(values: Sequence[float], spark) -> DataFrame:
    """Singular values with the cumulative share of their squares (among the kept ones)."""
    total, run, rows = sum(v * v for v in values), 0.0, []
    for i, v in enumerate(values):
        run += v * v
        rows.append((i + 1, v, run / total))
    return spark.createDataFrame(rows, "component int, singular_value double, cumulative_share double")


# --- scoring -----------------------------------------------------------------------------

#: Items per block (ordered by falling norm) and users of a task that walk the blocks together.
BLOCK_ITEMS, BLOCK_USERS = 5_000, 20_000
#: Blocks of items whose sets of features make a block of these.
_ITEM_BLOCKS = 10
# Scores of a task computed at once, and those looked through at once in single precision.
_CELLS, _SCREENED = 4_000_000, 1_000_000
# Shares of the cells left by a look in single precision: content products are looked at too from the first on, and from
# the second on matrix products score all cells.
_FEW, _MANY = 1 / 200, 1 / 16


def prefix(factors: Factors, rank: int) -> Factors:
    """The factors of a smaller rank: components come in order of their singular value."""
    cut = lambda df: df.withColumn("f", F.slice("f", 1, rank))
    return Factors(cut(factors.users), cut(factors.items), factors.values[:rank])


def _as_maps(features: DataFrame, key: str, name: str) -> DataFrame:
    """The features of a row as an array of (key, value); one that comes twice is an error."""
    return features.groupBy(key).agg(F.map_entries(F.map_from_entries(F.collect_list(F.struct("feature", "weight")))).alias(name))


def _item_blocks(factors: Factors, content: DataFrame | None, block_items: int) -> DataFrame:
    """Items with their latent vector, their content features, a number by falling norm, and a block."""
    items = factors.items.withColumn("norm", F.sqrt(F.aggregate("f", F.lit(0.0), lambda a, x: a + x * x)))
    if content is not None:
        items = items.join(_as_maps(content, ITEM, "content"), ITEM, "left")
    else:
        items = items.withColumn("content", F.lit(None).cast("array<struct<key: string, value: double>>"))
    numbered = ordered.row_number(items, [], [F.col("norm").desc(), F.col(ITEM)], "_n")
    idx = F.col("_n") - 1
    return durable(numbered.select(ITEM, "f", "content", "norm", idx.alias("idx"), F.floor(idx / block_items).cast("int").alias("block")))


def _dense(entries: pa.Array | pa.ChunkedArray, index: dict[str, int]) -> np.ndarray:
    """Arrays of (key, value) as rows of a matrix; keys outside ``index`` are left out."""
    if isinstance(entries, pa.ChunkedArray):
        entries = entries.combine_chunks()
    out = np.zeros((len(entries), len(index)))
    flat = entries.flatten()
    if len(flat):
        row = np.repeat(np.arange(len(entries)), pc.fill_null(pc.list_value_length(entries), 0).to_numpy(zero_copy_only=False))
        coded = flat.field(0).dictionary_encode()
        place = np.array([index.get(n, -1) for n in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
        held = place >= 0
        out[row[held], place[held]] = pc.fill_null(flat.field(1), 0.0).to_numpy(zero_copy_only=False)[held]
    return out


def _features(entries: pa.ChunkedArray) -> dict[str, int]:
    return {n: j for j, n in enumerate(pc.unique(entries.combine_chunks().flatten().field(0)).to_pylist())}


class _Kinds:
    """Distinct sets of features, each cut into two halves, of which there are far fewer than of their pairs."""

    def __init__(self, held: pa.Table, index: dict[str, int]):
        self.parts, codes = [], []
        for half in ("head", "tail"):
            code = pc.dictionary_encode(held.column(f"{half}_key").combine_chunks()).indices.to_numpy()
            self.parts.append(_dense(held.column(half).combine_chunks().take(pa.array(np.unique(code, return_index=True)[1])), index))
            codes.append(code)
        order = np.argsort(codes[0], kind="stable")
        #: The tails that come with the head ``h`` are those from ``starts[h]`` to ``starts[h + 1]``.
        self.tails = codes[1][order]
        self.starts = np.searchsorted(codes[0][order], np.arange(len(self.parts[0]) + 1))

    def best(self, head: np.ndarray, tail: np.ndarray, users: np.ndarray, h: np.ndarray, best: np.ndarray) -> None:
        """Raise ``best`` of ``users`` by the sets whose head is ``h``, given the scores of heads and tails."""
        counts = self.starts[h + 1] - self.starts[h]
        ends = np.cumsum(counts)
        at = 0
        while at < len(h):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CELLS)))
            n, own = counts[at:to], users[at:to]
            first = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(first - self.starts[h[at:to]], n)
            found = np.maximum.reduceat(tail[np.repeat(own, n), self.tails[place]], first)
            np.maximum.at(best, own, head[own, h[at:to]] + found)
            at = to


def _below(x: np.ndarray) -> np.ndarray:
    """Single-precision values that are not above those of ``x``."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


class _Users:
    """Users of a task: latent vectors, content profiles, seen items, score bounds and the lists so far."""

    def __init__(self, own: pa.Table, hybrid: bool, k: int, lists: int):
        self.names, self.k = own.column(USER).to_pylist(), k
        n = len(self.names)
        self.latent = vectors(own.column("f"))
        self.latent32 = self.latent.astype(np.float32)
        self.norm = np.sqrt(np.square(self.latent).sum(axis=1))
        self.index = _features(own.column("profile")) if hybrid else {}
        self.profile = _dense(own.column("profile"), self.index) if hybrid else None
        had = own.column("seen").combine_chunks()
        items = had.flatten().to_numpy(zero_copy_only=False)
        holders = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(had), 0).to_numpy(zero_copy_only=False))
        order = np.lexsort((holders, items))
        self._items, self._holders = items[order], holders[order]
        self.low, self.high = np.full(n, np.inf), np.full(n, -np.inf)
        self.least, self.most = np.zeros(n), np.zeros(n)
        self.score = np.full((lists, n, k), -np.inf)
        self.item = np.full((lists, n, k), "", dtype=object)

    def slices(self, block: _Block, rows: np.ndarray, cells: int = _CELLS):
        """The users at ``rows``, some at a time, and where among them and the block's items are those they have seen."""
        a, b = np.searchsorted(self._items, [block.first, block.first + len(block.names)])
        holders, places = self._holders[a:b], block.place[self._items[a:b] - block.first]
        order = np.argsort(holders, kind="stable")
        holders, places = holders[order], places[order]
        step = max(1, cells // len(block.names))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            i, j = np.searchsorted(holders, [part[0], part[-1] + 1])
            where = np.searchsorted(part, holders[i:j])
            real = part[np.minimum(where, len(part) - 1)] == holders[i:j]
            yield part, (where[real], places[i:j][real])

    def bounds(self, block: _Block, rows: np.ndarray, masked: bool) -> None:
        """Widen the latent bounds of the users at ``rows`` by a block; ``masked`` leaves out what they have seen.

        Single precision finds the few cells that may be a user's least or most; these are computed in double.
        """
        slack = self.slack(self.latent.shape[1], self.norm, block.norm)
        for part, seen in self.slices(block, rows, _SCREENED):
            rough = self.latent32[part] @ block.latent32.T
            gap = slack[part]
            for bound, better, way in ((self.high, np.maximum, 1), (self.low, np.minimum, -1)):
                if masked:
                    rough[seen] = -way * np.inf
                best = way * (rough.max(axis=1) if way > 0 else rough.min(axis=1))
                able = np.flatnonzero((best + gap >= way * bound[part]) & (best > -np.inf))
                least = np.maximum(best[able] - 2 * gap[able], way * bound[part[able]] - gap[able])
                r, c = cells_of(way * rough[able] >= _below(least)[:, None])
                to = part[able[r]]
                better.at(bound, to, self.latent_of(to, block, c))

    def content_bounds(self, kinds: _Kinds) -> None:
        """Widen the content bounds by some sets of features.

        A set scores its head's score and its tail's. Only heads that with the best tail of all would pass a user's
        bound are looked at with their own tails.
        """
        step = max(1, _CELLS // sum(map(len, kinds.parts)))
        for at in range(0, len(self.names), step):
            head, tail = (self.profile[at : at + step] @ part.T for part in kinds.parts)
            every = np.arange(len(head))
            for bound, way in ((self.most, 1), (self.least, -1)):
                if way < 0:
                    head, tail = -head, -tail
                best = way * bound[at : at + step]
                kinds.best(head, tail, every, head.argmax(axis=1), best)
                kinds.best(head, tail, *cells_of(head + tail.max(axis=1)[:, None] > best[:, None]), best)
                bound[at : at + step] = way * best

    @staticmethod
    def slack(width: int, mine: np.ndarray, theirs: float) -> np.ndarray:
        """How far a dot product of ``width`` terms may be off in single precision, given the norms of both sides."""
        return (width + 8) * 2.0**-23 * mine * theirs + 1e-30

    def latent_of(self, users: np.ndarray, block: _Block, items: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.latent[users], block.latent[items])

    def mixed_of(self, users: np.ndarray, block: _Block, items: np.ndarray) -> np.ndarray | None:
        """Content scores of some cells."""
        if self.profile is None:
            return None
        out, step = np.empty(len(users)), max(1, _CELLS // max(1, self.profile.shape[1]))
        for at in range(0, len(users), step):
            some = slice(at, at + step)
            out[some] = np.einsum("ij,ij->i", self.profile[users[some]], block.content[items[some]])
        return out

    def blended(self, users: np.ndarray, latent: np.ndarray, mixed: np.ndarray | None, share: float) -> np.ndarray:
        """Scores of cells whose users are ``users``, which has the shape of the others or broadcasts to it."""
        # The last digits of a product depend on the shapes of its matrices.
        if mixed is None:
            return np.round(latent, 10)
        a, b, c, d = (x[users] for x in (self.low, self.high, self.least, self.most))
        return np.round(share * (latent - a) / (b - a + 1e-9) + (1 - share) * (mixed - c) / (d - c + 1e-9), 10)

    def score_all(self, list_: int, block: _Block, rows: np.ndarray, share: float) -> None:
        """Score every cell of the users at ``rows``."""
        for part, seen in self.slices(block, rows):
            self.score_part(list_, block, part, seen, share)

    def score_part(self, list_: int, block: _Block, part: np.ndarray, seen: tuple[np.ndarray, np.ndarray], share: float) -> None:
        mixed = None if self.profile is None else self.profile[part] @ block.content.T
        score = self.blended(part[:, None], self.latent[part] @ block.latent.T, mixed, share)
        score[seen] = -np.inf
        self.merge(list_, part, score, block.names)

    def score_some(self, list_: int, block: _Block, rows: np.ndarray, share: float) -> None:
        """Score the cells that may reach the full lists of the users at ``rows``.

        Single precision tells which: the latent products alone where the best content score would not make up for
        the rest, else latent and content products together.
        """
        kth = self.score[list_, :, self.k - 1]
        kth = kth - 1e-9 * (1 + np.abs(kth))
        hybrid, width = self.profile is not None, self.latent.shape[1]
        cut = kth
        if hybrid:
            # Users without a full list have no bounds yet where they have seen all items; they are not among ``rows``.
            with np.errstate(all="ignore"):
                spread, mixing = self.high - self.low + 1e-9, self.most - self.least + 1e-9
                cut = self.low + (kth - max(0.0, 1 - share)) * spread / share if share > 0 else np.full(len(kth), -np.inf)
        cut = cut - self.slack(width, self.norm, block.norm)
        for part, seen in self.slices(block, rows, _SCREENED):
            rough = self.latent32[part] @ block.latent32.T
            able = rough >= _below(cut[part])[:, None]
            able[seen] = False
            if hybrid and np.count_nonzero(able) > able.size * _FEW:
                left, right = share / spread[part], (1 - share) / mixing[part]
                rough *= left.astype(np.float32)[:, None]
                mine = self.profile[part]
                rough += (mine * right[:, None]).astype(np.float32) @ block.content32.T
                off = self.slack(width, abs(left) * self.norm[part], block.norm) + self.slack(mine.shape[1], abs(right) * np.sqrt(np.square(mine).sum(axis=1)), block.content_norm)
                base = left * self.low[part] + right * self.least[part]
                able &= rough >= _below(kth[part] + base - 2 * off)[:, None]
            left_over = np.count_nonzero(able)
            if left_over > able.size * _MANY:
                self.score_part(list_, block, part, seen, share)
            elif left_over:
                r, c = cells_of(able)
                users = part[r]
                score = self.blended(users, self.latent_of(users, block, c), self.mixed_of(users, block, c), share)
                self.insert(list_, part, r, c, score, block.names)

    def merge(self, list_: int, part: np.ndarray, score: np.ndarray, names: np.ndarray) -> None:
        """Put the best of a block's items, which come in order of their names, into the lists."""
        k, top = self.k, min(self.k, score.shape[1])
        level = self.score[list_, part, k - 1]
        new = np.flatnonzero(np.isneginf(level))
        if len(new):
            level[new] = np.partition(score[new], score.shape[1] - top, axis=1)[:, score.shape[1] - top]
        r, c = np.nonzero((score >= level[:, None]) & (score > -np.inf))
        self.insert(list_, part, r, c, score[r, c], names)

    def insert(self, list_: int, part: np.ndarray, r: np.ndarray, c: np.ndarray, score: np.ndarray, names: np.ndarray) -> None:
        """Put the items at ``c`` into the lists of the users ``part[r]``, where their scores reach."""
        k = self.k
        reach = score >= self.score[list_, part[r], k - 1]
        r, c, score = r[reach], c[reach], score[reach]
        if not len(r):
            return
        hit = np.unique(r)
        old = self.score[list_, part[hit]] > -np.inf
        s = np.r_[self.score[list_, part[hit]][old], score]
        name = np.r_[self.item[list_, part[hit]][old], names[c]]
        row = np.r_[np.nonzero(old)[0], np.searchsorted(hit, r)]
        order = np.lexsort((np.unique(name, return_inverse=True)[1], -s, row))
        row, s, name = row[order], s[order], name[order]
        at = np.arange(len(row)) - np.searchsorted(row, row)
        keep = at < k
        to = part[hit[row[keep]]]
        self.score[list_, to, at[keep]], self.item[list_, to, at[keep]] = s[keep], name[keep]

    def batches(self, alphas: Sequence[float]) -> Iterator[pa.RecordBatch]:
        for s, share in enumerate(alphas):
            i, j = np.nonzero(self.score[s] > -np.inf)
            for at in range(0, len(i), 100_000):
                a, b = i[at : at + 100_000], j[at : at + 100_000]
                columns = [pa.array([self.names[x] for x in a], pa.string()), pa.array([x[1:] if x else None for x in self.item[s, a, b]], pa.string()), pa.array(self.score[s, a, b]), pa.array(np.full(len(a), share)), pa.array((b + 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [USER, ITEM, "score", "alpha", "rank"])


class _Block:
    """A block of items inside a task, in product id order."""

    def __init__(self, items: pa.Table, users: _Users, first: int):
        # An item without an id comes first.
        names = np.array(["" if n is None else f"={n}" for n in items.column(ITEM).to_pylist()], dtype=object)
        order = np.argsort(names, kind="stable")
        self.first, self.names = first, names[order]
        self.latent = vectors(items.column("f"))[order]
        self.latent32 = self.latent.astype(np.float32)
        self.norm = float(np.sqrt(np.square(self.latent).sum(axis=1)).max())
        self.content = self.content32 = None
        if users.profile is not None:
            self.content = _dense(items.column("content"), users.index)[order]
            self.content32 = self.content.astype(np.float32)
            self.content_norm = float(np.sqrt(np.square(self.content).sum(axis=1)).max())
        #: Where the item with a number of the block stands.
        self.place = np.empty(len(names), dtype=np.int64)
        self.place[items.column("idx").to_numpy()[order] - first] = np.arange(len(names))


def recommend_all(
    factors: Factors,
    seen: DataFrame,
    k: int = 10,
    content: DataFrame | None = None,
    profiles: DataFrame | None = None,
    alpha: float | Sequence[float] = ALPHA,
    mask_before_scaling: bool = False,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Top-k unseen items of every user with factors: (customer_id, product_id, score, rank).

    With content the latent and the content score are scaled to 0..1 per user and blended by ``alpha``;
    several alphas are served by the same scoring and come with a column ``alpha``.
    ``mask_before_scaling`` leaves seen items out of the latent bounds (single-user form).

    A join of largest inner products: items lie in written blocks by falling norm, and up to ``BLOCK_USERS``
    users walk these together in a task, each as far as a block's largest norm may still beat the user's
    k-th score. Of a block, single precision finds the cells that may reach a full list, with its error bound;
    only these are scored, in double. A user is in one row and one task, and no row is sent to blocks. Content bounds need one
    look at each half of the distinct sets of features. Equal scores go by product id.
    """
    many = not isinstance(alpha, (int, float))
    alphas = [float(a) for a in alpha] if many else [float(alpha)]
    hybrid = content is not None and profiles is not None and min(alphas) < 1.0
    items = _item_blocks(factors, content if hybrid else None, block_items)
    # A row per block of items.
    norms = [r["norm"] for r in items.groupBy("block").agg(F.max("norm").alias("norm")).orderBy("block").collect()]
    if not norms:
        return factors.users.select(USER, F.lit("").alias(ITEM), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    had = seen.select(USER, ITEM).join(items.select(ITEM, "idx"), ITEM).groupBy(USER).agg(F.collect_set("idx").alias("seen"))
    users = factors.users.select(USER, "f").join(had, USER, "left")
    if hybrid:
        users = users.filter(F.col(USER).isNotNull()).join(_as_maps(profiles, USER, "profile"), USER, "left")
    else:
        users = users.withColumn("profile", F.lit(None).cast("array<struct<key: string, value: double>>"))
    users = durable(users.select(USER, "f", "profile", "seen"))

    shelf = write_blocks(items.drop("norm"), "block")
    kinds, kind_blocks = None, 0
    if hybrid:
        # An item without content is a kind of its own: its content score is 0.
        kind = items.select(F.array_sort(F.coalesce("content", F.array().cast(items.schema["content"].dataType))).alias("c")).distinct()
        half = F.ceil(F.size("c") / 2).cast("int")
        halves = kind.select(F.slice("c", F.lit(1), half).alias("head"), F.slice("c", half + 1, F.size("c")).alias("tail"))
        kind_blocks = -(-len(norms) // _ITEM_BLOCKS)
        place = F.pmod(F.xxhash64("head"), F.lit(kind_blocks)).cast("int")
        kinds = write_blocks(halves.select("*", F.to_json("head").alias("head_key"), F.to_json("tail").alias("tail_key"), place.alias("block")), "block")
    most = BLOCK_USERS

    def read(own: _Users, block: int) -> _Block:
        return _Block(whole_block(shelf, [ITEM, "f", "content", "idx"], block=block), own, block * block_items)

    def settle_bounds(own: _Users) -> None:
        every = np.arange(len(own.names))
        for block, norm in enumerate(norms):
            # Later items have smaller norms; rounding must not hide one that just reaches.
            reach = own.norm * norm * (1 + 1e-9)
            rows = every[(own.high < reach) | (own.low > -reach)]
            if not len(rows):
                break
            own.bounds(read(own, block), rows, mask_before_scaling)
        own.least[:], own.most[:] = np.inf, -np.inf
        for block in range(kind_blocks):
            held = whole_block(kinds, ["head", "tail", "head_key", "tail_key"], block=block)
            if held is not None:
                own.content_bounds(_Kinds(held, own.index))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, most):
            own = _Users(table, hybrid, k, len(alphas))
            if hybrid:
                settle_bounds(own)
            for block, norm in enumerate(norms):
                need = np.zeros((len(alphas), len(own.names)), dtype=bool)
                for s, share in enumerate(alphas):
                    high = own.norm * norm
                    if hybrid:
                        high = share * (high - own.low) / (own.high - own.low + 1e-9) + (1 - share)
                    kth = own.score[s, :, k - 1]
                    # Rounding must not hide a block that just reaches.
                    need[s] = (high >= kth - 1e-9 * (1 + np.abs(kth))) | np.isneginf(kth)
                rows = np.flatnonzero(need.any(axis=0))
                if not len(rows):
                    break
                held = read(own, block)
                for s, share in enumerate(alphas):
                    full = own.score[s, :, k - 1] > -np.inf
                    own.score_all(s, held, np.flatnonzero(need[s] & ~full), share)
                    own.score_some(s, held, np.flatnonzero(need[s] & full), share)
            yield from own.batches(alphas)

    total = users.count()
    parts = max(1, -(-total // most), min(users.sparkSession.sparkContext.defaultParallelism, -(-total // 200)))
    schema = f"{USER} string, {ITEM} string, score double, alpha double, rank int"
    ranked = users.repartition(parts, USER).mapInArrow(walk, schema)
    return ranked if many else ranked.drop("alpha")


def recommend_user(
    factors: Factors, user: str, seen: DataFrame, k: int = 10, content: DataFrame | None = None, profiles: DataFrame | None = None, alpha: float = ALPHA
) -> DataFrame:
    """The list of one user, with seen items left out before scaling: (product_id, score, rank).

    Without anything seen, or at alpha 1, the plain latent scores count.
    """
    one = Factors(factors.users.filter(F.col(USER) == user), factors.items, factors.values)
    mine = seen.filter(F.col(USER) == user)
    if mine.isEmpty():
        content = profiles = None
    own = None if profiles is None else profiles.filter(F.col(USER) == user)
    return recommend_all(one, mine, k, content, own, alpha, mask_before_scaling=True).drop(USER)


def user_scores(factors: Factors, user: str, seen: DataFrame | None = None) -> DataFrame:
    """Latent score of every item for one user (linear in the catalogue); null where the user has seen it."""
    one = factors.users.filter(F.col(USER) == user).select(F.col("f").alias("uf"))
    rows = factors.items.withColumn("uf", one.scalar())
    dot = F.aggregate(F.zip_with("f", "uf", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = rows.select(ITEM, dot.alias("score"))
    if seen is None:
        return scored
    had = seen.filter(F.col(USER) == user).select(ITEM, F.lit(True).alias("had")).distinct()
    return scored.join(had, ITEM, "left").select(ITEM, F.when(F.col("had").isNull(), F.col("score")).alias("score"))
