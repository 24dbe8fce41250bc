"""Ranked lexical search over K2-treaps of the term-document grid.

Documents are indexed in blocks, each a grid with a row per term and a column per document, in
ascending doc_id. A cell holds the impact of its term in its document, the part of a score that does
not depend on the query. The grid is cut into square bands of rows, each a compressed quadtree: a
node is four bits that tell which of its quadrants are not empty, plus the largest impact in it
(kept as the difference to its parent's); children are found by rank over the bits. Nodes
are laid out level by level.

A query's terms are rows. Their paths descend together over ranges of documents: a range knows for each row the
node that covers both, so the weighted sum of these nodes' maxima bounds the score of each document
in the range. Ranges with the highest bounds are halved first, some at a time; at single documents
the bound is the score. A range that cannot come before the worst of the best found so far is
dropped; tasks carry these from block to block. Results equal those of scoring every document.

The index is one row per block in a written table, a third pass over which answers any number of
queries. Queries are sent to the tasks in blocks of ``ITEM_TERMS`` terms, so neither their number nor
that of the documents bounds what can be asked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.llm.common import Scratch
from shelfsense.llm.tokens import in_slices

TOP = 20
#: A block of documents ends at so many documents or bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 8192, 8_000_000
#: Distinct terms of queries (a term counts once for each item) that are sent to the tasks at a time.
ITEM_TERMS = 500_000
#: Ranges halved at a time, and node numbers that open ranges may hold before the deepest go first.
WIDTH, OPEN_NODES = 64, 1 << 22

_INDEX = "n_docs int, n_terms int, levels int, terms binary, dfs binary, ids binary, nulls binary, bits binary, most binary"
_NO_ID = np.iinfo(np.int64).max

# ASCII letters in lower case and digits stay, other ASCII becomes a blank, bytes of other characters stay.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_BITS = np.array([b.bit_count() for b in range(16)], dtype=np.int64)
# Quadrants of a node that come before quadrant q, by its four bits.
_BEFORE = np.array([[(b & ((1 << q) - 1)).bit_count() for q in range(4)] for b in range(16)], dtype=np.int32)


def _folded(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = (data.slice(offsets[0], offsets[-1] - offsets[0]) if data else pa.py_buffer(b"")).to_pybytes().translate(_FOLD)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data))


def count_terms(texts: pa.Array) -> np.ndarray:
    """Number of terms of each text."""
    folded = _folded(texts)
    offsets = np.frombuffer(folded.buffers()[1], dtype=np.int64)
    inside = np.frombuffer(folded.buffers()[2], dtype=np.uint8) != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts] = inside[starts]
    reached = np.zeros(len(first) + 1, dtype=np.int64)
    np.cumsum(first, out=reached[1:])
    return np.diff(reached[offsets])


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Every term of the texts in order: number of its text, place in the distinct terms, and these."""
    parts = pc.ascii_split_whitespace(_folded(texts))
    coded = pc.dictionary_encode(parts.flatten())  # words beside blanks at an end are empty
    doc = np.repeat(np.arange(len(parts)), np.diff(np.asarray(parts.offsets)))
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:
        real = code != empty
        doc, code = doc[real], code[real]
    return doc, code, coded.dictionary


class Treap:
    """A block's quadtrees; node ``empty`` stands for every quadrant that has nothing in it."""

    def __init__(self, levels: int, bands: int, bits: np.ndarray, most: np.ndarray):
        self.levels, self.bands, self.empty = levels, bands, len(bits)
        self.bits = np.append(bits, 0).astype(np.uint8)
        self.most = np.append(most, 0).astype(np.int64)
        self.first = np.zeros(len(bits) + 1, dtype=np.int32)
        self.first[:-1] = bands + np.concatenate([[0], np.cumsum(_BITS[bits])[:-1]])

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, levels: int) -> Treap:
        """From the grid's cells, of which no two share a place; rows count from 0 without holes."""
        place = rows >> levels
        for j in range(levels - 1, -1, -1):
            place = place << 2 | (rows >> j & 1) << 1 | columns >> j & 1
        order = np.argsort(place)
        place, most = place[order], impacts[order]
        bits, found = np.zeros(len(place), dtype=np.uint8), []
        for _ in range(levels):
            found.append((bits, most))
            parent, child = place >> 2, (1 << (place & 3)).astype(np.uint8)
            heads = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            place, bits, most = parent[heads], np.bitwise_or.reduceat(child, heads), np.maximum.reduceat(most, heads)
        found.append((bits, most))
        return cls(levels, len(place), np.concatenate([b for b, _ in found[::-1]]), np.concatenate([m for _, m in found[::-1]]))

    def pack(self) -> tuple[bytes, bytes]:
        """Bits, two nodes a byte, and maxima as differences to the parents', a byte plane after the other."""
        bits = self.bits[:-1]
        even = np.append(bits, np.zeros(len(bits) % 2, dtype=np.uint8))
        below = self.most[:-1].copy()
        below[self.bands :] = np.repeat(self.most[:-1], _BITS[bits]) - below[self.bands :]
        planes = below.astype("<u4").view(np.uint8).reshape(-1, 4).T
        return zstandard.compress((even[::2] | even[1::2] << 4).tobytes()), zstandard.compress(planes.tobytes())

    @classmethod
    def unpack(cls, levels: int, bands: int, bits: bytes, most: bytes) -> Treap:
        planes = np.frombuffer(zstandard.decompress(most), dtype=np.uint8).reshape(4, -1)
        below = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
        pairs = np.frombuffer(zstandard.decompress(bits), dtype=np.uint8)
        nodes = np.stack([pairs & 15, pairs >> 4], axis=1).ravel()[: len(below)]
        at, end = 0, bands
        while end < len(below):  # level by level, from the parents' maxima
            children = np.repeat(below[at:end], _BITS[nodes[at:end]])
            at, end = end, end + len(children)
            below[at:end] = children - below[at:end]
        return cls(levels, bands, nodes, below)

    def search(self, rows: np.ndarray, weights: np.ndarray, ids: np.ndarray, best: np.ndarray, top: int) -> np.ndarray:
        """The ``top`` best (score, id) of ``best`` and this block's columns, best first, equal scores by id.

        ``best`` and the result have a row each for scores, ids and columns; columns of other blocks are -1.
        """
        low = rows & ((1 << self.levels) - 1)
        nodes = (rows >> self.levels)[None, :].astype(np.int32)
        bound, level, start = self.most[nodes] @ weights, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        while len(bound):
            if best.shape[1] == top:
                worst, last = best[0, -1], best[1, -1]
                alive = (bound > worst) | (bound == worst) & (ids[start << (self.levels - level)] < last)
                bound, level, start, nodes = bound[alive], level[alive], start[alive], nodes[alive]
                if not len(bound):
                    break
            width = max(1, min(WIDTH, OPEN_NODES // (8 * len(rows))))
            if len(bound) <= width:
                go, stay = np.arange(len(bound)), np.zeros(0, dtype=np.int64)
            else:
                first = bound if nodes.size <= OPEN_NODES else level
                chosen = np.argpartition(-first, width)
                go, stay = chosen[:width], chosen[width:]
            own = nodes[go]
            bits, first_child = self.bits[own], self.first[own]
            bit = (low[None, :] >> (self.levels - 1 - level[go])[:, None] & 1) * 2
            new = []
            for side in (0, 1):
                quadrant = bit + side
                child = np.where(bits >> quadrant & 1, first_child + _BEFORE[bits, quadrant], self.empty).astype(np.int32)
                new.append((self.most[child] @ weights, level[go] + 1, start[go] * 2 + side, child))
            more = [np.concatenate(x) for x in zip(*new)]
            some = more[0] > 0
            more = [x[some] for x in more]
            done = more[1] == self.levels
            if done.any():
                columns = more[2][done]
                both = np.concatenate([best, [more[0][done], ids[columns], columns]], axis=1)
                best = both[:, np.lexsort((both[1], -both[0]))[:top]]
                more = [x[~done] for x in more]
            bound, level, start, nodes = (np.concatenate([x[stay], y]) for x, y in zip((bound, level, start, nodes), more))
        return best


def _impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 25 + (25 * lengths * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _index_block(doc_ids: pa.Array, texts: pa.Array, n_docs: int, n_terms: int) -> dict | None:
    order = pc.sort_indices(doc_ids, null_placement="at_end")
    doc_ids, texts = doc_ids.take(order), texts.take(order)
    doc, code, terms = terms_of(texts)
    if not len(doc):
        return None
    lengths = np.bincount(doc, minlength=len(texts))
    cells, tf = np.unique(doc * len(terms) + code, return_counts=True)
    columns, code = cells // len(terms), cells % len(terms)
    df = np.bincount(code, minlength=len(terms))
    # Frequent terms first: the rows of a band have much the same number of cells.
    by_df = np.argsort(-df, kind="stable")[: np.count_nonzero(df)]
    row_of = np.empty(len(terms), dtype=np.int64)
    row_of[by_df] = np.arange(len(by_df))
    levels = max(1, (len(texts) - 1).bit_length())
    treap = Treap.build(row_of[code], columns, _impacts(tf, lengths[columns], n_docs, n_terms), levels)
    bits, most = treap.pack()
    return {
        "n_docs": len(texts),
        "n_terms": len(by_df),
        "levels": levels,
        "terms": zstandard.compress("\n".join(terms.take(pa.array(by_df)).to_pylist()).encode()),
        "dfs": zstandard.compress(df[by_df].astype("<i8").tobytes()),
        "ids": zstandard.compress(doc_ids.fill_null(_NO_ID).to_numpy().astype("<i8").tobytes()),
        "nulls": zstandard.compress(np.packbits(doc_ids.is_null().to_numpy(zero_copy_only=False)).tobytes()),
        "bits": bits,
        "most": most,
    }


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Rows in blocks of bounded size; a longer text is a block of its own."""
    held, docs, size = [], 0, 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(sizes):
            reached = size + np.cumsum(sizes[at : at + BLOCK_DOCS - docs])
            fits = int(np.searchsorted(reached, BLOCK_BYTES, side="right"))
            if not fits and not docs:
                fits = 1
            if fits:
                held.append(batch.slice(at, fits))
                docs, size, at = docs + fits, int(reached[fits - 1]), at + fits
            if docs and (docs >= BLOCK_DOCS or at < len(sizes)):
                yield _joined(held)
                held, docs, size = [], 0, 0
    if docs:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    ids = pa.concat_arrays([b.column(0) for b in batches])
    return ids, pa.concat_arrays([b.column(1).cast(pa.large_string()) for b in batches])


def build_index(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The written index of all documents, a row per block, and the number of documents with a term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for batch in in_slices(batches):
            n = count_terms(batch.column(0))
            docs, terms = docs + np.count_nonzero(n), terms + n.sum()
        yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "terms": pa.array([terms], pa.int64())})

    total = docs.select("text").mapInArrow(counted, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
    schema = pa.schema([(n, pa.int32()) for n in ("n_docs", "n_terms", "levels")] + [(n, pa.binary()) for n in ("terms", "dfs", "ids", "nulls", "bits", "most")])

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            row = _index_block(ids, texts, n_docs, n_terms)
            # The worker lives on, and what its pool keeps would count twice with the next block.
            del ids, texts
            pa.default_memory_pool().release_unused()
            if row:
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scratch.keep(rows.mapInArrow(indexed, _INDEX), "index"), n_docs


def _term_list(packed: bytes) -> pa.Array:
    return pa.array(zstandard.decompress(packed).decode().split("\n"), type=pa.string())


def document_frequencies(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many documents each of the terms occurs; only the blocks' term lists are read."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(terms, pa.string()), np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for listed, dfs in zip(batch.column("terms"), batch.column("dfs")):
                at = pc.index_in(wanted, value_set=_term_list(listed.as_py())).fill_null(-1).to_numpy()
                df = np.append(np.frombuffer(zstandard.decompress(dfs.as_py()), dtype="<i8"), 0)
                total += df[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": pa.array(some, pa.int32()), "df": pa.array(total[some], pa.int64())})

    found = index.select("terms", "dfs").mapInArrow(counted, "place int, df long").groupBy("place").agg(F.sum("df").alias("df"))
    return {terms[r["place"]]: r["df"] for r in found.collect()}


def _wanted(items: DataFrame, scratch: Scratch) -> DataFrame:
    """Terms of the items: item_id, term, how often."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, code, terms = terms_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(doc)), terms.cast(pa.string()).take(pa.array(code))], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return scratch.keep(rows.mapInArrow(split, "item_id long, term string").groupBy("item_id", "term").count(), "wanted")


def search(index: DataFrame, n_docs: int, items: DataFrame, scratch: Scratch, top: int = TOP) -> DataFrame:
    """The ``top`` highest-scoring documents of each item: item_id, rank, doc_id, score."""
    spark = index.sparkSession
    wanted = _wanted(items, scratch)
    item_blocks = max(1, -(-wanted.count() // ITEM_TERMS))
    width = 2 * spark.sparkContext.defaultParallelism
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for k in range(item_blocks):
        own = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(item_blocks)) == k).collect()
        if own:
            df = document_frequencies(index, sorted({r["term"] for r in own}))
            part = index.coalesce(width).mapInArrow(_searcher(own, df, n_docs, top), "item_id long, doc_id long, score long")
            found = found.unionByName(scratch.keep(part, "found"))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _searcher(wanted: list, df: dict[str, int], n_docs: int, top: int):
    terms = sorted(df)
    place = {t: i for i, t in enumerate(terms)}
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms]
    queries: dict[int | None, list[tuple[int, int]]] = {}
    for r in wanted:
        if r["term"] in place and weight[place[r["term"]]] > 0:
            at = place[r["term"]]
            queries.setdefault(r["item_id"], []).append((at, weight[at] * r["count"]))
    queries = {item: np.array(q, dtype=np.int64).T for item, q in queries.items()}

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked, none = pa.array(terms, pa.string()), np.zeros((4, 0), dtype=np.int64)
        best = dict.fromkeys(queries, none)  # score, id, column, whether there is no id
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}
                levels = row["levels"]
                treap = Treap.unpack(levels, -(-row["n_terms"] // (1 << levels)), row["bits"], row["most"])
                at = pc.index_in(looked, value_set=_term_list(row["terms"])).fill_null(-1).to_numpy().astype(np.int64)
                # Columns beyond the last document are empty; a range may still start there.
                ids = np.full(1 << levels, _NO_ID)
                ids[: row["n_docs"]] = np.frombuffer(zstandard.decompress(row["ids"]), dtype="<i8")
                nulls = np.unpackbits(np.frombuffer(zstandard.decompress(row["nulls"]), dtype=np.uint8))
                for item, (places, weights) in queries.items():
                    rows = at[places]
                    here = rows >= 0
                    if here.any():
                        known = best[item]
                        known[2] = -1 - np.arange(known.shape[1])
                        now = treap.search(rows[here], weights[here], ids, known[:3], top)
                        column = now[2]
                        null = np.where(column >= 0, nulls[np.maximum(column, 0)], 0)
                        old = column < 0
                        null[old] = known[3][-1 - column[old]]
                        best[item] = np.concatenate([now, [null]])
        for item, (score, ids, _, null) in best.items():
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(score), pa.int64()), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())],
                    ["item_id", "doc_id", "score"],
                )

    return answer


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Index ``docs`` (doc_id, text) and rank them for each of ``items`` (item_id, text).

    Null, empty and blank texts have no terms: such documents are in no list and do not count, such items
    have none. Very long texts are indexed whole. Equal scores go by doc_id, null ids last; rows that
    share a doc_id are documents of their own. Equal items count once, and texts that share an item_id are
    one item. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "treap")
    index, n_docs = build_index(docs, scratch)
    return search(index, n_docs, items, scratch, top)


ORACLE = r"""
WITH letters AS (SELECT '[0-9A-Za-z\x{80}-\x{10FFFF}]+' AS p),
doc_terms AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p) AS t
  FROM documents, letters),
totals AS (SELECT count(*) AS n_all, sum(len(t))::BIGINT AS l_all FROM doc_terms WHERE len(t) > 0),
postings AS (
  SELECT r, doc_id, term, count(*) AS tf, any_value(m) AS m
  FROM (SELECT r, doc_id, 75 + (25 * len(t) * n_all) // l_all AS m, unnest(t) AS term FROM doc_terms, totals WHERE len(t) > 0) GROUP BY r, doc_id, term),
dfs AS (SELECT term, floor(1000 * ln((2 * any_value(n_all) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term),
item_terms AS (
  SELECT item_id, term, count(*) AS many FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p)) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark), letters) GROUP BY item_id, term),
scored AS (
  SELECT item_id, r, doc_id, sum(many * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM item_terms JOIN dfs USING (term) JOIN postings USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, (row_number() OVER best)::INT AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY row_number() OVER best <= 20
"""
