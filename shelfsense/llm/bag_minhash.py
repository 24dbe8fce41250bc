"""Near-duplicate documents by BagMinHash, banding and exact multiset overlap.

A document is the multiset of its shingles (five words; a shorter text is one shingle). BagMinHash
(Ertl, 2018) treats a shingle of weight w as the part (0, w] of a Poisson process over weight and time:
every point of the process falls on one of ``REGISTERS`` registers, and a register keeps the earliest
point below the document's weights. Two documents agree in a register with a probability equal to
their weighted Jaccard similarity. Weights are discretised to whole numbers and the process is
hierarchical: the dyadic ranges (0,1], (1,2], (2,4], ... are independent processes, and a point finds
its place in a range by halving it, so ranges above a weight are never entered and a weight costs
its logarithm. Points come in order of time, and a process ends once it is later than all registers
of its document.

Bands of registers propose pairs; a pair is a link if its exact weighted Jaccard similarity is at
least 4/5; classes are connected components. Equal texts are merged before all this, and a band that
thousands of documents share is not joined pair by pair: all its members are compared with its
least one first, and then only pairs that are still in different components. A pair inside a
component changes no class, so nothing is lost. Sizes and a one-bit-per-register sketch drop
hopeless pairs inside the joins (a pair at the threshold is lost with a chance below 1e-5). The second
join also compares bitmaps of the shingles, whose differing bits bound the overlap from above
without error, and takes a pair only in the first band that it shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsense.llm.common import Scratch, components, free, words

SHINGLE = 5
REGISTERS = 128
BANDS, ROWS = 25, 5
#: Bits of the sketches that may differ: mean and 4.5 standard deviations at similarity 0.8.
SKETCH_BITS = 28
#: Documents whose shingles are fetched by a broadcast of their keys (40 bytes each) up to this number.
BROADCAST_NODES = 1_000_000
#: 64-bit words of a document's bitmap of shingles.
BITMAP = 8
SLICE_WORDS = 500_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def shingles(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, shingle and weight of each different shingle; documents are ``starts[i]:starts[i+1]``
    of the word hashes."""
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    reach = np.minimum(sizes, SHINGLE)
    first = np.arange(len(hashes))[np.arange(len(hashes)) + reach[doc] <= starts[1:][doc]] if len(hashes) else np.zeros(0, int)
    doc = doc[first] if len(hashes) else np.zeros(0, int)
    acc = _mix(reach[doc].astype(_U))
    for j in range(SHINGLE):
        inside = j < reach[doc]
        acc[inside] = _mix(acc[inside] * _U(3) + hashes[first[inside] + j].astype(_U))
    order = np.lexsort((acc, doc))
    doc, acc = doc[order], acc[order]
    new = np.ones(len(acc), dtype=bool)
    new[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], acc[at], np.diff(np.append(at, len(acc)))


def bag_minhash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Register values (points' times) of each document; infinite for one without shingles."""
    # One process for each shingle and each dyadic range that its weight enters.
    docs, seeds, lengths, limits = [], [], [], []
    low, length, k = 0, 1, 0
    while True:
        enters = weight > low
        if not enters.any():
            break
        docs.append(doc[enters])
        seeds.append(_mix(shingle[enters] ^ _mix(np.full(1, k, dtype=_U))))
        lengths.append(np.full(enters.sum(), length, dtype=np.int64))
        limits.append(np.minimum(weight[enters] - low, length))
        low, length, k = low + length, max(1, low + length), k + 1
    values = np.full(n_docs * registers, np.inf)
    if docs:
        d, seed, length, limit = (np.concatenate(x) for x in (docs, seeds, lengths, limits))
        time = np.zeros(len(d))
        point = 0
        while len(d):
            point += 1
            h = _mix(seed + _U(point * 0xD1342543DE82EF95 % 2**64))
            time = time - np.log(_unit(h)) / length
            h = _mix(h)
            place = d * registers + (h % _U(registers)).astype(np.int64)
            # Halving a range of 2^b units b times leaves the unit given by b bits.
            unit = ((h >> _U(32)) & (length - 1).astype(_U)).astype(np.int64)
            inside = unit < limit
            np.minimum.at(values, place[inside], time[inside])
            last = values.reshape(n_docs, registers).max(axis=1)
            going = time < last[d]
            d, seed, length, limit, time = d[going], seed[going], length[going], limit[going], time[going]
    return values.reshape(n_docs, registers)


def bands_and_sketch(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each band, and the sketch as two 64-bit numbers."""
    raw = _mix(values.view(_U))
    banded = raw[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    acc = _mix(np.broadcast_to(np.arange(BANDS, dtype=_U), banded.shape[:2]))
    for j in range(ROWS):
        acc = _mix(acc * _U(3) + banded[:, :, j])
    bits = np.packbits((raw & _U(1)).astype(np.uint8), axis=1, bitorder="little")
    return acc.view(np.int64), np.ascontiguousarray(bits).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of about ``SLICE_WORDS`` words, their word hashes and where documents start."""
    for batch in batches:
        column = batch.column("h")
        starts = np.asarray(column.offsets).astype(np.int64)
        piece = (starts[1:] - starts[0]) // SLICE_WORDS
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
        values = column.values.to_numpy(zero_copy_only=False)
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a), values[starts[a] : starts[b]].view(_U), starts[a : b + 1] - starts[a]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, hashes, starts in _slices(batches):
        doc, shingle, weight = shingles(hashes, starts)
        values = bag_minhash(doc, shingle, weight, len(batch))
        bands, sketch = bands_and_sketch(values)
        n = np.bincount(doc, weights=weight, minlength=len(batch)).astype(np.int64)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32), bands[n > 0].ravel())
        bits = np.zeros((len(batch), 64 * BITMAP), dtype=np.uint8)
        bits[doc, (_mix(shingle) % _U(64 * BITMAP)).astype(np.int64)] = 1
        maps = np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()
        maps = pa.ListArray.from_arrays(np.arange(0, len(maps) + 1, BITMAP, dtype=np.int32), maps)
        columns = [*(batch.column(c) for c in ("doc_id", "mark", "d1", "d2")), pa.array(n), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), lists, maps]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "d1", "d2", "n", "s1", "s2", "bands", "bits"])


def _tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Multisets as sets: the k-th copy of a shingle gets a number of its own."""
    for batch, hashes, starts in _slices(batches):
        doc, shingle, weight = shingles(hashes, starts)
        copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
        tagged = _mix(np.repeat(shingle, weight) + copy.astype(_U)).view(np.int64)
        sizes = np.bincount(doc, weights=weight, minlength=len(batch)).astype(np.int64)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), tagged)
        yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "bag"])


def word_hashes(text: Column) -> Column:
    return F.transform(words(F.lower(F.coalesce(text, F.lit("")))), lambda w: F.xxhash64(w))


def _may_link(a: str, b: str) -> Column:
    """Sizes and sketches leave a similarity of 0.8 possible."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    differ = sum((F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in ("s1", "s2")), F.lit(0))
    return (na * 5 >= nb * 4) & (nb * 5 >= na * 4) & (differ <= SKETCH_BITS)


def _overlap_bound(a: str, b: str) -> Column:
    """The bitmaps leave a similarity of 4/5 possible: a bit that only one document has stands for a
    shingle that the other lacks."""

    def only(p: str, q: str) -> Column:
        own = (F.bit_count(F.col(f"{p}bits")[i].bitwiseAND(F.bitwise_not(F.col(f"{q}bits")[i]))) for i in range(BITMAP))
        return F.col(f"{p}n") - sum(own, F.lit(0))

    common = F.least(only(a, b), only(b, a))
    return common * 5 >= (F.col(f"{a}n") + F.col(f"{b}n") - common) * 4


def _short(band: Column) -> Column:
    return band.bitwiseAND((1 << 31) - 1).cast("int")


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes whose exact similarity is at least 4/5.

    A node's text is fetched by the row that stands for it (doc_id and text hash), and counts only if its
    word digests are the node's.
    """
    pairs = scratch.keep(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = scratch.keep(nodes.join(ends, "node", "left_semi").select("node", "d1", "d2", F.col("least.doc_id").alias("rep"), F.col("least.mark").alias("rep_mark")), "wanted")
    held = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), "text")
    rows = own.join(held, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("mark") == F.col("rep_mark")))
    rows = rows.select("node", "d1", "d2", word_hashes(F.col("text")).alias("h"))
    rows = rows.filter((F.xxhash64("h") == F.col("d1")) & (F.xxhash64(F.lit(1), "h") == F.col("d2"))).select("node", "h")
    bags = scratch.keep(rows.mapInArrow(_tag, "node long, bag array<long>").dropDuplicates(["node"]), "bags")
    left = bags.select(F.col("node").alias("a"), F.col("bag").alias("x"))
    right = bags.select(F.col("node").alias("b"), F.col("bag").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    sized = both.select("a", "b", common.alias("i"), (F.size("x") + F.size("y")).alias("t"))
    links = scratch.keep(sized.filter(F.col("i") * 5 >= (F.col("t") - F.col("i")) * 4).select("a", "b"), "links")
    scratch.drop(bags, wanted, pairs)
    return links


def text_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, mark (hash of its text) and class_id, the least doc_id of the class.

    Words lie between ASCII white space, in lower case. Classes are of texts: documents with the same
    words, also those with none (null, empty and blank texts), are one class at least, whatever their
    doc_ids. Rows without doc_id and different texts that share a doc_id are compared like all others. A
    class of rows without doc_id has a hash as its class_id, and of classes with the same least doc_id
    all but one do. Very long texts are read whole, in one row of a task. Other columns, whatever their
    names, are not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near")
    h = word_hashes(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), h.alias("h"))
    rows = rows.select("doc_id", "mark", F.xxhash64("h").alias("d1"), F.xxhash64(F.lit(1), "h").alias("d2"), "h")
    signed = scratch.keep(
        rows.mapInArrow(_sign, "doc_id long, mark long, d1 long, d2 long, n long, s1 long, s2 long, bands array<long>, bits array<long>"), "signed"
    )
    # Equal word sequences are one node, numbered as it is written; its least row stands for it.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("least")
    merged = signed.groupBy("d1", "d2").agg(least, *[F.first(c).alias(c) for c in ("n", "s1", "s2", "bands", "bits")])
    nodes = scratch.keep(merged.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select(F.explode("bands").alias("key"), "node", "n", "s1", "s2")
    pivots = (
        banded.groupBy("key")
        .agg(F.min("node").alias("pivot"), *[F.min_by(c, "node").alias(f"p{c}") for c in ("n", "s1", "s2")], F.count("*").alias("many"))
        .filter("many > 1")
        .drop("many")
    )
    shared = scratch.keep(banded.join(pivots, "key"), "shared")
    first = shared.filter((F.col("node") > F.col("pivot")) & _may_link("", "p")).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    first = scratch.keep(first, "first")
    links = _linked(first, nodes, docs, scratch)
    roots = scratch.keep(components(links, scratch).withColumnRenamed("node", "linked"), "roots")

    # What is still apart in a band: the members outside the pivot's component against all others.
    members = shared.join(roots, F.col("node") == F.col("linked"), "left").select("key", "node", "n", "s1", "s2", F.coalesce("root", "node").alias("root"))
    members = scratch.keep(members, "members")
    mixed = members.groupBy("key").agg(F.min_by("root", "node").alias("lead"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key", "lead")
    # 31 bits of a band's hash tell the bands of two documents apart.
    own = nodes.select("node", "n", "s1", "s2", "bits", F.transform("bands", _short).alias("bands"))
    mixed = scratch.keep(members.select("key", "node", "root").join(mixed, "key").join(own, "node"), "mixed")
    x, y = mixed.filter("root <> lead").alias("x"), mixed.alias("y")
    apart = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.root") != F.col("y.root"))
        & ((F.col("y.root") == F.col("y.lead")) | (F.col("x.node") < F.col("y.node")))
        & _may_link("x.", "y.")
        & _overlap_bound("x.", "y.")
        & (F.get(F.array_intersect("x.bands", "y.bands"), F.lit(0)) == _short(F.col("x.key"))),
    )
    rest = apart.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    more = _linked(rest.join(first, ["a", "b"], "left_anti"), nodes, docs, scratch)
    scratch.drop(shared, members, mixed, first)
    roots = scratch.keep(components(links.unionByName(more), scratch).withColumnRenamed("node", "linked"), "roots")
    # A class is named by its least doc_id, or by a digest where another class has that name or there is none.
    rooted = nodes.join(roots, F.col("node") == F.col("linked"), "left").select("d1", "d2", F.coalesce("root", "node").alias("root"), F.col("least.doc_id").alias("doc_id"))
    rooted = scratch.keep(rooted, "rooted")
    named = scratch.keep(rooted.groupBy("root").agg(F.min("doc_id").alias("least"), F.min("d1").alias("digest")), "named")
    owner = named.filter("least is not null").groupBy("least").agg(F.min("digest").alias("owner"))
    named = named.join(owner, "least", "left").select("root", F.when(F.col("digest") == F.col("owner"), F.col("least")).otherwise(F.col("digest")).alias("class_id"))
    found = rooted.join(named, "root").select("d1", "d2", "class_id")
    return signed.select("doc_id", "mark", "d1", "d2").join(found, ["d1", "d2"]).select("doc_id", "mark", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, the one with the least doc_id (rows without one come last).
    Odd rows are classed as ``classes`` says; the columns are those of ``docs``."""
    found = classes(docs)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    own, ident, mark = free(docs, "own"), free(docs, "ident"), free(docs, "mark")
    kept = found.groupBy("class_id").agg(F.min(order).alias("kept")).select(F.col("kept.doc_id").alias(ident), F.col("kept.mark").alias(mark))
    rows = docs.withColumn(own, text_mark(F.col("text")))
    left = rows.join(kept, rows["doc_id"].eqNullSafe(kept[ident]) & (rows[own] == kept[mark]), "left_semi")
    return left.dropDuplicates(["doc_id", own]).drop(own)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
node_of AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY w) AS node, w FROM d),
bags AS (
  SELECT node, s, count(*) AS c FROM (
    SELECT node, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s
    FROM node_of WHERE node = doc_id)
  GROUP BY node, s),
sizes AS (SELECT node, sum(c) AS n FROM bags GROUP BY node),
meets AS (SELECT x.node AS a, y.node AS b, sum(least(x.c, y.c)) AS i FROM bags x JOIN bags y ON x.s = y.s AND x.node < y.node GROUP BY ALL),
links AS (
  SELECT a, b FROM meets JOIN sizes p ON p.node = a JOIN sizes q ON q.node = b WHERE i * 5 >= (p.n + q.n - i) * 4),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT node, node AS root FROM node_of UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.node)
SELECT doc_id, min(root) AS class_id FROM node_of JOIN reach USING (node) GROUP BY doc_id
"""
