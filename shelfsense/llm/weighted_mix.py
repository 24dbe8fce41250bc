"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a weight by its place in code-point order, and the sources share a budget of
``SHARE`` times all words in proportion to these. A target stops at ``MOST_EPOCHS`` times its
source's words; what is over goes to the others by weight until none is above (water filling:
in the order of words per weight, the sources that their share would overfill come first, so
running sums over that order give the one level all others have).

A source takes as many whole epochs as fit its target. The rest of the target is a weighted sample without
replacement: each document has the key ``-ln(u) / weight``, ``u`` drawn by a digest of seed, doc_id
and text and ``weight`` from its quality, and the documents with the least keys are taken until their
running sum of words reaches the rest. The last one gives only the words that are missing.

Keys are sorted as narrow rows in equal chunks of (source, key), so a source with a third of all
rows is spread over many tasks; nothing but one row per chunk is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsense.llm.common import Scratch, words
from shelfsense.operators.ordered import positions

SOURCE_WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = 12
#: Quality weight of a document by its label; documents without one have weight 1.
QUALITY_WEIGHTS = {0: 0.5, 1: 2.0}


def word_count(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hex_number(digest: Column) -> Column:
    """The first 52 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST_EPOCHS, weights: Sequence[int] = SOURCE_WEIGHTS) -> DataFrame:
    """``sources`` has one row per source: source, source_size. Adds ``target`` in words.

    Sources of no words have the target 0. The null source is the last in order.
    """
    placed = positions(sources, [], [F.col("source").isNull(), F.col("source")], totals=False)
    order = F.pmod(F.col("rows_before"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (order + 1).cast("int")).cast("long")
    weighed = placed.select("source", "source_size", F.col("rows_before").alias("place"), weight.alias("weight"))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(most))
    filled = positions(weighed, [], [F.col("cap") / F.col("weight"), F.col("place")], {"size": "source_size", "weight": "weight"})
    # The level all later sources would have if the sources before this one were full.
    level = (F.col("size_total") * float(share) - F.col("size_before") * float(most)) / (F.col("weight_total") - F.col("weight_before"))
    filled = filled.select("source", "source_size", "weight", "cap", "rows_before", level.alias("level"))
    filled = filled.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    common = filled.agg(F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("rows_before"))).alias("common"))
    out = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("common") * F.col("weight")))
    return filled.crossJoin(F.broadcast(common)).select("source", "source_size", out.alias("target"))  # one row


def quality_weights(labels: DataFrame) -> DataFrame:
    """``(doc_id, weight)`` from a table of labels; several labels of a document count by their mean."""
    low, high = QUALITY_WEIGHTS[0], QUALITY_WEIGHTS[1]
    mean = F.avg(F.col("quality").cast("double"))
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.lit(low) + mean * (high - low)).alias("weight"))


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = SHARE, seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken and the columns in ``carry``.

    ``weights`` has at most one row per doc_id with its quality weight, above 0. Null texts have no
    words and are never taken, nor are empty ones; a null source is a source of its own, a null
    doc_id a document without a weight of its own. Very long texts count whole; at most one document of a
    source is taken in part. Repeated rows have equal keys and are told apart by nothing: which
    of them is taken is open, how many are not. Other columns, whatever their names, are not read.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest))
    known = ("doc_id", "source", "size", "u", "tie", "weight")
    extra = [F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(carry)]
    rows = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        ((_hex_number(draw) + 0.5) / float(1 << 52)).alias("u"), _hex_number(digest).alias("tie"), *extra,
    )
    if weights is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        given = weights.select(F.col("doc_id").alias("w_doc"), F.col("weight").cast("double").alias("weight"))
        rows = rows.join(given, F.col("doc_id") == F.col("w_doc"), "left").drop("w_doc").fillna(1.0, ["weight"])
    rows = scratch.keep(rows.withColumn("key", -F.log("u") / F.col("weight")).drop("u", "weight"), "rows")
    sizes = scratch.keep(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    goals = scratch.keep(targets(sizes, share), "targets")
    summed = positions(rows, ["source"], ["key", "doc_id", "tie"], {"size": "size"}, totals=False)
    goals = goals.withColumnRenamed("source", "g_source")
    joined = summed.join(goals, F.col("source").eqNullSafe(F.col("g_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") + 0.5) - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("size_before")))
    return joined.select(
        "doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"),
        *[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)],
    )


def texts(mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself, from a mix that carries ``text``: one row per document and epoch.

    ``epoch`` counts from 0. A document taken in part gives its first words, with single blanks.
    """
    rows = mixed.filter("taken > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, CAST((taken - 1) DIV size AS BIGINT))")))
    left = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    cut = F.array_join(F.slice(words(F.col("text")), F.lit(1), left.cast("int")), " ")
    return rows.withColumn("text", F.when(left < F.col("size"), cut).otherwise(F.col("text"))).drop("size", "source_size", "target", "taken")


ORACLE = r"""
WITH rated AS (
  SELECT doc_id AS w_doc, 0.5 + avg(quality::DOUBLE) * 1.5 AS weight FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(concat_ws(':', '12', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u,
    ('0x' || substr(md5(coalesce(text, '')), 1, 13))::BIGINT AS tie
  FROM documents),
docs AS (SELECT *, -ln(u) / coalesce(weight, 1.0) AS sort_key FROM sized LEFT JOIN rated ON doc_id = w_doc),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, row_number() OVER fill AS step,
    (sum(source_size) OVER () * 1.5::DOUBLE - (sum(source_size) OVER fill - source_size) * 2.0::DOUBLE)
      / (sum(weight) OVER () - (sum(weight) OVER fill - weight))::DOUBLE AS level
  FROM weighed WINDOW fill AS (ORDER BY cap / weight, place)),
goals AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap
    ELSE least(cap, weight * (SELECT arg_min(level, step) FROM levels WHERE cap > level * weight)) END AS target
  FROM levels),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY sort_key, doc_id NULLS FIRST, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM docs),
parts AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, s.earlier,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS epochs
  FROM summed s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target + 0.5)::BIGINT - epochs * source_size - earlier)))::BIGINT AS taken
FROM parts
"""
