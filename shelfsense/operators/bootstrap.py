"""Paired bootstrap of ranking metrics in one ordered pass per score.

Each row gets a Poisson(1) weight per draw, derived from its id and the draw number, so both
scores see the same resample. Rows are range-partitioned by (score, row hash), so that a score
half of the rows share spreads over many tasks; a task walks its sorted rows and keeps sums per
draw only. Tasks meet through three small rows per (chunk, draw): its first score, its last
score, whose ties may reach into other chunks, and all scores between these two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.session import chunk_count

_STEPS = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(12)])


def poisson_weights(row_hash: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Matrix (rows x draws) of Poisson(1) counts from a mixed 64-bit hash. Draw 0 is all ones."""
    with np.errstate(over="ignore"):
        x = row_hash.astype(np.uint64)[:, None] + draws.astype(np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    u = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    w = np.searchsorted(_STEPS, u, side="right").astype(np.float64)
    w[:, draws == 0] = 1.0
    return w


def _walk(draws: int, slab: int):
    """Per draw: weighted positives and negatives of a chunk's edge scores, and of those between with their wins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = np.arange(draws + 1)

        def block(at, edge, pos, neg, wins):
            return pd.DataFrame({"at": at, "edge": edge, "draw": ids, "pos": pos, "neg": neg, "wins": wins})

        pos, neg, wins = (np.zeros(draws + 1) for _ in range(3))
        tie = between = first = None
        for pdf in batches:
            for start in range(0, len(pdf), slab):
                part = pdf.iloc[start : start + slab]
                w = poisson_weights(part["row_hash"].to_numpy(), ids)
                y = part["y"].to_numpy().astype(bool)
                s = part["s"].to_numpy()
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1])
                p = np.add.reduceat(w * y[:, None], cuts, axis=0)
                q = np.add.reduceat(w * ~y[:, None], cuts, axis=0)
                for g, at in enumerate(cuts):
                    if tie is not None and s[at] == tie[0]:
                        tie = (tie[0], tie[1] + p[g], tie[2] + q[g])
                        continue
                    if tie is not None and first is None:
                        first = tie
                    elif tie is not None:
                        between = tie[0] if between is None else between
                        wins += tie[1] * (neg + tie[2] / 2.0)
                        pos += tie[1]
                        neg += tie[2]
                    tie = (s[at], p[g], q[g])
        for edge in (first, tie):
            if edge is not None:
                yield block(edge[0], True, edge[1], edge[2], np.zeros(draws + 1))
        if between is not None:
            yield block(between, False, pos, neg, wins)

    return run


def auc_draws(
    df: DataFrame, score: str, label: str, ids: list[str], draws: int = 2000, seed: int = 42, chunks: int | None = None
) -> DataFrame:
    """ROC-AUC per draw (draw 0: the plain rows). Draws with one class only have none.

    Rows without a score (NULL or NaN) or label take no part.
    """
    rows = df.select(
        F.col(score).cast("double").alias("s"),
        F.col(label).cast("int").alias("y"),
        F.xxhash64(F.lit(seed), *ids).alias("row_hash"),
    ).filter("s is not null and not isnan(s) and y is not null")
    n = chunks or chunk_count(df.sparkSession)
    laid = rows.repartitionByRange(n, "s", "row_hash").sortWithinPartitions("s")
    slab = max(1, 4_000_000 // (draws + 1))
    parts = laid.mapInPandas(
        _walk(draws, slab), "at double, edge boolean, draw int, pos double, neg double, wins double"
    )
    # A score between the edges of its chunk is in no other chunk; equal edge scores are one tie.
    merged = parts.groupBy("draw", "at").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("wins").alias("wins"), F.max("edge").alias("edge")
    )
    own = F.when(F.col("edge"), F.col("pos") * F.col("neg") / 2.0).otherwise(F.col("wins"))
    before = Window.partitionBy("draw").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = merged.withColumn("neg_before", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    total = placed.groupBy("draw").agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum(own + F.col("pos") * F.col("neg_before")).alias("w")
    )
    return total.filter("p > 0 and q > 0").select("draw", (F.col("w") / (F.col("p") * F.col("q"))).alias("auc"))


def paired_lift(
    df: DataFrame, candidate: str, reference: str, label: str, ids: list[str], draws: int = 2000, seed: int = 42
) -> DataFrame:
    """AUC lift of the candidate over the reference on the same resamples, with its 95% interval.

    The per-draw table has one row per draw, so its percentiles are taken by a plain aggregate.
    """
    a = auc_draws(df, candidate, label, ids, draws, seed).withColumnRenamed("auc", "cand")
    b = auc_draws(df, reference, label, ids, draws, seed).withColumnRenamed("auc", "ref")
    lifts = a.join(b, "draw").withColumn("lift", F.col("cand") - F.col("ref"))
    drawn = F.when(F.col("draw") > 0, F.col("lift"))
    one = lifts.agg(
        F.max(F.when(F.col("draw") == 0, F.col("cand"))).alias("candidate_value"),
        F.max(F.when(F.col("draw") == 0, F.col("ref"))).alias("reference_value"),
        F.max(F.when(F.col("draw") == 0, F.col("lift"))).alias("lift"),
        F.percentile(drawn, 0.025).alias("ci95_low"),
        F.percentile(drawn, 0.975).alias("ci95_high"),
        F.avg((drawn > 0).cast("int")).alias("share_positive"),
    )
    clear = (F.col("ci95_low") > 0) | (F.col("ci95_high") < 0)
    return one.select(
        F.lit(candidate).alias("candidate"),
        F.lit(reference).alias("reference"),
        *one.columns,
        clear.alias("ci_excludes_zero"),
        F.when(clear & (F.col("lift") > 0), "adds value").otherwise("does not beat baseline").alias("verdict"),
    )


__all__ = ["auc_draws", "paired_lift", "poisson_weights"]
