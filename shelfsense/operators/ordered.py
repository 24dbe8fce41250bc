"""Ranks, running sums, trailing frames and exact quantiles without one-task groups.

A window over a hot key, or over no key at all, sorts the whole group in one task. Here
rows are range-partitioned on (key, order) into chunks of about equal size and written
once to the shared folder, so that the chunk of each row is settled. Windows
then run inside (chunk, key). Only a group that crosses a chunk border needs anything
from other chunks, and at most two groups per chunk do, so what is broadcast never has
more than two rows per chunk (times the frame length for trailing frames).

The order columns must end in a unique one wherever ties would change the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.session import chunk_count, durable

CHUNK, POS = "_chunk", "_pos"
_POSITION_MASK = (1 << 33) - 1
# A group of fewer rows is sorted by one task; larger ones are looked for in this many sampled rows of each.
HOT_ROWS, SAMPLED_ROWS = 1_000_000, 20_000


def _names(columns: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in columns]


def lay_out(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], chunks: int | None = None
) -> DataFrame:
    """Range-partition and sort by (keys, order); stamp chunk id and position in the chunk."""
    by = _names(keys) + [F.col(o) if isinstance(o, str) else o for o in order]
    n = chunks or chunk_count(df.sparkSession)
    laid = (
        df.repartitionByRange(n, *by)
        .sortWithinPartitions(*by)
        .withColumn(CHUNK, F.spark_partition_id())
        # The low bits of this id count the rows of one task in their sorted order.
        .withColumn(POS, F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)))
    )
    return durable(laid)


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    cond = left[CHUNK] == right[CHUNK]
    for c in columns:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column | str] | None = None,
    chunks: int | None = None,
    totals: bool = True,
) -> DataFrame:
    """Add ``rows_before`` and ``rows_total``, and ``<name>_before`` / ``<name>_total`` per sum.

    *Before* covers the strictly earlier rows of the group, *total* the whole group.
    """
    sums = {k: (F.col(v) if isinstance(v, str) else v) for k, v in (sums or {}).items()}
    keys = list(keys)
    work = df
    for name, value in sums.items():
        work = work.withColumn(f"_v_{name}", F.coalesce(value, F.lit(0)))
    laid = lay_out(work, keys, order, chunks)
    measures = {"rows": F.lit(1).cast("long"), **{n: F.col(f"_v_{n}") for n in sums}}

    per_chunk = laid.groupBy(CHUNK, *keys).agg(
        *[F.sum(v).alias(f"_t_{n}") for n, v in measures.items()]
    )
    # A group has at most one row per chunk here, so these windows stay small.
    along = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    later = along.rowsBetween(1, Window.unboundedFollowing)
    carry = per_chunk.select(
        CHUNK,
        *keys,
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_in_{n}") for n in measures],
        *[F.coalesce(F.sum(f"_t_{n}").over(later), F.lit(0)).alias(f"_out_{n}") for n in measures],
    ).filter("_in_rows > 0 or _out_rows > 0")

    inside = Window.partitionBy(CHUNK, *keys).orderBy(POS)
    up_to = inside.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(CHUNK, *keys)
    local = laid
    for n, v in measures.items():
        local = local.withColumn(f"_b_{n}", F.coalesce(F.sum(v).over(up_to), F.lit(0)))
        if totals:
            local = local.withColumn(f"_w_{n}", F.sum(v).over(whole))
    joined = local.join(F.broadcast(carry), _same(local, carry, keys), "left")
    out = [local[c] for c in df.columns]
    for n in measures:
        out.append((F.col(f"_b_{n}") + F.coalesce(F.col(f"_in_{n}"), F.lit(0))).alias(f"{n}_before"))
        if totals:
            out.append(
                (
                    F.col(f"_w_{n}")
                    + F.coalesce(F.col(f"_in_{n}"), F.lit(0))
                    + F.coalesce(F.col(f"_out_{n}"), F.lit(0))
                ).alias(f"{n}_total")
            )
    return joined.select(*out)


def hot_values(df: DataFrame, key: str, least: int = HOT_ROWS) -> list:
    """Values of ``key`` (NULL among them) with about ``least`` rows or more.

    Long tables are counted on a sample: the answer only decides which of two exact ways rows go, and is at
    most rows / ``least`` values.
    """
    share = min(1.0, SAMPLED_ROWS / least)
    keys = df.select(key)
    counts = (keys if share == 1.0 else keys.sample(share, seed=7)).groupBy(key).count()
    return [r[key] for r in counts.filter(F.col("count") >= least * share).collect()]


def split_hot(df: DataFrame, key: str, hot: Sequence | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose group fits a plain window, and the rows of hot groups (None if there are none).

    ``hot`` lists the values to set apart; without it they are counted on ``df``.
    """
    hot = hot_values(df, key) if hot is None else list(hot)
    if not hot:
        return df, None
    df = durable(df)  # read by both ways
    apart = F.when(F.col(key).isNull(), F.lit(None in hot)).otherwise(F.col(key).isin([v for v in hot if v is not None]))
    return df.filter(~apart), df.filter(apart)


def row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    numbered = positions(df, keys, order, totals=False)
    return numbered.withColumn(name, F.col("rows_before") + 1).drop("rows_before")


def dense_rank(
    df: DataFrame, keys: Sequence[str], value: str, name: str, descending: bool = True, ids: Sequence[str] = ()
) -> DataFrame:
    """Dense rank by one non-NULL value: number the distinct values, then join them back.

    With ``ids`` (a unique key of the rows) the result has only these, the keys, the value and
    the rank, for the caller to join. These rows are settled first: a sum of doubles computed
    twice need not be equal to itself.
    """
    df = durable(df.select(*ids, *[k for k in keys if k not in ids], value) if ids else df)
    levels = df.select(*keys, value).distinct()
    order = F.col(value).desc() if descending else F.col(value).asc()
    ranked = row_number(levels, keys, [order], name).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_k_value"), name
    )
    cond = F.col(value) == F.col("_k_value")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(ranked, cond, "left").drop("_k_value", *[f"_k_{k}" for k in keys])


def tile(rows_before: Column, rows_total: Column, k: int) -> Column:
    """Bucket 1..k of equal size; the first ``total mod k`` buckets hold one row more."""
    size = F.floor(rows_total / k)
    extra = rows_total % k
    big = extra * (size + 1)
    return F.when(rows_before < big, F.floor(rows_before / (size + 1)) + 1).otherwise(
        extra + F.floor((rows_before - big) / F.greatest(size, F.lit(1))) + 1
    )


def rank_bin(rows_before: Column, rows_total: Column, k: int) -> Column:
    """Bin 1..k of a global order by right-closed rank quantiles (edges at q * (n - 1))."""
    return F.when(rows_total <= 1, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.ceil(rows_before * k / (rows_total - 1)))
    ).cast("long")


def with_halo(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    reach: int,
    chunks: int | None = None,
) -> DataFrame:
    """Chunked rows plus, for each chunk, the ``reach`` rows of its first group that precede it.

    The copies carry ``_halo = true`` and negative positions. A ROWS frame that looks back at
    most ``reach`` rows over ``frame_window`` is then exact inside every chunk.
    """
    keys = list(keys)
    laid = lay_out(df, keys, order, chunks).withColumn("_halo", F.lit(False))
    key = F.struct(*_names(keys)) if keys else F.struct(F.lit(0).alias("all"))
    edges = laid.withColumn("_key", key).groupBy(CHUNK).agg(
        F.max(POS).alias("_last_pos"),
        F.min_by("_key", POS).alias("_first_key"),
        F.max_by("_key", POS).alias("_last_key"),
    )
    edges = durable(edges)  # one row per chunk
    ends = edges.select(F.col(CHUNK).alias("_ec"), "_last_pos", "_last_key")
    tails = (
        laid.withColumn("_key", key)
        .join(
            F.broadcast(ends),
            (F.col(CHUNK) == F.col("_ec"))
            & (F.col(POS) > F.col("_last_pos") - reach)
            & F.col("_key").eqNullSafe(F.col("_last_key")),
        )
        .drop("_ec", "_last_pos", "_last_key")
    )
    # At most ``reach`` rows per chunk: number them along each group.
    in_group = Window.partitionBy("_key").orderBy(CHUNK, POS)
    tails = tails.withColumn("_ord", F.row_number().over(in_group).cast("long"))

    per_chunk = tails.groupBy(F.col("_key").alias("_gk"), F.col(CHUNK).alias("_gc")).agg(
        F.count("*").alias("_n")
    )
    receivers = edges.select(F.col("_first_key").alias("_gk"), F.col(CHUNK).alias("_gc"), F.lit(0).cast("long").alias("_n"))
    marked = per_chunk.withColumn("_recv", F.lit(False)).unionByName(
        receivers.withColumn("_recv", F.lit(True))
    )
    along = Window.partitionBy("_gk").orderBy("_gc").rangeBetween(Window.unboundedPreceding, -1)
    want = (
        marked.withColumn("_have", F.coalesce(F.sum("_n").over(along), F.lit(0)))
        .filter("_recv and _have > 0")
        .select("_gk", F.col("_gc").alias("_to"), "_have")
        .withColumn("_block", F.explode(F.array(F.floor(F.col("_have") / reach) - 1, F.floor(F.col("_have") / reach))))
    )
    tails = tails.withColumn("_tail_block", F.floor((F.col("_ord") - 1) / reach))
    halo = tails.join(
        F.broadcast(want),
        F.col("_key").eqNullSafe(F.col("_gk"))
        & (F.col("_tail_block") == F.col("_block"))
        & (F.col("_ord") <= F.col("_have"))
        & (F.col("_ord") > F.col("_have") - reach),
    ).select(
        *df.columns,
        F.col("_to").alias(CHUNK),
        (F.col("_ord") - F.col("_have") - 1).alias(POS),
        F.lit(True).alias("_halo"),
    )
    return laid.unionByName(halo)


def frame_window(keys: Sequence[str]):
    """Window for look-back frames over the output of ``with_halo``."""
    return Window.partitionBy(CHUNK, *keys).orderBy(POS)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("not _halo").drop("_halo", CHUNK, POS)


def quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per (keys, column), columns ``q0..``.

    Values are first counted, so the ordering step sees each distinct value once per group.
    """
    keys = list(keys)
    named = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    counts = (
        df.select(*keys, F.inline(named))
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "column", "value")
        .agg(F.count("*").alias("n"))
    )
    ranked = positions(counts, [*keys, "column"], ["value"], sums={"n": "n"})
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    picks = []
    for i, p in enumerate(probabilities):
        target = F.lit(float(p)) * (F.col("n_total") - 1)
        for tag, rank in (("lo", F.floor(target)), ("hi", F.ceil(target))):
            picks.append(F.max(F.when(first.__le__(rank) & (rank <= last), F.col("value"))).alias(f"_{tag}{i}"))
        picks.append(F.max(target - F.floor(target)).alias(f"_w{i}"))
    found = ranked.groupBy(*keys, "column").agg(F.max("n_total").alias("n"), *picks)
    return found.select(
        *keys,
        "column",
        "n",
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(f"q{i}")
            for i in range(len(probabilities))
        ],
    )


def quantiles_wide(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """The same with one row per key group and columns ``<column>_q0..``."""
    long = quantiles(df, columns, probabilities, keys)
    cells = [
        F.max(F.when(F.col("column") == c, F.col(f"q{i}"))).alias(f"{c}_q{i}")
        for c in columns
        for i in range(len(probabilities))
    ]
    return long.groupBy(*keys).agg(*cells)


def quantile_values(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles of whole columns as plain numbers (one row per column is collected)."""
    rows = quantiles(df, columns, probabilities).collect()
    return {r["column"]: [r[f"q{i}"] for i in range(len(probabilities))] for r in rows}
