"""Join shapes beyond plain equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits a key has in ``may_match``'s map, bits of one of its rows (fixed by Spark's bitmaps), and rows at most (128 MB).
_BITS_A_KEY, _MAP_BITS, _MOST_MAPS = 8, 32_768, 32_768


def with_scalar(df: DataFrame, one_row: DataFrame, *names: str) -> DataFrame:
    """Attach the values of a one-row frame to every row, as scalar subqueries."""
    for name in names:
        df = df.withColumn(name, one_row.select(name).scalar())
    return df


def lookback_pairs(
    probes: DataFrame, events: DataFrame, key: str, probe_time: str, event_time: str, days: int
) -> DataFrame:
    """Pairs with equal ``key`` and ``probe_time - days <= event_time < probe_time``.

    Time is cut into buckets of ``days``; a probe looks into its own bucket and the one
    before, so a heavy key is spread over its buckets instead of meeting in one task.
    """
    width = days * 86400

    def bucket(c):
        return F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / width)

    left = probes.withColumn("_b", F.explode(F.array(bucket(probe_time), bucket(probe_time) - 1)))
    right = events.withColumn("_b", bucket(event_time))
    pairs = left.join(right, [key, "_b"])
    inside = (F.col(event_time) >= F.col(probe_time) - F.expr(f"interval {days} days")) & (
        F.col(event_time) < F.col(probe_time)
    )
    return pairs.filter(inside).drop("_b")


def may_match(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may occur in ``keys``: all that do, and about one in eight of the others.

    Put before a join on ``key`` with few of the rows on its other side, it keeps the rest out of the shuffle.
    The keys are hashed into bitmaps, a byte for each, which are broadcast; no row of ``df`` moves.
    """
    maps = max(1, min(_MOST_MAPS, -(-keys.count() * _BITS_A_KEY // _MAP_BITS)))
    place = F.pmod(F.xxhash64(key), F.lit(maps * _MAP_BITS))
    row, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit(_MAP_BITS - 1))
    held = keys.filter(F.col(key).isNotNull()).select(row.alias("_map_row"), bit.alias("_bit"))
    held = held.groupBy("_map_row").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = df.filter(F.col(key).isNotNull()).withColumn("_map_row", row).join(F.broadcast(held), "_map_row")
    return near.filter(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1).select(*df.columns)
