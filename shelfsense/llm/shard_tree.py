"""Sharding by a hierarchical weighted hash tree.

Shards hang under racks, racks under regions; a node weighs what its shards weigh together. A row
descends from the root: at each level every child draws -ln(u) / weight, u being hashed from the
row's key and the child's name, and the least draw wins, so that a child receives rows in
proportion to its weight. When weights change inside one subtree, draws elsewhere stay as they are:
rows move only into or out of that subtree, level by level. ``grown`` adds a shard as a
subtree of its own, so one more shard takes rows only into itself.

Draws use MD5 of a readable string, so any engine can find a row's shard. Everything is one map-side
expression per row; slots come from a range-partitioned layout in equal chunks, not from one
window per shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsense.operators.ordered import positions

_SHARD = T.StructType([T.StructField("name", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("shard", T.IntegerType())])


def _level(children: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("name", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("children", T.ArrayType(children))])


_TREE = T.ArrayType(_level(_level(_SHARD)))


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def regular_tree(regions: int = 2, racks: int = 3, shards: int = 4) -> list[Shard]:
    """Equal shards, numbered from 0, under ``racks`` racks in each of ``regions`` regions."""
    return [
        Shard(f"r{r}", f"k{k}", (r * racks + k) * shards + s) for r in range(regions) for k in range(racks) for s in range(shards)
    ]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region and rack of its own."""
    taken = {s.region for s in tree}
    region = next(f"r{i}" for i in range(len(taken) + 1) if f"r{i}" not in taken)
    return [*tree, Shard(region, "k0", max((s.shard for s in tree), default=-1) + 1, weight)]


def _json(tree: list[Shard]) -> str:
    import json

    top: dict = {}
    for s in tree:
        top.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    total = lambda racks: sum(s.weight for shards in racks for s in shards)
    return json.dumps(
        [
            {
                "name": region,
                "weight": total(racks.values()),
                "children": [
                    {
                        "name": f"{region}/{rack}",
                        "weight": total([shards]),
                        "children": [{"name": f"{region}/{rack}/{s.shard}", "weight": s.weight, "shard": s.shard} for s in shards],
                    }
                    for rack, shards in racks.items()
                ],
            }
            for region, racks in top.items()
        ]
    )


def draw(key: Column, name: Column, weight: Column) -> Column:
    """-ln(u) / weight, u from the first 52 bits of MD5 of ``key|name``."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", key, name)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / weight


def _winner(key: Column, children: Column) -> Column:
    drawn = F.transform(children, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c.alias("node")))
    return F.array_min(drawn)["node"]


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard of a row by its key; a null key is the string ``null``. The tree is part of the plan."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    root = F.from_json(F.lit(_json(tree)), _TREE)
    rack = _winner(key, _winner(key, root)["children"])
    return _winner(key, rack["children"])["shard"]


def assign(docs: DataFrame, tree: list[Shard] | None = None) -> DataFrame:
    """Shard and slot of every document, and its shard if there were one shard more.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law (``key``), shard, slot (from 0 in
    doc_id order without gaps inside the shard) and grown_shard. A null text has no bytes and the CRC
    of none; rows that share a doc_id, null ones too, share a shard and get slots of their own; other
    columns, whatever their names, are not read; an empty table gives no rows.
    """
    tree = tree or regular_tree()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree).alias("shard"),
        shard_of(F.col("doc_id"), grown(tree)).alias("grown_shard"),
    )
    placed = positions(rows, ["shard"], ["doc_id", "text_crc32", "size"], totals=False)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", F.col("rows_before").alias("slot"), "grown_shard")


ORACLE = """
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
rows AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h,
         coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
sized AS (
  SELECT doc_id, k, strlen(text) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32
  FROM rows, crc_table),
leaves AS (
  SELECT s AS shard, 'r' || (s // 12) AS region, 'r' || (s // 12) || '/k' || (s // 4 % 3) AS rack, 0 AS more
  FROM (SELECT unnest(range(24)) AS s)
  UNION ALL SELECT 24, 'r2', 'r2/k0', 1),
trees AS (
  SELECT g, shard, region, rack, rack || '/' || shard AS leaf,
    count(*) OVER (PARTITION BY g, region) AS region_weight, count(*) OVER (PARTITION BY g, rack) AS rack_weight
  FROM leaves JOIN (SELECT unnest([0, 1]) AS g) ON more <= g),
ids AS (SELECT DISTINCT k FROM rows),
drawn AS (
  SELECT k, g, shard,
    -ln((('0x' || substr(md5(k || '|' || region), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / region_weight AS d1,
    -ln((('0x' || substr(md5(k || '|' || rack), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / rack_weight AS d2,
    -ln((('0x' || substr(md5(k || '|' || leaf), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS d3
  FROM ids, trees),
won AS (SELECT k, g, shard FROM drawn QUALIFY row_number() OVER (PARTITION BY k, g ORDER BY d1, d2, d3) = 1)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, a.shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY a.shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  b.shard::INTEGER AS grown_shard
FROM sized JOIN won a ON a.k = sized.k AND a.g = 0 JOIN won b ON b.k = sized.k AND b.g = 1
"""
