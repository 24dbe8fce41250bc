"""Tables, intermediate results and graph components shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsense.session import shared_dir

#: Words of a text: everything between ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one call, written as Parquet to the cluster's shared folder.

    A written table survives lost executors and is computed once. ``drop`` removes a table as
    soon as no later step reads it; what the returned plan still reads stays until ``drop_all``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._n = 0

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        self._n += 1
        path = self.path(f"{self._n:03d}-{name}")
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = path
        kept._scratch_path = path
        return kept

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            _delete(self.spark, df._scratch_path)

    def drop_all(self) -> None:
        _delete(self.spark, self.folder)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of an undirected graph: ``(node, root)``, the root being the least node.

    ``edges`` has two long columns ``a`` and ``b``. Alternating large-star and small-star steps
    (Kiveris et al., "Connected components in MapReduce and beyond") link every node to the least
    neighbour it knows until each component is a star; each step is one grouping and one join, so a
    node with many neighbours is pre-aggregated and its join is split. Only a row count and a sum
    of hashes reach the driver. Nodes without an edge do not appear.
    """
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 31) - 1)).alias("h")).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(lowest, "u")
        # A node's own link to its least neighbour, and its other neighbours' links to the same.
        small = linked.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        after = scratch.keep(small, "edges")
        scratch.drop(now)
        now = after
