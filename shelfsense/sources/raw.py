"""Read raw tables and marts; write marts, exports and metric records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_raw_table(
    spark: SparkSession, folder: str, name: str, schema: StructType | str | None = None
) -> DataFrame:
    """One raw table by name, from Parquet or header CSV; a missing table is an error."""
    parquet, csv = f"{folder}/{name}.parquet", f"{folder}/{name}.csv"
    if _exists(spark, parquet):
        return spark.read.parquet(parquet)
    if _exists(spark, csv):
        reader = spark.read.option("header", True)
        # Without a declared schema the whole file is read once to infer it.
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(csv)
    raise FileNotFoundError(f"raw table {name} not found in {folder}")


def load_raw(
    spark: SparkSession, folder: str, names: list[str], schemas: Mapping[str, StructType | str] | None = None
) -> dict[str, DataFrame]:
    """Load the named raw tables and register each as a temporary view."""
    tables = {}
    for name in names:
        tables[name] = load_raw_table(spark, folder, name, (schemas or {}).get(name))
        tables[name].createOrReplaceTempView(name)
    return tables


def write_raw_table(df: DataFrame, folder: str, name: str, force: bool = False) -> None:
    """Write a raw table; existing data stays unless ``force`` is given."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(f"{folder}/{name}.parquet")


def materialize(df: DataFrame, folder: str, name: str, partitions: list[str] | None = None) -> DataFrame:
    """Create or replace a mart as Parquet and return it as read back."""
    path = f"{folder}/{name}.parquet"
    writer = df.write.mode("overwrite")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)
    if not _exists(df.sparkSession, path):
        raise RuntimeError(f"mart was not created: {name}")
    return df.sparkSession.read.parquet(path)


def export_csv(df: DataFrame, folder: str, name: str) -> str:
    path = f"{folder}/{name}_csv"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_metrics(df: DataFrame, folder: str, name: str) -> str:
    """Metric records, one JSON object per row."""
    path = f"{folder}/{name}_json"
    df.write.mode("overwrite").json(path)
    return path


def load_mart(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A mart by its contract name, date columns typed."""
    from shelfsense.operators.quality import CONTRACTS

    if name not in CONTRACTS:
        raise KeyError(f"unknown mart: {name}")
    df = load_raw_table(spark, folder, name)
    types = dict(df.dtypes)
    for column in CONTRACTS[name].dates:
        if types.get(column) == "string":
            df = df.withColumn(column, F.to_timestamp_ntz(column))
    return df


def load_all_marts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    from shelfsense.operators.quality import CONTRACTS

    return {name: load_mart(spark, folder, name) for name in CONTRACTS}


def row_counts(marts: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per mart."""
    parts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("mart_name"), "row_count")
        for name, df in marts.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


__all__ = [
    "export_csv",
    "load_all_marts",
    "load_mart",
    "load_raw",
    "load_raw_table",
    "materialize",
    "row_counts",
    "write_metrics",
    "write_raw_table",
]
