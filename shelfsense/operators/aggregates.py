"""Aggregate reports: cross-tabs, shares, histograms, moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.functions.columns import guarded_ratio
from shelfsense.operators.joins import with_scalar


def cross_tab(df: DataFrame, rows: str, columns: str, total: str = "All") -> DataFrame:
    """Counts per pair with margins, in long form."""
    cube = df.cube(rows, columns).agg(
        F.count("*").alias("n"), F.grouping(rows).alias("_gr"), F.grouping(columns).alias("_gc")
    )
    return cube.select(
        F.when(F.col("_gr") == 1, total).otherwise(F.col(rows)).alias(rows),
        F.when(F.col("_gc") == 1, total).otherwise(F.col(columns)).alias(columns),
        "n",
    )


def row_shares(df: DataFrame, rows: str, columns: str) -> DataFrame:
    counts = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    # The window runs over the counted cells, not over the rows.
    return counts.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(rows)))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return with_scalar(counts, df.agg(F.count("*").alias("_all")), "_all").select(
        column, "n", (F.col("n") / F.col("_all")).alias("share")
    )


def sparsity(pairs: DataFrame, user: str, item: str) -> DataFrame:
    """Users, items and the empty share of the matrix, from distinct pairs."""
    users = pairs.groupBy(user).agg(F.count("*").alias("n")).agg(
        F.count("*").alias("users"), F.sum("n").alias("pairs")
    )
    items = pairs.select(item).distinct().agg(F.count("*").alias("items"))
    both = with_scalar(users, items, "items")
    return both.withColumn("sparsity", 1 - F.col("pairs") / (F.col("users").cast("double") * F.col("items")))


def histogram(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """Counts in right-closed buckets; values outside the edges get a NULL bucket."""
    bucket = None
    for lo, hi in zip(edges, edges[1:]):
        inside = (F.col(column) > lo) & (F.col(column) <= hi)
        label = f"({lo},{hi}]"
        bucket = F.when(inside, label) if bucket is None else bucket.when(inside, label)
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def sample_skewness(column: str) -> Column:
    """Bias-corrected skewness (Spark's own is the population form)."""
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))


def period_outcome(df: DataFrame, date: str, grain: str, outcome: str, name: str) -> DataFrame:
    period = F.date_trunc(grain, F.col(date)).cast("date")
    return df.groupBy(period.alias("period")).agg(F.count("*").alias("n"), F.avg(outcome).alias(name))


def view_to_buy(views: DataFrame, purchases: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct buyers over distinct viewers per category."""

    def people(df: DataFrame, name: str) -> DataFrame:
        tagged = df.select("customer_id", "product_id").distinct().join(
            products.select("product_id", "category"), "product_id"
        )
        return tagged.groupBy("category").agg(F.countDistinct("customer_id").alias(name))

    both = people(purchases, "buyers").join(people(views, "viewers"), "category", "left").na.fill({"viewers": 0})
    return both.withColumn("view_to_buy", guarded_ratio(F.col("buyers"), F.col("viewers")))


def arm_sizes(df: DataFrame, group: str, treated: str) -> DataFrame:
    t = F.col(treated).cast("int")
    return df.groupBy(group).agg(
        F.count("*").alias("rows_n"), F.sum(t).alias("treated"), F.avg(t).alias("treated_share")
    )
