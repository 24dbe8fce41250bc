"""One row per customer: churn, segment, best campaign, recommendations and an action."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.operators.decisions import action


def recommendation_lists(warm: DataFrame, cold: DataFrame, k: int = 3) -> DataFrame:
    """Top-k product ids per customer as text, in rank order."""
    rows = warm.select("customer_id", "product_id", "rank").unionByName(cold.select("customer_id", "product_id", "rank"))
    top = rows.filter(F.col("rank") <= k)
    listed = F.array_sort(F.collect_list(F.struct("rank", "product_id")))
    return top.groupBy("customer_id").agg(
        F.array_join(F.transform(listed, lambda r: r["product_id"]), ", ").alias("top3_recommendations")
    )


def master(
    mart: DataFrame, churn: DataFrame, segments: DataFrame, profile: DataFrame, uplift: DataFrame, recs: DataFrame
) -> DataFrame:
    base = mart.select("customer_id", "customer_value_band", "recency_days", "total_net_revenue")
    about = profile.select(
        "cluster_id", F.col("churn_rate").alias("segment_churn_rate"), F.col("avg_revenue").alias("segment_avg_revenue")
    )
    df = (
        base.join(churn.select("customer_id", "churn_prob"), "customer_id", "left")
        .join(segments.select("customer_id", "cluster_id", "segment_name"), "customer_id", "left")
        .join(uplift, "customer_id", "left")
        .join(recs, "customer_id", "left")
        .join(about, "cluster_id", "left")
    )
    return df.withColumn("recommended_action", action())


def full_signal(rows: DataFrame) -> DataFrame:
    """Customers with all four signals, highest churn first."""
    return rows.dropna(subset=["churn_prob", "segment_name", "uplift_ite", "top3_recommendations"]).orderBy(
        F.col("churn_prob").desc(), "customer_id"
    )


def lookup(rows: DataFrame, customer: str) -> DataFrame:
    return rows.filter(F.col("customer_id") == customer)
