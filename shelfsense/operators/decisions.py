"""Decisions taken from model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.operators.joins import with_scalar

# The actions a customer can be given.
OFFER_NOW = "Retention offer NOW + personalised recs (high churn, responds to offers)"
NO_DISCOUNT = "At risk but offer-insensitive: try service/loyalty touch, not discount"
CROSS_SELL = "Low risk, high value: cross-sell via recs, no discount needed"
GROWTH = "Growth target: include in next campaign"
MONITOR = "Monitor: no strong action this cycle"
VALUABLE_SEGMENTS = ["Champions", "Loyal"]


def targeting_depth(deciles: DataFrame) -> DataFrame:
    """Per decile: own effect against the population effect, cumulative band and the chosen depth.

    The depth is the last decile of the unbroken run from the top whose own effect is above the
    population effect, and at least one. The table has one row per decile.
    """
    nt, nc = F.col("n_treatment"), F.col("n_control")
    base = deciles.agg(
        (
            F.sum(F.col("response_rate_treatment") * nt) / F.sum(nt)
            - F.sum(F.col("response_rate_control") * nc) / F.sum(nc)
        ).alias("population_effect")
    )
    d = with_scalar(deciles, base, "population_effect")
    along = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.col("observed_uplift") * nt
    above = F.coalesce(F.col("observed_uplift") > F.col("population_effect"), F.lit(False))
    d = d.select(
        "decile",
        F.col("observed_uplift").alias("marginal_uplift"),
        "population_effect",
        above.alias("marginal_above_ate"),
        F.sum(nt).over(along).alias("cum_treated"),
        F.sum(gain).over(along).alias("cum_incremental"),
    ).withColumn("cum_incremental_rate", F.col("cum_incremental") / F.col("cum_treated"))
    failing = d.agg(F.min(F.when(~F.col("marginal_above_ate"), F.col("decile"))).alias("f"), F.max("decile").alias("m"))
    depth = failing.select(F.greatest(F.lit(1), F.coalesce(F.col("f") - 1, F.col("m"))).alias("target_depth"))
    return with_scalar(d, depth, "target_depth").withColumn("targeted", F.col("decile") <= F.col("target_depth"))


def action(churn: str = "churn_prob", uplift: str = "uplift_ite", segment: str = "segment_name", recs: str = "top3_recommendations") -> Column:
    """One action per customer; an unknown signal counts as absent."""
    high = F.coalesce(F.col(churn) >= 0.5, F.lit(False))
    responds = F.coalesce(F.col(uplift) > 0, F.lit(False))
    valuable = F.coalesce(F.col(segment).isin(VALUABLE_SEGMENTS), F.lit(False))
    return (
        F.when(high & responds, OFFER_NOW)
        .when(high, NO_DISCOUNT)
        .when(valuable, CROSS_SELL)
        .when(responds & F.col(recs).isNotNull(), GROWTH + " + recs")
        .when(responds, GROWTH)
        .otherwise(MONITOR)
    )


def top_ranked(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of a global order with their rank (a bounded top-k, then a small window)."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
