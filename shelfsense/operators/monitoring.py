"""Drift and alerting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsense.functions.distributions import kolmogorov_tail
from shelfsense.operators import ordered
from shelfsense.operators.quality import union_all


def _long(df: DataFrame, columns: Sequence[str], current: Column) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(F.coalesce(current, F.lit(False)).alias("cur"), F.inline(cells)).filter("x is not null")


def stability_index(df: DataFrame, columns: Sequence[str], current: Column, bins: int = 10) -> DataFrame:
    """Population stability index per column over equal-width bins of the reference range.

    Values outside that range count in the denominator only; empty shares are floored.
    """
    long = _long(df, columns, current)
    ref = F.when(~F.col("cur"), F.col("x"))
    bounds = long.groupBy("feature").agg(
        F.min(ref).alias("lo"),
        F.max(ref).alias("hi"),
        F.count(ref).alias("n_ref"),
        F.count_if("cur").alias("n_cur"),
    )
    # One row per monitored column.
    tagged = long.join(F.broadcast(bounds), "feature")
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    step = F.when((x < lo) | (x > hi) | (hi == lo), None).otherwise(
        F.least(F.lit(bins - 1), F.floor((x - lo) / ((hi - lo) / bins)))
    )
    counts = tagged.groupBy("feature", step.alias("bin")).agg(
        F.count_if(~F.col("cur")).alias("ref"), F.count_if("cur").alias("now")
    )
    grid = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    full = grid.join(counts, ["feature", "bin"], "left")
    p = F.greatest(F.coalesce("ref", F.lit(0)) / F.col("n_ref"), F.lit(1e-4))
    q = F.greatest(F.coalesce("now", F.lit(0)) / F.col("n_cur"), F.lit(1e-4))
    return full.groupBy("feature").agg(
        F.max("n_ref").alias("n_ref"),
        F.max("n_cur").alias("n_cur"),
        F.when(F.max("lo") == F.max("hi"), 0.0).otherwise(F.sum((q - p) * F.ln(q / p))).alias("psi"),
    )


def ks_statistic(df: DataFrame, columns: Sequence[str], current: Column) -> DataFrame:
    """Largest distance of the two empirical distributions per column."""
    counts = _long(df, columns, current).groupBy("feature", "x").agg(
        F.count_if(~F.col("cur")).alias("ref"), F.count_if("cur").alias("now")
    )
    s = ordered.positions(counts, ["feature"], ["x"], sums={"ref": "ref", "now": "now"})
    gap = F.abs(
        (F.col("ref_before") + F.col("ref")) / F.col("ref_total")
        - (F.col("now_before") + F.col("now")) / F.col("now_total")
    )
    return s.filter("ref_total > 0 and now_total > 0").groupBy("feature").agg(
        F.max("ref_total").alias("n_ref"), F.max("now_total").alias("n_cur"), F.max(gap).alias("ks_stat")
    )


def ks_test(df: DataFrame, columns: Sequence[str], current: Column) -> DataFrame:
    """The statistic with its asymptotic p value (one row per column passes the driver)."""
    rows = [
        (r.feature, r.n_ref, r.n_cur, r.ks_stat, kolmogorov_tail(r.ks_stat, r.n_ref, r.n_cur))
        for r in ks_statistic(df, columns, current).collect()
    ]
    return df.sparkSession.createDataFrame(
        rows, "feature string, n_ref long, n_cur long, ks_stat double, ks_pval double"
    )


def drift_table(df: DataFrame, mart: str, columns: Sequence[str], current: Column, least: int = 30) -> DataFrame:
    """Means, KS, PSI and a status per column; columns with too few values on a side are skipped."""
    means = _long(df, columns, current).groupBy("feature").agg(
        F.avg(F.when(~F.col("cur"), F.col("x"))).alias("ref_mean"), F.avg(F.when(F.col("cur"), F.col("x"))).alias("cur_mean")
    )
    psi = stability_index(df, columns, current).filter((F.col("n_ref") >= least) & (F.col("n_cur") >= least))
    ks = ks_test(df, columns, current).select("feature", "ks_stat", "ks_pval")
    t = psi.join(ks, "feature").join(means, "feature")
    p, v = F.col("ks_pval"), F.col("psi")
    return t.select(
        F.lit(mart).alias("mart"),
        "feature",
        "ref_mean",
        "cur_mean",
        ((F.col("cur_mean") - F.col("ref_mean")) / (F.abs("ref_mean") + 1e-6) * 100).alias("mean_delta_pct"),
        "ks_stat",
        "ks_pval",
        "psi",
        F.when(v > 0.20, "major").when(v > 0.10, "moderate").otherwise("stable").alias("psi_band"),
        F.when((v > 0.20) | (p < 0.01), "ALERT").when((v > 0.10) | (p < 0.05), "WARN").otherwise("OK").alias("status"),
    )


# Pipeline, metric, baseline, warning and alert threshold. The alert lies on the
# bad side of the warning, which gives the direction.
ALERT_RULES = [
    ("P01 Churn", "AUC-ROC", 0.8960, 0.870, 0.850),
    ("P01 Churn", "Precision@0.3_threshold", 0.432, 0.380, 0.330),
    ("P02 Uplift", "Top3Decile_uplift", 0.180, 0.130, 0.100),
    ("P02 Uplift", "ATE_test", 0.043, 0.020, 0.000),
    ("P03 Forecast", "RMSE", 1.850, 2.300, 2.700),
    ("P03 Forecast", "SMAPE_pct", 50.5, 60.0, 70.0),
    ("P04 Segmentation", "Silhouette", 0.2515, 0.200, 0.180),
    ("P04 Segmentation", "Champions_segment_size_pct", 17.0, 10.0, 5.0),
    ("P05 Recommendations", "HitRate@10", 0.0104, 0.0080, 0.0060),
    ("P06 Anomaly", "Daily_flag_rate_pct", 1.00, 3.00, 5.00),
    ("P06 Anomaly", "Daily_flag_rate_pct_floor", 1.00, 0.40, 0.20),
]


def evaluate_alerts(metrics: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Each rule's metric from (pipeline, metric, value) rows against its thresholds, two tiers, either
    direction; MISSING where no value is given."""
    if rules is None:
        rules = metrics.sparkSession.createDataFrame(
            ALERT_RULES,
            "pipeline string, metric string, baseline double, warn_threshold double, alert_threshold double",
        )
    v, warn, alert = F.col("value"), F.col("warn_threshold"), F.col("alert_threshold")
    high_is_bad = alert > warn
    bad = lambda limit: F.when(high_is_bad, v >= limit).otherwise(v <= limit)
    return metrics.join(rules, ["pipeline", "metric"], "right").select(
        "pipeline",
        "metric",
        "value",
        "baseline",
        "warn_threshold",
        "alert_threshold",
        F.when(v.isNull(), "MISSING").when(bad(alert), "ALERT").when(bad(warn), "WARN").otherwise("OK").alias("status"),
    )


def best_per_workload(frames: dict[str, tuple[DataFrame, str, str, bool]]) -> DataFrame:
    """Best model per workload: ``{workload: (table, model column, metric column, higher is better)}``."""
    parts = []
    for workload, (table, model, metric, higher) in frames.items():
        pick = F.max_by if higher else F.min_by
        value = F.max(metric) if higher else F.min(metric)
        parts.append(
            table.agg(pick(model, metric).alias("model"), value.cast("double").alias("value")).select(
                F.lit(workload).alias("workload"), F.lit(metric).alias("metric"), "model", "value"
            )
        )
    return union_all(parts)
