"""Model evaluation as aggregations over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.functions.columns import guarded_ratio
from shelfsense.operators import ordered
from shelfsense.operators.joins import with_scalar

DEFAULT_THRESHOLDS = [round(0.10 + 0.05 * i, 2) for i in range(17)]


def score_steps(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with positives and negatives at, below and in total."""
    y = F.col(label).cast("int")
    counted = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*keys, F.col(score).cast("double").alias("score"))
        .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    )
    return ordered.positions(counted, list(keys), ["score"], sums={"pos": "pos", "neg": "neg"})


def ranking_quality(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision per key group."""
    s = score_steps(df, score, label, keys)
    pos, neg = F.col("pos"), F.col("neg")
    # Falling score: everything not strictly below this score.
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    agg = s.groupBy(*keys).agg(
        F.sum((pos * (F.col("neg_before") + neg / 2.0)).cast("double")).alias("_wins"),
        F.sum(pos / F.col("pos_total") * (tp / (tp + fp))).alias("average_precision"),
        F.max("pos_total").alias("positives"),
        F.max("neg_total").alias("negatives"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return agg.withColumn("roc_auc", F.when(pairs > 0, F.col("_wins") / pairs)).drop("_wins")


def precision_recall_points(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    s = score_steps(df, score, label, keys)
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    return s.select(
        *keys,
        F.col("score").alias("threshold"),
        (tp / (tp + fp)).alias("precision"),
        guarded_ratio(tp, F.col("pos_total")).alias("recall"),
    )


def _confusion(score: Column, y: Column, cut: Column | float) -> dict[str, Column]:
    hit = score >= cut
    return {
        "tp": F.count_if(hit & (y == 1)),
        "fp": F.count_if(hit & (y == 0)),
        "tn": F.count_if(~hit & (y == 0)),
        "fn": F.count_if(~hit & (y == 1)),
    }


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    df = df.withColumn("precision", guarded_ratio(tp, tp + fp, 0.0)).withColumn("recall", guarded_ratio(tp, tp + fn, 0.0))
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", guarded_ratio(2 * p * r, p + r, 0.0)).withColumn(
        "specificity", guarded_ratio(tn, tn + fp, 0.0)
    )


def classification_summary(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Log-loss, Brier, and accuracy, balanced accuracy and MCC at a cut of one half."""
    s, y = F.col(score).cast("double"), F.col(label).cast("int")
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), s))
    agg = df.groupBy(*keys).agg(
        F.count("*").alias("n_test"),
        F.avg(y).alias("positive_rate"),
        F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"),
        F.avg((s - y) * (s - y)).alias("brier_score"),
        *[c.alias(n) for n, c in _confusion(s, y, 0.5).items()],
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return agg.select(
        *keys,
        "n_test",
        "positive_rate",
        "log_loss",
        "brier_score",
        ((tp + tn) / F.col("n_test")).alias("accuracy"),
        ((guarded_ratio(tp, tp + fn, 0.0) + guarded_ratio(tn, tn + fp, 0.0)) / 2).alias("balanced_accuracy"),
        guarded_ratio(tp * tn - fp * fn, spread, 0.0).alias("mcc"),
    )


def threshold_table(df: DataFrame, score: str, label: str, thresholds: Sequence[float] | None = None) -> DataFrame:
    """Confusion counts and rates per cut-off.

    Rows are counted per (score step, class) first, so the cut-offs multiply at most
    ``len(thresholds) + 1`` steps.
    """
    cuts = sorted(DEFAULT_THRESHOLDS if thresholds is None else thresholds)
    s = F.col(score).cast("double")
    step = sum((F.when(s >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    counts = df.groupBy(step.alias("step")).agg(
        F.count_if(F.col(label).cast("int") == 1).alias("pos"), F.count_if(F.col(label).cast("int") == 0).alias("neg")
    )
    per_cut = counts.select(
        F.inline(F.array(*[F.struct(F.lit(float(c)).alias("threshold"), F.lit(i + 1).alias("nth")) for i, c in enumerate(cuts)])),
        "step",
        "pos",
        "neg",
    )
    hit = F.col("step") >= F.col("nth")
    table = per_cut.groupBy("threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
    )
    everyone = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return _rates(table).withColumn("positive_rate", (F.col("tp") + F.col("fp")) / everyone)


def choose_threshold(table: DataFrame, precision_floor: float = 0.70) -> DataFrame:
    """Best F1, and best recall among cut-offs that reach the precision floor (if any does).

    Ties go to the lowest cut-off. The table has one row per cut-off.
    """
    keep = ["threshold", "precision", "recall", "f1", "specificity"]
    best = table.orderBy(F.col("f1").desc(), "threshold").limit(1).select(F.lit("max_f1").alias("selection_rule"), *keep)
    label = f"precision_floor_{precision_floor:.2f}".replace(".", "_")
    floor = (
        table.filter(F.col("precision") >= precision_floor)
        .orderBy(F.col("recall").desc(), "threshold")
        .limit(1)
        .select(F.lit(label).alias("selection_rule"), *keep)
    )
    return best.unionByName(floor)


def flag_rate_quality(df: DataFrame, score: str, label: str, rates: Sequence[float]) -> DataFrame:
    """Precision, recall and F1 when the top share of scores is flagged."""
    cuts = ordered.quantile_values(df, [score], [1.0 - r for r in rates]).get(score)
    spark = df.sparkSession
    if cuts is None:
        return spark.createDataFrame([], "flag_rate double, threshold double, flagged long, precision double, recall double, f1 double")
    s, y = F.col(score).cast("double"), F.col(label).cast("int")
    parts = []
    for i, cut in enumerate(cuts):
        for name, c in _confusion(s, y, cut).items():
            parts.append(c.alias(f"{name}{i}"))
    one = df.agg(*parts)
    rows = [
        F.struct(
            F.lit(float(r)).alias("flag_rate"),
            F.lit(float(cuts[i])).alias("threshold"),
            *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "tn", "fn")],
        )
        for i, r in enumerate(rates)
    ]
    table = _rates(one.select(F.inline(F.array(*rows))))
    return table.select("flag_rate", "threshold", (F.col("tp") + F.col("fp")).alias("flagged"), "precision", "recall", "f1")


def forecast_errors(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, bias and both sMAPE rules (zero denominators dropped, or counted as zero)."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    err, size = p - y, F.abs(y) + F.abs(p)
    part = F.when(size > 0, 2 * F.abs(err) / size)
    return (
        df.filter(y.isNotNull() & p.isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.avg(F.abs(err)).alias("mae"),
            F.sqrt(F.avg(err * err)).alias("rmse"),
            F.avg(part).alias("smape"),
            F.avg(F.coalesce(part, F.lit(0.0))).alias("smape_zero_counts"),
            F.avg(err).alias("mean_bias"),
        )
    )


def weekly_residuals(df: DataFrame, actual: str, predicted: str, time: str = "week_start_date") -> DataFrame:
    weekly = df.groupBy(time).agg(
        F.sum(F.col(actual).cast("double")).alias("actual"), F.sum(F.col(predicted).cast("double")).alias("predicted")
    )
    # One row per week from here on.
    last4 = Window.orderBy(time).rowsBetween(-3, 0)
    return weekly.withColumn("residual", F.col("actual") - F.col("predicted")).withColumn(
        "rolling_residual", F.avg("residual").over(last4)
    )


def reliability(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean score and observed rate in quantile bins of the score (right-open, last one closed)."""
    probs = [i / bins for i in range(bins + 1)]
    edges = ordered.quantile_values(df, [score], probs)[score]
    s = F.col(score).cast("double")
    # Bin of a score: how many inner edges lie at or below it.
    nth = sum((F.when(s >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return df.groupBy(nth.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(s).alias("mean_predicted"), F.avg(F.col(label).cast("int")).alias("observed_fraction")
    )


# --- uplift ------------------------------------------------------------------------------


def uplift_deciles(df: DataFrame, score: str, label: str, treated: str, ids: list[str], bins: int = 10) -> DataFrame:
    """Observed effect per bin of the falling score, with the running mean of the effects."""
    placed = ordered.positions(df, [], [F.col(score).desc(), *ids])
    t, y = F.col(treated).cast("int"), F.col(label).cast("int")
    table = (
        placed.withColumn("decile", ordered.rank_bin(F.col("rows_before"), F.col("rows_total"), bins))
        .groupBy("decile")
        .agg(
            F.count("*").alias("n_total"),
            F.sum(t).alias("n_treatment"),
            F.sum(1 - t).alias("n_control"),
            F.avg(F.when(t == 1, y)).alias("response_rate_treatment"),
            F.avg(F.when(t == 0, y)).alias("response_rate_control"),
            F.avg(score).alias("mean_score"),
        )
        .withColumn("observed_uplift", F.col("response_rate_treatment") - F.col("response_rate_control"))
    )
    along = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)  # ten rows
    return table.withColumn(
        "cumulative_observed_uplift",
        F.sum(F.coalesce("observed_uplift", F.lit(0.0))).over(along) / F.col("decile"),
    )


def overall_effect(df: DataFrame, label: str, treated: str, keys: Sequence[str] = ()) -> DataFrame:
    t, y = F.col(treated).cast("int"), F.col(label).cast("int")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(t).alias("n_treatment"),
        F.sum(1 - t).alias("n_control"),
        F.avg(F.when(t == 1, y)).alias("response_treatment"),
        F.avg(F.when(t == 0, y)).alias("response_control"),
        (F.avg(F.when(t == 1, y)) - F.avg(F.when(t == 0, y))).alias("effect"),
    )


def _small_rank(column: str) -> Column:
    """Average rank inside a table of a few rows."""
    w = Window.orderBy(column)
    ties = Window.partitionBy(column)
    return F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0


def decile_rank_correlation(deciles: DataFrame) -> DataFrame:
    valid = deciles.filter("observed_uplift is not null")
    ranked = valid.select(_small_rank("mean_score").alias("a"), _small_rank("observed_uplift").alias("b"))
    return ranked.agg(F.when(F.count("*") >= 3, F.corr("a", "b")).alias("rank_correlation"))


def uplift_summary(deciles: DataFrame, bins: int = 10) -> DataFrame:
    """Top-bin effects, overall effect and the area between the cumulative incremental responses
    and a straight line from zero to their total (unit steps, trapezoids)."""
    gain = F.coalesce(F.col("observed_uplift") * F.col("n_treatment"), F.lit(0.0))
    along = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)  # ten rows
    d = deciles.withColumn("gain", gain).withColumn("cum", F.sum(gain).over(along))
    d = with_scalar(d, d.agg(F.sum("gain").alias("all_gain")), "all_gain")
    over = F.col("cum") - F.col("all_gain") * (F.col("decile") - 1) / (bins - 1)
    weight = F.when(F.col("decile").isin(1, bins), 0.5).otherwise(1.0)
    nt, nc = F.col("n_treatment"), F.col("n_control")
    summary = d.agg(
        F.sum("n_total").alias("test_rows"),
        (
            F.sum(F.col("response_rate_treatment") * nt) / F.sum(nt)
            - F.sum(F.col("response_rate_control") * nc) / F.sum(nc)
        ).alias("overall_effect"),
        F.avg(F.when(F.col("decile") == 1, F.col("observed_uplift"))).alias("top1"),
        F.avg(F.when(F.col("decile") <= 3, F.col("observed_uplift"))).alias("top3"),
        F.avg(F.when(F.col("decile") <= 5, F.col("observed_uplift"))).alias("top5"),
        F.sum(over * weight).alias("qini_like_area"),
    )
    return with_scalar(summary, decile_rank_correlation(deciles), "rank_correlation")


def uplift_summary_weighted(deciles: DataFrame, bins: int = 10) -> DataFrame:
    """The other form: effects weighted by bin size, area of cumulative responses over the share."""
    gain = F.col("observed_uplift") * F.col("n_total")
    along = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)  # ten rows
    d = deciles.withColumn("gain", gain).withColumn("cum", F.sum(gain).over(along))

    def top(k):
        inside = F.when(F.col("decile") <= k, F.col("n_total"))
        return F.sum(F.col("observed_uplift") * inside) / F.sum(inside)

    weight = F.when(F.col("decile").isin(1, bins), 0.5).otherwise(1.0)
    return d.agg(
        top(3).alias("top3"),
        top(5).alias("top5"),
        F.sum("gain").alias("incremental_responses"),
        (F.sum(F.col("cum") * weight) / bins).alias("qini_like_area"),
    )


def decile_monotonicity(deciles: DataFrame, bins: int = 10) -> DataFrame:
    """Rank correlation of bin number and effect, and top against bottom bin."""
    ranked = deciles.filter("observed_uplift is not null").select(
        F.col("decile").cast("double").alias("a"), _small_rank("observed_uplift").alias("b"), "decile", "observed_uplift"
    )
    return ranked.agg(
        F.corr("a", "b").alias("rank_correlation"),
        F.max(F.when(F.col("decile") == 1, F.col("observed_uplift"))).alias("top"),
        F.max(F.when(F.col("decile") == bins, F.col("observed_uplift"))).alias("bottom"),
    ).withColumn("gap", F.col("top") - F.col("bottom"))


# --- comparisons -------------------------------------------------------------------------


def to_metric_rows(one_row: DataFrame, value: str) -> DataFrame:
    names = one_row.columns
    return one_row.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "metric", value)


def against_baseline(result: DataFrame, baseline: DataFrame) -> DataFrame:
    """Metric by metric: result, baseline and the difference. Both are one-row frames."""
    both = to_metric_rows(result, "result").join(to_metric_rows(baseline, "baseline"), "metric")
    return both.withColumn("delta", F.col("result") - F.col("baseline"))


def recheck(fresh: DataFrame, stored: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """(metric, value) rows against stored ones: OK, WARN or MISSING by relative difference."""
    old = stored.select("metric", F.col("value").alias("stored"))
    both = old.join(fresh.select("metric", F.col("value").alias("fresh")), "metric", "left")
    gap = F.abs(F.col("fresh") - F.col("stored")) / F.greatest(F.abs("stored"), F.lit(1e-9))
    return both.withColumn("relative_delta", gap).withColumn(
        "status", F.when(F.col("fresh").isNull(), "MISSING").when(gap <= tolerance, "OK").otherwise("WARN")
    )


def hit_rate(top: DataFrame, truth: DataFrame, ks: Sequence[int], user: str, item: str, rank: str) -> DataFrame:
    """Hit rate and mean reciprocal rank of the first hit at each K over all users with truth."""
    people = truth.select(user).distinct()
    first = (
        top.join(truth.select(user, item), [user, item], "left_semi").groupBy(user).agg(F.min(rank).alias("first_hit"))
    )
    seen = people.join(first, user, "left")
    parts = [F.count("*").alias("n_evaluated")]
    for k in ks:
        inside = F.col("first_hit") <= k
        parts.append(F.avg(F.when(inside, 1.0).otherwise(0.0)).alias(f"hit{k}"))
        parts.append(F.avg(F.when(inside, 1.0 / F.col("first_hit")).otherwise(0.0)).alias(f"mrr{k}"))
    one = seen.agg(*parts)
    rows = [
        F.struct(F.lit(k).alias("k"), F.col(f"hit{k}").alias("hit_rate"), F.col(f"mrr{k}").alias("mrr")) for k in ks
    ]
    return one.select("n_evaluated", F.inline(F.array(*rows)))
