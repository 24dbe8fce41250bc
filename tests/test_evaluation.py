"""Evaluation, monitoring, statistics and decisions on hand-computed rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfsense.functions import distributions as dist
from shelfsense.operators import bootstrap, decisions, evaluation as E, monitoring as MON, stats as ST


def _auc(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    pos, neg = y == 1, y == 0
    diff = s[pos][:, None] - s[neg][None, :]
    return float(((w[pos][:, None] * w[neg][None, :]) * ((diff > 0) + 0.5 * (diff == 0))).sum() / (w[pos].sum() * w[neg].sum()))


def test_confusion_at_a_threshold(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.3), (0, 0.2), (1, 0.6)], "y int, s double")
    r = E.threshold_table(df, "s", "y", [0.5]).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 0, 1, 2)
    assert r.precision == 1.0 and r.recall == pytest.approx(2 / 3)


def test_threshold_choice(spark):
    table = spark.createDataFrame(
        [(0.3, 0.4, 0.9, 0.55, 0.1), (0.5, 0.6, 0.7, 0.65, 0.2), (0.7, 0.9, 0.3, 0.45, 0.3)],
        "threshold double, precision double, recall double, f1 double, specificity double",
    )
    got = {r.selection_rule: r.threshold for r in E.choose_threshold(table, 0.70).collect()}
    assert got == {"max_f1": 0.5, "precision_floor_0_70": 0.7}
    assert [r.selection_rule for r in E.choose_threshold(table, 0.95).collect()] == ["max_f1"]


def test_flag_rate_threshold_is_a_linear_percentile(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (0, 0.3), (0, 0.4), (1, 0.9)], "y int, s double")
    r = E.flag_rate_quality(df, "s", "y", [0.2]).first()
    assert r.threshold == pytest.approx(np.percentile([0.1, 0.2, 0.3, 0.4, 0.9], 80)) and r.flagged == 1
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.3), (0, 0.2), (0, 0.1)], "y int, s double")
    r = E.flag_rate_quality(df, "s", "y", [0.4]).first()
    assert (r.flagged, r.precision, r.recall) == (2, 0.5, 0.5)


def test_both_smape_rules(spark):
    df = spark.createDataFrame([(10.0, 5.0), (0.0, 0.0)], "y double, p double")
    r = E.forecast_errors(df, "y", "p").first()
    assert r.smape == pytest.approx(2 / 3) and r.smape_zero_counts == pytest.approx(1 / 3)


def test_category_errors(spark):
    rows = [("fashion", 10, 12.0), ("fashion", 20, 18.0), ("beauty", 5, 5.0), ("beauty", 15, 10.0)]
    df = spark.createDataFrame(rows, "category string, y int, p double")
    r = {x.category: x for x in E.forecast_errors(df, "y", "p", ["category"]).collect()}
    assert r["fashion"].n == 2 and r["fashion"].mean_bias == 0.0


def test_ranking_quality_with_ties(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 20, 300) / 20
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    r = E.ranking_quality(df, "s", "y").first()
    assert r.roc_auc == pytest.approx(_auc(y, s))
    cuts = np.sort(np.unique(s))[::-1]
    ap = sum((y[s == c].sum() / y.sum()) * (y[s >= c].mean()) for c in cuts)
    assert r.average_precision == pytest.approx(ap)


def test_bootstrap_draws_equal_weighted_auc(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": [f"r{i}" for i in range(200)], "y": rng.integers(0, 2, 200), "s": rng.integers(0, 30, 200) / 30})
    df = spark.createDataFrame(pdf)
    got = bootstrap.auc_draws(df, "s", "y", ["id"], draws=20).toPandas().set_index("draw")["auc"]
    hashes = df.select("id", F.xxhash64(F.lit(42), "id").alias("h")).toPandas().set_index("id")["h"]
    w = bootstrap.poisson_weights(hashes.loc[pdf["id"]].to_numpy(), np.arange(21))
    for d in range(21):
        assert got[d] == pytest.approx(_auc(pdf["y"].to_numpy(), pdf["s"].to_numpy(), w[:, d]))
    assert abs(w[:, 1:].mean() - 1.0) < 0.1


@pytest.mark.parametrize("chunks", [1, 2, 9, 40])
def test_a_score_of_half_the_rows_spreads_over_chunks(spark, chunks):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"id": np.arange(300).astype(str), "y": rng.integers(0, 2, 300)})
    pdf["s"] = np.where(rng.random(300) < 0.5, 0.4, rng.integers(0, 8, 300) / 8.0)
    df = spark.createDataFrame(pdf)
    odd = spark.createDataFrame([("x", 1, None), ("y", 0, float("nan")), ("z", None, 0.9)], "id string, y long, s double")
    got = bootstrap.auc_draws(df.unionByName(odd), "s", "y", ["id"], draws=12, chunks=chunks).toPandas().set_index("draw")["auc"]
    hashes = df.select("id", F.xxhash64(F.lit(42), "id").alias("h")).toPandas().set_index("id")["h"]
    w = bootstrap.poisson_weights(hashes.loc[pdf["id"]].to_numpy(), np.arange(13))
    for d in range(13):
        assert got[d] == pytest.approx(_auc(pdf["y"].to_numpy(), pdf["s"].to_numpy(), w[:, d]))
    assert bootstrap.auc_draws(odd, "s", "y", ["id"], draws=3, chunks=chunks).count() == 0


def test_the_hot_score_of_a_bootstrap_reaches_several_tasks(spark):
    df = spark.range(4000).select(F.lit(0.5).alias("s"), F.xxhash64("id").alias("row_hash"))
    sizes = df.repartitionByRange(6, "s", "row_hash").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) == 6 and sizes.max() < 1200


def test_paired_lift_verdict(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    pdf = pd.DataFrame({"id": np.arange(400).astype(str), "y": y, "good": y + rng.normal(0, 0.5, 400), "bad": rng.random(400)})
    df = spark.createDataFrame(pdf)
    r = bootstrap.paired_lift(df, "good", "bad", "y", ["id"], draws=200).first()
    assert r.verdict == "adds value" and r.ci95_low <= r.lift <= r.ci95_high and r.share_positive == 1.0
    assert bootstrap.paired_lift(df, "bad", "good", "y", ["id"], draws=200).first().verdict == "does not beat baseline"


def _deciles(spark, effects):
    rows = [(i + 1, 100, 50, 50, 0.2 + e, 0.2, float(e), 1.0 - i / 10) for i, e in enumerate(effects)]
    return spark.createDataFrame(
        rows,
        "decile int, n_total long, n_treatment long, n_control long, response_rate_treatment double,"
        " response_rate_control double, observed_uplift double, mean_score double",
    )


def test_targeting_depth_is_the_unbroken_run(spark):
    d = _deciles(spark, [0.2, 0.15, 0.01, 0.3, 0, 0, 0, 0, 0, 0])
    assert decisions.targeting_depth(d).first()["target_depth"] == 2
    low = _deciles(spark, [0.0, 0.2, 0.2, 0, 0, 0, 0, 0, 0, 0])
    assert decisions.targeting_depth(low).first()["target_depth"] == 1


def test_uplift_summary_area(spark):
    effects = [0.3, 0.2, 0.1, 0.1, 0.0, 0.0, 0.05, 0.0, -0.1, 0.0]
    r = E.uplift_summary(_deciles(spark, effects)).first()
    gain = np.array(effects) * 50
    area = np.trapezoid(np.cumsum(gain) - np.linspace(0, gain.sum(), 10))
    assert r.qini_like_area == pytest.approx(area)
    assert r.top3 == pytest.approx(0.2) and r.overall_effect == pytest.approx(np.mean(effects))


def test_actions(spark):
    rows = [(0.9, 0.1, "Loyal", "a"), (0.9, -0.1, "Loyal", "a"), (0.1, 0.1, "Loyal", "a"), (0.1, 0.1, "X", "a"), (None, 0.1, "X", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "churn_prob double, uplift_ite double, segment_name string, top3_recommendations string")
    got = [r.a for r in df.select(decisions.action().alias("a")).collect()]
    assert got == [decisions.OFFER_NOW, decisions.NO_DISCOUNT, decisions.CROSS_SELL, decisions.GROWTH + " + recs", decisions.GROWTH, decisions.MONITOR]


def test_psi_and_ks_against_numpy(spark):
    rng = np.random.default_rng(4)
    ref, cur = rng.normal(0, 1, 500), rng.normal(0.5, 1.5, 300)
    pdf = pd.DataFrame({"x": np.r_[ref, cur], "cur": [False] * 500 + [True] * 300})
    df = spark.createDataFrame(pdf)
    bins = np.linspace(ref.min(), ref.max(), 11)
    p = np.clip(np.histogram(ref, bins)[0] / 500, 1e-4, None)
    q = np.clip(np.histogram(cur, bins)[0] / 300, 1e-4, None)
    assert MON.stability_index(df, ["x"], F.col("cur")).first().psi == pytest.approx(float(((q - p) * np.log(q / p)).sum()))
    grid = np.sort(pdf["x"])
    ks = np.abs(np.searchsorted(np.sort(ref), grid, "right") / 500 - np.searchsorted(np.sort(cur), grid, "right") / 300).max()
    r = MON.ks_test(df, ["x"], F.col("cur")).first()
    assert r.ks_stat == pytest.approx(ks) and 0 <= r.ks_pval < 0.01


def test_alert_direction_follows_the_thresholds(spark):
    m = spark.createDataFrame(
        [("P01 Churn", "AUC-ROC", 0.86), ("P03 Forecast", "RMSE", 2.8), ("P02 Uplift", "ATE_test", 0.05), ("P06 Anomaly", "Daily_flag_rate_pct", None)],
        "pipeline string, metric string, value double",
    )
    got = {r.metric: r.status for r in MON.evaluate_alerts(m).collect()}
    missing = [metric for _, metric, *_ in MON.ALERT_RULES if metric not in ("AUC-ROC", "RMSE", "ATE_test")]
    assert got == {"AUC-ROC": "WARN", "RMSE": "ALERT", "ATE_test": "OK", **dict.fromkeys(missing, "MISSING")} and len(got) == 11


def test_spearman_equals_rank_correlation(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.integers(0, 5, 200), "b": rng.integers(0, 9, 200)})
    r = ST.spearman_pairs(spark.createDataFrame(pdf), [("a", "b")]).first()
    assert r.spearman_r == pytest.approx(pdf["a"].rank().corr(pdf["b"].rank()))


def test_spearman_of_many_pairs_with_null_patterns(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.integers(0, 12, (300, 5)).astype(float), columns=list("abcde"))
    pdf["c"] += pdf["a"]
    pdf["f"] = 1.0
    for name, share in (("b", 0.3), ("d", 0.6)):
        pdf.loc[rng.random(300) < share, name] = np.nan
    pdf.loc[pdf["d"].isna(), "e"] = np.nan  # the same rows as d
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, e double, f double")
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("d", "e"), ("a", "e"), ("e", "a"), ("a", "f")]
    got = {(r.left_col, r.right_col): r for r in ST.spearman_pairs(df, pairs).collect()}
    assert set(got) == set(pairs) and got["a", "f"].spearman_r is None
    for x, y in pairs[:-1]:
        both = pdf[[x, y]].dropna()
        assert got[x, y].n_pairs == len(both)
        assert got[x, y].spearman_r == pytest.approx(both[x].rank().corr(both[y].rank()))
    assert ST.spearman_pairs(df, pairs, least=200).count() == sum(len(pdf[[x, y]].dropna()) >= 200 for x, y in pairs)
    assert ST.spearman_pairs(df.limit(0), pairs).count() == 0


def test_tail_probabilities():
    assert dist.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert dist.student_t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-4)
    assert dist.beta_quantile(0.5, 2, 2) == pytest.approx(0.5)
    assert dist.kolmogorov_tail(0.0, 10, 10) == 1.0


def test_recheck_status(spark):
    fresh = spark.createDataFrame([("a", 1.1), ("b", 2.0)], "metric string, value double")
    old = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "metric string, value double")
    assert {r.metric: r.status for r in E.recheck(fresh, old).collect()} == {"a": "OK", "b": "WARN", "c": "MISSING"}
