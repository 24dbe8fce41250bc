"""Evaluation on a deterministic score column, decisions and monitoring."""

from pyspark.sql import functions as F

from checks.registry import query
from checks.sqlbase import define
from shelfsense.operators import decisions as D
from shelfsense.operators import evaluation as E
from shelfsense.operators import monitoring as MON
from shelfsense.operators import splits as S

define(
    "scored",
    """SELECT order_item_id, return_flag AS y, order_date, return_id, item_net_price,
    CAST((CAST(substr(product_id, 2) AS BIGINT) * 7919 + CAST(substr(order_id, 2) AS BIGINT)) % 1000 AS DOUBLE) / 1000 AS s FROM b_returns""",
)
define(
    "arms",
    """SELECT campaign_id, customer_id, response_flag_30d AS y, CAST(treatment_flag AS INTEGER) AS t,
    CAST((CAST(substr(customer_id, 2) AS BIGINT) * 7919 + CAST(substr(campaign_id, 4) AS BIGINT) * 104729) % 2000 AS DOUBLE) / 1000 - 1 AS s FROM m_campaign""",
)
define(
    "ranked_arms",
    "SELECT *, row_number() OVER (ORDER BY s DESC, campaign_id, customer_id) - 1 AS i, count(*) OVER () AS n FROM arms",
)
define(
    "deciles",
    """SELECT *, avg_t - avg_c AS observed_uplift FROM (SELECT greatest(1, CAST(ceil(10.0 * i / (n - 1)) AS BIGINT)) AS decile, count(*) AS n_total,
    sum(t) AS n_treatment, sum(1 - t) AS n_control, avg(y) FILTER (WHERE t = 1) AS avg_t, avg(y) FILTER (WHERE t = 0) AS avg_c, avg(s) AS mean_score
    FROM ranked_arms GROUP BY 1)""",
)
define(
    "forecasts",
    """SELECT *, units_sold AS y, coalesce(lag_1w_units_sold, fb) AS p1, coalesce(lag_4w_units_sold, lag_1w_units_sold, fb) AS p4 FROM m_demand
    CROSS JOIN (SELECT median(units_sold) AS fb FROM m_demand WHERE week_start_date < DATE '2000-01-03') WHERE week_start_date >= DATE '2000-01-03'""",
)


def _number(column: str, start: int):
    return F.substring(column, start, 12).cast("long")


def scored(x):
    m = x.mart("returns_risk")
    raw = (_number("product_id", 2) * 7919 + _number("order_id", 2)) % 1000
    return m.withColumns({"s": raw.cast("double") / 1000, "y": F.col("return_flag")})


def arms(x):
    m = x.mart("campaign_response")
    raw = (_number("customer_id", 2) * 7919 + _number("campaign_id", 4) * 104729) % 2000
    return m.withColumns(
        {"s": raw.cast("double") / 1000 - 1, "y": F.col("response_flag_30d"), "t": F.col("treatment_flag").cast("int")}
    )


def decile_table(x):
    return x.stored("check_deciles", lambda: E.uplift_deciles(arms(x), "s", "y", "t", ["campaign_id", "customer_id"]))


def forecasts(x):
    from shelfsense.plans.forecast import naive_columns

    d = x.mart("product_demand").withColumn("is_test", F.col("week_start_date") >= F.lit("2000-01-03").cast("date"))
    return naive_columns(d).filter("is_test")


# --- classification ----------------------------------------------------------------------

_AUC = """SELECT (SELECT (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) FROM
    (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM scored)) AS roc_auc,
    (SELECT sum(pos / np * (tp / al)) FROM (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(c) OVER (ORDER BY s DESC) AS al,
      sum(pos) OVER () AS np FROM (SELECT s, sum(y) AS pos, count(*) AS c FROM scored GROUP BY 1))) AS average_precision"""


@query("ev_01_auc_average_precision", "roc_auc:f average_precision:f", _AUC)
def _(x):
    return E.ranking_quality(scored(x), "s", "y")


_CONF = """count(*) FILTER (WHERE s >= c AND y = 1) AS tp, count(*) FILTER (WHERE s >= c AND y = 0) AS fp,
    count(*) FILTER (WHERE s < c AND y = 0) AS tn, count(*) FILTER (WHERE s < c AND y = 1) AS fn"""


@query(
    "ev_02_classification_summary",
    "n_test:i positive_rate:f log_loss:f brier_score:f accuracy:f balanced_accuracy:f mcc:f",
    f"""SELECT n AS n_test, pr AS positive_rate, ll AS log_loss, br AS brier_score, (tp + tn) / n AS accuracy,
        (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy,
        (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc
        FROM (SELECT count(*) AS n, avg(y) AS pr, avg((s - y) * (s - y)) AS br,
        avg(-(y * ln(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, s))) + (1 - y) * ln(1 - greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, s))))) AS ll,
        {_CONF} FROM (SELECT *, 0.5::DOUBLE AS c FROM scored))""",
)
def _(x):
    return E.classification_summary(scored(x), "s", "y")


_TABLE = f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
    SELECT c AS threshold, tp, fp, tn, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity,
    (tp + fp) / (tp + fp + tn + fn) AS positive_rate FROM (SELECT c, {_CONF} FROM scored,
    (SELECT round(0.1 + 0.05 * k, 2)::DOUBLE AS c FROM range(17) t(k)) GROUP BY c))"""


@query(
    "ev_03_threshold_table",
    "threshold:f tp:i fp:i tn:i fn:i precision:f recall:f f1:f specificity:f positive_rate:f",
    _TABLE,
)
def _(x):
    return E.threshold_table(scored(x), "s", "y")


@query(
    "ev_04_threshold_choice",
    "selection_rule threshold:f precision:f recall:f f1:f specificity:f",
    f"""WITH d AS ({_TABLE}) SELECT * FROM (SELECT 'max_f1' AS selection_rule, threshold, precision, recall, f1, specificity FROM d ORDER BY f1 DESC, threshold LIMIT 1)
        UNION ALL SELECT * FROM (SELECT 'precision_floor_0_30', threshold, precision, recall, f1, specificity FROM d WHERE precision >= 0.3::DOUBLE ORDER BY recall DESC, threshold LIMIT 1)""",
)
def _(x):
    return E.choose_threshold(E.threshold_table(scored(x), "s", "y"), 0.30)


@query(
    "ev_05_precision_recall_curve",
    "threshold:f precision:f recall:f",
    """SELECT s AS threshold, tp / al AS precision, tp / np AS recall FROM (SELECT s, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(c) OVER (ORDER BY s DESC) AS al,
       sum(pos) OVER () AS np FROM (SELECT s, sum(y) AS pos, count(*) AS c FROM scored GROUP BY 1))""",
)
def _(x):
    return E.precision_recall_points(scored(x), "s", "y")


def _flag_sql(rates):
    return " UNION ALL ".join(
        f"""SELECT {r}::DOUBLE AS flag_rate, c AS threshold, tp + fp AS flagged, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
        2 * tp / (2 * tp + fp + fn) AS f1 FROM (SELECT c, {_CONF} FROM scored, (SELECT quantile_cont(s, 1 - {r}) AS c FROM scored) GROUP BY c)"""
        for r in rates
    )


@query("ev_06_flag_rate_quality", "flag_rate:f threshold:f flagged:i precision:f recall:f f1:f", _flag_sql([0.01]))
def _(x):
    return E.flag_rate_quality(scored(x), "s", "y", [0.01])


@query("ev_07_flag_rate_sweep", "flag_rate:f threshold:f flagged:i precision:f recall:f f1:f", _flag_sql([0.01, 0.02, 0.05]))
def _(x):
    return E.flag_rate_quality(scored(x), "s", "y", [0.01, 0.02, 0.05])


# --- forecasts ---------------------------------------------------------------------------

_ERR = """count(*) AS n, avg(abs({p} - y)) AS mae, sqrt(avg(({p} - y) * ({p} - y))) AS rmse, avg(2 * abs({p} - y) / nullif(abs({p}) + abs(y), 0)) AS smape,
    avg(coalesce(2 * abs({p} - y) / nullif(abs({p}) + abs(y), 0), 0)) AS smape_zero_counts, avg({p} - y) AS mean_bias"""


@query(
    "ev_08_forecast_errors",
    "n:i mae:f rmse:f smape:f smape_zero_counts:f mean_bias:f",
    f"SELECT {_ERR.format(p='p1')} FROM forecasts",
)
def _(x):
    return E.forecast_errors(forecasts(x), "units_sold", "naive_lag1")


@query(
    "ev_08_forecast_errors_by_category",
    "category n:i mae:f rmse:f smape:f smape_zero_counts:f mean_bias:f",
    f"SELECT category, {_ERR.format(p='p4')} FROM forecasts GROUP BY 1",
)
def _(x):
    return E.forecast_errors(forecasts(x), "units_sold", "naive_lag4", ["category"])


@query(
    "ev_09_weekly_residuals",
    "week_start_date:d actual:f predicted:f residual:f rolling_residual:f",
    """SELECT *, avg(residual) OVER (ORDER BY week_start_date ROWS 3 PRECEDING) AS rolling_residual FROM (
       SELECT week_start_date, sum(y) AS actual, sum(p1) AS predicted, sum(y) - sum(p1) AS residual FROM forecasts GROUP BY 1)""",
)
def _(x):
    return E.weekly_residuals(forecasts(x), "units_sold", "naive_lag1")


@query(
    "ml_11_naive_forecasts",
    "product_id store_id_or_online week_start_date:d naive_lag1:f naive_lag4:f naive_blend:f",
    """SELECT product_id, store_id_or_online, week_start_date, p1 AS naive_lag1, p4 AS naive_lag4, 0.7::DOUBLE * p1 + 0.3::DOUBLE * p4 AS naive_blend FROM forecasts""",
)
def _(x):
    return forecasts(x)


@query(
    "ev_19_naive_comparison",
    "forecast n:i mae:f rmse:f smape:f mean_bias:f mae_gain_pct:f",
    f"""WITH e AS (SELECT 'blend' AS forecast, {_ERR.format(p='(0.7::DOUBLE * p1 + 0.3::DOUBLE * p4)')} FROM forecasts
        UNION ALL SELECT 'last_week', count(*), avg(abs(lag_1w_units_sold - y)), sqrt(avg((lag_1w_units_sold - y) * (lag_1w_units_sold - y))),
          avg(2 * abs(lag_1w_units_sold - y) / (lag_1w_units_sold + y)), 0, avg(lag_1w_units_sold - y) FROM forecasts WHERE lag_1w_units_sold IS NOT NULL
        UNION ALL SELECT 'four_weeks', count(*), avg(abs(lag_4w_units_sold - y)), sqrt(avg((lag_4w_units_sold - y) * (lag_4w_units_sold - y))),
          avg(2 * abs(lag_4w_units_sold - y) / (lag_4w_units_sold + y)), 0, avg(lag_4w_units_sold - y) FROM forecasts WHERE lag_4w_units_sold IS NOT NULL)
        SELECT *, (mae - (SELECT mae FROM e WHERE forecast = 'blend')) / mae * 100 AS mae_gain_pct FROM e""",
)
def _(x):
    from shelfsense.plans.forecast import naive_comparison

    columns = {"blend": "naive_blend", "last_week": "lag_1w_units_sold", "four_weeks": "lag_4w_units_sold"}
    return naive_comparison(forecasts(x), columns, "blend")


@query(
    "ev_10_reliability",
    "bin:i n:i mean_predicted:f observed_fraction:f",
    """SELECT len(list_filter(q[2:-2], lambda e: s >= e)) AS bin, count(*) AS n, avg(s) AS mean_predicted, avg(y) AS observed_fraction FROM scored,
       (SELECT quantile_cont(s, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM scored) GROUP BY 1""",
)
def _(x):
    return E.reliability(scored(x), "s", "y", 10)


# --- uplift ------------------------------------------------------------------------------

_DECILE_COLS = "decile:i n_total:i n_treatment:i n_control:i response_rate_treatment:f response_rate_control:f mean_score:f observed_uplift:f"
_DECILE_SQL = "SELECT *, avg_t AS response_rate_treatment, avg_c AS response_rate_control FROM deciles"


@query(
    "ev_12_uplift_deciles",
    _DECILE_COLS + " cumulative_observed_uplift:f",
    f"SELECT *, sum(coalesce(observed_uplift, 0)) OVER (ORDER BY decile) / decile AS cumulative_observed_uplift FROM ({_DECILE_SQL})",
)
def _(x):
    return decile_table(x)


_RANKCORR = """(SELECT corr(rank_a, rank_b) FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS rank_a,
    rank() OVER (ORDER BY observed_uplift) + (count(*) OVER (PARTITION BY observed_uplift) - 1) / 2 AS rank_b FROM deciles))"""


@query(
    "ev_12_uplift_summary",
    "test_rows:i overall_effect:f top1:f top3:f top5:f qini_like_area:f rank_correlation:f",
    f"""WITH g AS (SELECT *, observed_uplift * n_treatment AS gain, sum(observed_uplift * n_treatment) OVER (ORDER BY decile) AS cum,
          sum(observed_uplift * n_treatment) OVER () AS total FROM deciles),
        h AS (SELECT decile, cum - total * (decile - 1) / 9 AS v FROM g)
        SELECT (SELECT count(*) FROM arms) AS test_rows, (SELECT avg(y) FILTER (WHERE t = 1) - avg(y) FILTER (WHERE t = 0) FROM arms) AS overall_effect,
        (SELECT observed_uplift FROM deciles WHERE decile = 1) AS top1, (SELECT avg(observed_uplift) FROM deciles WHERE decile <= 3) AS top3,
        (SELECT avg(observed_uplift) FROM deciles WHERE decile <= 5) AS top5,
        (SELECT sum((a.v + b.v) / 2) FROM h a JOIN h b ON b.decile = a.decile + 1) AS qini_like_area, {_RANKCORR.format(a='mean_score')} AS rank_correlation""",
)
def _(x):
    return E.uplift_summary(decile_table(x))


@query(
    "ev_13_weighted_uplift_summary",
    "top3:f top5:f incremental_responses:f qini_like_area:f",
    """WITH h AS (SELECT decile, sum(observed_uplift * n_total) OVER (ORDER BY decile) AS v FROM deciles)
       SELECT (SELECT sum(observed_uplift * n_total) / sum(n_total) FROM deciles WHERE decile <= 3) AS top3,
       (SELECT sum(observed_uplift * n_total) / sum(n_total) FROM deciles WHERE decile <= 5) AS top5,
       (SELECT sum(observed_uplift * n_total) FROM deciles) AS incremental_responses,
       (SELECT sum((a.v + b.v) / 2 * 0.1::DOUBLE) FROM h a JOIN h b ON b.decile = a.decile + 1) AS qini_like_area""",
)
def _(x):
    return E.uplift_summary_weighted(decile_table(x))


@query(
    "udf_02_grouped_measures",
    "campaign_id n:i n_treatment:i n_control:i response_treatment:f response_control:f effect:f",
    """SELECT campaign_id, count(*) AS n, sum(t) AS n_treatment, sum(1 - t) AS n_control, avg(y) FILTER (WHERE t = 1) AS response_treatment,
       avg(y) FILTER (WHERE t = 0) AS response_control, avg(y) FILTER (WHERE t = 1) - avg(y) FILTER (WHERE t = 0) AS effect FROM arms GROUP BY 1""",
)
def _(x):
    return E.overall_effect(arms(x), "y", "t", ["campaign_id"])


@query(
    "ev_17_campaign_effects",
    "campaign_id n:i effect:f",
    "SELECT campaign_id, count(*) AS n, avg(y) FILTER (WHERE t = 1) - avg(y) FILTER (WHERE t = 0) AS effect FROM arms GROUP BY 1",
)
def _(x):
    return E.overall_effect(arms(x), "y", "t", ["campaign_id"])


@query(
    "ev_20_decile_monotonicity",
    "rank_correlation:f top:f bottom:f gap:f",
    f"""SELECT {_RANKCORR.format(a='decile')} AS rank_correlation, a.observed_uplift AS top, b.observed_uplift AS bottom,
        a.observed_uplift - b.observed_uplift AS gap FROM deciles a, deciles b WHERE a.decile = 1 AND b.decile = 10""",
)
def _(x):
    return E.decile_monotonicity(decile_table(x))


@query(
    "ev_16_segment_metrics",
    "segments:i largest:i smallest:i churn_spread_pp:f",
    """SELECT count(*) AS segments, max(n) AS largest, min(n) AS smallest, 100 * (max(r) - min(r)) AS churn_spread_pp FROM
       (SELECT customer_value_band, count(*) AS n, avg(churn_flag_90d) AS r FROM m_customer GROUP BY 1)""",
)
def _(x):
    from shelfsense.plans.segmentation import segment_metrics, segment_profile

    return segment_metrics(segment_profile(x.mart("customer_features"), "customer_value_band", ["total_net_revenue"]))


@query(
    "ev_18_metric_recheck",
    "metric stored:f fresh:f relative_delta:f status",
    """SELECT metric, stored, fresh, abs(fresh - stored) / greatest(abs(stored), 1e-9::DOUBLE) AS relative_delta,
       CASE WHEN fresh IS NULL THEN 'MISSING' WHEN abs(fresh - stored) / greatest(abs(stored), 1e-9::DOUBLE) <= 0.25::DOUBLE THEN 'OK' ELSE 'WARN' END AS status FROM (
       SELECT region AS metric, sum(total_net_revenue) AS stored FROM m_customer WHERE tenure_days >= 1500 GROUP BY 1) LEFT JOIN
       (SELECT region AS metric, sum(total_net_revenue) AS fresh FROM m_customer WHERE tenure_days < 1500 GROUP BY 1) USING (metric)""",
)
def _(x):
    m = x.mart("customer_features").withColumn("metric", F.col("region"))
    value = F.sum("total_net_revenue").alias("value")
    return E.recheck(
        m.filter("tenure_days < 1500").groupBy("metric").agg(value), m.filter("tenure_days >= 1500").groupBy("metric").agg(value)
    )


# --- decisions ---------------------------------------------------------------------------


@query(
    "dec_01_targeting_depth",
    "decile:i marginal_uplift:f population_effect:f marginal_above_ate:b cum_treated:i cum_incremental:f cum_incremental_rate:f target_depth:i targeted:b",
    """WITH p AS (SELECT avg(y) FILTER (WHERE t = 1) - avg(y) FILTER (WHERE t = 0) AS e FROM arms),
       d AS (SELECT decile, observed_uplift AS u, n_treatment AS nt, observed_uplift > e AS above, e FROM deciles, p),
       k AS (SELECT greatest(1, coalesce(min(decile) FILTER (WHERE NOT above) - 1, 10)) AS target_depth FROM d)
       SELECT decile, u AS marginal_uplift, e AS population_effect, above AS marginal_above_ate, sum(nt) OVER w AS cum_treated, sum(u * nt) OVER w AS cum_incremental,
       sum(u * nt) OVER w / sum(nt) OVER w AS cum_incremental_rate, target_depth, decile <= target_depth AS targeted FROM d, k WINDOW w AS (ORDER BY decile)""",
)
def _(x):
    return D.targeting_depth(decile_table(x))


_ACTION_INPUT = """SELECT m.customer_id, CASE WHEN tenure_days % 7 = 0 THEN NULL ELSE (tenure_days % 100) / 100 END AS churn,
    CASE WHEN tenure_days % 5 = 0 THEN NULL ELSE (tenure_days % 11) - 5 END AS uplift,
    CASE customer_value_band WHEN 'high_value' THEN 'Champions' WHEN 'mid_value' THEN 'Loyal' ELSE 'Others' END AS seg,
    CASE WHEN total_sessions IS NOT NULL THEN 'x' END AS recs FROM m_customer m"""
_ACTION_SQL = f"""SELECT customer_id, CASE
    WHEN coalesce(churn, 0) >= 0.5::DOUBLE AND coalesce(uplift, 0) > 0 THEN '{D.OFFER_NOW}' WHEN coalesce(churn, 0) >= 0.5::DOUBLE THEN '{D.NO_DISCOUNT}'
    WHEN seg IN ('Champions', 'Loyal') THEN '{D.CROSS_SELL}' WHEN coalesce(uplift, 0) > 0 THEN '{D.GROWTH}' || CASE WHEN recs IS NULL THEN '' ELSE ' + recs' END
    ELSE '{D.MONITOR}' END AS action FROM ({_ACTION_INPUT})"""


def _action(x):
    m = x.mart("customer_features")
    t = F.col("tenure_days")
    seg = F.when(F.col("customer_value_band") == "high_value", "Champions").when(
        F.col("customer_value_band") == "mid_value", "Loyal"
    ).otherwise("Others")
    df = m.withColumns(
        {
            "churn_prob": F.when(t % 7 != 0, (t % 100) / 100.0),
            "uplift_ite": F.when(t % 5 != 0, (t % 11) - 5),
            "segment_name": seg,
            "top3_recommendations": F.when(F.col("total_sessions").isNotNull(), "x"),
        }
    )
    return df.withColumn("action", D.action())


@query("dec_02_recommended_action", "customer_id action", _ACTION_SQL)
def _(x):
    return _action(x)


@query("udf_03_row_decision_as_expression", "action n:i", f"SELECT action, count(*) AS n FROM ({_ACTION_SQL}) GROUP BY 1")
def _(x):
    return _action(x).groupBy("action").agg(F.count("*").alias("n"))


# --- monitoring --------------------------------------------------------------------------

_DRIFT = ["item_discount_pct", "refund_amount", "item_net_price"]
define(
    "drift",
    "SELECT *, row_number() OVER (ORDER BY order_date, order_item_id) > floor(count(*) OVER () * (1 - 0.3::DOUBLE)) AS cur FROM b_returns",
)


def _drift_frame(x):
    return x.stored(
        "check_drift",
        lambda: S.time_ordered(x.mart("returns_risk").select("order_item_id", "order_date", *_DRIFT), "order_date", ["order_item_id"], 0.3),
    )


def _psi_sql(c):
    return f"""SELECT '{c}' AS feature, (SELECT sum((q - p) * ln(q / p)) FROM (SELECT b, greatest(1e-4::DOUBLE, coalesce(nr, 0) / tr) AS p, greatest(1e-4::DOUBLE, coalesce(nc, 0) / tc) AS q
        FROM range(10) g(b) LEFT JOIN (SELECT least(9, CAST(floor((x - lo) / ((hi - lo) / 10)) AS BIGINT)) AS b, count(*) FILTER (WHERE NOT cur) AS nr, count(*) FILTER (WHERE cur) AS nc
          FROM (SELECT {c} AS x, cur FROM drift), (SELECT min({c}) AS lo, max({c}) AS hi FROM drift WHERE NOT cur) WHERE x BETWEEN lo AND hi GROUP BY 1) USING (b),
        (SELECT count({c}) FILTER (WHERE NOT cur) AS tr, count({c}) FILTER (WHERE cur) AS tc FROM drift))) AS psi"""


@query("mon_01_stability_index", "feature psi:f", " UNION ALL ".join(_psi_sql(c) for c in _DRIFT))
def _(x):
    return MON.stability_index(_drift_frame(x), _DRIFT, F.col("is_test"))


def _ks_sql(c):
    return f"""SELECT '{c}' AS feature, max(tr) AS n_ref, max(tc) AS n_cur, max(abs(cr / tr - cc / tc)) AS ks_stat FROM (
        SELECT sum(nr) OVER (ORDER BY x) AS cr, sum(nc) OVER (ORDER BY x) AS cc, sum(nr) OVER () AS tr, sum(nc) OVER () AS tc FROM (
        SELECT {c} AS x, count(*) FILTER (WHERE NOT cur) AS nr, count(*) FILTER (WHERE cur) AS nc FROM drift WHERE {c} IS NOT NULL GROUP BY 1))"""


def _ks_tail_sql(columns):
    """Statistics with the asymptotic probability of a larger distance, 100 terms of its series."""
    rows = " UNION ALL ".join(_ks_sql(c) for c in columns)
    return f"""SELECT feature, n_ref, n_cur, ks_stat, CASE WHEN any_value(lam) < 1e-3 THEN 1.0
          ELSE least(1.0, greatest(0.0, 2 * sum((CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * j * j * lam * lam)))) END AS ks_pval
        FROM (SELECT *, sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) * ks_stat AS lam FROM ({rows})), range(1, 101) t(j)
        GROUP BY feature, n_ref, n_cur, ks_stat"""


@query("mon_02_ks_two_sample", "feature n_ref:i n_cur:i ks_stat:f ks_pval:f", _ks_tail_sql(_DRIFT))
def _(x):
    return MON.ks_test(_drift_frame(x), _DRIFT, F.col("is_test"))


def _drift_sql(c):
    return f"""SELECT 'mart_returns_risk' AS mart, '{c}' AS feature, r AS ref_mean, k AS cur_mean, (k - r) / (abs(r) + 1e-6::DOUBLE) * 100 AS mean_delta_pct,
        ks_stat, ks_pval, psi, CASE WHEN psi > 0.2::DOUBLE THEN 'major' WHEN psi > 0.1::DOUBLE THEN 'moderate' ELSE 'stable' END AS psi_band,
        CASE WHEN psi > 0.2::DOUBLE OR ks_pval < 0.01::DOUBLE THEN 'ALERT' WHEN psi > 0.1::DOUBLE OR ks_pval < 0.05::DOUBLE THEN 'WARN' ELSE 'OK' END AS status
        FROM (SELECT avg({c}) FILTER (WHERE NOT cur) AS r, avg({c}) FILTER (WHERE cur) AS k FROM drift), (SELECT psi FROM ({_psi_sql(c)})),
        (SELECT ks_stat, ks_pval FROM ({_ks_tail_sql([c])}))"""


@query(
    "mon_03_drift_table",
    "mart feature ref_mean:f cur_mean:f mean_delta_pct:f ks_stat:f ks_pval:f psi:f psi_band status",
    " UNION ALL ".join(_drift_sql(c) for c in _DRIFT),
)
def _(x):
    return MON.drift_table(_drift_frame(x), "mart_returns_risk", _DRIFT, F.col("is_test"))


_RULES_SQL = """
    ('P01 Churn', 'AUC-ROC', 0.896::DOUBLE, 0.87::DOUBLE, 0.85::DOUBLE),
    ('P01 Churn', 'Precision@0.3_threshold', 0.432, 0.38, 0.33),
    ('P02 Uplift', 'Top3Decile_uplift', 0.18, 0.13, 0.1),
    ('P02 Uplift', 'ATE_test', 0.043, 0.02, 0),
    ('P03 Forecast', 'RMSE', 1.85, 2.3, 2.7),
    ('P03 Forecast', 'SMAPE_pct', 50.5, 60, 70),
    ('P04 Segmentation', 'Silhouette', 0.2515, 0.2, 0.18),
    ('P04 Segmentation', 'Champions_segment_size_pct', 17, 10, 5),
    ('P05 Recommendations', 'HitRate@10', 0.0104, 0.008, 0.006),
    ('P06 Anomaly', 'Daily_flag_rate_pct', 1, 3, 5),
    ('P06 Anomaly', 'Daily_flag_rate_pct_floor', 1, 0.4, 0.2)"""


@query(
    "mon_04_alert_evaluation",
    "pipeline metric value:f baseline:f warn_threshold:f alert_threshold:f status",
    f"""WITH rules(pipeline, metric, baseline, warn_threshold, alert_threshold) AS (VALUES {_RULES_SQL}),
        v AS (SELECT 'P03 Forecast' AS pipeline, 'RMSE' AS metric, sqrt(avg((p1 - y) * (p1 - y))) AS value FROM forecasts
          UNION ALL SELECT 'P02 Uplift', 'ATE_test', avg(y) FILTER (WHERE t = 1) - avg(y) FILTER (WHERE t = 0) FROM arms
          UNION ALL SELECT 'P01 Churn', 'AUC-ROC', roc_auc FROM ({_AUC}))
        SELECT pipeline, metric, value, baseline, warn_threshold, alert_threshold, CASE WHEN value IS NULL THEN 'MISSING' WHEN alert_threshold > warn_threshold THEN
          CASE WHEN value >= alert_threshold THEN 'ALERT' WHEN value >= warn_threshold THEN 'WARN' ELSE 'OK' END
          ELSE CASE WHEN value <= alert_threshold THEN 'ALERT' WHEN value <= warn_threshold THEN 'WARN' ELSE 'OK' END END AS status
        FROM rules LEFT JOIN v USING (pipeline, metric)""",
)
def _(x):
    rmse = E.forecast_errors(forecasts(x), "units_sold", "naive_lag1").select(
        F.lit("P03 Forecast").alias("pipeline"), F.lit("RMSE").alias("metric"), F.col("rmse").alias("value")
    )
    ate = E.overall_effect(arms(x), "y", "t").select(F.lit("P02 Uplift"), F.lit("ATE_test"), "effect")
    auc = E.ranking_quality(scored(x), "s", "y").select(F.lit("P01 Churn"), F.lit("AUC-ROC"), "roc_auc")
    return MON.evaluate_alerts(rmse.union(ate).union(auc))


@query(
    "mon_05_best_per_workload",
    "workload metric model value:f",
    f"""SELECT 'forecast' AS workload, 'mae' AS metric, min_by(m, mae) AS model, min(mae) AS value FROM (SELECT 'lag1' AS m, {_ERR.format(p='p1')} FROM forecasts
        UNION ALL SELECT 'lag4', {_ERR.format(p='p4')} FROM forecasts)
        UNION ALL SELECT 'uplift', 'observed_uplift', max_by(CAST(decile AS VARCHAR), observed_uplift), max(observed_uplift) FROM deciles""",
)
def _(x):
    f = forecasts(x)
    errors = E.forecast_errors(f, "units_sold", "naive_lag1").withColumn("m", F.lit("lag1")).unionByName(
        E.forecast_errors(f, "units_sold", "naive_lag4").withColumn("m", F.lit("lag4"))
    )
    named = decile_table(x).withColumn("m", F.col("decile").cast("string"))
    return MON.best_per_workload({"forecast": (errors, "m", "mae", False), "uplift": (named, "m", "observed_uplift", True)})


