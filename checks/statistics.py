"""Statistics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.registry import query
from shelfsense.operators import stats as ST
from shelfsense.operators.evaluation import forecast_errors, overall_effect
from shelfsense.plans import features as FT

Z = "1.959963984540054::DOUBLE"


@query(
    "st_01_mean_interval",
    "n:i estimate:f ci_lower:f ci_upper:f",
    f"""SELECT count(v) AS n, avg(v) AS estimate, avg(v) - {Z} * stddev_samp(v) / sqrt(count(v)) AS ci_lower,
        avg(v) + {Z} * stddev_samp(v) / sqrt(count(v)) AS ci_upper FROM (SELECT avg_order_value AS v FROM m_customer)""",
)
def _(x):
    return ST.mean_interval(x.mart("customer_features"), "avg_order_value")


@query(
    "st_02_proportion_interval",
    "n:i estimate:f ci_lower:f ci_upper:f",
    f"""SELECT n, p AS estimate, p - {Z} * sqrt(p * (1 - p) / n) AS ci_lower, p + {Z} * sqrt(p * (1 - p) / n) AS ci_upper
        FROM (SELECT count(*) AS n, avg(response_flag_30d) AS p FROM m_campaign)""",
)
def _(x):
    return ST.proportion_interval(x.mart("campaign_response"), "response_flag_30d")


@query(
    "st_03_welch_t",
    "t_stat:f dof:f",
    """SELECT (m1 - m2) / sqrt(a + b) AS t_stat, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS dof FROM (
       SELECT n1, m1, n2, m2, v1 / n1 AS a, v2 / n2 AS b FROM (SELECT
         count(*) FILTER (WHERE discount_band = 'deep_discount') AS n1, avg(item_net_price) FILTER (WHERE discount_band = 'deep_discount') AS m1,
         var_samp(item_net_price) FILTER (WHERE discount_band = 'deep_discount') AS v1, count(*) FILTER (WHERE discount_band = 'low_discount') AS n2,
         avg(item_net_price) FILTER (WHERE discount_band = 'low_discount') AS m2, var_samp(item_net_price) FILTER (WHERE discount_band = 'low_discount') AS v2 FROM b_returns))""",
)
def _(x):
    return ST.welch_test(
        x.mart("returns_risk"), "item_net_price", F.col("discount_band") == "deep_discount", F.col("discount_band") == "low_discount"
    )


@query(
    "st_04_two_proportion_z",
    "rate_1:f rate_2:f effect:f z:f",
    """SELECT p1 AS rate_1, p2 AS rate_2, p1 - p2 AS effect, (p1 - p2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) AS z FROM (SELECT
       avg(response_flag_30d) FILTER (WHERE treatment_flag) AS p1, count(*) FILTER (WHERE treatment_flag) AS n1,
       avg(response_flag_30d) FILTER (WHERE control_flag) AS p2, count(*) FILTER (WHERE control_flag) AS n2, avg(response_flag_30d) AS p FROM m_campaign)""",
)
def _(x):
    return ST.two_proportion_test(x.mart("campaign_response"), "response_flag_30d", F.col("treatment_flag"), F.col("control_flag"))


_LABELS = ["response_flag_30d", "conversion_within_7d", "open_flag"]


@query(
    "st_05_unpooled_effects",
    "label control:f treatment:f effect:f se:f z:f",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS label, pc AS control, pt AS treatment, pt - pc AS effect, s AS se, CASE WHEN s > 0 THEN (pt - pc) / s END AS z FROM (
        SELECT *, sqrt(pt * (1 - pt) / nt + pc * (1 - pc) / nc) AS s FROM (SELECT avg({c}) FILTER (WHERE treatment_flag) AS pt,
        count(*) FILTER (WHERE treatment_flag) AS nt, avg({c}) FILTER (WHERE control_flag) AS pc, count(*) FILTER (WHERE control_flag) AS nc FROM m_campaign))"""
        for c in _LABELS
    ),
)
def _(x):
    return ST.label_effects(x.mart("campaign_response"), _LABELS, "treatment_flag")


@query(
    "st_06_autocorrelation",
    "lag:i acf:f",
    """WITH s AS (SELECT row_number() OVER (ORDER BY week_start_date) AS i, u - avg(u) OVER () AS d FROM
         (SELECT week_start_date, sum(units_sold) AS u FROM w_demand GROUP BY 1))
       SELECT k AS lag, (SELECT sum(a.d * b.d) FROM s a JOIN s b ON b.i = a.i - k) / (SELECT sum(d * d) FROM s) AS acf FROM range(9) t(k)""",
)
def _(x):
    weekly = x.mart("product_demand").groupBy("week_start_date").agg(F.sum("units_sold").alias("u"))
    return ST.autocorrelation(weekly, "week_start_date", "u", 8)


@query(
    "st_07_beta_posterior",
    "alpha:f beta:f mean:f",
    """SELECT 1 + k AS alpha, 1 + n - k AS beta, (1 + k) / (2 + n) AS mean FROM (SELECT sum(response_flag_30d) AS k, count(*) AS n FROM m_campaign WHERE treatment_flag)""",
)
def _(x):
    return ST.beta_posterior(x.mart("campaign_response").filter("treatment_flag"), "response_flag_30d")


def _spearman_sql(table, a, b):
    return f"""SELECT '{a}' AS left_col, '{b}' AS right_col, count(*) AS n_pairs, corr(ra, rb) AS spearman_r FROM (
        SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra,
               rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb
        FROM (SELECT {a} AS a, {b} AS b FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"""


_PAIRS = [("units_sold", "lag_1w_units_sold"), ("units_sold", "promo_days"), ("units_sold", "avg_starting_inventory")]


@query(
    "st_08_spearman",
    "left_col right_col n_pairs:i spearman_r:f",
    " UNION ALL ".join(_spearman_sql("m_demand", a, b) for a, b in _PAIRS),
)
def _(x):
    return ST.spearman_pairs(x.mart("product_demand"), _PAIRS)


LAGS = (1, 2, 3, 4, 8, 13, 26, 52)
_LAGGED = f"""(SELECT units_sold, {", ".join(f"lag(units_sold, {k}) OVER w AS lag{k}" for k in LAGS)} FROM w_demand
    WINDOW w AS (PARTITION BY product_id, store_id_or_online ORDER BY week_start_date))"""


@query(
    "st_09_lag_correlation_profile",
    "right_col n_pairs:i spearman_r:f",
    " UNION ALL ".join(
        f"SELECT * FROM ({_spearman_sql(_LAGGED, 'units_sold', f'lag{k}')}) WHERE n_pairs >= 100" for k in LAGS
    ),
)
def _(x):
    w = Window.partitionBy("product_id", "store_id_or_online").orderBy("week_start_date")
    df = x.mart("product_demand").select("units_sold", *[F.lag("units_sold", k).over(w).alias(f"lag{k}") for k in LAGS])
    return ST.spearman_pairs(df, [("units_sold", f"lag{k}") for k in LAGS], least=100)


_NUM = ["total_orders", "total_net_revenue", "avg_order_value", "total_units", "tenure_days"]


@query(
    "st_10_pearson_pairs",
    "left_col right_col correlation:f",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS left_col, '{b}' AS right_col, corr({a}, {b}) AS correlation FROM m_customer"""
        for i, a in enumerate(_NUM)
        for b in _NUM[i + 1 :]
    ),
)
def _(x):
    return ST.pearson_pairs(x.mart("customer_features"), _NUM)


_ST11 = ["total_orders", "total_net_revenue", "avg_order_value", "total_units", "tenure_days", "recency_days", "total_sessions", "avg_session_minutes", "avg_pages_viewed", "return_rate_per_unit"]


def _drop_sql(columns, limit):
    """Walk the list in SQL: a column goes when an earlier kept one correlates."""
    pairs = ", ".join(
        f"coalesce(abs(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))) >= {limit}::DOUBLE, false) AS h_{i}_{j}"
        for j, b in enumerate(columns) for i, a in enumerate(columns[:j])
    )
    gone = ["false AS d_0"] + [f"({' OR '.join(f'(h_{i}_{j} AND NOT d_{i})' for i in range(j))}) AS d_{j}" for j in range(1, len(columns))]
    rows = " UNION ALL ".join(f"SELECT '{c}' AS dropped, {j} AS place FROM g WHERE d_{j}" for j, c in enumerate(columns))
    return f"WITH h AS (SELECT {pairs} FROM m_customer), g AS (SELECT {', '.join(gone)} FROM h) {rows}"


@query("st_11_drop_correlated", "dropped place:i", _drop_sql(_ST11, 0.9))
def _(x):
    gone = ST.drop_correlated(ST.pearson_pairs(x.mart("customer_features"), _ST11), _ST11)
    return x.spark.createDataFrame([(c, _ST11.index(c)) for c in gone], "dropped string, place long")


_BAL_NUM = ["pre_90d_orders", "pre_90d_revenue", "offer_strength"]
_BAL_CAT = ["campaign_type", "targeting_rule_source"]


def _balance_sql():
    parts = [
        f"""SELECT '{c}' AS feature, NULL AS level, 'numeric' AS kind, mc AS control_mean, mt AS treatment_mean,
        CASE WHEN v = 0 THEN 0 ELSE (mt - mc) / sqrt(v) END AS smd FROM (SELECT avg({c}) FILTER (WHERE NOT treatment_flag) AS mc,
        avg({c}) FILTER (WHERE treatment_flag) AS mt, (var_samp({c}) FILTER (WHERE treatment_flag) + var_samp({c}) FILTER (WHERE NOT treatment_flag)) / 2 AS v FROM m_campaign)"""
        for c in _BAL_NUM
    ]
    for c in _BAL_CAT:
        parts.append(
            f"""SELECT * FROM (SELECT '{c}' AS feature, lev AS level, 'categorical' AS kind, mc AS control_mean, mt AS treatment_mean,
            (mt - mc) / sqrt(v) AS smd FROM (SELECT lev, avg(h) FILTER (WHERE NOT treatment_flag) AS mc, avg(h) FILTER (WHERE treatment_flag) AS mt,
            (var_samp(h) FILTER (WHERE treatment_flag) + var_samp(h) FILTER (WHERE NOT treatment_flag)) / 2 AS v FROM
            (SELECT treatment_flag, lev, CAST(coalesce({c} = lev, false) AS INTEGER) AS h FROM m_campaign, (SELECT DISTINCT {c} AS lev FROM m_campaign WHERE {c} IS NOT NULL)) GROUP BY lev)
            ORDER BY abs(smd) DESC, lev DESC LIMIT 1)"""
        )
    return " UNION ALL ".join(parts)


@query(
    "st_12_standardised_mean_difference",
    "feature level kind control_mean:f treatment_mean:f smd:f status",
    f"""SELECT *, CASE WHEN abs(smd) > 0.25::DOUBLE THEN 'SEVERE' WHEN abs(smd) > 0.1::DOUBLE THEN 'imbalanced' ELSE 'balanced' END AS status FROM ({_balance_sql()})""",
)
def _(x):
    return ST.balance_table(x.mart("campaign_response"), _BAL_NUM, _BAL_CAT, "treatment_flag")


@query(
    "st_13_pre_period_balance",
    "arm:i n:i mean_pre_90d_orders:f mean_pre_90d_revenue:f",
    """SELECT CAST(treatment_flag AS INTEGER) AS arm, count(*) AS n, avg(pre_90d_orders) AS mean_pre_90d_orders,
       avg(pre_90d_revenue) AS mean_pre_90d_revenue FROM m_campaign GROUP BY 1""",
)
def _(x):
    return ST.arm_means(x.mart("campaign_response"), ["pre_90d_orders", "pre_90d_revenue"], "treatment_flag")


_AUC_NUM = ["revenue_within_30d", "pre_90d_revenue", "open_flag", "source_event_rows"]
_AUC_CAT = ["response_bucket", "targeting_rule_source"]


def _auc_sql():
    parts = []
    for c in _AUC_NUM:
        parts.append(
            f"SELECT '{c}' AS feature, response_flag_30d AS y, CAST(coalesce({c}, (SELECT median({c}) FROM m_campaign)) AS DOUBLE) AS s FROM m_campaign"
        )
    for c in _AUC_CAT:
        parts.append(
            f"""SELECT '{c}', response_flag_30d, avg(response_flag_30d) OVER (PARTITION BY coalesce({c}, '__MISSING__')) FROM m_campaign"""
        )
    return f"""SELECT feature, CASE WHEN count(DISTINCT s) > 1 THEN greatest(a, 1 - a) END AS auc FROM (
        SELECT feature, s, (sum(r) FILTER (WHERE y = 1) OVER (PARTITION BY feature) - np * (np + 1) / 2) / (np * nn) AS a FROM (
        SELECT feature, y, s, rank() OVER (PARTITION BY feature ORDER BY s) + (count(*) OVER (PARTITION BY feature, s) - 1) / 2 AS r,
        sum(y) OVER (PARTITION BY feature) AS np, sum(1 - y) OVER (PARTITION BY feature) AS nn FROM ({' UNION ALL '.join(parts)}))) GROUP BY feature, a"""


@query("st_14_single_feature_auc", "feature auc:f", _auc_sql())
def _(x):
    return ST.single_feature_auc(x.mart("campaign_response"), "response_flag_30d", _AUC_NUM, _AUC_CAT)


@query(
    "st_15_leakage_audit",
    "feature auto_flag:b action reasons",
    f"""SELECT feature, auc >= 0.95::DOUBLE AS auto_flag, CASE WHEN reasons = '' THEN 'keep' ELSE 'drop' END AS action,
        CASE WHEN reasons = '' THEN 'none' ELSE reasons END AS reasons FROM (SELECT *, concat_ws(';',
        CASE WHEN feature = 'open_flag' THEN 'rule_blacklist_exact' END, CASE WHEN feature LIKE '%revenue_within%' THEN 'rule_blacklist_contains:revenue_within' END,
        CASE WHEN auc >= 0.95::DOUBLE THEN 'auto_leak_auc>=0.95' END) AS reasons FROM ({_auc_sql()}) WHERE auc IS NOT NULL)""",
)
def _(x):
    signal = ST.single_feature_auc(x.mart("campaign_response"), "response_flag_30d", _AUC_NUM, _AUC_CAT)
    return ST.leakage_audit(signal.filter("auc is not null"), ["open_flag"], ["revenue_within"])


@query(
    "st_15_leakage_verdict",
    "feature verdict",
    f"""SELECT feature, CASE WHEN auc >= 0.97::DOUBLE THEN 'forbidden' WHEN auc >= 0.65::DOUBLE THEN 'suspicious' ELSE 'safe-looking' END AS verdict FROM ({_auc_sql()})""",
)
def _(x):
    return ST.leakage_verdict(ST.single_feature_auc(x.mart("campaign_response"), "response_flag_30d", _AUC_NUM, _AUC_CAT))


@query(
    "st_16_outcome_spread_categories",
    "feature bins:i spread_pp:f",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(*) AS bins, 100 * (max(r) - min(r)) AS spread_pp FROM
        (SELECT {c}, avg(churn_flag_90d) AS r FROM m_customer WHERE {c} IS NOT NULL GROUP BY 1)"""
        for c in ("region", "loyalty_tier", "income_band")
    ),
)
def _(x):
    return ST.category_spread(x.mart("customer_features"), ["region", "loyalty_tier", "income_band"], "churn_flag_90d")


@query(
    "st_16_outcome_spread_numeric",
    "feature bins:i spread_pp:f",
    """SELECT 'tenure_days' AS feature, count(*) AS bins, 100 * (max(r) - min(r)) AS spread_pp FROM (
       SELECT len(list_filter(list_sort(list_distinct(q))[2:-2], lambda e: tenure_days > e)) AS bin, avg(churn_flag_90d) AS r FROM m_customer,
       (SELECT quantile_cont(CAST(tenure_days AS DOUBLE), [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM m_customer) GROUP BY 1)""",
)
def _(x):
    return ST.numeric_spread(x.mart("customer_features"), ["tenure_days"], "churn_flag_90d")


@query(
    "st_17_group_effects",
    "campaign_type n:i n_treatment:i n_control:i response_t:f response_c:f uplift:f ci95:f",
    """SELECT *, rt AS response_t, rc AS response_c, rt - rc AS uplift, 1.96::DOUBLE * sqrt(rt * (1 - rt) / n_treatment + rc * (1 - rc) / n_control) AS ci95 FROM (
       SELECT campaign_type, count(*) AS n, count(*) FILTER (WHERE treatment_flag) AS n_treatment, count(*) FILTER (WHERE NOT treatment_flag) AS n_control,
       avg(response_flag_30d) FILTER (WHERE treatment_flag) AS rt, avg(response_flag_30d) FILTER (WHERE NOT treatment_flag) AS rc FROM m_campaign GROUP BY 1)
       WHERE n_treatment >= 30 AND n_control >= 30""",
)
def _(x):
    return ST.group_effects(x.mart("campaign_response"), "campaign_type", "response_flag_30d", "treatment_flag")


def _slice_sql(kind, expr):
    return f"""SELECT '{kind}' AS slice, CAST({expr} AS VARCHAR) AS value, count(*) AS n, avg(abs(p - y)) AS mae,
        avg(2 * abs(p - y) / nullif(abs(p) + abs(y), 0)) AS smape FROM t GROUP BY {expr}"""


@query(
    "st_18_error_by_slice",
    "slice value n:i mae:f smape:f",
    f"""WITH t AS (SELECT *, units_sold AS y, coalesce(lag_1w_units_sold, (SELECT median(units_sold) FROM m_demand WHERE week_start_date < DATE '2000-01-03')) AS p
        FROM m_demand WHERE week_start_date >= DATE '2000-01-03') {_slice_sql('category', 'category')} UNION ALL {_slice_sql('seasonal', 'seasonal_flag')}
        UNION ALL {_slice_sql('price_tier', 'price_tier')}""",
)
def _(x):
    from shelfsense.plans.forecast import naive_columns

    d = x.mart("product_demand").withColumn("is_test", F.col("week_start_date") >= F.lit("2000-01-03").cast("date"))
    test = naive_columns(d).filter("is_test")
    parts = []
    for kind, c in (("category", "category"), ("seasonal", "seasonal_flag"), ("price_tier", "price_tier")):
        e = forecast_errors(test.withColumn("value", F.col(c).cast("string")), "units_sold", "naive_lag1", ["value"])
        parts.append(e.withColumn("slice", F.lit(kind)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "st_18_error_by_series_length",
    "quartile:i n:i mae:f",
    """WITH t AS (SELECT *, units_sold AS y, coalesce(lag_1w_units_sold, (SELECT median(units_sold) FROM m_demand WHERE week_start_date < DATE '2000-01-03')) AS p FROM
         (SELECT *, count(*) OVER (PARTITION BY product_id, store_id_or_online) AS len FROM m_demand) WHERE week_start_date >= DATE '2000-01-03')
       SELECT 1 + len(list_filter(list_sort(list_distinct(q))[2:-2], lambda e: len > e)) AS quartile, count(*) AS n, avg(abs(p - y)) AS mae
       FROM t, (SELECT quantile_cont(CAST(len AS DOUBLE), [0, 0.25, 0.5, 0.75, 1]) AS q FROM t) GROUP BY 1""",
)
def _(x):
    from shelfsense.operators import ordered
    from shelfsense.plans.forecast import naive_columns

    d = x.mart("product_demand")
    lengths = d.groupBy("product_id", "store_id_or_online").agg(F.count("*").alias("series_len"))
    d = d.withColumn("is_test", F.col("week_start_date") >= F.lit("2000-01-03").cast("date"))
    test = naive_columns(d).filter("is_test").join(lengths, ["product_id", "store_id_or_online"])
    edges = ordered.quantile_values(test, ["series_len"], [0, 0.25, 0.5, 0.75, 1])["series_len"]
    binned = test.withColumn("quartile", ST.quantile_bins(F.col("series_len").cast("double"), edges))
    return forecast_errors(binned, "units_sold", "naive_lag1", ["quartile"])


@query(
    "st_19_rolling_leak_test",
    "match_current:f match_lagged:f",
    """SELECT avg(CAST(coalesce(abs(rolling_4w_avg_units - cur) < 0.01, false) AS INTEGER)) AS match_current,
       avg(CAST(coalesce(abs(rolling_4w_avg_units - lagged) < 0.01, false) AS INTEGER)) AS match_lagged FROM (
       SELECT rolling_4w_avg_units, avg(units_sold) OVER (w ROWS 3 PRECEDING) AS cur, avg(units_sold) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS lagged
       FROM m_demand WINDOW w AS (PARTITION BY product_id, store_id_or_online ORDER BY week_start_date))""",
)
def _(x):
    w = Window.partitionBy("product_id", "store_id_or_online").orderBy("week_start_date")
    d = x.mart("product_demand").withColumns(
        {"cur": F.avg("units_sold").over(w.rowsBetween(-3, 0)), "lagged": F.avg("units_sold").over(w.rowsBetween(-4, -1))}
    )
    return d.agg(
        ST.equal_within(d, "rolling_4w_avg_units", "cur").alias("match_current"),
        ST.equal_within(d, "rolling_4w_avg_units", "lagged").alias("match_lagged"),
    )


@query(
    "st_20_outcome_rates",
    "region n:i rate:f",
    "SELECT region, count(*) AS n, avg(churn_flag_90d) AS rate FROM m_customer GROUP BY 1",
)
def _(x):
    return ST.outcome_rates(x.mart("customer_features"), "region", "churn_flag_90d")


@query(
    "st_21_effect_dispersion",
    "campaigns:i sd:f",
    """SELECT count(*) AS campaigns, stddev_samp(e) AS sd FROM (SELECT campaign_id, avg(response_flag_30d) FILTER (WHERE treatment_flag)
       - avg(response_flag_30d) FILTER (WHERE NOT treatment_flag) AS e FROM m_campaign GROUP BY 1)""",
)
def _(x):
    per = overall_effect(x.mart("campaign_response"), "response_flag_30d", "treatment_flag", ["campaign_id"])
    return per.agg(F.count("*").alias("campaigns"), F.stddev_samp("effect").alias("sd"))


@query(
    "st_22_seasonal_profile",
    "week_of_year:i mean_units:f",
    "SELECT weekofyear(week_start_date) AS week_of_year, avg(units_sold) AS mean_units FROM w_demand GROUP BY 1",
)
def _(x):
    return x.mart("product_demand").groupBy(F.weekofyear("week_start_date").alias("week_of_year")).agg(F.avg("units_sold").alias("mean_units"))


_SIGNALS = """(SELECT * FROM (SELECT week_start_date, units_sold, lag(units_sold, 2) OVER w AS lag_2w, avg(units_sold) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS roll_2w_avg
    FROM w_demand WINDOW w AS (PARTITION BY product_id, store_id_or_online ORDER BY week_start_date)) WHERE week_start_date >= DATE '2000-01-03')"""


@query(
    "st_23_candidate_signal",
    "right_col n_pairs:i spearman_r:f",
    " UNION ALL ".join(_spearman_sql(_SIGNALS, "units_sold", c) for c in ("lag_2w", "roll_2w_avg")),
)
def _(x):
    df = FT.forecast_features(x.mart("product_demand")).filter("week_start_date >= date'2000-01-03'")
    return ST.spearman_pairs(df, [("units_sold", "lag_2w"), ("units_sold", "roll_2w_avg")], least=100)


