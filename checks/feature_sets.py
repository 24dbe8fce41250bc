"""Splits and feature builders."""


from pyspark.sql import functions as F

from checks.registry import query
from shelfsense.operators import splits as S
from shelfsense.plans import features as FT
from shelfsense.plans import recommend as rec
from shelfsense.plans.returns import class_weight, with_labels

_TIME_SPLIT = """SELECT {id}, row_number() OVER (ORDER BY {time}, {id}) > floor(count(*) OVER () * {keep}::DOUBLE) AS is_test FROM {table}"""


@query(
    "ft_01_time_ordered_split",
    "customer_id is_test:b",
    _TIME_SPLIT.format(id="customer_id", time="signup_date", keep="(1 - 0.2)", table="m_customer").replace("(1 - 0.2)::DOUBLE", "(1 - 0.2::DOUBLE)"),
)
def _(x):
    return S.time_ordered(x.mart("customer_features"), "signup_date", ["customer_id"], 0.2)


@query(
    "ft_01_time_split_campaigns",
    "campaign_id customer_id is_test:b",
    """SELECT campaign_id, customer_id, row_number() OVER (ORDER BY assignment_datetime, campaign_id, customer_id)
       > floor(count(*) OVER () * (1 - 0.2::DOUBLE)) AS is_test FROM s_targets""",
)
def _(x):
    return S.time_ordered(x.mart("campaign_response"), "assignment_datetime", ["campaign_id", "customer_id"], 0.2)


@query(
    "ft_02_split_at_week",
    "product_id store_id_or_online week_start_date:d is_test:b",
    "SELECT product_id, store_id_or_online, week_start_date, week_start_date >= DATE '2000-01-03' AS is_test FROM w_demand",
)
def _(x):
    return S.at_week(x.mart("product_demand"), "2000-01-03")


@query(
    "ft_03_split_at_week_share",
    "product_id store_id_or_online week_start_date:d is_test:b",
    """SELECT product_id, store_id_or_online, week_start_date, week_start_date >= (SELECT list_sort(list(DISTINCT week_start_date))[
       CAST(floor(count(DISTINCT week_start_date) * 0.8::DOUBLE) AS BIGINT) + 1] FROM w_demand) AS is_test FROM w_demand""",
)
def _(x):
    return S.by_week_share(x.mart("product_demand"), 0.8)


@query(
    "ft_04_validation_tail",
    "customer_id part",
    """WITH a AS (SELECT customer_id, signup_date, row_number() OVER (ORDER BY signup_date, customer_id) > floor(count(*) OVER () * (1 - 0.2::DOUBLE)) AS t FROM m_customer),
       b AS (SELECT customer_id, row_number() OVER (ORDER BY signup_date, customer_id) > floor(count(*) OVER () * (1 - 0.15::DOUBLE)) AS v FROM a WHERE NOT t)
       SELECT customer_id, CASE WHEN t THEN 'test' WHEN v THEN 'validation' ELSE 'train' END AS part FROM a LEFT JOIN b USING (customer_id)""",
)
def _(x):
    from shelfsense.plans.training import three_way

    return three_way(x.mart("customer_features"), "signup_date", ["customer_id"])


@query(
    "ft_05_stratified_split",
    "customer_id is_test:b",
    """SELECT customer_id, row_number() OVER (PARTITION BY churn_flag_90d ORDER BY md5(customer_id), customer_id) - 1
       < round(count(*) OVER (PARTITION BY churn_flag_90d) * 0.2::DOUBLE) AS is_test FROM m_customer""",
)
def _(x):
    return S.stratified(x.mart("customer_features").select("customer_id", "churn_flag_90d"), "churn_flag_90d", ["customer_id"], 0.2)


_TIMED = """SELECT customer_id, split_strategy, CASE WHEN split_strategy = 'time_ordered' THEN by_time ELSE by_class END AS is_test FROM (
    SELECT *, CASE WHEN (SELECT count({t}) > CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) FROM m_customer) AND (SELECT bool_and(c = 2) AND count(*) = 2 FROM
        (SELECT by_time, count(DISTINCT churn_flag_90d) AS c FROM sides GROUP BY 1)) THEN 'time_ordered' ELSE 'stratified' END AS split_strategy FROM sides)"""
_SIDES = """WITH sides AS (SELECT customer_id, churn_flag_90d,
    row_number() OVER (ORDER BY {t} NULLS LAST, customer_id) > CAST(floor(count(*) OVER () * (1 - 0.2::DOUBLE)) AS BIGINT) AS by_time,
    row_number() OVER (PARTITION BY churn_flag_90d ORDER BY md5(customer_id), customer_id) - 1 < round(count(*) OVER (PARTITION BY churn_flag_90d) * 0.2::DOUBLE) AS by_class
    FROM m_customer) """

# Registration dates are known for everyone; the last order date decides the churn label by itself, so one side lacks a class.
for _name, _time in (("ft_05_time_first_split", "signup_date"), ("ft_05_split_fallback", "last_order_date")):

    @query(_name, "customer_id is_test:b split_strategy", (_SIDES + _TIMED).format(t=_time))
    def _(x, t=_time):
        rows = x.mart("customer_features").select("customer_id", "churn_flag_90d", t)
        return S.time_else_stratified(rows, "churn_flag_90d", t, ["customer_id"])


@query(
    "ft_06_drift_split",
    "order_item_id is_test:b",
    """SELECT order_item_id, row_number() OVER (ORDER BY order_date, order_item_id) > floor(count(*) OVER () * (1 - 0.3::DOUBLE)) AS is_test FROM b_returns""",
)
def _(x):
    return S.time_ordered(x.mart("returns_risk").select("order_item_id", "order_date"), "order_date", ["order_item_id"], 0.3)


@query(
    "ft_07_leave_last_out",
    "customer_id product_id is_test:b",
    """SELECT customer_id, product_id, row_number() OVER (PARTITION BY customer_id ORDER BY last_interaction_date DESC, interaction_score DESC, product_id DESC) = 1 AS is_test
       FROM m_inter QUALIFY count(*) OVER (PARTITION BY customer_id) > 1""",
)
def _(x):
    return S.leave_last_out(
        x.mart("recommendation_interactions"), "customer_id", ["last_interaction_date", "interaction_score", "product_id"]
    )


@query(
    "ft_08_churn_features",
    "customer_id order_velocity_per_month:f purchase_session_rate:f cart_to_purchase_rate:f is_loyalty_enrolled:i was_targeted_by_campaign:i has_session_data:i",
    """SELECT customer_id, CASE WHEN tenure_days > 0 THEN total_orders / (tenure_days / 30) END AS order_velocity_per_month,
       sessions_with_purchase / nullif(total_sessions, 0) AS purchase_session_rate,
       sessions_with_purchase / nullif(sessions_add_to_cart, 0) AS cart_to_purchase_rate,
       CAST(loyalty_tier IS NOT NULL AS INTEGER) AS is_loyalty_enrolled, CAST(campaigns_targeted IS NOT NULL AS INTEGER) AS was_targeted_by_campaign,
       CAST(total_sessions IS NOT NULL AS INTEGER) AS has_session_data FROM m_customer""",
)
def _(x):
    return FT.churn_features(x.mart("customer_features"))


@query(
    "ft_09_uplift_features",
    "campaign_id customer_id assignment_month:i assignment_dayofweek:i segment_campaign is_new_customer:i targeting_is_rule_based:i log_pre_90d_revenue:f log_tenure_days:f order_density_90d:f",
    """SELECT campaign_id, customer_id, month(assignment_datetime) AS assignment_month, isodow(assignment_datetime) - 1 AS assignment_dayofweek,
       coalesce(customer_value_band, 'unknown') || '_' || campaign_type AS segment_campaign, CAST(pre_90d_orders = 0 AS INTEGER) AS is_new_customer,
       CASE WHEN targeting_rule_source LIKE 'rule%' THEN 1 ELSE 0 END AS targeting_is_rule_based, ln(1 + coalesce(pre_90d_revenue, 0)) AS log_pre_90d_revenue,
       ln(1 + coalesce(tenure_days, 0)) AS log_tenure_days, pre_90d_orders / 90 AS order_density_90d
       FROM m_campaign LEFT JOIN m_customer USING (customer_id)""",
)
def _(x):
    return FT.uplift_features(FT.enrich_with_customers(x.mart("campaign_response"), x.mart("customer_features")))


@query(
    "ft_10_forecast_features",
    "product_id store_id_or_online week_start_date:d lag_2w:i roll_2w_avg:f has_yoy_lag:i has_inventory:i sin_woy:f cos_woy:f",
    """SELECT product_id, store_id_or_online, week_start_date, lag(units_sold, 2) OVER w AS lag_2w,
       avg(units_sold) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS roll_2w_avg, CAST(lag(units_sold, 52) OVER w IS NOT NULL AS INTEGER) AS has_yoy_lag,
       CAST(avg_starting_inventory IS NOT NULL AS INTEGER) AS has_inventory, sin(2 * pi() * weekofyear(week_start_date) / 52) AS sin_woy,
       cos(2 * pi() * weekofyear(week_start_date) / 52) AS cos_woy FROM m_demand
       WINDOW w AS (PARTITION BY product_id, store_id_or_online ORDER BY week_start_date)""",
)
def _(x):
    return FT.forecast_features(x.mart("product_demand"))


@query(
    "ft_11_segment_features",
    "customer_id is_non_purchaser:i total_orders:i recency_days:i total_sessions:f log_total_orders:f log_total_net_revenue:f log_recency_days:f log_total_sessions:f purchase_rate:f order_rate_per_month:f",
    """SELECT customer_id, np AS is_non_purchaser, o AS total_orders, rec AS recency_days, s AS total_sessions, ln(1 + o) AS log_total_orders,
       ln(1 + coalesce(total_net_revenue, 0)) AS log_total_net_revenue, ln(1 + rec) AS log_recency_days, ln(1 + s) AS log_total_sessions,
       CASE WHEN s > 0 THEN p / s ELSE 0 END AS purchase_rate, CASE WHEN tenure_days > 0 THEN o / (tenure_days / 30) ELSE 0 END AS order_rate_per_month
       FROM (SELECT *, CAST(total_orders IS NULL AS INTEGER) AS np, coalesce(total_orders, 0) AS o, coalesce(recency_days, tenure_days) AS rec,
         coalesce(total_sessions, (SELECT median(total_sessions) FROM m_customer)) AS s,
         coalesce(sessions_with_purchase, (SELECT median(sessions_with_purchase) FROM m_customer)) AS p FROM m_customer)""",
)
def _(x):
    return FT.segment_features(x.mart("customer_features"))


@query(
    "ft_12_return_features",
    "order_item_id is_suspected_abuse_reason:i is_electronics:i is_low_discount:i is_high_risk_band:i loyalty_tier refund_amount:f days_to_return:i",
    """SELECT order_item_id, CAST(coalesce(return_reason, '') = 'suspected_abuse' AS INTEGER) AS is_suspected_abuse_reason,
       CAST(category = 'electronics' AS INTEGER) AS is_electronics, CAST(discount_band = 'low_discount' AS INTEGER) AS is_low_discount,
       CAST(return_risk_band = 'high' AS INTEGER) AS is_high_risk_band, coalesce(loyalty_tier, 'unknown') AS loyalty_tier,
       coalesce(refund_amount, 0) AS refund_amount, coalesce(days_to_return, 0) AS days_to_return FROM m_returns WHERE return_flag = 1""",
)
def _(x):
    return FT.return_features(x.mart("returns_risk").filter("return_flag = 1"))


_SCORE_SQL = """SELECT customer_id, product_id, ln(1 + sum(q)) + 0.15 * ln(1 + sum(v)) + 0.4 * ln(1 + sum(w)) + 0.5 * sum(p) AS score FROM (
    SELECT customer_id, product_id, quantity AS q, 0 AS v, 0 AS w, 0 AS p FROM r_items JOIN r_orders USING (order_id)
    UNION ALL SELECT customer_id_nullable, product_id_nullable, 0, CAST(event_type = 'view_product' AS INTEGER), CAST(event_type = 'wishlist_add' AS INTEGER), 0
      FROM r_clicks WHERE event_type IN ('view_product', 'wishlist_add') AND customer_id_nullable IS NOT NULL AND product_id_nullable IS NOT NULL
    UNION ALL SELECT customer_id, product_id, 0, 0, 0, 1 FROM r_reviews WHERE rating >= 4) GROUP BY ALL"""


@query("ft_13_implicit_score", "customer_id product_id score:f", _SCORE_SQL)
def _(x):
    signals = rec.signal_counts(rec.purchases(x.staging), x.staging)
    return signals.withColumn("score", rec.implicit_score(signals))


CONTENT_SQL = """SELECT product_id, feature, 1 / sqrt(count(*) OVER (PARTITION BY product_id)) AS weight FROM (
    SELECT product_id, 'cat=' || category AS feature FROM r_products UNION ALL SELECT product_id, 'sub=' || subcategory FROM r_products
    UNION ALL SELECT product_id, 'brand=' || brand_type FROM r_products UNION ALL SELECT product_id, 'price=' || price_tier FROM r_products
    UNION ALL SELECT product_id, 'emb=' || left(recommendation_embedding_group, 2) FROM r_attributes
    UNION ALL SELECT product_id, 'eco' FROM r_attributes WHERE eco_flag UNION ALL SELECT product_id, 'bundle' FROM r_attributes WHERE bundle_candidate_flag)"""


@query("ft_14_content_vectors", "product_id feature weight:f", CONTENT_SQL)
def _(x):
    return rec.content_features(x.staging.products, x.staging.product_attributes)


@query(
    "ft_15_tfidf_keywords",
    "product_id term weight:f",
    r"""WITH t AS (SELECT product_id, unnest(regexp_extract_all(lower(description_keywords), '[a-z_]+')) AS term FROM r_attributes),
        df AS (SELECT term, count(DISTINCT product_id) AS d, count(*) AS total FROM t GROUP BY 1),
        vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM r_attributes)) / (1 + d)) + 1 AS idf FROM df ORDER BY total DESC, term LIMIT 50),
        raw AS (SELECT product_id, term, count(*) * max(idf) AS w FROM t JOIN vocab USING (term) GROUP BY 1, 2)
        SELECT product_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY product_id)) AS weight FROM raw""",
)
def _(x):
    from shelfsense.plans.content import keyword_weights

    return keyword_weights(x.staging.product_attributes, "description_keywords", 50)


@query(
    "ft_16_class_weight",
    "positives:i negatives:i weight:f",
    """SELECT count(*) FILTER (WHERE is_abuse) AS positives, count(*) FILTER (WHERE NOT is_abuse) AS negatives,
       count(*) FILTER (WHERE NOT is_abuse) / greatest(count(*) FILTER (WHERE is_abuse), 1) AS weight
       FROM (SELECT is_abuse, row_number() OVER (ORDER BY order_date, return_id) <= floor(count(*) OVER () * (1 - 0.2::DOUBLE)) AS train
         FROM b_returns JOIN r_labels USING (return_id)) WHERE train""",
)
def _(x):
    labelled = with_labels(x.mart("returns_risk"), x.staging.returns_hidden_labels)
    split = S.time_ordered(labelled, "order_date", ["return_id"], 0.2)
    return class_weight(split.filter("not is_test"), "is_abuse")


@query(
    "ft_18_customer_return_profile",
    "return_id cust_total_returns:i cust_abuse_rate:f cust_return_seq:i cust_prior_abuse_rate:f",
    """SELECT return_id, count(*) OVER (PARTITION BY customer_id) AS cust_total_returns, avg(CAST(is_abuse AS INTEGER)) OVER (PARTITION BY customer_id) AS cust_abuse_rate,
       row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_item_id) - 1 AS cust_return_seq,
       coalesce(avg(CAST(is_abuse AS INTEGER)) OVER (PARTITION BY customer_id ORDER BY order_date, order_item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cust_prior_abuse_rate
       FROM b_returns JOIN r_labels USING (return_id)""",
)
def _(x):
    return FT.customer_return_profile(with_labels(x.mart("returns_risk"), x.staging.returns_hidden_labels))


@query(
    "ft_19_return_ratios",
    "order_item_id refund_to_price_ratio:f discount_x_refund:f",
    """SELECT order_item_id, least(5, greatest(0, coalesce(refund_amount / item_net_price, 0))) AS refund_to_price_ratio,
       item_discount_pct * coalesce(refund_amount, 0) AS discount_x_refund FROM b_returns""",
)
def _(x):
    return FT.return_ratio_features(x.mart("returns_risk"))


@query(
    "ft_20_offer_match",
    "campaign_id customer_id discount_match:i is_oversaturated:i",
    """WITH e AS (SELECT c.campaign_id, c.customer_id, c.offer_type, round(m.avg_item_discount_pct, 9) AS d, m.campaigns_targeted AS n
         FROM m_campaign c LEFT JOIN m_customer m USING (customer_id))
       SELECT campaign_id, customer_id, CAST(offer_type = 'percent_discount' AND coalesce(d, 0) > (SELECT median(d) FROM e) AS INTEGER) AS discount_match,
       CAST(coalesce(n > 1.5 * (SELECT median(n) FROM e), false) AS INTEGER) AS is_oversaturated FROM e""",
)
def _(x):
    # Rounded alike on both sides: the median itself must not fall on either side of itself.
    customers = x.mart("customer_features").withColumn("avg_item_discount_pct", F.round("avg_item_discount_pct", 9))
    return FT.offer_match_features(FT.enrich_with_customers(x.mart("campaign_response"), customers))


@query(
    "ft_21_campaign_conversion_rate",
    "customer_id campaign_cvr:f",
    "SELECT customer_id, campaigns_converted_30d / nullif(campaigns_targeted, 0) AS campaign_cvr FROM m_customer",
)
def _(x):
    return FT.campaign_conversion_rate(x.mart("customer_features"))


