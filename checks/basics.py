"""Sources, staging, projections, filters, scalar functions and set operations."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from checks.registry import query
from shelfsense.functions import columns as C
from shelfsense.operators.joins import with_scalar
from shelfsense.sources import raw as R
from shelfsense.sources.standin import RAW_TABLES
from shelfsense.sources.staging import COLUMNS

# --- staging projections (SRC-04), one query per raw table --------------------------------

_STAGED = {
    "calendar": (
        "r_calendar",
        "date:d day_of_week week_of_year:i month:i quarter:i year:i is_weekend:b is_month_end:b is_payday_period:b"
        " holiday_name is_public_holiday:b retail_season promo_season_flag:b",
    ),
    "customers": (
        "r_customers",
        "customer_id signup_date:d birth_year:f gender region city_tier acquisition_channel preferred_channel loyalty_tier"
        " loyalty_signup_date:d income_band customer_segment_seed is_marketing_opt_in:b",
    ),
    "orders": (
        "r_orders",
        "order_id customer_id order_datetime:t order_date:d channel store_id_nullable payment_type order_status"
        " gross_amount:f discount_amount:f net_amount:f shipping_fee:f device_type basket_size:i used_promo_code:b"
        " promo_code_nullable campaign_attributed_flag:b session_id_nullable fraud_risk_seed:f",
    ),
    "products": (
        "r_products",
        "product_id category subcategory brand_type price_tier base_price:f cost:f launch_date:d product_style"
        " seasonal_flag:b premium_flag:b return_risk_seed:f margin_band",
    ),
    "product_attributes": (
        "r_attributes",
        "product_id color size_group material_type eco_flag:b bundle_candidate_flag:b recommendation_embedding_group"
        " description_keywords",
    ),
    "stores": (
        "r_stores",
        "store_id region city store_type opening_date:d store_size_band store_format latitude_fake:f longitude_fake:f",
    ),
    "daily_inventory": (
        "r_inventory",
        "date:d product_id store_id_or_online starting_inventory:i ending_inventory:i stock_received:i stockout_flag:b"
        " backorder_flag:b",
    ),
    "daily_prices": (
        "r_prices",
        "date:d product_id store_id_or_online listed_price:f discount_pct:f promo_flag:b markdown_flag:b bundle_flag:b",
    ),
    "campaigns": (
        "r_campaigns",
        "campaign_id campaign_name campaign_type start_date:d end_date:d channel offer_type offer_strength:f"
        " target_rule_summary control_group_pct:f",
    ),
    "campaign_events": (
        "r_events",
        "campaign_id customer_id delivered_flag:b open_flag:b click_flag:b unsubscribe_flag:b conversion_within_7d:b"
        " conversion_within_30d:b revenue_within_7d:f revenue_within_30d:f",
    ),
    "returns": (
        "r_returns",
        "return_id order_item_id return_request_date:d return_processed_date:d return_reason refund_amount:f refund_method"
        " return_status return_channel",
    ),
    "reviews": (
        "r_reviews",
        "review_id customer_id product_id review_date:d rating:i review_length:i sentiment_seed:f helpful_votes:i",
    ),
    "web_sessions": (
        "r_sessions",
        "session_id customer_id_nullable session_start:t session_end:t traffic_source device_type pages_viewed:i"
        " product_views:i category_views:i add_to_cart_flag:b checkout_flag:b purchase_flag:b bounce_flag:b",
    ),
    "session_events": (
        "r_clicks",
        "event_id session_id customer_id_nullable event_time:t event_type product_id_nullable category_nullable",
    ),
}

for _name, (_sql, _cols) in _STAGED.items():
    query(f"src_04_staging_{_name}", _cols, f"SELECT * FROM {_sql}")(
        lambda x, n=_name: x.staging.table(n)
    )


@query(
    "src_04_staging_calendar_week",
    "date:d week_start_date:d",
    "SELECT date, CAST(date_trunc('week', date) AS DATE) AS week_start_date FROM r_calendar",
)
def _(x):
    return x.staging.calendar


@query(
    "src_04_staging_completed_orders",
    "order_id customer_id order_date:d net_amount:f",
    "SELECT * FROM s_completed",
)
def _(x):
    return x.staging.completed_orders


@query(
    "src_01_register_raw_views",
    "order_status orders:i net:f",
    "SELECT order_status, count(*) AS orders, sum(net_amount) AS net FROM r_orders GROUP BY 1",
)
def _(x):
    folder = f"{x.mart_folder}/raw"
    R.write_raw_table(x.raw("orders"), folder, "orders", force=True)
    R.load_raw(x.spark, folder, ["orders"])
    return x.spark.sql("select order_status, count(*) as orders, sum(net_amount) as net from orders group by order_status")


_MEASURES = {"orders": "net_amount", "returns": "refund_amount"}
_SQL_NAMES = {n: t for n, (t, *_) in _STAGED.items()} | {"order_items": "r_items", "campaign_targets": "r_targets", "returns_hidden_labels": "r_labels"}


def _count_sql(name, table):
    return f"SELECT '{name}' AS table_name, count(*) AS n, CAST({f'sum({_MEASURES[name]})' if name in _MEASURES else 'NULL'} AS DOUBLE) AS total FROM {table}"


@query("src_01_register_all_csv_views", "table_name n:i total:f", " UNION ALL ".join(_count_sql(n, _SQL_NAMES[n]) for n in RAW_TABLES))
def _(x):
    """Every raw table from header CSV with inferred types, counted through its view."""
    folder = f"{x.mart_folder}/raw_all"
    for name in RAW_TABLES:
        x.raw(name).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    tables = R.load_raw(x.spark, folder, list(RAW_TABLES))
    assert dict(tables["orders"].dtypes)["net_amount"] in ("double", "int", "bigint")
    return x.spark.sql(" UNION ALL ".join(_count_sql(n, n) for n in RAW_TABLES))


@query(
    "src_02_load_raw_table_csv",
    "store_id region city opening_date:d latitude_fake:f",
    "SELECT * FROM r_stores",
)
def _(x):
    folder = f"{x.mart_folder}/raw_csv"
    x.raw("stores").write.mode("overwrite").option("header", True).csv(f"{folder}/stores.csv")
    schema = x.raw("stores").select(*COLUMNS["stores"]).schema
    return R.load_raw_table(x.spark, folder, "stores", schema)


@query(
    "src_03_load_mart",
    "week_start_date:d store_id_or_online net_revenue:f",
    "SELECT * FROM m_store",
)
def _(x):
    x.mart("store_week_performance")
    return R.load_mart(x.spark, x.mart_folder, "mart_store_week_performance")


_MART_NAMES = {
    "customer_features": "m_customer",
    "product_demand": "m_demand",
    "campaign_response": "m_campaign",
    "returns_risk": "m_returns",
    "recommendation_interactions": "m_inter",
    "store_week_performance": "m_store",
}
_MART_COUNTS = " UNION ALL ".join(
    f"SELECT 'mart_{n}' AS mart_name, count(*) AS row_count FROM {t}" for n, t in _MART_NAMES.items()
)


@query("snk_01_materialize_all_marts", "mart_name row_count:i", _MART_COUNTS)
def _(x):
    for n in _MART_NAMES:
        x.mart(n)
    return R.row_counts(R.load_all_marts(x.spark, x.mart_folder))


@query("snk_05_mart_row_counts", "mart_name row_count:i", _MART_COUNTS)
def _(x):
    return R.row_counts({f"mart_{n}": x.mart(n) for n in _MART_NAMES})


@query(
    "snk_02_export_mart_csv",
    "week_start_date:d store_id_or_online units_sold:i net_revenue:f",
    "SELECT * FROM m_store",
)
def _(x):
    mart = x.mart("store_week_performance")
    path = R.export_csv(mart, x.mart_folder, "store_week")
    return x.spark.read.schema(mart.schema).option("header", True).csv(path)


@query("snk_02_export_all_marts_csv", "mart_name row_count:i", _MART_COUNTS)
def _(x):
    exported = {}
    for n in _MART_NAMES:
        path = R.export_csv(x.mart(n), x.mart_folder, f"all_{n}")
        exported[f"mart_{n}"] = x.spark.read.schema(x.mart(n).schema).option("header", True).csv(path)
    return R.row_counts(exported)


@query(
    "snk_03_write_metric_records",
    "region customers:i revenue:f",
    "SELECT region, count(*) AS customers, sum(total_net_revenue) AS revenue FROM m_customer GROUP BY 1",
)
def _(x):
    metrics = (
        x.mart("customer_features")
        .groupBy("region")
        .agg(F.count("*").alias("customers"), F.sum("total_net_revenue").alias("revenue"))
    )
    path = R.write_metrics(metrics, x.mart_folder, "region_metrics")
    return x.spark.read.schema(metrics.schema).json(path)


@query(
    "snk_04_forced_overwrite",
    "campaign_id offer_strength:f refused:b",
    "SELECT *, true AS refused FROM r_campaigns",
)
def _(x):
    """Existing raw data is kept without ``force``: the empty table must not have replaced it."""
    folder = f"{x.mart_folder}/guarded"
    R.write_raw_table(x.raw("campaigns"), folder, "campaigns", force=True)
    try:
        R.write_raw_table(x.raw("campaigns").limit(0), folder, "campaigns")
        refused = False
    except AnalysisException:
        refused = True
    return R.load_raw_table(x.spark, folder, "campaigns").withColumn("refused", F.lit(refused))


# --- projections and filters -------------------------------------------------------------


@query(
    "prj_01_completed_filter",
    "order_id order_status",
    "SELECT * FROM r_orders WHERE lower(order_status) = 'completed'",
)
def _(x):
    return x.staging.completed_orders


@query("prj_02_positive_quantity", "order_item_id quantity:i", "SELECT * FROM r_items WHERE quantity > 0")
def _(x):
    return x.staging.order_items


@query(
    "prj_03_eligible_targets",
    "campaign_id customer_id assignment_datetime:t treatment_flag:b control_flag:b eligibility_flag:b targeting_rule_source",
    "SELECT * FROM r_targets WHERE eligibility_flag",
)
def _(x):
    return x.staging.campaign_targets


@query(
    "prj_04_known_identity",
    "event_id customer_id_nullable product_id_nullable",
    "SELECT * FROM r_clicks WHERE customer_id_nullable IS NOT NULL AND product_id_nullable IS NOT NULL",
)
def _(x):
    return x.staging.session_events.dropna(subset=["customer_id_nullable", "product_id_nullable"])


@query(
    "prj_05_event_kinds",
    "kind customer_id product_id n:i",
    """SELECT 'view' AS kind, customer_id_nullable AS customer_id, product_id_nullable AS product_id, count(*) AS n
       FROM r_clicks WHERE event_type = 'view_product' AND customer_id_nullable IS NOT NULL AND product_id_nullable IS NOT NULL GROUP BY ALL
       UNION ALL SELECT 'wish', customer_id_nullable, product_id_nullable, count(*) FROM r_clicks
       WHERE event_type = 'wishlist_add' AND customer_id_nullable IS NOT NULL AND product_id_nullable IS NOT NULL GROUP BY ALL
       UNION ALL SELECT 'liked', customer_id, product_id, count(*) FROM r_reviews WHERE rating >= 4 GROUP BY ALL""",
)
def _(x):
    from shelfsense.plans import recommend as rec

    parts = [
        rec.known_events(x.staging, "view_product").select(F.lit("view").alias("kind"), "customer_id", "product_id"),
        rec.known_events(x.staging, "wishlist_add").select(F.lit("wish").alias("kind"), "customer_id", "product_id"),
        rec.liked_reviews(x.staging).select(F.lit("liked").alias("kind"), "customer_id", "product_id"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("kind", "customer_id", "product_id").agg(F.count("*").alias("n"))


@query(
    "prj_06_location_key",
    "order_id loc",
    "SELECT order_id, CASE WHEN channel ILIKE 'store' THEN store_id_nullable ELSE 'ONLINE' END AS loc FROM r_orders",
)
def _(x):
    return x.staging.orders.withColumn("loc", C.location_key(F.col("channel"), F.col("store_id_nullable")))


@query(
    "prj_07_value_band",
    "customer_value_band n:i",
    """SELECT CASE WHEN r >= 1500 THEN 'high_value' WHEN r >= 600 THEN 'mid_value' WHEN r IS NULL THEN 'no_purchase'
       ELSE 'low_value' END AS customer_value_band, count(*) AS n
       FROM (SELECT (SELECT sum(net_amount) FROM s_completed o WHERE o.customer_id = c.customer_id) AS r FROM r_customers c) GROUP BY 1""",
)
def _(x):
    spent = x.staging.completed_orders.groupBy("customer_id").agg(F.sum("net_amount").alias("r"))
    return (
        x.staging.customers.join(spent, "customer_id", "left")
        .groupBy(C.value_band(F.col("r")).alias("customer_value_band"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "prj_08_bands",
    "band_of band n:i",
    """SELECT 'demand' AS band_of, weekly_demand_band AS band, count(*) AS n FROM m_demand GROUP BY 2
       UNION ALL SELECT 'performance', performance_band, count(*) FROM m_store GROUP BY 2
       UNION ALL SELECT 'discount', discount_band, count(*) FROM b_returns GROUP BY 2""",
)
def _(x):
    def count_of(df, label, band):
        return df.groupBy(band.alias("band")).agg(F.count("*").alias("n")).select(F.lit(label).alias("band_of"), "band", "n")

    demand = count_of(x.mart("product_demand"), "demand", C.demand_band(F.col("units_sold")))
    perf = count_of(x.mart("store_week_performance"), "performance", C.performance_band(F.col("net_revenue")))
    disc = count_of(x.mart("returns_risk"), "discount", C.discount_band(F.col("item_discount_pct")))
    return demand.unionByName(perf).unionByName(disc)


@query(
    "prj_09_risk_band",
    "return_risk_band n:i",
    "SELECT return_risk_band, count(*) AS n FROM m_returns GROUP BY 1",
)
def _(x):
    rate = F.coalesce(F.col("prior_customer_return_rate"), F.lit(0.0))
    return (
        x.mart("returns_risk")
        .groupBy(C.return_risk_band(rate, F.col("item_discount_pct")).alias("return_risk_band"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "prj_10_response_bucket",
    "campaign_id response_bucket n:i",
    "SELECT campaign_id, response_bucket, count(*) AS n FROM m_campaign GROUP BY ALL",
)
def _(x):
    bucket = C.response_bucket(F.col("treatment_flag"), F.col("control_flag"), F.col("conversion_within_30d"))
    return x.mart("campaign_response").groupBy("campaign_id", bucket.alias("response_bucket")).agg(F.count("*").alias("n"))


@query(
    "prj_11_binary_labels",
    "customer_id churn_flag_90d:i",
    """SELECT c.customer_id, coalesce(CAST((SELECT max(order_date) FROM s_completed) - max(o.order_date) > 90 AS INTEGER), 0) AS churn_flag_90d
       FROM r_customers c LEFT JOIN s_completed o USING (customer_id) GROUP BY 1""",
)
def _(x):
    last = x.staging.completed_orders.groupBy("customer_id").agg(F.max("order_date").alias("last"))
    anchor = x.staging.completed_orders.agg(F.max("order_date").alias("anchor"))
    df = with_scalar(x.staging.customers.join(last, "customer_id", "left"), anchor, "anchor")
    return df.withColumn("churn_flag_90d", C.flag(F.datediff("anchor", "last") > 90))


@query(
    "prj_12_guarded_ratio_null",
    "customer_id online_order_share:f store_order_share:f revenue_per_order:f",
    "SELECT customer_id, online_order_share, store_order_share, revenue_per_order FROM m_customer",
)
def _(x):
    from shelfsense.plans.marts import order_totals

    df = x.staging.customers.join(order_totals(x.staging), "customer_id", "left")
    n = F.col("total_orders")
    return df.select(
        "customer_id",
        C.guarded_ratio(F.col("online_orders"), n).alias("online_order_share"),
        C.guarded_ratio(F.col("store_orders"), n).alias("store_order_share"),
        C.guarded_ratio(F.col("total_net_revenue"), n).alias("revenue_per_order"),
    )


@query(
    "prj_13_guarded_ratio_zero",
    "product_id r:f",
    """SELECT product_id, CASE WHEN count(*) > 0 THEN coalesce(count(r.return_id), 0) / sum(quantity) ELSE 0 END AS r
       FROM s_lines LEFT JOIN r_returns r USING (order_item_id) GROUP BY 1""",
)
def _(x):
    m = x.mart("returns_risk").groupBy("product_id").agg(
        F.sum("quantity").alias("units"), F.count("return_id").alias("returned")
    )
    return m.withColumn("r", F.coalesce(C.guarded_ratio(F.col("returned"), F.col("units"), 0.0), F.lit(0.0)))


@query(
    "prj_14_presence_flags",
    "customer_id is_loyalty_enrolled:i was_targeted_by_campaign:i has_session_data:i",
    """SELECT customer_id, CAST(loyalty_tier IS NOT NULL AS INTEGER) AS is_loyalty_enrolled,
       CAST(campaigns_targeted IS NOT NULL AS INTEGER) AS was_targeted_by_campaign,
       CAST(total_sessions IS NOT NULL AS INTEGER) AS has_session_data FROM m_customer""",
)
def _(x):
    return x.mart("customer_features").select(
        "customer_id",
        C.present("loyalty_tier").alias("is_loyalty_enrolled"),
        C.present("campaigns_targeted").alias("was_targeted_by_campaign"),
        C.present("total_sessions").alias("has_session_data"),
    )


@query(
    "prj_15_category_flags",
    "order_item_id suspected:i low:i",
    """SELECT order_item_id, CASE WHEN return_reason = 'suspected_abuse' THEN 1 ELSE 0 END AS suspected,
       CASE WHEN discount_band = 'low_discount' THEN 1 ELSE 0 END AS low FROM b_returns""",
)
def _(x):
    return x.mart("returns_risk").select(
        "order_item_id",
        C.equals_flag("return_reason", "suspected_abuse").alias("suspected"),
        C.equals_flag("discount_band", "low_discount").alias("low"),
    )


@query(
    "prj_16_constant_fill",
    "order_item_id loyalty_tier refund_amount:f days_to_return:i",
    """SELECT order_item_id, coalesce(loyalty_tier, 'unknown') AS loyalty_tier, coalesce(refund_amount, 0) AS refund_amount,
       coalesce(days_to_return, 0) AS days_to_return FROM b_returns""",
)
def _(x):
    return x.mart("returns_risk").na.fill({"loyalty_tier": "unknown", "refund_amount": 0.0, "days_to_return": 0})


@query(
    "prj_17_fill_from_column",
    "customer_id recency_days:i",
    "SELECT customer_id, coalesce(recency_days, tenure_days) AS recency_days FROM m_customer",
)
def _(x):
    return x.mart("customer_features").withColumn("recency_days", F.coalesce("recency_days", "tenure_days"))


@query(
    "prj_18_fill_with_median",
    "customer_id total_sessions:f avg_pages_viewed:f",
    """SELECT customer_id, coalesce(total_sessions, (SELECT median(total_sessions) FROM m_customer)) AS total_sessions,
       coalesce(avg_pages_viewed, (SELECT median(avg_pages_viewed) FROM m_customer)) AS avg_pages_viewed FROM m_customer""",
)
def _(x):
    from shelfsense.plans.features import fill_median

    return fill_median(x.mart("customer_features"), ["total_sessions", "avg_pages_viewed"])


@query(
    "prj_19_drop_no_purchase",
    "customer_id customer_value_band",
    "SELECT * FROM m_customer WHERE customer_value_band IS DISTINCT FROM 'no_purchase'",
)
def _(x):
    from shelfsense.plans.features import active_customers

    return active_customers(x.mart("customer_features"))


@query(
    "prj_20_mature_cohort",
    "customer_id signup_date:d",
    "SELECT * FROM m_customer WHERE signup_date <= (SELECT max(signup_date) FROM m_customer) - 90",
)
def _(x):
    from shelfsense.plans.features import mature_cohort

    return mature_cohort(x.mart("customer_features"), 90)


@query(
    "prj_21_ordered_feature_list",
    "customer_id tenure_days:i total_orders:i income_band",
    "SELECT customer_id, tenure_days, total_orders, income_band FROM m_customer",
)
def _(x):
    m = x.mart("customer_features")
    return m.select(*C.existing(m, ["customer_id", "tenure_days", "total_orders", "tenure_days", "absent", "income_band"]))


@query(
    "prj_22_forbidden_guard",
    "product_id store_id_or_online week_start_date:d lag_1w_units_sold:i lag_4w_units_sold:i",
    "SELECT * FROM m_demand",
)
def _(x):
    from shelfsense.plans.features import FORECAST_FORBIDDEN

    keep = ["product_id", "store_id_or_online", "week_start_date", "lag_1w_units_sold", "lag_4w_units_sold"]
    C.refuse_columns(keep, FORECAST_FORBIDDEN)
    return x.mart("product_demand").select(*keep)


@query(
    "prj_23_clip",
    "order_item_id ratio:f",
    """SELECT order_item_id, CASE WHEN refund_amount / item_net_price > 0.5::DOUBLE THEN 0.5::DOUBLE ELSE refund_amount / item_net_price END AS ratio
       FROM b_returns WHERE return_flag = 1""",
)
def _(x):
    m = x.mart("returns_risk").filter("return_flag = 1")
    return m.withColumn("ratio", C.clipped(F.col("refund_amount") / F.col("item_net_price"), 0.0, 0.5))


@query(
    "prj_24_column_products",
    "order_item_id discount_x_refund:f",
    "SELECT order_item_id, item_discount_pct * refund_amount AS discount_x_refund FROM b_returns",
)
def _(x):
    return x.mart("returns_risk").withColumn("discount_x_refund", F.col("item_discount_pct") * F.col("refund_amount"))


# --- scalar functions --------------------------------------------------------------------


@query("sc_01_lower", "order_id c", "SELECT order_id, lower(channel) AS c FROM r_orders")
def _(x):
    return x.staging.orders.withColumn("c", F.lower("channel"))


@query(
    "sc_02_starts_with",
    "customer_id campaign_id f:i",
    "SELECT customer_id, campaign_id, CASE WHEN targeting_rule_source LIKE 'rule%' THEN 1 ELSE 0 END AS f FROM r_targets",
)
def _(x):
    return x.staging.table("campaign_targets").withColumn("f", C.starts_with_flag("targeting_rule_source", "rule"))


@query(
    "sc_03_joined_category",
    "customer_id seg",
    "SELECT customer_id, coalesce(loyalty_tier, 'unknown') || '_' || income_band AS seg FROM r_customers",
)
def _(x):
    return x.staging.customers.withColumn("seg", C.joined_category("loyalty_tier", "income_band"))


@query(
    "sc_04_prefix",
    "product_id p",
    "SELECT product_id, left(recommendation_embedding_group, 2) AS p FROM r_attributes",
)
def _(x):
    return x.staging.product_attributes.withColumn("p", F.substring("recommendation_embedding_group", 1, 2))


@query(
    "sc_05_join_list",
    "category styles",
    "SELECT category, string_agg(DISTINCT product_style, ', ' ORDER BY product_style) AS styles FROM r_products GROUP BY 1",
)
def _(x):
    return x.staging.products.groupBy("category").agg(
        F.array_join(F.array_sort(F.collect_set("product_style")), ", ").alias("styles")
    )


@query(
    "sc_06_date_and_minute_difference",
    "session_id minutes:i days:i",
    """SELECT session_id, date_diff('minute', session_start, session_end) AS minutes,
       date_diff('day', session_start, session_end) AS days FROM r_sessions""",
)
def _(x):
    a, b = F.col("session_start"), F.col("session_end")
    return x.staging.web_sessions.select(
        "session_id", C.minutes_between(a, b).alias("minutes"), F.datediff(b, a).alias("days")
    )


@query(
    "sc_07_week_start",
    "order_id w:d",
    "SELECT order_id, CAST(date_trunc('week', order_date) AS DATE) AS w FROM r_orders",
)
def _(x):
    return x.staging.orders.withColumn("w", C.week_start(F.col("order_date")))


@query(
    "sc_08_minus_interval",
    "campaign_id customer_id since:t",
    "SELECT campaign_id, customer_id, assignment_datetime - INTERVAL 90 DAY AS since FROM r_targets",
)
def _(x):
    return x.staging.table("campaign_targets").withColumn("since", F.expr("assignment_datetime - interval 90 days"))


@query("sc_09_to_date", "event_id d:d", "SELECT event_id, CAST(event_time AS DATE) AS d FROM r_clicks")
def _(x):
    return x.staging.session_events.withColumn("d", F.to_date("event_time"))


@query(
    "sc_10_safe_timestamp",
    "keyword n:i readable:i",
    """SELECT left(description_keywords, 1) AS keyword, count(*) AS n,
       count(TRY_CAST(CASE WHEN product_id LIKE '%7' THEN '2024-01-01 10:00:00' ELSE description_keywords END AS TIMESTAMP)) AS readable
       FROM r_attributes GROUP BY 1""",
)
def _(x):
    text = F.when(F.col("product_id").like("%7"), "2024-01-01 10:00:00").otherwise(F.col("description_keywords"))
    df = x.staging.product_attributes.withColumn("t", text)
    return df.groupBy(F.substring("description_keywords", 1, 1).alias("keyword")).agg(
        F.count("*").alias("n"), F.count(F.expr("try_cast(t as timestamp_ntz)")).alias("readable")
    )


@query(
    "sc_11_month_weekday_hour",
    "campaign_id customer_id m:i wd:i h:i",
    """SELECT campaign_id, customer_id, month(assignment_datetime) AS m, isodow(assignment_datetime) - 1 AS wd,
       hour(assignment_datetime) AS h FROM r_targets""",
)
def _(x):
    t = F.col("assignment_datetime")
    return x.staging.table("campaign_targets").select(
        "campaign_id", "customer_id", F.month(t).alias("m"), F.weekday(t).alias("wd"), F.hour(t).alias("h")
    )


@query(
    "sc_12_iso_week_quarter",
    "order_id w:i q:i",
    "SELECT order_id, weekofyear(order_date) AS w, quarter(order_date) AS q FROM r_orders",
)
def _(x):
    return x.staging.orders.select("order_id", F.weekofyear("order_date").alias("w"), F.quarter("order_date").alias("q"))


@query(
    "sc_13_week_cycle",
    "order_id s:f c:f",
    """SELECT order_id, sin(2 * pi() * weekofyear(order_date) / 52) AS s, cos(2 * pi() * weekofyear(order_date) / 52) AS c FROM r_orders""",
)
def _(x):
    s, c = C.week_cycle(F.col("order_date"))
    return x.staging.orders.select("order_id", s.alias("s"), c.alias("c"))


@query(
    "sc_14_log1p",
    "customer_id v:f",
    "SELECT customer_id, ln(1 + coalesce(total_net_revenue, 0)) AS v FROM m_customer",
)
def _(x):
    return x.mart("customer_features").withColumn("v", C.log1p_of("total_net_revenue"))


@query(
    "sc_15_coalesce",
    "order_item_id v:i",
    "SELECT order_item_id, coalesce(days_to_return, -1) AS v FROM b_returns",
)
def _(x):
    return x.mart("returns_risk").withColumn("v", F.coalesce("days_to_return", F.lit(-1)))


@query(
    "sc_16_rounding",
    "region v:f",
    "SELECT region, round(avg(tenure_days), 2) AS v FROM m_customer GROUP BY 1",
)
def _(x):
    return x.mart("customer_features").groupBy("region").agg(F.round(F.avg("tenure_days"), 2).alias("v"))


@query(
    "sc_17_min_max_normalise",
    "customer_id product_id v:f",
    """SELECT customer_id, product_id, (interaction_score - min(interaction_score) OVER w) /
       (max(interaction_score) OVER w - min(interaction_score) OVER w + 1e-9::DOUBLE) AS v
       FROM m_inter WINDOW w AS (PARTITION BY customer_id)""",
)
def _(x):
    from shelfsense.plans.recommend import min_max_per_user

    return min_max_per_user(
        x.mart("recommendation_interactions").select("customer_id", "product_id", "interaction_score"),
        "interaction_score",
        "v",
    )


@query(
    "sc_18_business_calendar",
    "retail_season is_public_holiday:b is_weekend:b is_month_end:b is_payday_period:b promo_season_flag:b days:i",
    """SELECT retail_season, is_public_holiday, is_weekend, is_month_end, is_payday_period, promo_season_flag, count(*) AS days
       FROM r_calendar GROUP BY ALL""",
)
def _(x):
    return x.staging.calendar.groupBy(
        "retail_season", "is_public_holiday", "is_weekend", "is_month_end", "is_payday_period", "promo_season_flag"
    ).agg(F.count("*").alias("days"))


@query(
    "sc_19_regex",
    "word n:i",
    r"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(regexp_replace(description_keywords, '^small ', '')), '\w+')) AS word
        FROM r_attributes) GROUP BY 1""",
)
def _(x):
    text = F.lower(F.regexp_replace("description_keywords", "^small ", ""))
    words = x.staging.product_attributes.select(F.explode(F.regexp_extract_all(text, F.lit(r"(\w+)"), 1)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


# --- set operations ----------------------------------------------------------------------


@query(
    "set_01_union_interactions",
    "customer_id product_id interaction_date:d interaction_source interaction_count:i interaction_value:f weighted_score:f",
    """SELECT customer_id, product_id, interaction_date, interaction_source, n AS interaction_count, v AS interaction_value,
       w AS weighted_score FROM daily_inter""",
)
def _(x):
    from shelfsense.plans.marts import daily_interactions

    return daily_interactions(x.staging)


@query(
    "set_03_key_intersection",
    "customer_id",
    "SELECT customer_id FROM s_completed INTERSECT SELECT customer_id FROM r_sessions s(a, customer_id, b, c, d, e, f, g, h, i, j, k, l)",
)
def _(x):
    with_orders = x.staging.completed_orders.select("customer_id")
    with_sessions = x.staging.web_sessions.select(F.col("customer_id_nullable").alias("customer_id"))
    return with_orders.intersect(with_sessions)


@query(
    "set_04_key_difference",
    "customer_id",
    "SELECT customer_id FROM r_customers WHERE customer_id NOT IN (SELECT customer_id FROM s_completed)",
)
def _(x):
    return x.staging.customers.join(x.staging.completed_orders, "customer_id", "left_anti")


@query(
    "set_05_distinct_combinations",
    "combos:i rows_total:i",
    "SELECT count(*) AS combos, (SELECT count(*) FROM r_orders) AS rows_total FROM (SELECT DISTINCT channel, payment_type, device_type FROM r_orders)",
)
def _(x):
    per = x.staging.orders.groupBy("channel", "payment_type", "device_type").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("combos"), F.sum("n").alias("rows_total"))


