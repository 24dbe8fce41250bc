"""Joins and aggregations."""

from pyspark.sql import functions as F

from checks.registry import query
from shelfsense.functions import columns as C
from shelfsense.operators import aggregates as A
from shelfsense.operators import joins as J
from shelfsense.operators import ordered
from shelfsense.operators import quality as Q
from shelfsense.plans import marts as M

# --- joins -------------------------------------------------------------------------------


@query(
    "jn_01_orders_items",
    "order_item_id customer_id order_date:d quantity:i",
    "SELECT * FROM s_lines",
)
def _(x):
    return x.staging.order_items.join(x.staging.completed_orders, "order_id")


@query(
    "jn_02_left_dimension",
    "order_item_id product_id category region",
    """SELECT order_item_id, l.product_id, category, region FROM s_lines l LEFT JOIN r_products USING (product_id)
       LEFT JOIN r_customers USING (customer_id)""",
)
def _(x):
    s = x.staging
    lines = s.order_items.join(s.completed_orders.select("order_id", "customer_id"), "order_id")
    return lines.join(s.products.select("product_id", "category"), "product_id", "left").join(
        s.customers.select("customer_id", "region"), "customer_id", "left"
    )


@query(
    "jn_03_left_composite_key",
    "week_start_date:d product_id store_id_or_online units_sold:i avg_listed_price:f avg_starting_inventory:f",
    """SELECT week_start_date, product_id, store_id_or_online, units_sold, avg_listed_price, avg_starting_inventory FROM w_demand
       LEFT JOIN w_prices USING (week_start_date, product_id, store_id_or_online)
       LEFT JOIN w_inventory USING (week_start_date, product_id, store_id_or_online)""",
)
def _(x):
    s = x.staging
    return (
        M.demand_weekly(s)
        .join(M.price_weekly(s, M.SERIES), M.GRAIN, "left")
        .join(M.inventory_weekly(s, M.SERIES), M.GRAIN, "left")
    )


@query(
    "jn_04_scalar_anchor",
    "customer_id tenure_days:i",
    "SELECT customer_id, (SELECT max(order_date) FROM s_completed) - signup_date AS tenure_days FROM r_customers",
)
def _(x):
    df = J.with_scalar(x.staging.customers, M.anchor_date(x.staging), "anchor_date")
    return df.withColumn("tenure_days", F.datediff("anchor_date", "signup_date"))


@query(
    "jn_05_interval_lookback",
    "campaign_id customer_id assignment_datetime:t pre_90d_orders:i pre_90d_revenue:f pre_90d_aov:f",
    "SELECT * FROM pre90",
)
def _(x):
    return M.pre_assignment(x.staging)


@query(
    "jn_06_customer_assembly",
    "customer_id total_orders:i total_units:i total_returns:i total_sessions:i campaigns_targeted:i",
    "SELECT * FROM m_customer",
)
def _(x):
    s = x.staging
    df = s.customers.select("customer_id")
    for part in (M.order_totals(s), M.item_and_return_totals(s), M.session_totals(s), M.campaign_totals(s)):
        df = df.join(part, "customer_id", "left")
    return df


@query(
    "jn_07_orphan_check",
    "failed_rows:i",
    "SELECT count(*) AS failed_rows FROM r_clicks WHERE product_id_nullable IS NULL OR session_id NOT IN (SELECT session_id FROM r_sessions)",
)
def _(x):
    s = x.staging
    events = s.session_events.withColumn("session_key", F.when(F.col("product_id_nullable").isNotNull(), F.col("session_id")))
    return Q.orphan_count(events, s.web_sessions, [("session_key", "session_id")])


@query(
    "jn_08_conditional_orphan",
    "failed_rows:i",
    "SELECT count(*) AS failed_rows FROM r_orders WHERE lower(channel) = 'store' AND store_id_nullable NOT IN (SELECT store_id FROM r_stores)",
)
def _(x):
    s = x.staging
    at_store = s.orders.filter((F.lower("channel") == "store") & F.col("store_id_nullable").isNotNull())
    return Q.orphan_count(at_store, s.stores, [("store_id_nullable", "store_id")])


_SPLIT = "DATE '1999-01-01'"


@query(
    "jn_09_seen_on_both_sides",
    "customer_id",
    f"""SELECT customer_id FROM r_orders JOIN r_items USING (order_id) GROUP BY 1
        HAVING min(order_date) < {_SPLIT} AND max(order_date) >= {_SPLIT}""",
)
def _(x):
    from shelfsense.plans import recommend as rec

    return rec.overlap_customers(rec.purchases(x.staging), "1999-01-01")


@query(
    "jn_10_full_outer_signals",
    "customer_id product_id quantity:i view_count:i wish_count:i pos_review:i",
    """SELECT customer_id, product_id, sum(q) AS quantity, sum(v) AS view_count, sum(w) AS wish_count, sum(p) AS pos_review FROM (
       SELECT customer_id, product_id, quantity AS q, 0 AS v, 0 AS w, 0 AS p FROM r_items JOIN r_orders USING (order_id)
       UNION ALL SELECT customer_id_nullable, product_id_nullable, 0, CAST(event_type = 'view_product' AS INTEGER), CAST(event_type = 'wishlist_add' AS INTEGER), 0
         FROM r_clicks WHERE event_type IN ('view_product', 'wishlist_add') AND customer_id_nullable IS NOT NULL AND product_id_nullable IS NOT NULL
       UNION ALL SELECT customer_id, product_id, 0, 0, 0, 1 FROM r_reviews WHERE rating >= 4) GROUP BY ALL""",
)
def _(x):
    from shelfsense.plans import recommend as rec

    return rec.signal_counts(rec.purchases(x.staging), x.staging)


@query(
    "jn_11_unseen_in_train",
    "customer_id product_id",
    f"""SELECT DISTINCT customer_id, product_id FROM r_orders o JOIN r_items USING (order_id) WHERE order_date >= {_SPLIT}
        AND customer_id IN (SELECT customer_id FROM r_orders JOIN r_items USING (order_id) WHERE order_date < {_SPLIT})
        EXCEPT SELECT customer_id, product_id FROM r_orders JOIN r_items USING (order_id) WHERE order_date < {_SPLIT}""",
)
def _(x):
    from shelfsense.plans import recommend as rec

    return rec.novel_items(rec.purchases(x.staging), "1999-01-01")


@query(
    "jn_12_deduplicated_enrichment",
    "campaign_id customer_id tenure_days:i total_orders:i customer_value_band",
    "SELECT campaign_id, customer_id, tenure_days, total_orders, customer_value_band FROM s_targets LEFT JOIN m_customer USING (customer_id)",
)
def _(x):
    from shelfsense.plans.features import enrich_with_customers

    twice = x.mart("customer_features").unionByName(x.mart("customer_features"))
    return enrich_with_customers(x.staging.campaign_targets, twice)


@query(
    "jn_13_train_means",
    "product_id store_id_or_online week_start_date:d product_mean_demand:f store_mean_demand:f",
    """SELECT product_id, store_id_or_online, week_start_date, p AS product_mean_demand, s AS store_mean_demand FROM w_demand
       LEFT JOIN (SELECT product_id, avg(units_sold) AS p FROM w_demand WHERE week_start_date < DATE '2000-01-03' GROUP BY 1) USING (product_id)
       LEFT JOIN (SELECT store_id_or_online, avg(units_sold) AS s FROM w_demand WHERE week_start_date < DATE '2000-01-03' GROUP BY 1) USING (store_id_or_online)""",
)
def _(x):
    from shelfsense.plans.features import attach_series_means

    d = x.mart("product_demand")
    return attach_series_means(d, d.filter("week_start_date < date'2000-01-03'"))


@query(
    "jn_14_label_join",
    "kind rows_n:i abusive:i",
    """SELECT 'inner' AS kind, count(*) AS rows_n, count(*) FILTER (WHERE is_abuse) AS abusive FROM b_returns JOIN r_labels USING (return_id)
       UNION ALL SELECT 'left', count(*), count(*) FILTER (WHERE is_abuse) FROM b_returns LEFT JOIN r_labels USING (return_id)""",
)
def _(x):
    from shelfsense.plans.returns import with_labels

    def tally(df, kind):
        return df.agg(F.count("*").alias("rows_n"), F.sum("is_abuse").alias("abusive")).withColumn("kind", F.lit(kind))

    m, labels = x.mart("returns_risk"), x.staging.returns_hidden_labels
    return tally(with_labels(m, labels, "inner"), "inner").unionByName(tally(with_labels(m, labels, "left"), "left"))


@query(
    "jn_15_combined_signals",
    "customer_id region churn_flag_90d:i best_campaign top_product",
    """SELECT m.customer_id, m.region, churn_flag_90d, b.campaign_id AS best_campaign, p.product_id AS top_product FROM m_customer m
       LEFT JOIN (SELECT customer_id, max_by(campaign_id, (revenue_within_30d, campaign_id)) AS campaign_id FROM m_campaign GROUP BY 1) b USING (customer_id)
       LEFT JOIN (SELECT customer_id, product_id FROM m_inter WHERE product_rank_for_customer = 1) p USING (customer_id)""",
)
def _(x):
    best = x.mart("campaign_response").groupBy("customer_id").agg(
        F.max_by("campaign_id", F.struct("revenue_within_30d", "campaign_id")).alias("best_campaign")
    )
    top = (
        x.mart("recommendation_interactions")
        .filter("product_rank_for_customer = 1")
        .select("customer_id", F.col("product_id").alias("top_product"))
    )
    return x.mart("customer_features").join(best, "customer_id", "left").join(top, "customer_id", "left")


@query(
    "jn_16_result_vs_baseline",
    "metric result:f baseline:f delta:f",
    """SELECT metric, result, baseline, result - baseline AS delta FROM (
       UNPIVOT (SELECT avg(net_revenue) AS mean_revenue, max(net_revenue) AS max_revenue FROM m_store WHERE week_start_date >= DATE '1999-01-04')
       ON mean_revenue, max_revenue INTO NAME metric VALUE result) JOIN (
       UNPIVOT (SELECT avg(net_revenue) AS mean_revenue, max(net_revenue) AS max_revenue FROM m_store WHERE week_start_date < DATE '1999-01-04')
       ON mean_revenue, max_revenue INTO NAME metric VALUE baseline) USING (metric)""",
)
def _(x):
    from shelfsense.operators.evaluation import against_baseline

    m = x.mart("store_week_performance")

    def measures(cond):
        return m.filter(cond).agg(F.avg("net_revenue").alias("mean_revenue"), F.max("net_revenue").alias("max_revenue"))

    return against_baseline(
        measures("week_start_date >= date'1999-01-04'"), measures("week_start_date < date'1999-01-04'")
    )


@query(
    "jn_17_product_metadata",
    "product_id category material_type",
    "SELECT product_id, category, material_type FROM r_products JOIN r_attributes USING (product_id)",
)
def _(x):
    return x.staging.products.join(x.staging.product_attributes, "product_id")


# --- aggregations ------------------------------------------------------------------------


@query(
    "ag_01_order_totals",
    "customer_id total_orders:i total_net_revenue:f avg_order_value:f first_order_date:d last_order_date:d",
    """SELECT customer_id, count(*) AS total_orders, sum(net_amount) AS total_net_revenue, avg(net_amount) AS avg_order_value,
       min(order_date) AS first_order_date, max(order_date) AS last_order_date FROM s_completed GROUP BY 1""",
)
def _(x):
    return M.order_totals(x.staging)


@query(
    "ag_02_conditional_count",
    "customer_id online_orders:i store_orders:i",
    """SELECT customer_id, sum(CAST(lower(channel) = 'online' AS INTEGER)) AS online_orders,
       sum(CAST(lower(channel) = 'store' AS INTEGER)) AS store_orders FROM s_completed GROUP BY 1""",
)
def _(x):
    return M.order_totals(x.staging)


@query(
    "ag_03_boolean_or_dedup",
    "campaign_id customer_id delivered_flag:i open_flag:i click_flag:i conversion_within_30d:i revenue_within_30d:f source_event_rows:i",
    "SELECT * FROM s_outcomes",
)
def _(x):
    return x.staging.campaign_events_dedup


@query(
    "ag_04_count_nullable",
    "customer_id total_returns:i",
    "SELECT l.customer_id, count(r.return_id) AS total_returns FROM s_lines l LEFT JOIN r_returns r USING (order_item_id) GROUP BY 1",
)
def _(x):
    return M.item_and_return_totals(x.staging)


@query(
    "ag_05_average_of_difference",
    "customer_id avg_days_to_return:f",
    """SELECT l.customer_id, avg(return_request_date - order_date) AS avg_days_to_return FROM s_lines l
       LEFT JOIN r_returns r USING (order_item_id) GROUP BY 1""",
)
def _(x):
    return M.item_and_return_totals(x.staging)


@query(
    "ag_05_average_session_minutes",
    "customer_id avg_session_minutes:f",
    """SELECT customer_id_nullable AS customer_id, avg(date_diff('minute', session_start, session_end)) AS avg_session_minutes
       FROM r_sessions WHERE customer_id_nullable IS NOT NULL GROUP BY 1""",
)
def _(x):
    return M.session_totals(x.staging)


@query(
    "ag_06_weighted_event_score",
    "customer_id_nullable score:f",
    """SELECT customer_id_nullable, sum(CASE WHEN event_type = 'add_to_cart' THEN 2.0 WHEN event_type = 'view_product' THEN 1.0
       WHEN event_type = 'purchase' THEN 3.0 ELSE 0.5 END) AS score FROM r_clicks GROUP BY 1""",
)
def _(x):
    return x.staging.session_events.groupBy("customer_id_nullable").agg(
        F.sum(C.event_weight(F.col("event_type"))).alias("score")
    )


@query("ag_07_global_anchor", "anchor_date:d", "SELECT max(order_date) AS anchor_date FROM s_completed")
def _(x):
    return M.anchor_date(x.staging)


@query(
    "ag_08_weekly_rollup",
    "week_start_date:d store_id_or_online avg_starting_inventory:f stock_received_units:i stockout_days:i",
    """SELECT CAST(date_trunc('week', date) AS DATE) AS week_start_date, store_id_or_online,
       avg(starting_inventory) AS avg_starting_inventory, sum(stock_received) AS stock_received_units,
       count(*) FILTER (WHERE stockout_flag) AS stockout_days FROM r_inventory GROUP BY ALL""",
)
def _(x):
    return M.inventory_weekly(x.staging, ["store_id_or_online"])


@query(
    "ag_09_duplicate_grain",
    "duplicate_rows:i",
    "SELECT coalesce(sum(n - 1), 0) AS duplicate_rows FROM (SELECT count(*) AS n FROM r_events GROUP BY campaign_id, customer_id HAVING count(*) > 1)",
)
def _(x):
    return Q.duplicate_rows(x.staging.campaign_events, ["campaign_id", "customer_id"])


@query(
    "ag_10_count_minus_distinct",
    "repeated:i",
    "SELECT count(*) - count(DISTINCT product_id) AS repeated FROM r_items",
)
def _(x):
    return x.staging.order_items.agg((F.count("*") - F.countDistinct("product_id")).alias("repeated"))


@query(
    "ag_11_train_only_mean",
    "product_id product_mean_demand:f",
    "SELECT product_id, avg(units_sold) AS product_mean_demand FROM w_demand WHERE week_start_date < DATE '2000-01-03' GROUP BY 1",
)
def _(x):
    from shelfsense.plans.features import mean_demand

    train = x.mart("product_demand").filter("week_start_date < date'2000-01-03'")
    return mean_demand(train, "product_id", "product_mean_demand")


@query(
    "ag_12_group_profile",
    "customer_value_band n:i median_tenure:f mean_tenure:f",
    """SELECT customer_value_band, count(*) AS n, median(tenure_days) AS median_tenure, avg(tenure_days) AS mean_tenure
       FROM m_customer GROUP BY 1""",
)
def _(x):
    m = x.mart("customer_features")
    means = m.groupBy("customer_value_band").agg(F.count("*").alias("n"), F.avg("tenure_days").alias("mean_tenure"))
    medians = ordered.quantiles_wide(m, ["tenure_days"], [0.5], ["customer_value_band"])
    return means.join(medians, "customer_value_band").withColumnRenamed("tenure_days_q0", "median_tenure")


@query(
    "ag_13_pair_counts",
    "customer_id product_id n:i",
    """SELECT customer_id_nullable AS customer_id, product_id_nullable AS product_id, count(*) AS n FROM r_clicks
       WHERE event_type = 'view_product' AND customer_id_nullable IS NOT NULL AND product_id_nullable IS NOT NULL GROUP BY ALL""",
)
def _(x):
    from shelfsense.plans import recommend as rec

    return rec.known_events(x.staging, "view_product").groupBy("customer_id", "product_id").agg(F.count("*").alias("n"))


@query(
    "ag_14_item_set_per_user",
    "customer_id products:i",
    "SELECT customer_id, count(DISTINCT product_id) AS products FROM r_orders JOIN r_items USING (order_id) GROUP BY 1",
)
def _(x):
    # The set stays in rows: one row per member, no array per user.
    from shelfsense.plans import recommend as rec

    return rec.seen_items(rec.purchases(x.staging)).groupBy("customer_id").agg(F.count("*").alias("products"))


@query(
    "ag_15_cross_tab_margins",
    "region customer_value_band n:i",
    """SELECT coalesce(region, 'All') AS region, coalesce(customer_value_band, 'All') AS customer_value_band, count(*) AS n
       FROM m_customer GROUP BY CUBE (region, customer_value_band)""",
)
def _(x):
    return A.cross_tab(x.mart("customer_features"), "region", "customer_value_band")


@query(
    "ag_15_cross_tab_pivot",
    "region high_value:i low_value:i mid_value:i no_purchase:i",
    """SELECT region, count(*) FILTER (WHERE customer_value_band = 'high_value') AS high_value,
       count(*) FILTER (WHERE customer_value_band = 'low_value') AS low_value,
       count(*) FILTER (WHERE customer_value_band = 'mid_value') AS mid_value,
       count(*) FILTER (WHERE customer_value_band = 'no_purchase') AS no_purchase FROM m_customer GROUP BY 1""",
)
def _(x):
    bands = ["high_value", "low_value", "mid_value", "no_purchase"]
    return x.mart("customer_features").groupBy("region").pivot("customer_value_band", bands).count().na.fill(0)


@query(
    "ag_16_row_normalised_cross_tab",
    "region customer_value_band row_share:f",
    """SELECT region, customer_value_band, n / sum(n) OVER (PARTITION BY region) AS row_share
       FROM (SELECT region, customer_value_band, count(*) AS n FROM m_customer GROUP BY 1, 2)""",
)
def _(x):
    return A.row_shares(x.mart("customer_features"), "region", "customer_value_band")


@query(
    "ag_17_value_shares",
    "event_type n:i share:f",
    "SELECT event_type, count(*) AS n, count(*) / (SELECT count(*) FROM r_clicks) AS share FROM r_clicks GROUP BY 1",
)
def _(x):
    return A.value_shares(x.staging.session_events, "event_type")


@query(
    "ag_18_sparsity",
    "users:i items:i pairs:i sparsity:f",
    """SELECT count(DISTINCT customer_id) AS users, count(DISTINCT product_id) AS items, count(DISTINCT (customer_id, product_id)) AS pairs,
       1 - count(DISTINCT (customer_id, product_id)) / (CAST(count(DISTINCT customer_id) AS DOUBLE) * count(DISTINCT product_id)) AS sparsity
       FROM r_orders JOIN r_items USING (order_id)""",
)
def _(x):
    from shelfsense.plans import recommend as rec

    return A.sparsity(rec.seen_items(rec.purchases(x.staging)), "customer_id", "product_id")


@query(
    "ag_19_fixed_edge_histogram",
    "bucket n:i",
    """SELECT CASE WHEN n <= 0 OR n > 100 THEN NULL WHEN n <= 5 THEN '(0,5]' WHEN n <= 10 THEN '(5,10]' WHEN n <= 20 THEN '(10,20]'
       WHEN n <= 50 THEN '(20,50]' ELSE '(50,100]' END AS bucket, count(*) AS n
       FROM (SELECT customer_id, count(*) AS n FROM r_orders JOIN r_items USING (order_id) GROUP BY 1) GROUP BY 1""",
)
def _(x):
    from shelfsense.plans import recommend as rec

    per_user = rec.purchases(x.staging).groupBy("customer_id").agg(F.count("*").alias("n"))
    return A.histogram(per_user, "n", [0, 5, 10, 20, 50, 100])


@query(
    "ag_20_exact_quantiles",
    "metric:s q25:f q50:f q95:f",
    """SELECT 'item_net_price' AS metric, quantile_cont(item_net_price, 0.25) AS q25, quantile_cont(item_net_price, 0.5) AS q50,
       quantile_cont(item_net_price, 0.95) AS q95 FROM b_returns
       UNION ALL SELECT 'item_discount_pct', quantile_cont(item_discount_pct, 0.25), quantile_cont(item_discount_pct, 0.5),
       quantile_cont(item_discount_pct, 0.95) FROM b_returns""",
)
def _(x):
    q = ordered.quantiles(x.mart("returns_risk"), ["item_net_price", "item_discount_pct"], [0.25, 0.5, 0.95])
    return q.select(F.col("column").alias("metric"), F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q95"))


@query(
    "ag_21_skewness",
    "revenue:f orders:f",
    "SELECT skewness(total_net_revenue) AS revenue, skewness(total_orders) AS orders FROM m_customer",
)
def _(x):
    return x.mart("customer_features").agg(
        A.sample_skewness("total_net_revenue").alias("revenue"), A.sample_skewness("total_orders").alias("orders")
    )


@query(
    "ag_22_null_report",
    "column_name null_count:i null_rate:f",
    """SELECT 'customer_id' AS column_name, count(*) FILTER (WHERE customer_id IS NULL) AS null_count, avg(CAST(customer_id IS NULL AS INTEGER)) AS null_rate FROM m_customer
       UNION ALL SELECT 'loyalty_tier', count(*) FILTER (WHERE loyalty_tier IS NULL), avg(CAST(loyalty_tier IS NULL AS INTEGER)) FROM m_customer
       UNION ALL SELECT 'total_orders', count(*) FILTER (WHERE total_orders IS NULL), avg(CAST(total_orders IS NULL AS INTEGER)) FROM m_customer
       UNION ALL SELECT 'total_sessions', count(*) FILTER (WHERE total_sessions IS NULL), avg(CAST(total_sessions IS NULL AS INTEGER)) FROM m_customer""",
)
def _(x):
    return Q.null_report(x.mart("customer_features"), ["customer_id", "loyalty_tier", "total_orders", "total_sessions"])


@query(
    "ag_23_duplicate_rows",
    "duplicate_rows:i",
    "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT customer_id_nullable, product_id_nullable FROM r_clicks)) AS duplicate_rows FROM r_clicks",
)
def _(x):
    return Q.duplicate_rows(x.staging.session_events, ["customer_id_nullable", "product_id_nullable"])


@query(
    "ag_24_period_counts",
    "grain period:d n:i churn_rate:f",
    """SELECT 'month' AS grain, CAST(date_trunc('month', signup_date) AS DATE) AS period, count(*) AS n, avg(churn_flag_90d) AS churn_rate FROM m_customer GROUP BY 2
       UNION ALL SELECT 'quarter', CAST(date_trunc('quarter', signup_date) AS DATE), count(*), avg(churn_flag_90d) FROM m_customer GROUP BY 2""",
)
def _(x):
    m = x.mart("customer_features")
    by = lambda g: A.period_outcome(m, "signup_date", g, "churn_flag_90d", "churn_rate").withColumn("grain", F.lit(g))
    return by("month").unionByName(by("quarter"))


@query(
    "ag_25_weighted_mean",
    "region v:f",
    "SELECT region, sum(avg_order_value * total_orders) / sum(total_orders) AS v FROM m_customer WHERE total_orders IS NOT NULL GROUP BY 1",
)
def _(x):
    return x.mart("customer_features").groupBy("region").agg(A.weighted_mean("avg_order_value", "total_orders").alias("v"))


@query(
    "ag_26_view_to_buy",
    "category viewers:i buyers:i view_to_buy:f",
    """SELECT category, coalesce(v, 0) AS viewers, b AS buyers, CASE WHEN v > 0 THEN b / v END AS view_to_buy FROM
       (SELECT category, count(DISTINCT customer_id) AS b FROM r_orders JOIN r_items USING (order_id) JOIN r_products USING (product_id) GROUP BY 1)
       LEFT JOIN (SELECT category, count(DISTINCT customer_id_nullable) AS v FROM r_clicks JOIN r_products ON product_id_nullable = product_id
         WHERE event_type = 'view_product' AND customer_id_nullable IS NOT NULL GROUP BY 1) USING (category)""",
)
def _(x):
    from shelfsense.plans import recommend as rec

    return A.view_to_buy(
        rec.known_events(x.staging, "view_product"), rec.purchases(x.staging), x.staging.products
    )


@query(
    "ag_27_campaign_sizes",
    "campaign_id rows_n:i treated:i treated_share:f",
    """SELECT campaign_id, count(*) AS rows_n, count(*) FILTER (WHERE treatment_flag) AS treated,
       avg(CAST(treatment_flag AS INTEGER)) AS treated_share FROM s_targets GROUP BY 1""",
)
def _(x):
    return A.arm_sizes(x.mart("campaign_response"), "campaign_id", "treatment_flag")


@query(
    "ag_28_campaigns_per_customer",
    "campaigns:i customers:i",
    "SELECT c AS campaigns, count(*) AS customers FROM (SELECT customer_id, count(DISTINCT campaign_id) AS c FROM s_targets GROUP BY 1) GROUP BY 1",
)
def _(x):
    per = x.mart("campaign_response").groupBy("customer_id").agg(F.countDistinct("campaign_id").alias("campaigns"))
    return per.groupBy("campaigns").agg(F.count("*").alias("customers"))


@query(
    "ag_28_targeting_sources",
    "targeting_rule_source randomised:i n:i",
    """SELECT targeting_rule_source, CASE WHEN targeting_rule_source LIKE 'random%' THEN 1 ELSE 0 END AS randomised, count(*) AS n
       FROM s_targets GROUP BY ALL""",
)
def _(x):
    return (
        x.staging.campaign_targets.withColumn("randomised", C.starts_with_flag("targeting_rule_source", "random"))
        .groupBy("targeting_rule_source", "randomised")
        .agg(F.count("*").alias("n"))
    )
