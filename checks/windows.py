"""Window functions, sorting and top-k."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.registry import query
from shelfsense.operators import ordered
from shelfsense.plans import features as FT
from shelfsense.plans import marts as M


def _series():
    return Window.partitionBy("product_id", "store_id_or_online").orderBy("week_start_date")


@query(
    "wn_01_order_recency_rank",
    "order_id customer_id order_recency_rank:i",
    "SELECT order_id, customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_id DESC) AS order_recency_rank FROM s_completed",
)
def _(x):
    orders = x.staging.completed_orders.select("order_id", "customer_id", "order_date")
    return ordered.row_number(
        orders, ["customer_id"], [F.col("order_date").desc(), F.col("order_id").desc()], "order_recency_rank"
    )


@query(
    "wn_02_three_key_rank",
    "customer_id product_id product_rank_for_customer:i category_rank_for_customer:i",
    "SELECT * FROM m_inter",
)
def _(x):
    return M.recommendation_interactions(x.staging)


@query(
    "wn_03_dense_rank_region",
    "customer_id region spend_rank_in_region:i",
    """SELECT customer_id, region, dense_rank() OVER (PARTITION BY region ORDER BY coalesce(r, 0) DESC) AS spend_rank_in_region
       FROM r_customers LEFT JOIN (SELECT customer_id, sum(net_amount) AS r FROM s_completed GROUP BY 1) USING (customer_id)""",
)
def _(x):
    return M.regional_ranks(x.staging).join(x.staging.customers.select("customer_id", "region"), "customer_id")


@query(
    "wn_04_ntile_campaign",
    "campaign_id customer_id revenue_decile_within_campaign:i",
    """SELECT campaign_id, customer_id, ntile(10) OVER (PARTITION BY campaign_id ORDER BY coalesce(revenue_within_30d, 0) DESC, customer_id) AS revenue_decile_within_campaign
       FROM s_targets t LEFT JOIN s_outcomes e USING (campaign_id, customer_id)""",
)
def _(x):
    df = x.mart("campaign_response").select("campaign_id", "customer_id", "revenue_within_30d")
    p = ordered.positions(df, ["campaign_id"], [F.col("revenue_within_30d").desc(), F.col("customer_id")])
    return p.withColumn("revenue_decile_within_campaign", ordered.tile(F.col("rows_before"), F.col("rows_total"), 10))


@query(
    "wn_05_lag_per_series",
    "product_id store_id_or_online week_start_date:d lag1:i lag4:i",
    """SELECT product_id, store_id_or_online, week_start_date, lag(units_sold, 1) OVER w AS lag1, lag(units_sold, 4) OVER w AS lag4
       FROM w_demand WINDOW w AS (PARTITION BY product_id, store_id_or_online ORDER BY week_start_date)""",
)
def _(x):
    d = x.mart("product_demand")
    return d.withColumns({"lag1": F.lag("units_sold", 1).over(_series()), "lag4": F.lag("units_sold", 4).over(_series())})


@query(
    "wn_06_extra_lags",
    "product_id store_id_or_online week_start_date:d lag_2w:i lag_3w:i lag_8w:i lag_13w:i lag_52w:i has_yoy_lag:i",
    """SELECT product_id, store_id_or_online, week_start_date, lag(units_sold, 2) OVER w AS lag_2w, lag(units_sold, 3) OVER w AS lag_3w,
       lag(units_sold, 8) OVER w AS lag_8w, lag(units_sold, 13) OVER w AS lag_13w, lag(units_sold, 52) OVER w AS lag_52w,
       CAST(lag(units_sold, 52) OVER w IS NOT NULL AS INTEGER) AS has_yoy_lag
       FROM w_demand WINDOW w AS (PARTITION BY product_id, store_id_or_online ORDER BY week_start_date)""",
)
def _(x):
    return FT.forecast_features(x.mart("product_demand"))


@query(
    "wn_07_trailing_four",
    "product_id store_id_or_online week_start_date:d mean4:f sum4:f",
    """SELECT product_id, store_id_or_online, week_start_date, avg(units_sold) OVER w AS mean4, sum(net_revenue) OVER w AS sum4 FROM w_demand
       WINDOW w AS (PARTITION BY product_id, store_id_or_online ORDER BY week_start_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
def _(x):
    w = _series().rowsBetween(-3, 0)
    return x.mart("product_demand").withColumns({"mean4": F.avg("units_sold").over(w), "sum4": F.sum("net_revenue").over(w)})


@query(
    "wn_08_running_sum",
    "store_id_or_online week_start_date:d running:f",
    "SELECT store_id_or_online, week_start_date, sum(net_revenue) OVER (PARTITION BY store_id_or_online ORDER BY week_start_date) AS running FROM m_store",
)
def _(x):
    w = Window.partitionBy("store_id_or_online").orderBy("week_start_date").rowsBetween(Window.unboundedPreceding, 0)
    return x.mart("store_week_performance").withColumn("running", F.sum("net_revenue").over(w))


@query(
    "wn_09_prior_mean",
    "order_item_id prior_customer_return_rate:f",
    """SELECT order_item_id, coalesce(avg(return_flag) OVER (PARTITION BY customer_id ORDER BY order_date, order_item_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_customer_return_rate FROM b_returns""",
)
def _(x):
    return M.customer_return_history(M.return_items(x.staging).select("order_item_id", "customer_id", "order_date", "return_flag"))


@query(
    "wn_10_sum_of_thirty_earlier",
    "order_item_id recent_product_return_events:i",
    """SELECT order_item_id, coalesce(sum(return_flag) OVER (PARTITION BY product_id ORDER BY order_date, order_item_id
       ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0) AS recent_product_return_events FROM b_returns""",
)
def _(x):
    return M.product_return_history(M.return_items(x.staging).select("order_item_id", "product_id", "order_date", "return_flag"))


@query(
    "wn_11_lagged_rolling_min_count",
    "product_id store_id_or_online week_start_date:d roll_2w_avg:f roll_8w_avg:f roll_13w_avg:f",
    """SELECT product_id, store_id_or_online, week_start_date, avg(units_sold) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS roll_2w_avg,
       CASE WHEN count(*) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) >= 4 THEN avg(units_sold) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) END AS roll_8w_avg,
       CASE WHEN count(*) OVER (w ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) >= 6 THEN avg(units_sold) OVER (w ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) END AS roll_13w_avg
       FROM w_demand WINDOW w AS (PARTITION BY product_id, store_id_or_online ORDER BY week_start_date)""",
)
def _(x):
    return FT.forecast_features(x.mart("product_demand"))


@query(
    "wn_12_drop_short_series",
    "product_id store_id_or_online week_start_date:d units_sold:i",
    """SELECT product_id, store_id_or_online, week_start_date, units_sold FROM w_demand
       QUALIFY count(*) OVER (PARTITION BY product_id, store_id_or_online) >= 8""",
)
def _(x):
    return FT.drop_short_series(x.mart("product_demand"), 8)


@query(
    "wn_13_sequence_from_zero",
    "order_item_id seq:i",
    """SELECT order_item_id, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_item_id) - 1 AS seq
       FROM b_returns WHERE return_flag = 1""",
)
def _(x):
    r = x.mart("returns_risk").filter("return_flag = 1").select("order_item_id", "customer_id", "order_date")
    return ordered.row_number(r, ["customer_id"], ["order_date", "order_item_id"], "nth").withColumn("seq", F.col("nth") - 1)


@query(
    "wn_14_last_row_per_key",
    "customer_id product_id",
    """SELECT customer_id, product_id FROM m_inter QUALIFY count(*) OVER (PARTITION BY customer_id) > 1 AND
       row_number() OVER (PARTITION BY customer_id ORDER BY last_interaction_date DESC, interaction_score DESC, product_id DESC) = 1""",
)
def _(x):
    from shelfsense.operators import splits

    m = x.mart("recommendation_interactions").select("customer_id", "product_id", "last_interaction_date", "interaction_score")
    return splits.leave_last_out(m, "customer_id", ["last_interaction_date", "interaction_score", "product_id"]).filter("is_test")


@query(
    "wn_15_best_row_per_key",
    "customer_id product_id interaction_score:f",
    """SELECT customer_id, product_id, interaction_score FROM m_inter
       QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY interaction_score DESC, product_id DESC) = 1""",
)
def _(x):
    return (
        x.mart("recommendation_interactions")
        .groupBy("customer_id")
        .agg(F.max(F.struct("interaction_score", "product_id")).alias("best"))
        .select("customer_id", "best.*")
    )


@query(
    "wn_16_global_rank_bins",
    "customer_id decile:i",
    """SELECT customer_id, greatest(1, CAST(ceil(10.0 * i / (n - 1)) AS BIGINT)) AS decile FROM
       (SELECT customer_id, row_number() OVER (ORDER BY tenure_days DESC, customer_id) - 1 AS i, count(*) OVER () AS n FROM m_customer)""",
)
def _(x):
    m = x.mart("customer_features").select("customer_id", "tenure_days")
    p = ordered.positions(m, [], [F.col("tenure_days").desc(), F.col("customer_id")])
    return p.withColumn("decile", ordered.rank_bin(F.col("rows_before"), F.col("rows_total"), 10))


@query(
    "wn_17_quantile_bins",
    "customer_id bin:i",
    """SELECT customer_id, CASE WHEN total_orders IS NULL THEN NULL ELSE 1 + len(list_filter(list_sort(list_distinct(q))[2:-2], lambda e: total_orders > e)) END AS bin
       FROM (SELECT customer_id, total_orders FROM m_customer),
       (SELECT quantile_cont(CAST(total_orders AS DOUBLE), [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM m_customer)""",
)
def _(x):
    from shelfsense.operators.stats import quantile_bins

    m = x.mart("customer_features")
    edges = ordered.quantile_values(m, ["total_orders"], [0, 0.2, 0.4, 0.6, 0.8, 1])["total_orders"]
    return m.withColumn("bin", quantile_bins(F.col("total_orders").cast("double"), edges))


@query(
    "wn_18_cumulative_small_table",
    "channel net:f cumulative:f",
    """SELECT channel, net, sum(net) OVER (ORDER BY channel) AS cumulative
       FROM (SELECT channel, sum(net_amount) AS net FROM s_completed GROUP BY 1)""",
)
def _(x):
    per = x.staging.completed_orders.groupBy("channel").agg(F.sum("net_amount").alias("net"))
    return per.withColumn("cumulative", F.sum("net").over(Window.orderBy("channel").rowsBetween(Window.unboundedPreceding, 0)))


@query(
    "wn_19_global_weekly_series",
    "week_start_date:d units:i shifted:i rolling4:f",
    """SELECT week_start_date, units, lag(units) OVER w AS shifted, CASE WHEN count(*) OVER (w ROWS 3 PRECEDING) = 4
       THEN avg(units) OVER (w ROWS 3 PRECEDING) END AS rolling4 FROM (SELECT week_start_date, sum(units_sold) AS units FROM w_demand GROUP BY 1)
       WINDOW w AS (ORDER BY week_start_date)""",
)
def _(x):
    weekly = x.mart("product_demand").groupBy("week_start_date").agg(F.sum("units_sold").alias("units"))
    w = Window.orderBy("week_start_date")
    four = w.rowsBetween(-3, 0)
    return weekly.withColumns(
        {
            "shifted": F.lag("units").over(w),
            "rolling4": F.when(F.count("*").over(four) == 4, F.avg("units").over(four)),
        }
    )


@query(
    "wn_20_rolling_min_one",
    "week_start_date:d rolling4:f",
    """SELECT week_start_date, avg(units) OVER (ORDER BY week_start_date ROWS 3 PRECEDING) AS rolling4
       FROM (SELECT week_start_date, sum(units_sold) AS units FROM w_demand GROUP BY 1)""",
)
def _(x):
    weekly = x.mart("product_demand").groupBy("week_start_date").agg(F.sum("units_sold").alias("units"))
    return weekly.withColumn("rolling4", F.avg("units").over(Window.orderBy("week_start_date").rowsBetween(-3, 0)))


@query(
    "wn_21_cumulative_share_over_time",
    "signup_date:d n:i cumulative_pct:f",
    """SELECT signup_date, n, 100.0 * sum(n) OVER (ORDER BY signup_date) / sum(n) OVER () AS cumulative_pct
       FROM (SELECT signup_date, count(*) AS n FROM m_customer GROUP BY 1)""",
)
def _(x):
    per_day = x.mart("customer_features").groupBy("signup_date").agg(F.count("*").alias("n"))
    p = ordered.positions(per_day, [], ["signup_date"], sums={"n": "n"})
    return p.withColumn("cumulative_pct", 100.0 * (F.col("n_before") + F.col("n")) / F.col("n_total"))


# --- sort, limit, top-k ------------------------------------------------------------------


@query(
    "srt_01_top_500_ranked",
    "rank:i customer_id total_net_revenue:f",
    """SELECT row_number() OVER (ORDER BY total_net_revenue DESC NULLS LAST, customer_id) AS rank, customer_id, total_net_revenue FROM m_customer
       QUALIFY row_number() OVER (ORDER BY total_net_revenue DESC NULLS LAST, customer_id) <= 500""",
)
def _(x):
    from shelfsense.operators.decisions import top_ranked

    m = x.mart("customer_features").select("customer_id", "total_net_revenue")
    return top_ranked(m, [F.col("total_net_revenue").desc_nulls_last(), F.col("customer_id")], 500)


@query(
    "srt_02_top_groups_by_sum",
    "product_id week_start_date:d units:i",
    """SELECT product_id, week_start_date, sum(units_sold) AS units FROM w_demand WHERE product_id IN
       (SELECT product_id FROM w_demand GROUP BY 1 ORDER BY sum(units_sold) DESC, product_id LIMIT 10) GROUP BY ALL""",
)
def _(x):
    d = x.mart("product_demand")
    top = d.groupBy("product_id").agg(F.sum("units_sold").alias("u")).orderBy(F.col("u").desc(), "product_id").limit(10)
    return d.join(top, "product_id", "left_semi").groupBy("product_id", "week_start_date").agg(F.sum("units_sold").alias("units"))


@query(
    "srt_03_top_per_group",
    "category product_id pop:i pop_rank:i",
    """SELECT category, product_id, count(*) AS pop, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, product_id) AS pop_rank
       FROM r_items JOIN r_products USING (product_id) GROUP BY 1, 2
       QUALIFY row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, product_id) <= 10""",
)
def _(x):
    from shelfsense.plans import recommend as rec

    return rec.category_top(rec.purchases(x.staging), x.staging.products, 10)


@query(
    "srt_04_largest_residuals",
    "product_id store_id_or_online week_start_date:d error:f",
    """SELECT product_id, store_id_or_online, week_start_date, units_sold - lag_1w_units_sold AS error FROM m_demand WHERE lag_1w_units_sold IS NOT NULL
       ORDER BY abs(units_sold - lag_1w_units_sold) DESC, product_id, store_id_or_online, week_start_date LIMIT 500""",
)
def _(x):
    d = x.mart("product_demand").filter("lag_1w_units_sold is not null").withColumn("error", F.col("units_sold") - F.col("lag_1w_units_sold"))
    return d.orderBy(F.abs("error").desc(), "product_id", "store_id_or_online", "week_start_date").limit(500)


@query(
    "srt_05_review_queue",
    "return_id refund_amount:f",
    "SELECT return_id, refund_amount FROM b_returns WHERE refund_amount >= 250",
)
def _(x):
    from shelfsense.plans.returns import review_queue

    return review_queue(x.mart("returns_risk").filter("return_flag = 1"), "refund_amount", 250.0)


@query(
    "srt_06_extreme_rows",
    "kind region revenue:f",
    """SELECT 'max' AS kind, region, revenue FROM (SELECT region, sum(total_net_revenue) AS revenue FROM m_customer GROUP BY 1 ORDER BY 2 DESC LIMIT 1)
       UNION ALL SELECT 'min', region, revenue FROM (SELECT region, sum(total_net_revenue) AS revenue FROM m_customer GROUP BY 1 ORDER BY 2 LIMIT 1)""",
)
def _(x):
    per = x.mart("customer_features").groupBy("region").agg(F.sum("total_net_revenue").alias("revenue"))
    one = per.agg(
        F.max_by("region", "revenue").alias("a"), F.max("revenue").alias("b"), F.min_by("region", "revenue").alias("c"), F.min("revenue").alias("d")
    )
    rows = F.array(
        F.struct(F.lit("max").alias("kind"), F.col("a").alias("region"), F.col("b").alias("revenue")),
        F.struct(F.lit("min").alias("kind"), F.col("c").alias("region"), F.col("d").alias("revenue")),
    )
    return one.select(F.inline(rows))


@query(
    "udf_01_grouped_transform",
    "product_id store_id_or_online week_start_date:d roll_3w_max:i",
    """SELECT product_id, store_id_or_online, week_start_date, max(units_sold) OVER (PARTITION BY product_id, store_id_or_online
       ORDER BY week_start_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS roll_3w_max FROM w_demand""",
)
def _(x):
    back = _series().rowsBetween(-3, -1)
    return x.mart("product_demand").withColumn("roll_3w_max", F.max("units_sold").over(back))
