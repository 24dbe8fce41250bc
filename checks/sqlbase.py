"""Named SQL building blocks for the reference queries, written against the given tables.

``with_tables(body)`` puts in front of a query the definitions it names, and theirs.
"""

from __future__ import annotations

import re

_LINE = (
    "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'"
    " || CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)"
)
_PRI = "substr(o_orderpriority, 1, 1)"
_ASSIGNED = (
    "(TIMESTAMP '1996-01-01 00:00:00' + to_days(CAST(k * 300 + c_custkey % 14 AS INTEGER))"
    " + to_hours(CAST(c_custkey % 24 AS INTEGER)))"
)
_RAWNUM = "CAST(json_extract(props, '$.k') AS BIGINT)"

TABLES: dict[str, str] = {}


def define(name: str, sql: str) -> None:
    TABLES[name] = sql.strip()


# --- raw tables --------------------------------------------------------------------------
define(
    "r_customers",
    """SELECT 'C' || c_custkey AS customer_id,
    DATE '1995-01-01' + CAST(c_custkey % 1500 AS INTEGER) AS signup_date,
    CAST(1950 + c_custkey % 50 AS DOUBLE) AS birth_year,
    CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'm' END AS gender, r_name AS region,
    'tier_' || (1 + c_nationkey % 3) AS city_tier,
    CASE c_custkey % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'social' WHEN 2 THEN 'referral' ELSE 'email' END AS acquisition_channel,
    CASE c_custkey % 3 WHEN 0 THEN 'online' WHEN 1 THEN 'store' ELSE 'app' END AS preferred_channel,
    CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS loyalty_tier,
    CASE WHEN c_custkey % 2 = 0 THEN DATE '1995-01-01' + CAST(c_custkey % 1500 + 30 AS INTEGER) END AS loyalty_signup_date,
    CASE WHEN c_acctbal < 3000 THEN 'low' WHEN c_acctbal < 7000 THEN 'mid' ELSE 'high' END AS income_band,
    c_mktsegment AS customer_segment_seed, c_custkey % 3 <> 0 AS is_marketing_opt_in
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
define(
    "r_orders",
    f"""SELECT 'O' || o_orderkey AS order_id, 'C' || o_custkey AS customer_id,
    o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS order_datetime,
    CAST(o_orderdate AS DATE) AS order_date,
    CASE {_PRI} WHEN '1' THEN 'online' WHEN '2' THEN 'Online' WHEN '3' THEN 'store' WHEN '4' THEN 'Store' ELSE 'app' END AS channel,
    CASE WHEN {_PRI} IN ('3', '4') THEN 'S' || (o_orderkey % 10) END AS store_id_nullable,
    CASE o_orderkey % 3 WHEN 0 THEN 'card' WHEN 1 THEN 'wallet' ELSE 'cash' END AS payment_type,
    CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Completed' ELSE 'completed' END
        WHEN 'O' THEN 'pending' ELSE 'canceled' END AS order_status,
    o_totalprice / 300.0::DOUBLE AS gross_amount, o_totalprice / 300.0::DOUBLE * 0.05::DOUBLE AS discount_amount,
    o_totalprice / 300.0::DOUBLE * 0.95::DOUBLE AS net_amount,
    CAST(o_orderkey % 4 AS DOUBLE) * 2.5::DOUBLE AS shipping_fee,
    CASE o_orderkey % 2 WHEN 0 THEN 'mobile' ELSE 'desktop' END AS device_type,
    1 + o_orderkey % 5 AS basket_size, o_orderkey % 5 = 0 AS used_promo_code,
    CASE WHEN o_orderkey % 5 = 0 THEN 'PROMO' || (o_orderkey % 9) END AS promo_code_nullable,
    o_orderkey % 7 = 0 AS campaign_attributed_flag,
    CASE WHEN {_PRI} NOT IN ('3', '4') THEN 'W' || o_orderkey END AS session_id_nullable,
    CAST(o_orderkey % 100 AS DOUBLE) / 100 AS fraud_risk_seed
    FROM orders""",
)
define(
    "r_items",
    f"""SELECT {_LINE} AS order_item_id, 'O' || l_orderkey AS order_id, 'P' || l_partkey AS product_id,
    CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice / 300.0::DOUBLE AS item_list_price,
    abs(l_discount) * 5 AS item_discount_pct,
    l_extendedprice * (1 - l_discount) / 300.0::DOUBLE AS item_net_price,
    l_extendedprice * 0.6::DOUBLE / 300.0::DOUBLE AS item_cost,
    l_extendedprice * (0.4::DOUBLE - l_discount) / 300.0::DOUBLE AS item_margin,
    CASE l_linenumber % 2 WHEN 0 THEN 'ship' ELSE 'pickup' END AS fulfillment_type
    FROM lineitem""",
)
define(
    "r_products",
    """SELECT 'P' || p_partkey AS product_id, p_type AS category, p_brand AS subcategory,
    CASE p_partkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'partner' ELSE 'premium' END AS brand_type,
    CASE WHEN p_retailprice < 930 THEN 'low' WHEN p_retailprice < 970 THEN 'mid' ELSE 'high' END AS price_tier,
    p_retailprice AS base_price, p_retailprice * 0.6::DOUBLE AS cost,
    DATE '1994-01-01' + CAST(p_partkey % 700 AS INTEGER) AS launch_date, 'style_' || (p_size % 4) AS product_style,
    p_partkey % 4 = 0 AS seasonal_flag, p_partkey % 7 = 0 AS premium_flag,
    CAST(p_partkey % 100 AS DOUBLE) / 100 AS return_risk_seed,
    CASE WHEN p_size < 17 THEN 'thin' WHEN p_size < 34 THEN 'normal' ELSE 'wide' END AS margin_band
    FROM part""",
)
define(
    "r_attributes",
    """SELECT 'P' || p_partkey AS product_id, split_part(p_name, ' ', 1) AS color,
    CASE WHEN p_size < 25 THEN 'small' ELSE 'large' END AS size_group, 'mat_' || (p_partkey % 4) AS material_type,
    p_partkey % 5 = 0 AS eco_flag, p_partkey % 6 = 0 AS bundle_candidate_flag,
    'g' || (p_partkey % 8) || '_' || (p_partkey % 3) AS recommendation_embedding_group, p_name AS description_keywords
    FROM part""",
)
define(
    "r_stores",
    """SELECT 'S' || s_suppkey AS store_id, r_name AS region, n_name AS city,
    CASE s_suppkey % 3 WHEN 0 THEN 'mall' WHEN 1 THEN 'street' ELSE 'outlet' END AS store_type,
    DATE '1990-01-01' + CAST(s_suppkey AS INTEGER) AS opening_date,
    CASE WHEN s_acctbal < 3000 THEN 'small' WHEN s_acctbal < 7000 THEN 'medium' ELSE 'large' END AS store_size_band,
    CASE s_suppkey % 2 WHEN 0 THEN 'full' ELSE 'express' END AS store_format,
    CAST(s_suppkey % 90 AS DOUBLE) AS latitude_fake, CAST(s_suppkey % 180 AS DOUBLE) AS longitude_fake
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
define(
    "r_daily",
    """SELECT CAST(o_orderdate AS DATE) AS date, 'P' || l_partkey AS product_id, l_partkey,
    CASE WHEN substr(o_orderpriority, 1, 1) IN ('3', '4') THEN 'S' || (o_orderkey % 10) ELSE 'ONLINE' END AS store_id_or_online,
    l_extendedprice, abs(l_discount) * 5 AS pct, CAST(l_quantity AS INTEGER) AS quantity, l_returnflag
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
define(
    "r_prices",
    """SELECT date, product_id, store_id_or_online, max(l_extendedprice) / 300.0::DOUBLE AS listed_price,
    max(pct) AS discount_pct, max(pct) >= 0.2::DOUBLE AS promo_flag, max(pct) >= 0.35::DOUBLE AS markdown_flag,
    max(l_partkey) % 6 = 0 AS bundle_flag
    FROM r_daily GROUP BY date, product_id, store_id_or_online""",
)
define(
    "r_inventory",
    """SELECT date, product_id, store_id_or_online, sold * 2 + spare AS starting_inventory,
    sold + spare AS ending_inventory, sold AS stock_received, sold + spare < 15 AS stockout_flag,
    sold + spare < 8 AS backorder_flag
    FROM (SELECT date, product_id, store_id_or_online,
            CAST(sum(quantity) FILTER (WHERE l_returnflag <> 'N') AS INTEGER) AS sold,
            CAST(max(l_partkey) % 10 AS INTEGER) AS spare
          FROM r_daily GROUP BY date, product_id, store_id_or_online) WHERE sold IS NOT NULL""",
)
define(
    "r_campaigns",
    """SELECT 'CMP' || r_regionkey AS campaign_id, 'Campaign ' || r_regionkey AS campaign_name,
    CASE r_regionkey % 3 WHEN 0 THEN 'retention' WHEN 1 THEN 'winback' ELSE 'seasonal' END AS campaign_type,
    DATE '1996-01-01' + CAST(r_regionkey * 300 AS INTEGER) AS start_date,
    DATE '1996-01-01' + CAST(r_regionkey * 300 + 30 AS INTEGER) AS end_date,
    CASE r_regionkey % 2 WHEN 0 THEN 'email' ELSE 'push' END AS channel,
    CASE r_regionkey % 2 WHEN 0 THEN 'percent_discount' ELSE 'free_shipping' END AS offer_type,
    CAST(5 + r_regionkey * 5 AS DOUBLE) AS offer_strength, 'rule ' || r_regionkey AS target_rule_summary,
    0.16::DOUBLE AS control_group_pct FROM region""",
)
define(
    "r_targets",
    f"""SELECT 'CMP' || k AS campaign_id, 'C' || c_custkey AS customer_id, {_ASSIGNED} AS assignment_datetime,
    (c_custkey + k) % 6 <> 0 AS treatment_flag, (c_custkey + k) % 6 = 0 AS control_flag,
    CASE WHEN c_custkey % 40 = 7 THEN NULL ELSE (c_custkey * 31 + k * 17) % 100 < 70 END AS eligibility_flag,
    c_mktsegment AS predicted_business_segment_at_send,
    CASE c_custkey % 3 WHEN 0 THEN 'rule_based_v1' WHEN 1 THEN 'randomised_holdout' END AS targeting_rule_source,
    c_custkey, k FROM customer, (SELECT unnest([0, 1, 2, 3, 4]) AS k)""",
)
define(
    "r_events",
    """SELECT t.campaign_id, t.customer_id, (c_custkey + k) % 10 <> 0 AS delivered_flag,
    (c_custkey * 3 + k) % 4 = 0 AS open_flag, (c_custkey * 5 + k) % 9 = 0 AS click_flag,
    (c_custkey + k) % 97 = 0 AS unsubscribe_flag,
    copy = 0 AND r7 IS NOT NULL AS conversion_within_7d, copy = 0 AND r30 IS NOT NULL AS conversion_within_30d,
    CASE WHEN copy = 0 THEN coalesce(r7, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS revenue_within_7d,
    CASE WHEN copy = 0 THEN coalesce(r30, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS revenue_within_30d
    FROM (SELECT *, unnest(CASE WHEN c_custkey % 50 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM r_targets) t
    LEFT JOIN (SELECT x.campaign_id, x.customer_id, sum(o.net_amount) AS r30,
                 sum(o.net_amount) FILTER (WHERE o.order_datetime < x.assignment_datetime + INTERVAL 7 DAY) AS r7
               FROM r_targets x JOIN s_completed o ON x.customer_id = o.customer_id
                AND o.order_datetime >= x.assignment_datetime
                AND o.order_datetime < x.assignment_datetime + INTERVAL 30 DAY
               GROUP BY x.campaign_id, x.customer_id) h
    ON t.campaign_id = h.campaign_id AND t.customer_id = h.customer_id""",
)
define(
    "r_returns",
    f"""SELECT 'R' || {_LINE} AS return_id, {_LINE} AS order_item_id,
    CAST(o_orderdate AS DATE) + l_linenumber * 5 AS return_request_date,
    CAST(o_orderdate AS DATE) + (l_linenumber * 5 + 3) AS return_processed_date,
    CASE l_linenumber % 4 WHEN 0 THEN 'changed_mind' WHEN 1 THEN 'defective' WHEN 2 THEN 'suspected_abuse' ELSE 'late' END AS return_reason,
    l_extendedprice * (1 - l_discount) * 0.9::DOUBLE / 300.0::DOUBLE AS refund_amount,
    CASE l_linenumber % 2 WHEN 0 THEN 'card' ELSE 'voucher' END AS refund_method,
    CASE l_partkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' ELSE 'rejected' END AS return_status,
    CASE l_suppkey % 2 WHEN 0 THEN 'store' ELSE 'mail' END AS return_channel
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
)
define(
    "r_labels",
    f"""SELECT 'R' || {_LINE} AS return_id,
    l_extendedprice > 60000 AND (l_orderkey + l_partkey) % 4 = 0 AS is_abuse
    FROM lineitem WHERE l_returnflag = 'R'""",
)
define(
    "r_reviews",
    f"""SELECT 'V' || event_id AS review_id, 'C' || user_id AS customer_id, 'P' || {_RAWNUM} AS product_id,
    CAST(ts AS DATE) AS review_date, 1 + event_id % 5 AS rating, 20 + event_id % 200 AS review_length,
    CAST(event_id % 200 - 100 AS DOUBLE) / 100 AS sentiment_seed, event_id % 7 AS helpful_votes
    FROM events WHERE event_type = 'purchase'""",
)
define(
    "r_sessions",
    """SELECT 'W' || event_id AS session_id, CASE WHEN event_id % 8 <> 0 THEN 'C' || user_id END AS customer_id_nullable,
    ts AS session_start,
    ts + to_minutes(CAST(event_id % 50 AS INTEGER)) + to_seconds(CAST(event_id % 60 AS DOUBLE)) AS session_end,
    CASE event_id % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'social' WHEN 2 THEN 'direct' ELSE 'email' END AS traffic_source,
    CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device_type,
    1 + event_id % 20 AS pages_viewed, event_id % 7 AS product_views, event_id % 5 AS category_views,
    event_type <> 'view' AS add_to_cart_flag, event_type = 'purchase' AS checkout_flag,
    event_type = 'purchase' AS purchase_flag, event_id % 10 = 0 AS bounce_flag
    FROM events WHERE event_type IN ('view', 'click', 'purchase')""",
)
define(
    "r_clicks",
    f"""SELECT 'E' || event_id AS event_id, 'W' || event_id AS session_id,
    CASE WHEN event_id % 11 <> 0 THEN 'C' || user_id END AS customer_id_nullable, ts AS event_time,
    CASE event_type WHEN 'view' THEN 'view_product' WHEN 'click' THEN 'add_to_cart' WHEN 'signup' THEN 'wishlist_add'
        ELSE event_type END AS event_type,
    CASE WHEN event_id % 13 <> 0 THEN 'P' || {_RAWNUM} END AS product_id_nullable,
    CASE event_id % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'STANDARD' END AS category_nullable
    FROM events""",
)
define(
    "r_calendar",
    """SELECT d AS date, dayname(d) AS day_of_week, weekofyear(d) AS week_of_year, month(d) AS month,
    quarter(d) AS quarter, year(d) AS year, isodow(d) >= 6 AS is_weekend, d = last_day(d) AS is_month_end,
    day(d) IN (1, 2, 3, 15, 16, 28, 29, 30, 31) AS is_payday_period,
    CASE strftime(d, '%m-%d') WHEN '01-01' THEN 'New Year Day' WHEN '12-25' THEN 'Christmas' WHEN '12-26' THEN 'Boxing Day'
        WHEN '11-29' THEN 'Black Friday' WHEN '07-04' THEN 'Summer Sale' END AS holiday_name,
    strftime(d, '%m-%d') IN ('01-01', '12-25', '12-26', '11-29', '07-04') AS is_public_holiday,
    CASE WHEN month(d) IN (12, 1, 2) THEN 'winter_reset' WHEN month(d) IN (3, 4, 5) THEN 'spring_launch'
        WHEN month(d) IN (6, 7, 8) THEN 'summer_sale' ELSE 'autumn_peak' END AS retail_season,
    month(d) IN (1, 6, 7, 11, 12) AS promo_season_flag
    FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS d FROM orders)""",
)

# --- staging -----------------------------------------------------------------------------
define("s_completed", "SELECT * FROM r_orders WHERE lower(order_status) = 'completed'")
define("s_items", "SELECT * FROM r_items WHERE quantity > 0")
define("s_targets", "SELECT * FROM r_targets WHERE eligibility_flag")
define(
    "s_outcomes",
    """SELECT campaign_id, customer_id, CAST(bool_or(delivered_flag) AS INTEGER) AS delivered_flag,
    CAST(bool_or(open_flag) AS INTEGER) AS open_flag, CAST(bool_or(click_flag) AS INTEGER) AS click_flag,
    CAST(bool_or(unsubscribe_flag) AS INTEGER) AS unsubscribe_flag,
    CAST(bool_or(conversion_within_7d) AS INTEGER) AS conversion_within_7d,
    CAST(bool_or(conversion_within_30d) AS INTEGER) AS conversion_within_30d,
    max(revenue_within_7d) AS revenue_within_7d, max(revenue_within_30d) AS revenue_within_30d,
    count(*) AS source_event_rows FROM r_events GROUP BY ALL""",
)
define(
    "s_lines",
    """SELECT i.*, o.customer_id, o.order_date, o.order_datetime, o.channel, o.payment_type,
    CAST(date_trunc('week', o.order_date) AS DATE) AS week_start_date,
    CASE WHEN lower(o.channel) = 'store' THEN o.store_id_nullable ELSE 'ONLINE' END AS store_id_or_online
    FROM s_items i JOIN s_completed o USING (order_id)""",
)

# --- marts -------------------------------------------------------------------------------
define(
    "m_customer",
    """SELECT *, dense_rank() OVER (PARTITION BY region ORDER BY coalesce(total_net_revenue, 0) DESC) AS spend_rank_in_region
    FROM (SELECT c.customer_id, c.region, c.city_tier, c.preferred_channel, c.loyalty_tier, c.income_band,
      c.customer_segment_seed, c.is_marketing_opt_in, c.signup_date, total_orders, total_net_revenue, avg_order_value,
      total_discount_amount, avg_basket_size, first_order_date, last_order_date,
      anchor - last_order_date AS recency_days, anchor - signup_date AS tenure_days,
      total_net_revenue / nullif(total_orders, 0) AS revenue_per_order,
      online_orders / nullif(total_orders, 0) AS online_order_share,
      store_orders / nullif(total_orders, 0) AS store_order_share,
      total_units, avg_item_discount_pct, avg_item_margin, total_returns, total_refund_amount, avg_days_to_return,
      CASE WHEN total_units > 0 THEN total_returns / total_units ELSE 0 END AS return_rate_per_unit,
      total_sessions, avg_session_minutes, avg_pages_viewed, sessions_add_to_cart, sessions_with_purchase,
      campaigns_targeted, campaigns_treatment, campaigns_converted_30d, campaign_revenue_30d,
      CASE WHEN anchor - last_order_date > 90 THEN 1 ELSE 0 END AS churn_flag_90d,
      CASE WHEN total_net_revenue IS NULL THEN 'no_purchase' WHEN total_net_revenue < 600 THEN 'low_value'
           WHEN total_net_revenue < 1500 THEN 'mid_value' ELSE 'high_value' END AS customer_value_band
    FROM r_customers c CROSS JOIN (SELECT max(order_date) AS anchor FROM s_completed)
    LEFT JOIN (SELECT customer_id, count(DISTINCT order_id) AS total_orders, sum(net_amount) AS total_net_revenue,
        avg(net_amount) AS avg_order_value, sum(discount_amount) AS total_discount_amount,
        avg(basket_size) AS avg_basket_size, min(order_date) AS first_order_date, max(order_date) AS last_order_date,
        count(*) FILTER (WHERE lower(channel) = 'online') AS online_orders,
        count(*) FILTER (WHERE lower(channel) = 'store') AS store_orders
      FROM s_completed GROUP BY customer_id) oa USING (customer_id)
    LEFT JOIN (SELECT customer_id, sum(quantity) AS total_units, avg(item_discount_pct) AS avg_item_discount_pct,
        avg(item_margin) AS avg_item_margin FROM s_lines GROUP BY customer_id) ia USING (customer_id)
    LEFT JOIN (SELECT l.customer_id, count(r.return_id) AS total_returns, sum(r.refund_amount) AS total_refund_amount,
        avg(r.return_request_date - l.order_date) AS avg_days_to_return
      FROM s_lines l LEFT JOIN r_returns r ON l.order_item_id = r.order_item_id GROUP BY l.customer_id) ra USING (customer_id)
    LEFT JOIN (SELECT customer_id_nullable AS customer_id, count(*) AS total_sessions,
        avg(date_diff('minute', session_start, session_end)) AS avg_session_minutes,
        avg(pages_viewed) AS avg_pages_viewed, count(*) FILTER (WHERE add_to_cart_flag) AS sessions_add_to_cart,
        count(*) FILTER (WHERE purchase_flag) AS sessions_with_purchase
      FROM r_sessions WHERE customer_id_nullable IS NOT NULL GROUP BY 1) sa USING (customer_id)
    LEFT JOIN (SELECT t.customer_id, count(*) AS campaigns_targeted,
        count(*) FILTER (WHERE treatment_flag) AS campaigns_treatment,
        count(*) FILTER (WHERE conversion_within_30d = 1) AS campaigns_converted_30d,
        sum(coalesce(revenue_within_30d, 0)) AS campaign_revenue_30d
      FROM s_targets t LEFT JOIN s_outcomes e ON t.campaign_id = e.campaign_id AND t.customer_id = e.customer_id
      GROUP BY t.customer_id) ca USING (customer_id))""",
)
define(
    "w_demand",
    """SELECT week_start_date, product_id, store_id_or_online, sum(quantity) AS units_sold, count(*) AS order_line_count,
    sum(item_net_price) AS net_revenue, avg(item_discount_pct) AS avg_item_discount_pct FROM s_lines GROUP BY ALL""",
)
define(
    "w_prices",
    """SELECT CAST(date_trunc('week', date) AS DATE) AS week_start_date, product_id, store_id_or_online,
    avg(listed_price) AS avg_listed_price, avg(discount_pct) AS avg_discount_pct,
    count(*) FILTER (WHERE promo_flag) AS promo_days, count(*) FILTER (WHERE markdown_flag) AS markdown_days
    FROM r_prices GROUP BY ALL""",
)
define(
    "w_inventory",
    """SELECT CAST(date_trunc('week', date) AS DATE) AS week_start_date, product_id, store_id_or_online,
    avg(starting_inventory) AS avg_starting_inventory, avg(ending_inventory) AS avg_ending_inventory,
    sum(stock_received) AS stock_received_units, count(*) FILTER (WHERE stockout_flag) AS stockout_days,
    count(*) FILTER (WHERE backorder_flag) AS backorder_days FROM r_inventory GROUP BY ALL""",
)
define(
    "m_demand",
    """SELECT d.*, category, subcategory, price_tier, seasonal_flag, premium_flag, avg_listed_price, avg_discount_pct,
    promo_days, markdown_days, avg_starting_inventory, avg_ending_inventory, stock_received_units, stockout_days,
    backorder_days, lag(units_sold) OVER w AS lag_1w_units_sold, lag(units_sold, 4) OVER w AS lag_4w_units_sold,
    avg(units_sold) OVER (w ROWS 3 PRECEDING) AS rolling_4w_avg_units,
    sum(net_revenue) OVER (w ROWS 3 PRECEDING) AS rolling_4w_revenue,
    CASE WHEN units_sold < 10 THEN 'low' WHEN units_sold < 30 THEN 'medium' ELSE 'high' END AS weekly_demand_band
    FROM w_demand d LEFT JOIN w_prices USING (week_start_date, product_id, store_id_or_online)
    LEFT JOIN w_inventory USING (week_start_date, product_id, store_id_or_online)
    LEFT JOIN r_products USING (product_id)
    WINDOW w AS (PARTITION BY product_id, store_id_or_online ORDER BY week_start_date)""",
)
define(
    "m_store",
    """SELECT h.week_start_date, h.store_id_or_online, coalesce(region, 'online') AS region, city, store_type, store_size_band,
    order_count, net_revenue, discount_amount, avg_basket_size, campaign_attributed_orders, units_sold, item_margin,
    avg_item_discount_pct, avg_starting_inventory, avg_ending_inventory, stock_received_units, stockout_days,
    backorder_days, avg_discount_pct, promo_days, markdown_days,
    sum(net_revenue) OVER (w ROWS UNBOUNDED PRECEDING) AS running_revenue,
    avg(net_revenue) OVER (w ROWS 3 PRECEDING) AS rolling_4w_avg_revenue, lag(net_revenue) OVER w AS lag_1w_revenue,
    CASE WHEN net_revenue < 8000 THEN 'low' WHEN net_revenue < 20000 THEN 'medium' ELSE 'high' END AS performance_band
    FROM (SELECT CAST(date_trunc('week', order_date) AS DATE) AS week_start_date,
        CASE WHEN lower(channel) = 'store' THEN store_id_nullable ELSE 'ONLINE' END AS store_id_or_online,
        count(DISTINCT order_id) AS order_count, sum(net_amount) AS net_revenue, sum(discount_amount) AS discount_amount,
        avg(basket_size) AS avg_basket_size, count(*) FILTER (WHERE campaign_attributed_flag) AS campaign_attributed_orders
      FROM s_completed GROUP BY ALL) h
    LEFT JOIN (SELECT week_start_date, store_id_or_online, sum(quantity) AS units_sold, sum(item_margin) AS item_margin,
        avg(item_discount_pct) AS avg_item_discount_pct FROM s_lines GROUP BY ALL) i USING (week_start_date, store_id_or_online)
    LEFT JOIN (SELECT CAST(date_trunc('week', date) AS DATE) AS week_start_date, store_id_or_online,
        avg(starting_inventory) AS avg_starting_inventory, avg(ending_inventory) AS avg_ending_inventory,
        sum(stock_received) AS stock_received_units, count(*) FILTER (WHERE stockout_flag) AS stockout_days,
        count(*) FILTER (WHERE backorder_flag) AS backorder_days FROM r_inventory GROUP BY ALL) v
      USING (week_start_date, store_id_or_online)
    LEFT JOIN (SELECT CAST(date_trunc('week', date) AS DATE) AS week_start_date, store_id_or_online,
        avg(discount_pct) AS avg_discount_pct, count(*) FILTER (WHERE promo_flag) AS promo_days,
        count(*) FILTER (WHERE markdown_flag) AS markdown_days FROM r_prices GROUP BY ALL) p
      USING (week_start_date, store_id_or_online)
    LEFT JOIN r_stores ON store_id = h.store_id_or_online
    WINDOW w AS (PARTITION BY h.store_id_or_online ORDER BY h.week_start_date)""",
)
define(
    "pre90",
    """SELECT t.campaign_id, t.customer_id, t.assignment_datetime, count(DISTINCT o.order_id) AS pre_90d_orders,
    sum(o.net_amount) AS pre_90d_revenue, avg(o.net_amount) AS pre_90d_aov
    FROM s_targets t LEFT JOIN s_completed o ON o.customer_id = t.customer_id
      AND o.order_datetime BETWEEN t.assignment_datetime - INTERVAL 90 DAY AND t.assignment_datetime - INTERVAL 1 MICROSECOND
    GROUP BY ALL""",
)
define(
    "m_campaign",
    """SELECT *, row_number() OVER (PARTITION BY campaign_id
        ORDER BY conversion_within_30d DESC NULLS LAST, revenue_within_30d DESC, customer_id) AS campaign_response_rank,
    ntile(10) OVER (PARTITION BY campaign_id
        ORDER BY revenue_within_30d DESC, conversion_within_30d DESC NULLS LAST, customer_id) AS revenue_decile_within_campaign
    FROM (SELECT t.campaign_id, campaign_name, campaign_type, c.channel AS campaign_channel, offer_type, offer_strength,
      t.customer_id, t.assignment_datetime, treatment_flag, control_flag, predicted_business_segment_at_send,
      targeting_rule_source, delivered_flag, open_flag, click_flag, unsubscribe_flag, conversion_within_7d,
      conversion_within_30d, coalesce(revenue_within_7d, 0) AS revenue_within_7d,
      coalesce(revenue_within_30d, 0) AS revenue_within_30d, coalesce(source_event_rows, 0) AS source_event_rows,
      pre_90d_orders, pre_90d_revenue, pre_90d_aov, coalesce(conversion_within_30d, 0) AS response_flag_30d,
      CASE WHEN treatment_flag THEN CASE conversion_within_30d WHEN 1 THEN 'persuaded_or_sure_thing'
             WHEN 0 THEN 'treated_no_response' ELSE 'non_converter' END
           WHEN control_flag AND conversion_within_30d = 1 THEN 'organic_converter' ELSE 'non_converter' END AS response_bucket
    FROM s_targets t LEFT JOIN s_outcomes e ON t.campaign_id = e.campaign_id AND t.customer_id = e.customer_id
    LEFT JOIN r_campaigns c ON t.campaign_id = c.campaign_id
    LEFT JOIN pre90 p ON t.campaign_id = p.campaign_id AND t.customer_id = p.customer_id)""",
)
define(
    "b_returns",
    """SELECT l.order_item_id, l.order_id, l.customer_id, l.product_id, order_date, channel, payment_type, category,
    subcategory, price_tier, region, loyalty_tier, quantity, item_list_price, item_discount_pct, item_net_price,
    item_cost, item_margin, fulfillment_type, CAST(return_id IS NOT NULL AS INTEGER) AS return_flag, return_id,
    return_reason, return_status, return_channel, refund_amount, return_request_date - order_date AS days_to_return,
    CASE WHEN item_discount_pct < 0.15::DOUBLE THEN 'low_discount' WHEN item_discount_pct < 0.35::DOUBLE THEN 'medium_discount'
         ELSE 'deep_discount' END AS discount_band, return_risk_seed
    FROM s_lines l LEFT JOIN r_returns r ON l.order_item_id = r.order_item_id
    LEFT JOIN r_products p ON l.product_id = p.product_id LEFT JOIN r_customers c ON l.customer_id = c.customer_id""",
)
define(
    "m_returns",
    """SELECT *, CASE WHEN greatest(prior_customer_return_rate, item_discount_pct) >= 0.35::DOUBLE THEN 'high'
        WHEN greatest(prior_customer_return_rate, item_discount_pct) >= 0.15::DOUBLE THEN 'medium' ELSE 'low' END AS return_risk_band
    FROM (SELECT *, coalesce(avg(return_flag) OVER (PARTITION BY customer_id ORDER BY order_date, order_item_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_customer_return_rate,
      coalesce(sum(return_flag) OVER (PARTITION BY product_id ORDER BY order_date, order_item_id
          ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0) AS recent_product_return_events,
      row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_item_id DESC) AS customer_item_recency_rank
    FROM b_returns)""",
)
define(
    "daily_inter",
    """SELECT customer_id, product_id, order_date AS interaction_date, 'purchase' AS interaction_source,
      sum(quantity) AS n, sum(item_net_price) AS v, CAST(sum(quantity) AS DOUBLE) * 3 AS w FROM s_lines GROUP BY 1, 2, 3
    UNION ALL SELECT customer_id_nullable, product_id_nullable, CAST(event_time AS DATE), 'session_event', count(*),
      0::DOUBLE, sum(CASE event_type WHEN 'add_to_cart' THEN 2::DOUBLE WHEN 'view_product' THEN 1::DOUBLE
        WHEN 'purchase' THEN 3::DOUBLE ELSE 0.5::DOUBLE END) FROM r_clicks
      WHERE customer_id_nullable IS NOT NULL AND product_id_nullable IS NOT NULL GROUP BY 1, 2, 3
    UNION ALL SELECT customer_id, product_id, review_date, 'review', count(*), avg(rating), CAST(sum(rating) AS DOUBLE)
      FROM r_reviews GROUP BY 1, 2, 3""",
)
define(
    "m_inter",
    """SELECT *, max(last_interaction_date) OVER () - last_interaction_date AS recency_days,
    row_number() OVER (PARTITION BY customer_id ORDER BY interaction_score DESC, last_interaction_date DESC, product_id) AS product_rank_for_customer,
    row_number() OVER (PARTITION BY customer_id, category ORDER BY interaction_score DESC, last_interaction_date DESC, product_id) AS category_rank_for_customer
    FROM (SELECT customer_id, product_id, count(*) AS active_days, sum(n) AS total_interactions,
        sum(v) AS total_interaction_value, sum(w) AS interaction_score,
        min(interaction_date) AS first_interaction_date, max(interaction_date) AS last_interaction_date
      FROM daily_inter GROUP BY 1, 2)
    LEFT JOIN (SELECT product_id, category, subcategory, price_tier, brand_type FROM r_products) USING (product_id)
    LEFT JOIN (SELECT product_id, color, material_type, recommendation_embedding_group FROM r_attributes) USING (product_id)""",
)

_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def with_tables(body: str) -> str:
    """Prefix ``body`` with the definitions it needs, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_WORD.findall(text)):
            if name in TABLES and name not in ordered:
                visit(TABLES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body
    defs = ",\n".join(f"{n} AS ({TABLES[n]})" for n in ordered)
    return f"WITH {defs}\n{body}"
