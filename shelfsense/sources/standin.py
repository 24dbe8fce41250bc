"""Adapter: express the given star-schema tables as the retail raw tables.

Every derived column is integer arithmetic or a product of given columns, so the same
definition can be written in any SQL engine. All rows of the given tables are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_ID = (
    "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string),"
    " cast(l_partkey as string), cast(l_suppkey as string),"
    " cast(cast(floor(l_extendedprice * 100 + 0.5) as bigint) as string))"
)
MONEY_SCALE = 300.0
STORES_IN_USE = 10
CAMPAIGNS = 5


class GivenTables:
    """Parquet tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]


def customers(t: GivenTables) -> DataFrame:
    regions = t["nation"].join(t["region"], F.expr("n_regionkey = r_regionkey"))
    signup = "date_add(date'1995-01-01', cast(c_custkey % 1500 as int))"
    return t["customer"].join(regions, F.expr("c_nationkey = n_nationkey"), "left").selectExpr(
        "concat('C', c_custkey) as customer_id",
        f"{signup} as signup_date",
        "cast(1950 + c_custkey % 50 as double) as birth_year",
        "case when c_custkey % 2 = 0 then 'f' else 'm' end as gender",
        "r_name as region",
        "concat('tier_', 1 + c_nationkey % 3) as city_tier",
        "case c_custkey % 4 when 0 then 'search' when 1 then 'social' when 2 then 'referral' else 'email' end as acquisition_channel",
        "case c_custkey % 3 when 0 then 'online' when 1 then 'store' else 'app' end as preferred_channel",
        "case when c_custkey % 2 = 0 then c_mktsegment end as loyalty_tier",
        f"case when c_custkey % 2 = 0 then date_add({signup}, 30) end as loyalty_signup_date",
        "case when c_acctbal < 3000 then 'low' when c_acctbal < 7000 then 'mid' else 'high' end as income_band",
        "c_mktsegment as customer_segment_seed",
        "c_custkey % 3 <> 0 as is_marketing_opt_in",
    )


def orders(t: GivenTables) -> DataFrame:
    channel = (
        "case substr(o_orderpriority, 1, 1) when '1' then 'online' when '2' then 'Online'"
        " when '3' then 'store' when '4' then 'Store' else 'app' end"
    )
    at_store = "substr(o_orderpriority, 1, 1) in ('3', '4')"
    return t["orders"].selectExpr(
        "concat('O', o_orderkey) as order_id",
        "concat('C', o_custkey) as customer_id",
        "o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 as int)) as order_datetime",
        "cast(o_orderdate as date) as order_date",
        f"{channel} as channel",
        f"case when {at_store} then concat('S', o_orderkey % {STORES_IN_USE}) end as store_id_nullable",
        "case o_orderkey % 3 when 0 then 'card' when 1 then 'wallet' else 'cash' end as payment_type",
        "case o_orderstatus when 'F' then case when o_orderkey % 2 = 0 then 'Completed' else 'completed' end"
        " when 'O' then 'pending' else 'canceled' end as order_status",
        f"o_totalprice / {MONEY_SCALE} as gross_amount",
        f"o_totalprice / {MONEY_SCALE} * 0.05D as discount_amount",
        f"o_totalprice / {MONEY_SCALE} * 0.95D as net_amount",
        "cast(o_orderkey % 4 as double) * 2.5D as shipping_fee",
        "case o_orderkey % 2 when 0 then 'mobile' else 'desktop' end as device_type",
        "cast(1 + o_orderkey % 5 as int) as basket_size",
        "o_orderkey % 5 = 0 as used_promo_code",
        "case when o_orderkey % 5 = 0 then concat('PROMO', o_orderkey % 9) end as promo_code_nullable",
        "o_orderkey % 7 = 0 as campaign_attributed_flag",
        f"case when not ({at_store}) then concat('W', o_orderkey) end as session_id_nullable",
        "cast(o_orderkey % 100 as double) / 100 as fraud_risk_seed",
    )


def order_items(t: GivenTables) -> DataFrame:
    return t["lineitem"].selectExpr(
        f"{LINE_ID} as order_item_id",
        "concat('O', l_orderkey) as order_id",
        "concat('P', l_partkey) as product_id",
        "cast(l_quantity as int) as quantity",
        f"l_extendedprice / {MONEY_SCALE} as item_list_price",
        "abs(l_discount) * 5 as item_discount_pct",
        f"l_extendedprice * (1 - l_discount) / {MONEY_SCALE} as item_net_price",
        f"l_extendedprice * 0.6D / {MONEY_SCALE} as item_cost",
        f"l_extendedprice * (0.4D - l_discount) / {MONEY_SCALE} as item_margin",
        "case l_linenumber % 2 when 0 then 'ship' else 'pickup' end as fulfillment_type",
    )


def products(t: GivenTables) -> DataFrame:
    return t["part"].selectExpr(
        "concat('P', p_partkey) as product_id",
        "p_type as category",
        "p_brand as subcategory",
        "case p_partkey % 3 when 0 then 'own' when 1 then 'partner' else 'premium' end as brand_type",
        "case when p_retailprice < 930 then 'low' when p_retailprice < 970 then 'mid' else 'high' end as price_tier",
        "p_retailprice as base_price",
        "p_retailprice * 0.6D as cost",
        "date_add(date'1994-01-01', cast(p_partkey % 700 as int)) as launch_date",
        "concat('style_', p_size % 4) as product_style",
        "p_partkey % 4 = 0 as seasonal_flag",
        "p_partkey % 7 = 0 as premium_flag",
        "cast(p_partkey % 100 as double) / 100 as return_risk_seed",
        "case when p_size < 17 then 'thin' when p_size < 34 then 'normal' else 'wide' end as margin_band",
    )


def product_attributes(t: GivenTables) -> DataFrame:
    return t["part"].selectExpr(
        "concat('P', p_partkey) as product_id",
        "split_part(p_name, ' ', 1) as color",
        "case when p_size < 25 then 'small' else 'large' end as size_group",
        "concat('mat_', p_partkey % 4) as material_type",
        "p_partkey % 5 = 0 as eco_flag",
        "p_partkey % 6 = 0 as bundle_candidate_flag",
        "concat('g', p_partkey % 8, '_', p_partkey % 3) as recommendation_embedding_group",
        "p_name as description_keywords",
    )


def stores(t: GivenTables) -> DataFrame:
    place = t["nation"].join(t["region"], F.expr("n_regionkey = r_regionkey"))
    return t["supplier"].join(place, F.expr("s_nationkey = n_nationkey"), "left").selectExpr(
        "concat('S', s_suppkey) as store_id",
        "r_name as region",
        "n_name as city",
        "case s_suppkey % 3 when 0 then 'mall' when 1 then 'street' else 'outlet' end as store_type",
        "date_add(date'1990-01-01', cast(s_suppkey as int)) as opening_date",
        "case when s_acctbal < 3000 then 'small' when s_acctbal < 7000 then 'medium' else 'large' end as store_size_band",
        "case s_suppkey % 2 when 0 then 'full' else 'express' end as store_format",
        "cast(s_suppkey % 90 as double) as latitude_fake",
        "cast(s_suppkey % 180 as double) as longitude_fake",
    )


def _daily_lines(t: GivenTables) -> DataFrame:
    placed = orders(t).selectExpr(
        "order_id",
        "order_date as date",
        "case when lower(channel) = 'store' then store_id_nullable else 'ONLINE' end as store_id_or_online",
    )
    lines = t["lineitem"].selectExpr(
        "concat('O', l_orderkey) as order_id",
        "concat('P', l_partkey) as product_id",
        "l_extendedprice",
        "abs(l_discount) * 5 as pct",
        "cast(l_quantity as int) as quantity",
        "l_returnflag",
        "l_partkey",
    )
    return lines.join(placed, "order_id")


def daily_totals(t: GivenTables) -> DataFrame:
    """What prices and inventory have in common: one join and one aggregation of the lines."""
    return _daily_lines(t).groupBy("date", "product_id", "store_id_or_online").agg(
        F.expr("max(l_extendedprice) as top_price"),
        F.expr("max(pct) as top_pct"),
        F.expr("max(l_partkey) as partkey"),
        F.expr("cast(sum(case when l_returnflag <> 'N' then quantity end) as int) as sold"),
    )


def daily_prices(t: GivenTables, daily: DataFrame | None = None) -> DataFrame:
    return (daily_totals(t) if daily is None else daily).selectExpr(
        "date",
        "product_id",
        "store_id_or_online",
        f"top_price / {MONEY_SCALE} as listed_price",
        "top_pct as discount_pct",
        "top_pct >= 0.2 as promo_flag",
        "top_pct >= 0.35 as markdown_flag",
        "partkey % 6 = 0 as bundle_flag",
    )


def daily_inventory(t: GivenTables, daily: DataFrame | None = None) -> DataFrame:
    sold = (
        (daily_totals(t) if daily is None else daily)
        .filter("sold is not null")
        .withColumn("spare", F.expr("cast(partkey % 10 as int)"))
    )
    return sold.selectExpr(
        "date",
        "product_id",
        "store_id_or_online",
        "sold * 2 + spare as starting_inventory",
        "sold + spare as ending_inventory",
        "sold as stock_received",
        "sold + spare < 15 as stockout_flag",
        "sold + spare < 8 as backorder_flag",
    )


def campaigns(t: GivenTables) -> DataFrame:
    start = "date_add(date'1996-01-01', cast(r_regionkey * 300 as int))"
    return t["region"].selectExpr(
        "concat('CMP', r_regionkey) as campaign_id",
        "concat('Campaign ', r_regionkey) as campaign_name",
        "case r_regionkey % 3 when 0 then 'retention' when 1 then 'winback' else 'seasonal' end as campaign_type",
        f"{start} as start_date",
        f"date_add({start}, 30) as end_date",
        "case r_regionkey % 2 when 0 then 'email' else 'push' end as channel",
        "case r_regionkey % 2 when 0 then 'percent_discount' else 'free_shipping' end as offer_type",
        "cast(5 + r_regionkey * 5 as double) as offer_strength",
        "concat('rule ', r_regionkey) as target_rule_summary",
        "0.16D as control_group_pct",
    )


def campaign_targets(t: GivenTables) -> DataFrame:
    """One row per customer and campaign; ``eligibility_flag`` is NULL for some."""
    return t["customer"].selectExpr(
        "c_custkey", "c_mktsegment", f"explode(sequence(0, {CAMPAIGNS - 1})) as k"
    ).selectExpr(
        "concat('CMP', k) as campaign_id",
        "concat('C', c_custkey) as customer_id",
        "timestamp_ntz'1996-01-01 00:00:00'"
        " + make_dt_interval(cast(k * 300 + c_custkey % 14 as int), cast(c_custkey % 24 as int)) as assignment_datetime",
        "(c_custkey + k) % 6 <> 0 as treatment_flag",
        "(c_custkey + k) % 6 = 0 as control_flag",
        "case when c_custkey % 40 = 7 then null else (c_custkey * 31 + k * 17) % 100 < 70 end as eligibility_flag",
        "c_mktsegment as predicted_business_segment_at_send",
        "case c_custkey % 3 when 0 then 'rule_based_v1' when 1 then 'randomised_holdout' end as targeting_rule_source",
        "c_custkey",
        "k",
    )


def campaign_events(t: GivenTables) -> DataFrame:
    """Outcome rows per target; one customer in fifty carries a second, unconverted row."""
    sent = campaign_targets(t).select("campaign_id", "customer_id", "assignment_datetime", "c_custkey", "k")
    bought = orders(t).filter("lower(order_status) = 'completed'").select(
        "customer_id", "order_datetime", "net_amount"
    )
    hits = (
        sent.join(bought, "customer_id")
        .filter(
            "order_datetime >= assignment_datetime"
            " and order_datetime < assignment_datetime + interval 30 days"
        )
        .groupBy("campaign_id", "customer_id")
        .agg(
            F.expr("sum(net_amount) as revenue_30d"),
            F.expr(
                "sum(case when order_datetime < assignment_datetime + interval 7 days then net_amount end) as revenue_7d"
            ),
        )
    )
    rows = sent.join(hits, ["campaign_id", "customer_id"], "left").withColumn(
        "copy", F.expr("explode(case when c_custkey % 50 = 0 then array(0, 1) else array(0) end)")
    )
    return rows.selectExpr(
        "campaign_id",
        "customer_id",
        "(c_custkey + k) % 10 <> 0 as delivered_flag",
        "(c_custkey * 3 + k) % 4 = 0 as open_flag",
        "(c_custkey * 5 + k) % 9 = 0 as click_flag",
        "(c_custkey + k) % 97 = 0 as unsubscribe_flag",
        "copy = 0 and revenue_7d is not null as conversion_within_7d",
        "copy = 0 and revenue_30d is not null as conversion_within_30d",
        "case when copy = 0 then coalesce(revenue_7d, 0.0D) else 0.0D end as revenue_within_7d",
        "case when copy = 0 then coalesce(revenue_30d, 0.0D) else 0.0D end as revenue_within_30d",
    )


def returns(t: GivenTables) -> DataFrame:
    lines = t["lineitem"].filter("l_returnflag = 'R'")
    return lines.join(t["orders"], F.expr("l_orderkey = o_orderkey")).selectExpr(
        f"concat('R', {LINE_ID}) as return_id",
        f"{LINE_ID} as order_item_id",
        "date_add(cast(o_orderdate as date), l_linenumber * 5) as return_request_date",
        "date_add(cast(o_orderdate as date), l_linenumber * 5 + 3) as return_processed_date",
        "case l_linenumber % 4 when 0 then 'changed_mind' when 1 then 'defective' when 2 then 'suspected_abuse' else 'late' end as return_reason",
        f"l_extendedprice * (1 - l_discount) * 0.9D / {MONEY_SCALE} as refund_amount",
        "case l_linenumber % 2 when 0 then 'card' else 'voucher' end as refund_method",
        "case l_partkey % 3 when 0 then 'approved' when 1 then 'pending' else 'rejected' end as return_status",
        "case l_suppkey % 2 when 0 then 'store' else 'mail' end as return_channel",
    )


def returns_hidden_labels(t: GivenTables) -> DataFrame:
    return t["lineitem"].filter("l_returnflag = 'R'").selectExpr(
        f"concat('R', {LINE_ID}) as return_id",
        "l_extendedprice > 60000 and (l_orderkey + l_partkey) % 4 = 0 as abuse_flag_hidden_for_validation",
    )


def reviews(t: GivenTables) -> DataFrame:
    return t["events"].filter("event_type = 'purchase'").selectExpr(
        "concat('V', event_id) as review_id",
        "concat('C', user_id) as customer_id",
        "concat('P', get_json_object(props, '$.k')) as product_id",
        "cast(ts as date) as review_date",
        "cast(1 + event_id % 5 as int) as rating",
        "cast(20 + event_id % 200 as int) as review_length",
        "cast(event_id % 200 - 100 as double) / 100 as sentiment_seed",
        "cast(event_id % 7 as int) as helpful_votes",
    )


def web_sessions(t: GivenTables) -> DataFrame:
    return t["events"].filter("event_type in ('view', 'click', 'purchase')").selectExpr(
        "concat('W', event_id) as session_id",
        "case when event_id % 8 <> 0 then concat('C', user_id) end as customer_id_nullable",
        "ts as session_start",
        "ts + make_dt_interval(0, 0, cast(event_id % 50 as int), cast(event_id % 60 as int)) as session_end",
        "case event_id % 4 when 0 then 'search' when 1 then 'social' when 2 then 'direct' else 'email' end as traffic_source",
        "case event_id % 3 when 0 then 'mobile' when 1 then 'desktop' else 'tablet' end as device_type",
        "cast(1 + event_id % 20 as int) as pages_viewed",
        "cast(event_id % 7 as int) as product_views",
        "cast(event_id % 5 as int) as category_views",
        "event_type <> 'view' as add_to_cart_flag",
        "event_type = 'purchase' as checkout_flag",
        "event_type = 'purchase' as purchase_flag",
        "event_id % 10 = 0 as bounce_flag",
    )


def session_events(t: GivenTables) -> DataFrame:
    return t["events"].selectExpr(
        "concat('E', event_id) as event_id",
        "concat('W', event_id) as session_id",
        "case when event_id % 11 <> 0 then concat('C', user_id) end as customer_id_nullable",
        "ts as event_time",
        "case event_type when 'view' then 'view_product' when 'click' then 'add_to_cart'"
        " when 'signup' then 'wishlist_add' else event_type end as event_type",
        "case when event_id % 13 <> 0 then concat('P', get_json_object(props, '$.k')) end as product_id_nullable",
        "case event_id % 3 when 0 then 'ECONOMY' when 1 then 'STANDARD' end as category_nullable",
    )


def calendar(t: GivenTables) -> DataFrame:
    from shelfsense.functions.calendar import date_dimension

    return date_dimension(t["orders"].selectExpr("cast(o_orderdate as date) as date"), "date")


RAW_TABLES = {
    "calendar": calendar,
    "customers": customers,
    "orders": orders,
    "order_items": order_items,
    "products": products,
    "product_attributes": product_attributes,
    "stores": stores,
    "daily_prices": daily_prices,
    "daily_inventory": daily_inventory,
    "campaigns": campaigns,
    "campaign_targets": campaign_targets,
    "campaign_events": campaign_events,
    "returns": returns,
    "returns_hidden_labels": returns_hidden_labels,
    "reviews": reviews,
    "web_sessions": web_sessions,
    "session_events": session_events,
}

# Tables that take an aggregation of the given ones, and those that are read off one written table of totals.
# Returns take a join alone, which moves less than writing and reading them would.
COMPUTED = {"campaign_events"}
DAILY = {"daily_prices", "daily_inventory"}
