"""The six analytical marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.functions import columns as C
from shelfsense.operators import ordered
from shelfsense.operators.joins import lookback_pairs, may_match, with_scalar
from shelfsense.sources.staging import Staging


def _located(orders: DataFrame) -> DataFrame:
    return orders.withColumn("week_start_date", C.week_start(F.col("order_date"))).withColumn(
        "store_id_or_online", C.location_key(F.col("channel"), F.col("store_id_nullable"))
    )


def _ordered_items(s: Staging) -> DataFrame:
    """Items that may be of a completed order, for a join with these: the others stay out of the shuffle."""
    return may_match(s.order_items, s.completed_orders.select("order_id"), "order_id")


def _count_true(column: str):
    return F.sum(C.flag(F.col(column)))


# --- customers ---------------------------------------------------------------------------


def order_totals(s: Staging) -> DataFrame:
    channel = F.lower("channel")
    return s.completed_orders.groupBy("customer_id").agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.sum("net_amount").alias("total_net_revenue"),
        F.avg("net_amount").alias("avg_order_value"),
        F.sum("discount_amount").alias("total_discount_amount"),
        F.avg("basket_size").alias("avg_basket_size"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.sum(C.flag(channel == "online")).alias("online_orders"),
        F.sum(C.flag(channel == "store")).alias("store_orders"),
    )


def item_and_return_totals(s: Staging) -> DataFrame:
    """Item and return sums per customer from one pass over orders x items.

    Returns are summed per item first: an item may have several, and joining them raw would
    repeat the item's units.
    """
    per_item = s.returns.groupBy("order_item_id").agg(
        F.count("return_id").alias("n_returns"),
        F.sum("refund_amount").alias("refund"),
        F.sum(F.unix_date("return_request_date")).alias("request_days"),
        F.count("return_request_date").alias("n_requests"),
    )
    lines = (
        _ordered_items(s).join(s.completed_orders.select("order_id", "customer_id", "order_date"), "order_id")
        .join(per_item, "order_item_id", "left")
        .withColumn("wait_days", F.col("request_days") - F.col("n_requests") * F.unix_date("order_date"))
    )
    return (
        lines.groupBy("customer_id")
        .agg(
            F.sum("quantity").alias("total_units"),
            F.avg("item_discount_pct").alias("avg_item_discount_pct"),
            F.avg("item_margin").alias("avg_item_margin"),
            F.coalesce(F.sum("n_returns"), F.lit(0)).alias("total_returns"),
            F.sum("refund").alias("total_refund_amount"),
            F.sum("wait_days").alias("wait_days"),
            F.sum("n_requests").alias("n_requests"),
        )
        .withColumn("avg_days_to_return", C.guarded_ratio(F.col("wait_days"), F.col("n_requests")))
        .drop("wait_days", "n_requests")
    )


def session_totals(s: Staging) -> DataFrame:
    known = s.web_sessions.filter(F.col("customer_id_nullable").isNotNull())
    return known.groupBy(F.col("customer_id_nullable").alias("customer_id")).agg(
        F.count("*").alias("total_sessions"),
        F.avg(C.minutes_between(F.col("session_start"), F.col("session_end"))).alias("avg_session_minutes"),
        F.avg("pages_viewed").alias("avg_pages_viewed"),
        _count_true("add_to_cart_flag").alias("sessions_add_to_cart"),
        _count_true("purchase_flag").alias("sessions_with_purchase"),
    )


def campaign_totals(s: Staging) -> DataFrame:
    both = s.campaign_targets.join(s.campaign_events_dedup, ["campaign_id", "customer_id"], "left")
    return both.groupBy("customer_id").agg(
        F.count("*").alias("campaigns_targeted"),
        _count_true("treatment_flag").alias("campaigns_treatment"),
        F.sum(C.flag(F.col("conversion_within_30d") == 1)).alias("campaigns_converted_30d"),
        F.sum(F.coalesce("revenue_within_30d", F.lit(0.0))).alias("campaign_revenue_30d"),
    )


def anchor_date(s: Staging) -> DataFrame:
    return s.completed_orders.agg(F.max("order_date").alias("anchor_date"))


def customer_base(s: Staging) -> DataFrame:
    """Customer mart without the regional rank."""
    c = s.customers.select(
        "customer_id",
        "region",
        "city_tier",
        "preferred_channel",
        "loyalty_tier",
        "income_band",
        "customer_segment_seed",
        "is_marketing_opt_in",
        "signup_date",
    )
    wide = c
    for part in (order_totals(s), item_and_return_totals(s), session_totals(s), campaign_totals(s)):
        wide = wide.join(part, "customer_id", "left")
    wide = with_scalar(wide, anchor_date(s), "anchor_date")
    recency = F.datediff("anchor_date", "last_order_date")
    orders, units = F.col("total_orders"), F.col("total_units")
    return wide.select(
        *c.columns,
        "total_orders",
        "total_net_revenue",
        "avg_order_value",
        "total_discount_amount",
        "avg_basket_size",
        "first_order_date",
        "last_order_date",
        recency.alias("recency_days"),
        F.datediff("anchor_date", "signup_date").alias("tenure_days"),
        C.guarded_ratio(F.col("total_net_revenue"), orders).alias("revenue_per_order"),
        C.guarded_ratio(F.col("online_orders"), orders).alias("online_order_share"),
        C.guarded_ratio(F.col("store_orders"), orders).alias("store_order_share"),
        "total_units",
        "avg_item_discount_pct",
        "avg_item_margin",
        "total_returns",
        "total_refund_amount",
        "avg_days_to_return",
        F.coalesce(C.guarded_ratio(F.coalesce("total_returns", F.lit(0)), units, 0.0), F.lit(0.0)).alias(
            "return_rate_per_unit"
        ),
        "total_sessions",
        "avg_session_minutes",
        "avg_pages_viewed",
        "sessions_add_to_cart",
        "sessions_with_purchase",
        "campaigns_targeted",
        "campaigns_treatment",
        "campaigns_converted_30d",
        "campaign_revenue_30d",
        C.flag(recency > 90).alias("churn_flag_90d"),
        C.value_band(F.col("total_net_revenue")).alias("customer_value_band"),
    )


def regional_ranks(s: Staging) -> DataFrame:
    """Dense rank of spend within the region per customer; nothing but the spend is settled for it."""
    spent = s.completed_orders.groupBy("customer_id").agg(F.sum("net_amount").alias("_r"))
    narrow = s.customers.select("customer_id", "region").join(spent, "customer_id", "left")
    spend = narrow.select("customer_id", "region", F.coalesce("_r", F.lit(0.0)).alias("_spend"))
    ranks = ordered.dense_rank(spend, ["region"], "_spend", "spend_rank_in_region", ids=["customer_id"])
    return ranks.select("customer_id", "spend_rank_in_region")


def customer_features(s: Staging) -> DataFrame:
    return customer_base(s).join(regional_ranks(s), "customer_id", "left")


# --- weekly product demand ---------------------------------------------------------------

SERIES = ["product_id", "store_id_or_online"]
GRAIN = ["week_start_date", *SERIES]


def demand_weekly(s: Staging) -> DataFrame:
    placed = _located(s.completed_orders).select("order_id", "week_start_date", "store_id_or_online")
    return (
        _ordered_items(s).join(placed, "order_id")
        .groupBy(*GRAIN)
        .agg(
            F.sum("quantity").alias("units_sold"),
            F.count("*").alias("order_line_count"),
            F.sum("item_net_price").alias("net_revenue"),
            F.avg("item_discount_pct").alias("avg_item_discount_pct"),
        )
    )


def price_weekly(s: Staging, keys: list[str]) -> DataFrame:
    return (
        s.daily_prices.withColumn("week_start_date", C.week_start(F.col("date")))
        .groupBy("week_start_date", *keys)
        .agg(
            F.avg("listed_price").alias("avg_listed_price"),
            F.avg("discount_pct").alias("avg_discount_pct"),
            _count_true("promo_flag").alias("promo_days"),
            _count_true("markdown_flag").alias("markdown_days"),
        )
    )


def inventory_weekly(s: Staging, keys: list[str]) -> DataFrame:
    return (
        s.daily_inventory.withColumn("week_start_date", C.week_start(F.col("date")))
        .groupBy("week_start_date", *keys)
        .agg(
            F.avg("starting_inventory").alias("avg_starting_inventory"),
            F.avg("ending_inventory").alias("avg_ending_inventory"),
            F.sum("stock_received").alias("stock_received_units"),
            _count_true("stockout_flag").alias("stockout_days"),
            _count_true("backorder_flag").alias("backorder_days"),
        )
    )


def product_demand(s: Staging) -> DataFrame:
    facts = demand_weekly(s)
    for part in (price_weekly(s, SERIES), inventory_weekly(s, SERIES)):
        facts = facts.join(part, GRAIN, "left")
    about = s.products.select(
        "product_id", "category", "subcategory", "price_tier", "seasonal_flag", "premium_flag"
    )
    # One row per week and series, so a series is as long as the calendar at most.
    w = Window.partitionBy(*SERIES).orderBy("week_start_date")
    last4 = w.rowsBetween(-3, 0)
    return facts.join(about, "product_id", "left").select(
        *GRAIN,
        *about.columns[1:],
        "units_sold",
        "order_line_count",
        "net_revenue",
        "avg_item_discount_pct",
        "avg_listed_price",
        "avg_discount_pct",
        "promo_days",
        "markdown_days",
        "avg_starting_inventory",
        "avg_ending_inventory",
        "stock_received_units",
        "stockout_days",
        "backorder_days",
        F.lag("units_sold", 1).over(w).alias("lag_1w_units_sold"),
        F.lag("units_sold", 4).over(w).alias("lag_4w_units_sold"),
        F.avg("units_sold").over(last4).alias("rolling_4w_avg_units"),
        F.sum("net_revenue").over(last4).alias("rolling_4w_revenue"),
        C.demand_band(F.col("units_sold")).alias("weekly_demand_band"),
    )


# --- weekly location performance ---------------------------------------------------------


def store_week_performance(s: Staging) -> DataFrame:
    keys = ["week_start_date", "store_id_or_online"]
    located = _located(s.completed_orders)
    headers = located.groupBy(*keys).agg(
        F.countDistinct("order_id").alias("order_count"),
        F.sum("net_amount").alias("net_revenue"),
        F.sum("discount_amount").alias("discount_amount"),
        F.avg("basket_size").alias("avg_basket_size"),
        _count_true("campaign_attributed_flag").alias("campaign_attributed_orders"),
    )
    items = (
        _ordered_items(s).join(located.select("order_id", *keys), "order_id")
        .groupBy(*keys)
        .agg(
            F.sum("quantity").alias("units_sold"),
            F.sum("item_margin").alias("item_margin"),
            F.avg("item_discount_pct").alias("avg_item_discount_pct"),
        )
    )
    stock = inventory_weekly(s, ["store_id_or_online"])
    prices = price_weekly(s, ["store_id_or_online"]).drop("avg_listed_price")
    facts = headers
    for part in (items, stock, prices):
        facts = facts.join(part, keys, "left")
    about = s.stores.select(
        F.col("store_id").alias("store_id_or_online"), "region", "city", "store_type", "store_size_band"
    )
    w = Window.partitionBy("store_id_or_online").orderBy("week_start_date")
    return facts.join(about, "store_id_or_online", "left").select(
        *keys,
        F.coalesce("region", F.lit("online")).alias("region"),
        "city",
        "store_type",
        "store_size_band",
        *headers.columns[2:],
        *items.columns[2:],
        *stock.columns[2:],
        *prices.columns[2:],
        F.sum("net_revenue").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running_revenue"),
        F.avg("net_revenue").over(w.rowsBetween(-3, 0)).alias("rolling_4w_avg_revenue"),
        F.lag("net_revenue", 1).over(w).alias("lag_1w_revenue"),
        C.performance_band(F.col("net_revenue")).alias("performance_band"),
    )


# --- campaign response -------------------------------------------------------------------


def pre_assignment(s: Staging, days: int = 90) -> DataFrame:
    """Orders of the customer in the half-open window of ``days`` before each assignment."""
    keys = ["campaign_id", "customer_id", "assignment_datetime"]
    probes = s.campaign_targets.select(*keys).distinct()
    events = s.completed_orders.select("customer_id", "order_id", "order_datetime", "net_amount")
    seen = (
        lookback_pairs(probes, events, "customer_id", "assignment_datetime", "order_datetime", days)
        .groupBy(*keys)
        .agg(
            F.countDistinct("order_id").alias("pre_90d_orders"),
            F.sum("net_amount").alias("pre_90d_revenue"),
            F.avg("net_amount").alias("pre_90d_aov"),
        )
    )
    return probes.join(seen, keys, "left").withColumn(
        "pre_90d_orders", F.coalesce("pre_90d_orders", F.lit(0))
    )


def campaign_base(s: Staging) -> DataFrame:
    """Campaign mart without the ranks inside a campaign."""
    pair = ["campaign_id", "customer_id"]
    about = s.campaigns.select(
        "campaign_id",
        "campaign_name",
        "campaign_type",
        F.col("channel").alias("campaign_channel"),
        "offer_type",
        "offer_strength",
    )
    # Joined back on the pair alone: a pair assigned at two times gets both windows.
    history = pre_assignment(s).drop("assignment_datetime")
    df = (
        s.campaign_targets.join(s.campaign_events_dedup, pair, "left")
        .join(about, "campaign_id", "left")
        .join(history, pair, "left")
    )
    converted = F.col("conversion_within_30d")
    return df.select(
        *about.columns,
        "customer_id",
        "assignment_datetime",
        "treatment_flag",
        "control_flag",
        "predicted_business_segment_at_send",
        "targeting_rule_source",
        "delivered_flag",
        "open_flag",
        "click_flag",
        "unsubscribe_flag",
        "conversion_within_7d",
        "conversion_within_30d",
        F.coalesce("revenue_within_7d", F.lit(0.0)).alias("revenue_within_7d"),
        F.coalesce("revenue_within_30d", F.lit(0.0)).alias("revenue_within_30d"),
        F.coalesce("source_event_rows", F.lit(0)).alias("source_event_rows"),
        "pre_90d_orders",
        "pre_90d_revenue",
        "pre_90d_aov",
        C.flag(converted == 1).alias("response_flag_30d"),
        C.response_bucket(F.col("treatment_flag"), F.col("control_flag"), converted).alias("response_bucket"),
    )


def campaign_response(s: Staging) -> DataFrame:
    base = campaign_base(s)
    converted, revenue = F.col("conversion_within_30d"), F.col("revenue_within_30d")
    # A few campaigns hold all rows: rank them in range chunks, not in one task each. Only the key and
    # what it is ordered by is laid out; the ranks are joined back by the key.
    key = ["campaign_id", "customer_id"]
    ranked = ordered.row_number(
        base.select(*key, converted, revenue),
        ["campaign_id"],
        [converted.desc_nulls_last(), revenue.desc(), F.col("customer_id")],
        "campaign_response_rank",
    )
    placed = ordered.positions(
        ranked, ["campaign_id"], [revenue.desc(), converted.desc_nulls_last(), F.col("customer_id")]
    )
    decile = ordered.tile(F.col("rows_before"), F.col("rows_total"), 10).alias("revenue_decile_within_campaign")
    return base.join(placed.select(*key, "campaign_response_rank", decile), key)


# --- return risk -------------------------------------------------------------------------


def _joined(rows: DataFrame, about: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` with what ``about`` says of their key; ``_repeated`` also tells the rows whose key is there several times."""
    about = about.withColumn("_times", F.count("*").over(Window.partitionBy(key)))
    out = rows.join(about, key, how)
    return out.withColumn("_repeated", F.col("_repeated") | (F.coalesce("_times", F.lit(1)) > 1)).drop("_times")


def _item_rows(s: Staging) -> DataFrame:
    """Items of completed orders with their returns and order.

    ``_repeated`` is true for all rows whose order_item_id comes in several rows (and may be for others).
    """
    o = s.completed_orders.select("order_id", "customer_id", "order_date", "channel", "payment_type")
    r = s.returns.select(
        "order_item_id",
        "return_id",
        "return_request_date",
        "return_reason",
        "refund_amount",
        "return_status",
        "return_channel",
    )
    items = _ordered_items(s).join(r, "order_item_id", "left")
    items = items.withColumn("_repeated", F.count("*").over(Window.partitionBy("order_item_id")) > 1)
    return _joined(items, o, "order_id", "inner").withColumn("return_flag", C.present("return_id"))


def _item_products(s: Staging) -> DataFrame:
    return s.products.select("product_id", "category", "subcategory", "price_tier", "return_risk_seed")


def _item_customers(s: Staging) -> DataFrame:
    return s.customers.select("customer_id", "region", "loyalty_tier")


def _item_bands(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "discount_band": C.discount_band(F.col("item_discount_pct")),
            "days_to_return": F.datediff("return_request_date", "order_date"),
        }
    )


def return_items(s: Staging) -> DataFrame:
    """Items of completed orders with their order, customer, product and returns."""
    rows = _item_rows(s).drop("_repeated").join(_item_customers(s), "customer_id", "left")
    return _item_bands(rows.join(_item_products(s), "product_id", "left"))


def return_events(s: Staging) -> DataFrame:
    """Keys, date and return flag of ``return_items``, row for row.

    Products and customers only matter here where a key of theirs comes twice, which repeats the item.
    """
    rows = (
        s.order_items.select("order_item_id", "order_id", "product_id")
        .join(s.completed_orders.select("order_id", "customer_id", "order_date"), "order_id")
        .join(s.returns.select("order_item_id", "return_id"), "order_item_id", "left")
    )
    for key, about in (("product_id", s.products), ("customer_id", s.customers)):
        if not about.groupBy(key).count().filter("count > 1").isEmpty():
            rows = rows.join(about.select(key), key, "left")
    return rows.select("order_item_id", "customer_id", "product_id", "order_date", C.present("return_id").alias("return_flag"))


def customer_return_history(items: DataFrame, hot: Sequence | None = None) -> DataFrame:
    """Return rate over the customer's strictly earlier items, and the item's recency rank."""
    usual, crowded = ordered.split_hot(items, "customer_id", hot)

    def named(rows, before, returned, total):
        return rows.select(
            *items.columns,
            C.guarded_ratio(returned, before, 0.0).alias("prior_customer_return_rate"),
            (total - before).alias("customer_item_recency_rank"),
        )

    w = Window.partitionBy("customer_id").orderBy("order_date", "order_item_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    returned = F.coalesce(F.sum("return_flag").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = named(usual, F.row_number().over(w).cast("long") - 1, returned, F.count("*").over(whole))
    if crowded is None:
        return out
    placed = ordered.positions(
        crowded, ["customer_id"], ["order_date", "order_item_id"], sums={"returned": "return_flag"}
    )
    return out.unionByName(named(placed, F.col("rows_before"), F.col("returned_before"), F.col("rows_total")))


def product_return_history(items: DataFrame, reach: int = 30, hot: Sequence | None = None) -> DataFrame:
    """Returned items among the product's ``reach`` previous items."""
    usual, crowded = ordered.split_hot(items, "product_id", hot)

    def named(rows, w):
        earlier = F.sum("return_flag").over(w.rowsBetween(-reach, -1))
        return rows.withColumn("recent_product_return_events", F.coalesce(earlier, F.lit(0)))

    out = named(usual, Window.partitionBy("product_id").orderBy("order_date", "order_item_id"))
    if crowded is None:
        return out
    chunks = ordered.with_halo(crowded, ["product_id"], ["order_date", "order_item_id"], reach)
    return out.unionByName(ordered.drop_halo(named(chunks, ordered.frame_window(["product_id"]))))


_HISTORIES = (["prior_customer_return_rate", "customer_item_recency_rank"], ["recent_product_return_events"])


def _all_histories(rows: DataFrame) -> DataFrame:
    """An item that comes in several rows has each of its histories on each of them."""
    same = Window.partitionBy("order_item_id")
    several = rows.filter("_repeated")
    for i, names in enumerate(_HISTORIES):
        several = several.withColumn(f"_all{i}", F.collect_list(F.struct(*names)).over(same))
    several = several.drop(*[c for names in _HISTORIES for c in names])
    for i in range(len(_HISTORIES)):
        several = several.select(*[c for c in several.columns if c != f"_all{i}"], F.inline(f"_all{i}"))
    return rows.filter("not _repeated").unionByName(several)


def returns_risk(s: Staging) -> DataFrame:
    # Rows move once each by item, order, customer and product, and a table's columns join them as late as they can;
    # nothing is written or joined back for a history.
    hot_products = ordered.hot_values(s.order_items, "product_id")
    hot_customers = ordered.hot_values(s.completed_orders, "customer_id")
    p = _item_products(s)
    # Products that come twice repeat an item in its customer's history too.
    first = not p.groupBy("product_id").count().filter("count > 1").isEmpty()
    rows = _joined(_item_rows(s), _item_customers(s), "customer_id")
    by_customer = customer_return_history(_joined(rows, p, "product_id") if first else rows, hot=hot_customers)
    both = product_return_history(by_customer if first else _joined(by_customer, p, "product_id"), hot=hot_products)
    both = _item_bands(both)
    df = _all_histories(both.filter("order_item_id is not null"))
    return df.select(
        "order_item_id",
        "order_id",
        "customer_id",
        "product_id",
        "order_date",
        "channel",
        "payment_type",
        "category",
        "subcategory",
        "price_tier",
        "region",
        "loyalty_tier",
        "quantity",
        "item_list_price",
        "item_discount_pct",
        "item_net_price",
        "item_cost",
        "item_margin",
        "fulfillment_type",
        "return_flag",
        "return_id",
        "return_reason",
        "return_status",
        "return_channel",
        "refund_amount",
        "days_to_return",
        "discount_band",
        "return_risk_seed",
        "prior_customer_return_rate",
        "recent_product_return_events",
        C.return_risk_band(F.col("prior_customer_return_rate"), F.col("item_discount_pct")).alias(
            "return_risk_band"
        ),
        "customer_item_recency_rank",
    )


# --- recommendation interactions ---------------------------------------------------------


def daily_interactions(s: Staging) -> DataFrame:
    """Purchases, session events and reviews, one row per customer, product, day and source."""
    keys = ["customer_id", "product_id", "interaction_date"]

    def shaped(df, source, count, value, score):
        return df.groupBy(*keys).agg(
            F.lit(source).alias("interaction_source"),
            count.cast("long").alias("interaction_count"),
            value.cast("double").alias("interaction_value"),
            score.cast("double").alias("weighted_score"),
        )

    bought = _ordered_items(s).join(
        s.completed_orders.select("order_id", "customer_id", F.col("order_date").alias("interaction_date")),
        "order_id",
    )
    events = s.session_events.select(
        F.col("customer_id_nullable").alias("customer_id"),
        F.col("product_id_nullable").alias("product_id"),
        F.to_date("event_time").alias("interaction_date"),
        "event_type",
    ).filter("customer_id is not null and product_id is not null")
    reviewed = s.reviews.filter("customer_id is not null and product_id is not null").withColumnRenamed(
        "review_date", "interaction_date"
    )
    units = F.sum("quantity")
    return (
        shaped(bought, "purchase", units, F.sum("item_net_price"), units * 3.0)
        .unionByName(
            shaped(
                events, "session_event", F.count("*"), F.lit(0.0), F.sum(C.event_weight(F.col("event_type")))
            )
        )
        .unionByName(
            shaped(
                reviewed, "review", F.count("*"), F.avg("rating"), F.sum(F.coalesce("rating", F.lit(0)))
            )
        )
    )


def interaction_totals(s: Staging) -> DataFrame:
    return (
        daily_interactions(s)
        .groupBy("customer_id", "product_id")
        .agg(
            F.count("*").alias("active_days"),
            F.sum("interaction_count").alias("total_interactions"),
            F.sum("interaction_value").alias("total_interaction_value"),
            F.sum("weighted_score").alias("interaction_score"),
            F.min("interaction_date").alias("first_interaction_date"),
            F.max("interaction_date").alias("last_interaction_date"),
        )
    )


def last_interaction(s: Staging) -> DataFrame:
    """Latest interaction date of any source, from the base tables (no join needed for events)."""
    bought = _ordered_items(s).join(s.completed_orders, "order_id").select(F.col("order_date").alias("d"))
    events = s.session_events.filter(
        "customer_id_nullable is not null and product_id_nullable is not null"
    ).select(F.to_date("event_time").alias("d"))
    reviewed = s.reviews.filter("customer_id is not null and product_id is not null").select(
        F.col("review_date").alias("d")
    )
    return bought.unionByName(events).unionByName(reviewed).agg(F.max("d").alias("max_interaction_date"))


def recommendation_interactions(s: Staging) -> DataFrame:
    p = s.products.select("product_id", "category", "subcategory", "price_tier", "brand_type")
    a = s.product_attributes.select(
        "product_id", "color", "material_type", "recommendation_embedding_group"
    )
    df = with_scalar(interaction_totals(s), last_interaction(s), "max_interaction_date")
    df = df.join(p, "product_id", "left").join(a, "product_id", "left")
    best = [F.col("interaction_score").desc(), F.col("last_interaction_date").desc(), F.col("product_id")]
    # One row per customer and product: a customer has at most a catalogue of rows here.
    return df.select(
        "customer_id",
        "product_id",
        *p.columns[1:],
        *a.columns[1:],
        "active_days",
        "total_interactions",
        "total_interaction_value",
        "interaction_score",
        "first_interaction_date",
        "last_interaction_date",
        F.datediff("max_interaction_date", "last_interaction_date").alias("recency_days"),
        F.row_number().over(Window.partitionBy("customer_id").orderBy(*best)).alias("product_rank_for_customer"),
        F.row_number()
        .over(Window.partitionBy("customer_id", "category").orderBy(*best))
        .alias("category_rank_for_customer"),
    )


MARTS = {
    "mart_customer_features": customer_features,
    "mart_product_demand": product_demand,
    "mart_campaign_response": campaign_response,
    "mart_returns_risk": returns_risk,
    "mart_recommendation_interactions": recommendation_interactions,
    "mart_store_week_performance": store_week_performance,
}
