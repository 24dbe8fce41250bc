"""Hand-computed feature cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from shelfsense.functions import columns as C
from shelfsense.operators import ordered, splits
from shelfsense.plans import features as FT
from shelfsense.plans import recommend as rec
from shelfsense.plans.returns import class_weight

D = dt.date


def _one(df):
    return df.first().asDict()


def test_churn_rates(spark):
    row = [(300, 6, 10, 4, 5, None, 2)]
    df = spark.createDataFrame(
        row,
        "tenure_days int, total_orders int, total_sessions int, sessions_with_purchase int, sessions_add_to_cart int,"
        " loyalty_tier string, campaigns_targeted int",
    )
    r = _one(FT.churn_features(df))
    assert r["order_velocity_per_month"] == pytest.approx(0.6)
    assert r["purchase_session_rate"] == pytest.approx(0.4)
    assert r["cart_to_purchase_rate"] == pytest.approx(0.8)
    assert (r["is_loyalty_enrolled"], r["was_targeted_by_campaign"], r["has_session_data"]) == (0, 1, 1)


def test_maturity_cut_keeps_old_customers_only(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 1)), ("b", D(2024, 9, 20))], "customer_id string, signup_date date")
    assert [r.customer_id for r in FT.mature_cohort(df, 90).collect()] == ["a"]
    with pytest.raises(ValueError):
        FT.mature_cohort(df.drop("signup_date"), 90)


def _series(spark, n, product="P1"):
    start = D(2025, 1, 6)
    rows = [(product, "S1", start + dt.timedelta(weeks=i), i + 1, 1.0) for i in range(n)]
    return spark.createDataFrame(
        rows, "product_id string, store_id_or_online string, week_start_date date, units_sold int, avg_starting_inventory double"
    )


def test_forecast_lags_look_strictly_back(spark):
    rows = FT.forecast_features(_series(spark, 15)).orderBy("week_start_date").collect()
    assert rows[2]["lag_2w"] == 1 and rows[0]["lag_2w"] is None
    assert rows[2]["roll_2w_avg"] == pytest.approx(1.5)
    assert rows[3]["roll_8w_avg"] is None and rows[4]["roll_8w_avg"] == pytest.approx(2.5)
    assert all(r["lag_52w"] is None and r["has_yoy_lag"] == 0 for r in rows)


def test_short_series_are_dropped(spark):
    df = _series(spark, 7, "short").unionByName(_series(spark, 8, "long"))
    assert {r.product_id for r in FT.drop_short_series(df).collect()} == {"long"}


def test_implicit_score(spark):
    df = spark.createDataFrame([(2, 3, 1, 1), (0, 0, 0, 0)], "quantity int, view_count int, wish_count int, pos_review int")
    got = [r.s for r in df.select(rec.implicit_score(df).alias("s")).collect()]
    assert got[0] == pytest.approx(math.log(3) + 0.15 * math.log(4) + 0.4 * math.log(2) + 0.5)
    assert got[1] == 0.0
    only = df.select("quantity")
    assert only.select(rec.implicit_score(only).alias("s")).first().s == pytest.approx(math.log(3))


def test_overlap_customers_bought_on_both_sides(spark):
    rows = [("C1", "P1", 1, D(2025, 10, 1)), ("C1", "P1", 1, D(2025, 11, 15)), ("C2", "P2", 1, D(2025, 10, 5))]
    df = spark.createDataFrame(rows, "customer_id string, product_id string, quantity int, order_date date")
    assert [r.customer_id for r in rec.overlap_customers(df, "2025-11-01").collect()] == ["C1"]
    assert rec.novel_items(df, "2025-11-01").count() == 0  # P1 was bought before


def _returns(spark):
    rows = []
    for i in range(20):
        rows.append(
            (
                f"r{i:02d}",
                D(2025, 1, 1) + dt.timedelta(days=i),
                "suspected_abuse" if i < 4 else None,
                "electronics" if i < 5 else "fashion",
                "low_discount" if i < 3 else "deep_discount",
                "high" if i < 2 else "low",
                None if i < 6 else "gold",
                1 if i == 3 else 0,
            )
        )
    df = spark.createDataFrame(
        rows,
        "return_id string, order_date date, return_reason string, category string, discount_band string,"
        " return_risk_band string, loyalty_tier string, is_abuse int",
    )
    return df.withColumns({c: F.lit(None).cast("double") for c in FT.RETURN_NUMERIC})


def test_return_features_split_and_weight(spark):
    fe = FT.return_features(_returns(spark))
    s = fe.agg(
        F.sum("is_electronics").alias("e"),
        F.sum("is_low_discount").alias("l"),
        F.sum("is_high_risk_band").alias("h"),
        F.count_if(F.col("loyalty_tier") == "unknown").alias("u"),
        F.sum("refund_amount").alias("z"),
    ).first()
    assert (s.e, s.l, s.h, s.u, s.z) == (5, 3, 2, 6, 0.0)
    split = splits.time_ordered(fe, "order_date", ["return_id"], 0.2)
    assert split.filter("is_test").count() == 4
    assert split.filter("is_test").agg(F.min("order_date")).first()[0] == D(2025, 1, 17)
    assert class_weight(split.filter("not is_test"), "is_abuse").first()["weight"] == 15.0


def test_segment_features_separate_buyers_and_others(spark):
    cols = dict.fromkeys([*FT.SEGMENT_PURCHASE, *FT.SEGMENT_SESSION, "recency_days", "tenure_days"])
    buyer = {**{c: 1.0 for c in cols}, "total_orders": 10.0, "tenure_days": 365.0, "recency_days": 5.0}
    other = {**{c: None for c in cols}, "tenure_days": 100.0}
    schema = "customer_id string, " + ", ".join(f"{c} double" for c in cols)
    df = spark.createDataFrame([("C1", *buyer.values()), ("C2", *other.values())], schema)
    r = {x["customer_id"]: x for x in FT.segment_features(df).collect()}
    assert r["C2"]["is_non_purchaser"] == 1 and r["C2"]["total_orders"] == 0 and r["C2"]["recency_days"] == 100
    assert r["C1"]["log_total_orders"] == pytest.approx(math.log1p(10))
    assert r["C1"]["order_rate_per_month"] == pytest.approx(10 / (365 / 30))


def test_uplift_features(spark):
    df = spark.createDataFrame(
        [
            ("CMP1", dt.datetime(2025, 3, 15, 10), "mid", "retention", 2, 150.0, "rule_based_v1", 400),
            ("CMP1", dt.datetime(2025, 3, 15, 10), None, "retention", 0, None, None, None),
        ],
        "campaign_id string, assignment_datetime timestamp_ntz, customer_value_band string, campaign_type string,"
        " pre_90d_orders int, pre_90d_revenue double, targeting_rule_source string, tenure_days int",
    )
    a, b = FT.uplift_features(df).collect()
    assert (a["assignment_month"], a["assignment_dayofweek"], a["segment_campaign"]) == (3, 5, "mid_retention")
    assert (a["is_new_customer"], a["targeting_is_rule_based"]) == (0, 1)
    assert a["log_pre_90d_revenue"] == pytest.approx(math.log1p(150)) and a["order_density_90d"] == pytest.approx(2 / 90)
    assert (b["targeting_is_rule_based"], b["is_new_customer"], b["segment_campaign"]) == (0, 1, "unknown_retention")


def test_enrichment_never_multiplies_rows(spark):
    c = spark.createDataFrame([("CMP1", "C1")], "campaign_id string, customer_id string")
    m = spark.createDataFrame([("C1", 5), ("C1", 7)], "customer_id string, tenure_days int")
    out = FT.enrich_with_customers(c, m).collect()
    assert len(out) == 1 and out[0]["tenure_days"] == 5


@pytest.mark.parametrize("share", [0, 1, -0.1, 1.5])
def test_split_share_must_lie_inside(spark, share):
    with pytest.raises(ValueError):
        splits.time_ordered(spark.range(3), "id", ["id"], share)


def test_time_split_counts_and_null_times(spark):
    rows = [(i, D(2024, 1, 1)) for i in range(7)] + [(7, D(2024, 1, 2)), (8, None), (9, None)]
    df = spark.createDataFrame(rows, "id int, d date")
    out = {r.id: r.is_test for r in splits.time_ordered(df, "d", ["id"], 0.5).collect()}
    assert sorted(i for i, t in out.items() if not t) == [0, 1, 2, 3, 4]
    late = {r.id: r.is_test for r in splits.time_ordered(df, "d", ["id"], 0.1).collect()}
    assert [i for i, t in late.items() if t] == [9]


def test_forbidden_columns_fail_loudly():
    with pytest.raises(ValueError, match="net_revenue"):
        C.refuse_columns(["lag_2w", "net_revenue"], FT.FORECAST_FORBIDDEN)
    C.refuse_columns(FT.CHURN_NUMERIC, FT.CHURN_FORBIDDEN)
    C.refuse_columns(FT.UPLIFT_NUMERIC + FT.UPLIFT_CATEGORICAL, FT.UPLIFT_FORBIDDEN)


def test_return_events_are_the_items_row_for_row(spark):
    """Nulls, an item with two returns, and products and customers that come twice or not at all."""
    from collections import Counter
    from types import SimpleNamespace

    from shelfsense.plans import marts

    make = spark.createDataFrame
    day = dt.date(2024, 1, 1)
    items = [("i1", "o1", "p1"), ("i2", "o1", "p2"), ("i3", "o2", None), ("i4", "o3", "p9"), ("i5", "lost", "p1"), (None, "o2", "p1")]
    for copies in (1, 2):
        s = SimpleNamespace(
            order_items=make(items, "order_item_id string, order_id string, product_id string").withColumns({"item_discount_pct": F.lit(0.1)}),
            completed_orders=make([("o1", "c1"), ("o2", None), ("o3", "c2")], "order_id string, customer_id string").withColumns(
                {"order_date": F.lit(day), "channel": F.lit("app"), "payment_type": F.lit("card")}
            ),
            products=make([("p1",)] * copies + [("p2",), (None,), (None,)], "product_id string").withColumns(
                {c: F.lit("x") for c in ("category", "subcategory", "price_tier", "return_risk_seed")}
            ),
            customers=make([("c1",)] * copies + [("c2",)], "customer_id string").withColumns({"region": F.lit("r"), "loyalty_tier": F.lit("l")}),
            returns=make([("i1", "r1"), ("i1", "r2"), ("i4", "r3"), (None, "r4")], "order_item_id string, return_id string").withColumns(
                {"return_request_date": F.lit(day), **{c: F.lit("x") for c in ("return_reason", "refund_amount", "return_status", "return_channel")}}
            ),
        )
        got = marts.return_events(s)
        assert Counter(got.collect()) == Counter(marts.return_items(s).select(*got.columns).collect())


def _return_staging(spark):
    """Items with two returns, ids that come twice or are null, and products that come twice or not at all."""
    from types import SimpleNamespace

    make = spark.createDataFrame
    ids = [f"i{k}" for k in range(60)] + ["i3", None]
    items = [(i, f"o{k % 17}", None if k % 13 == 5 else f"p{k % 4}", 0.01 * k) for k, i in enumerate(ids)]
    orders = [(f"o{k}", None if k == 4 else f"c{k % 3}", dt.date(2024, 1, 1 + k % 5)) for k in range(16)]
    returns = [(f"i{k % 50}", f"r{k}") for k in range(0, 90, 4)]
    return SimpleNamespace(
        order_items=make(items, "order_item_id string, order_id string, product_id string, item_discount_pct double").withColumns(
            {c: F.lit(1.0) for c in ("quantity", "item_list_price", "item_net_price", "item_cost", "item_margin", "fulfillment_type")}
        ),
        completed_orders=make(orders, "order_id string, customer_id string, order_date date").withColumns(
            {c: F.lit("x") for c in ("channel", "payment_type")}
        ),
        products=make([("p0", "a"), ("p1", "b"), ("p1", "c"), ("p2", "d")], "product_id string, category string").withColumns(
            {c: F.lit("x") for c in ("subcategory", "price_tier", "return_risk_seed")}
        ),
        customers=make([("c0", "n"), ("c1", "s")], "customer_id string, region string").withColumns({"loyalty_tier": F.lit("l")}),
        returns=make(returns, "order_item_id string, return_id string").withColumns(
            {"return_request_date": F.lit(dt.date(2024, 2, 1)), **{c: F.lit("x") for c in ("return_reason", "refund_amount", "return_status", "return_channel")}}
        ),
    )


def test_returns_mart_is_its_histories_joined_by_item_and_writes_nothing(spark, monkeypatch):
    from collections import Counter

    from shelfsense.plans import marts

    s = _return_staging(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    written, durable = [], ordered.durable
    monkeypatch.setattr(ordered, "durable", lambda df: written.append(df) or durable(df))
    try:
        mart = marts.returns_risk(s)
        names = ["order_item_id", "order_id", "category", "return_id", "prior_customer_return_rate", "recent_product_return_events", "customer_item_recency_rank"]
        got = Counter(mart.select(*names).collect())
        plan = mart._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert not written and "Scan parquet" not in plan
    items = marts.return_items(s)
    by_customer = marts.customer_return_history(items).select("order_item_id", "prior_customer_return_rate", "customer_item_recency_rank")
    by_product = marts.product_return_history(items).select("order_item_id", "recent_product_return_events")
    joined = items.join(by_customer, "order_item_id").join(by_product, "order_item_id")
    assert got == Counter(joined.select(*names).collect())


def test_rows_without_a_key_on_the_other_side_stay_out_of_the_shuffle(spark):
    from shelfsense.operators.joins import may_match

    rows = spark.range(40_000).select(F.concat(F.lit("O"), "id").alias("order_id"), F.col("id").alias("n"))
    keys = rows.filter("n % 4 = 0").select("order_id")
    near = may_match(rows.unionByName(spark.createDataFrame([(None, -1)], "order_id string, n long")), keys.unionByName(keys), "order_id")
    assert near.columns == ["order_id", "n"]
    assert near.filter("n % 4 = 0").count() == 10_000 and near.filter("n < 0").isEmpty()
    assert near.filter("n % 4 <> 0").count() < 30_000 / 4
    assert may_match(rows, keys.limit(0), "order_id").isEmpty()
    assert "Exchange hashpartitioning(order_id" not in near._jdf.queryExecution().executedPlan().toString()


def test_a_table_joins_the_returns_mart_as_late_as_it_can(spark):
    """What a row of an early shuffle carries is what a later step needs."""
    from types import SimpleNamespace

    from shelfsense.plans import marts

    s = _return_staging(spark)
    s = SimpleNamespace(**{**vars(s), "products": s.products.filter("category <> 'c'")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = marts.returns_risk(s)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    # The outermost join comes first; the plan has it once for rows that are repeated and once for others.
    assert [next(k for k in ("product_id", "customer_id", "order_id", "order_item_id") if f"[{k}#" in j) for j in joins[:4]] == [
        "product_id", "customer_id", "order_id", "order_item_id",
    ]
    assert "_map_row" in plan


def test_hot_groups_get_the_histories_of_plain_windows(spark):
    from collections import Counter

    from shelfsense.plans import marts

    items = marts.return_items(_return_staging(spark)).select("order_item_id", "customer_id", "product_id", "order_date", "return_id", "return_flag")
    for history, key, hot in (
        (marts.customer_return_history, "customer_id", [None, "c1"]),
        (marts.product_return_history, "product_id", ["p1", None]),
    ):
        assert Counter(history(items, hot=hot).collect()) == Counter(history(items, hot=[]).collect())
    assert set(ordered.hot_values(items, "customer_id", least=4)) == {"c0", "c1", "c2", None}
    assert ordered.hot_values(items, "customer_id") == []
    usual, crowded = ordered.split_hot(items, "customer_id", [None])
    assert {r.customer_id for r in crowded.collect()} == {None}
    assert usual.count() + crowded.count() == items.count() and usual.filter("customer_id is null").isEmpty()


def test_prices_and_inventory_share_one_written_table(spark, tmp_path):
    from checks.registry import Space

    folder = str(tmp_path)
    day = dt.datetime(1995, 3, 1)
    orders = [(1, 7, "F", 10.0, day, "1-URGENT"), (2, 8, "O", 20.0, day, "3-MEDIUM")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(
        f"{folder}/orders.parquet"
    )
    lines = [(1, 11, 3.0, 300.0, 0.02, "R"), (1, 11, 2.0, 600.0, 0.08, "N"), (2, 12, 5.0, 900.0, 0.0, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string").write.parquet(
        f"{folder}/lineitem.parquet"
    )
    x = Space(spark, folder)
    prices = {(r.product_id, r.store_id_or_online): (r.listed_price, r.discount_pct, r.promo_flag, r.markdown_flag) for r in x.raw("daily_prices").collect()}
    assert prices == {("P11", "ONLINE"): (2.0, 0.4, True, True), ("P12", "S2"): (3.0, 0.0, False, False)}
    stock = [(r.product_id, r.starting_inventory, r.ending_inventory, r.stock_received, r.backorder_flag) for r in x.raw("daily_inventory").collect()]
    assert stock == [("P11", 7, 4, 3, True)]
    assert list(x._marts) == ["raw_daily"]


def test_files_count_for_more_than_their_size_where_a_broadcast_is_decided(spark, tmp_path):
    path = tmp_path / "long"
    spark.range(100_000).write.parquet(str(path))
    stored = sum(f.stat().st_size for f in path.glob("*.parquet"))
    assert spark.read.parquet(str(path))._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= 4 * stored


def test_rank_correlations_join_only_ranks(spark, monkeypatch):
    from shelfsense.operators import stats as ST

    rows = spark.createDataFrame([(float(i % 7), float(i % 5), None if i % 11 == 0 else float(i)) for i in range(200)], "a double, b double, c double")
    pairs = ST.spearman_pairs(rows, [("a", "b"), ("a", "c")])
    pdf = rows.toPandas()
    got = {r.right_col: (r.n_pairs, r.spearman_r) for r in pairs.collect()}
    for c in ("b", "c"):
        both = pdf[["a", c]].dropna()
        assert got[c][0] == len(both) and got[c][1] == pytest.approx(both["a"].rank().corr(both[c].rank()))
    # One join of cells with their ranks, and that of the carry between chunks.
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_a_stored_table_leaves_no_shuffle_files(spark, tmp_path):
    import time

    from checks.registry import Space
    from shelfsense.session import release_shuffles

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    release_shuffles(spark)
    time.sleep(2)  # what earlier tests have left
    known = shuffled()
    Space(spark, str(tmp_path)).stored("counted", lambda: spark.range(1000).groupBy(F.col("id") % 7).count())
    # Spark deletes them in the background.
    for _ in range(40):
        if not shuffled() - known:
            break
        time.sleep(0.25)
    assert not shuffled() - known


def test_shuffles_start_with_more_partitions_than_the_session_names(spark):
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) > int(spark.conf.get("spark.sql.shuffle.partitions"))
