"""Recommendation: signals, interactions, popularity, cold start and content profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.operators import ordered
from shelfsense.session import durable
from shelfsense.sources.staging import Staging

# Signal weights and the purchase count below which a customer is cold.
WEIGHTS = {"quantity": 1.0, "view_count": 0.15, "wish_count": 0.40, "pos_review": 0.5}
COLD_BELOW = 5
PAIR = ["customer_id", "product_id"]


def purchases(s: Staging) -> DataFrame:
    """All ordered items, whatever the order's status."""
    return s.table("order_items").join(s.orders.select("order_id", "customer_id", "order_date"), "order_id").select(
        *PAIR, "quantity", "order_date"
    )


def known_events(s: Staging, kind: str) -> DataFrame:
    return s.session_events.filter(
        (F.col("event_type") == kind) & F.col("customer_id_nullable").isNotNull() & F.col("product_id_nullable").isNotNull()
    ).select(
        F.col("customer_id_nullable").alias("customer_id"), F.col("product_id_nullable").alias("product_id"), "event_time"
    )


def liked_reviews(s: Staging) -> DataFrame:
    return s.reviews.filter("rating >= 4").select(*PAIR, "review_date")


def overlap_customers(bought: DataFrame, split: str) -> DataFrame:
    """Customers who bought both before and from the split date on (one aggregation)."""
    cut = F.lit(split).cast("date")
    spans = bought.groupBy("customer_id").agg(F.min("order_date").alias("a"), F.max("order_date").alias("b"))
    return spans.filter((F.col("a") < cut) & (F.col("b") >= cut)).select("customer_id")


def seen_items(bought: DataFrame, before: str | None = None) -> DataFrame:
    if before:
        bought = bought.filter(F.col("order_date") < F.lit(before).cast("date"))
    return bought.select(*PAIR).distinct()


def novel_items(bought: DataFrame, split: str) -> DataFrame:
    """Items a customer of both periods bought for the first time after the split."""
    cut = F.lit(split).cast("date")
    first = bought.groupBy(*PAIR).agg(F.min("order_date").alias("first_bought"))
    return first.filter(F.col("first_bought") >= cut).join(overlap_customers(bought, split), "customer_id", "left_semi").select(*PAIR)


def signal_counts(
    bought: DataFrame, s: Staging, split: str | None = None, strict: bool = True
) -> DataFrame:
    """Quantity, views, wishes and good reviews per customer and product; absent signals are 0.

    With a split date, purchases and views end there; ``strict`` also cuts wishes and reviews,
    otherwise those keep their later rows. One union and one aggregation replace outer joins.
    """
    views, wishes, liked = known_events(s, "view_product"), known_events(s, "wishlist_add"), liked_reviews(s)
    if split:
        cut = F.lit(split).cast("date")
        bought = bought.filter(F.col("order_date") < cut)
        views = views.filter(F.col("event_time") < cut.cast("timestamp_ntz"))
        if strict:
            wishes = wishes.filter(F.col("event_time") < cut.cast("timestamp_ntz"))
            liked = liked.filter(F.col("review_date") < cut)

    def as_signal(df: DataFrame, name: str, value) -> DataFrame:
        cells = [(value if n == name else F.lit(0)).cast("long").alias(n) for n in WEIGHTS]
        return df.select(*PAIR, *cells)

    rows = (
        as_signal(bought, "quantity", F.col("quantity"))
        .unionByName(as_signal(views, "view_count", F.lit(1)))
        .unionByName(as_signal(wishes, "wish_count", F.lit(1)))
        .unionByName(as_signal(liked, "pos_review", F.lit(1)))
    )
    return rows.groupBy(*PAIR).agg(*[F.sum(n).alias(n) for n in WEIGHTS])


def implicit_score(df: DataFrame, weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted log counts; good reviews count linearly. A missing signal column counts as 0."""

    def signal(name):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)

    return (
        F.log1p(signal("quantity")) * weights["quantity"]
        + F.log1p(signal("view_count")) * weights["view_count"]
        + F.log1p(signal("wish_count")) * weights["wish_count"]
        + signal("pos_review") * weights["pos_review"]
    )


def interactions(
    bought: DataFrame, s: Staging, split: str, strict: bool = True, weights: dict[str, float] = WEIGHTS
) -> DataFrame:
    """Positive scores of customers active on both sides of the split, from the train side."""
    signals = signal_counts(bought, s, split, strict).join(overlap_customers(bought, split), "customer_id", "left_semi")
    return signals.withColumn("score", implicit_score(signals, weights)).filter("score > 0")


def min_max_per_user(df: DataFrame, value: str, name: str, user: str = "customer_id") -> DataFrame:
    """Scale to 0..1 inside each user. Bounds come from an aggregate joined back, not a window."""
    bounds = df.groupBy(user).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)
    return df.join(bounds, user).withColumn(name, scaled).drop("_lo", "_hi")


# --- popularity and cold start -----------------------------------------------------------


def category_top(bought: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """Best-selling products per category by bought rows, ties by product id."""
    counts = bought.groupBy("product_id").agg(F.count("*").alias("pop"))
    tagged = counts.join(products.select("product_id", "category"), "product_id")
    w = Window.partitionBy("category").orderBy(F.col("pop").desc(), "product_id")
    # A rank filter on a per-product table: Spark keeps only the leading rows of each task.
    return tagged.withColumn("pop_rank", F.row_number().over(w)).filter(F.col("pop_rank") <= n)


def global_ranking(scored: DataFrame, value: Column) -> DataFrame:
    """All products by falling score with their rank."""
    totals = scored.groupBy("product_id").agg(value.alias("pop_score"))
    return ordered.row_number(totals, [], [F.col("pop_score").desc(), "product_id"], "item_rank")


def first_unseen(users: DataFrame, seen_ranks: DataFrame, ranking: DataFrame, k: int, rank: str = "item_rank") -> DataFrame:
    """For each user the first ``need`` list places that the user has not seen, at most ``k``.

    ``users`` has customer_id and need. Only seen places with fewer than ``need`` unseen ones
    before them can matter, so a user gets ``need`` plus that many places: no user x item product.
    """
    w = Window.partitionBy("customer_id").orderBy(rank)
    hits = (
        seen_ranks.select("customer_id", rank)
        .distinct()
        .join(users.select("customer_id", "need"), "customer_id")
        .withColumn("_gap", F.col(rank) - F.row_number().over(w))
        .filter(F.col("_gap") < F.col("need"))
    )
    extra = hits.groupBy("customer_id").agg(F.count("*").alias("_m"))
    places = (
        users.filter("need > 0")
        .join(extra, "customer_id", "left")
        .select(
            "customer_id",
            "need",
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("need").cast("long") + F.coalesce("_m", F.lit(0)))).alias(rank),
        )
    )
    free = places.join(hits.select("customer_id", rank), ["customer_id", rank], "left_anti")
    picked = free.join(ranking, rank)
    return picked.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= F.least(F.col("need"), F.lit(k)))


def popularity_recommendations(
    train: DataFrame, users: DataFrame, k: int = 10, value: Column | None = None
) -> DataFrame:
    """Top-k of the global list per user without the items the user already has in ``train``."""
    ranking = global_ranking(train, F.sum("interaction_score") if value is None else value)
    seen = train.select(*PAIR).join(ranking.select("product_id", "item_rank"), "product_id")
    want = users.select("customer_id").distinct().withColumn("need", F.lit(k))
    return first_unseen(want, seen, ranking, k).select("customer_id", "product_id", F.col("place").alias("rank"))


def bought_counts(bought: DataFrame) -> DataFrame:
    return bought.groupBy(*PAIR).agg(F.count("*").alias("c"))


def preferred_categories(counts_per_item: DataFrame, products: DataFrame, n: int | None = 3) -> DataFrame:
    """A user's categories by falling number of bought rows, the first ``n`` or all."""
    counts = (
        counts_per_item.join(products.select("product_id", "category"), "product_id")
        .groupBy("customer_id", "category")
        .agg(F.sum("c").alias("bought"))
    )
    w = Window.partitionBy("customer_id").orderBy(F.col("bought").desc(), "category")
    ranked = counts.withColumn("cat_rank", F.row_number().over(w))
    return ranked if n is None else ranked.filter(F.col("cat_rank") <= n)


def cold_start(
    users: DataFrame, bought: DataFrame, products: DataFrame, category_list: DataFrame, k: int = 10, categories: int | None = 3
) -> DataFrame:
    """Unseen best sellers of the user's top categories (None: all the user has), then of all categories in name order."""
    mine = durable(bought_counts(bought.join(users.select("customer_id"), "customer_id", "left_semi")))
    seen = mine.select(*PAIR)
    liked = preferred_categories(mine, products, categories)
    category_list = durable(category_list)
    w = Window.partitionBy("customer_id").orderBy("cat_rank", "pop_rank")
    own = (
        liked.join(category_list.select("category", "product_id", "pop_rank"), "category")
        .join(seen, PAIR, "left_anti")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select(*PAIR, "rank")
    )
    have = own.groupBy("customer_id").agg(F.count("*").alias("have"))
    short = users.select("customer_id").distinct().join(have, "customer_id", "left").select(
        "customer_id", F.coalesce("have", F.lit(0)).alias("have")
    ).filter(F.col("have") < k).withColumn("need", F.lit(k) - F.col("have"))
    # One list over all categories: top-n rows per category.
    listing = ordered.row_number(category_list.select("category", "product_id", "pop_rank"), [], ["category", "pop_rank"], "item_rank")
    taken = seen.unionByName(own.select(*PAIR)).join(listing.select("product_id", "item_rank"), "product_id")
    more = first_unseen(short, taken, listing, k)
    filled = more.join(short.select("customer_id", "have"), "customer_id").select(
        *PAIR, (F.col("have") + F.col("place")).alias("rank")
    )
    return own.select(*PAIR, F.col("rank").cast("long")).unionByName(filled)


def routing(users: DataFrame, bought: DataFrame, below: int = COLD_BELOW) -> DataFrame:
    counts = bought.groupBy("customer_id").agg(F.count("product_id").alias("purchases"))
    n = F.coalesce("purchases", F.lit(0))
    return users.select("customer_id").join(counts, "customer_id", "left").select(
        "customer_id", n.alias("purchases"), F.when(n < below, "cold").otherwise("warm").alias("route")
    )


# --- content -----------------------------------------------------------------------------


def content_features(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row per (product, feature): categories one-hot, embedding-group prefix and two flags.

    Every weight is 1 / norm, so the dot product of two items is their cosine.
    """
    a = attributes.select("product_id", "recommendation_embedding_group", "eco_flag", "bundle_candidate_flag")
    df = products.select("product_id", "category", "subcategory", "brand_type", "price_tier").join(a, "product_id")
    names = F.filter(
        F.array(
            F.concat(F.lit("cat="), F.col("category")),
            F.concat(F.lit("sub="), F.col("subcategory")),
            F.concat(F.lit("brand="), F.col("brand_type")),
            F.concat(F.lit("price="), F.col("price_tier")),
            F.concat(F.lit("emb="), F.substring("recommendation_embedding_group", 1, 2)),
            F.when(F.col("eco_flag"), "eco"),
            F.when(F.col("bundle_candidate_flag"), "bundle"),
        ),
        lambda c: c.isNotNull(),
    )
    return df.select("product_id", names.alias("f")).select(
        "product_id", F.explode("f").alias("feature"), (1.0 / F.sqrt(F.size("f"))).alias("weight")
    )


def content_profile(seen: DataFrame, features: DataFrame) -> DataFrame:
    """Mean unit vector of a user's items: its dot product with an item is the mean cosine."""
    sizes = seen.groupBy("customer_id").agg(F.count("*").alias("n"))
    sums = seen.join(features, "product_id").groupBy("customer_id", "feature").agg(F.sum("weight").alias("w"))
    return sums.join(sizes, "customer_id").select("customer_id", "feature", (F.col("w") / F.col("n")).alias("weight"))


def content_scores(pairs: DataFrame, profile: DataFrame, features: DataFrame) -> DataFrame:
    """Mean cosine of given (user, item) pairs to the user's items."""
    items = features.select("product_id", "feature", F.col("weight").alias("iw"))
    hits = pairs.join(items, "product_id").join(profile, ["customer_id", "feature"])
    return hits.groupBy(*PAIR).agg(F.sum(F.col("iw") * F.col("weight")).alias("content_score"))


def similar_items(features: DataFrame, item: Column | str, k: int = 10) -> DataFrame:
    """Items most similar to one item by cosine; linear in the catalogue."""
    mine = features.filter(F.col("product_id") == item).select("feature", F.col("weight").alias("mw"))
    return (
        features.filter(F.col("product_id") != item)
        .join(mine, "feature")
        .groupBy("product_id")
        .agg(F.sum(F.col("weight") * F.col("mw")).alias("cosine"))
        .orderBy(F.round("cosine", 9).desc(), "product_id")
        .limit(k)
    )


def top_k(scored: DataFrame, exclude: DataFrame, score: str, k: int = 10) -> DataFrame:
    """Best ``k`` items per user outside the exclusion pairs, ties by product id."""
    w = Window.partitionBy("customer_id").orderBy(F.col(score).desc(), "product_id")
    free = scored.join(exclude, PAIR, "left_anti")
    # The rank filter lets Spark keep k rows per user in each map task.
    return free.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
