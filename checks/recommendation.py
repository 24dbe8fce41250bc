"""Recommendation checks that need no solver."""

from pyspark.sql import functions as F

from checks.feature_sets import CONTENT_SQL
from checks.registry import query
from checks.sqlbase import define
from shelfsense.operators import splits as S
from shelfsense.operators.evaluation import hit_rate
from shelfsense.plans import recommend as rec

SPLIT = "1999-01-01"
_D = f"DATE '{SPLIT}'"
define("bought", "SELECT customer_id, product_id, quantity, order_date FROM r_items JOIN r_orders USING (order_id)")
define(
    "both_sides",
    f"SELECT customer_id FROM bought GROUP BY 1 HAVING bool_or(order_date < {_D}) AND bool_or(order_date >= {_D})",
)
define("content", CONTENT_SQL)
define(
    "lastout",
    """SELECT customer_id, product_id, interaction_score, row_number() OVER (PARTITION BY customer_id
    ORDER BY last_interaction_date DESC, interaction_score DESC, product_id DESC) = 1 AS is_test FROM m_inter
    QUALIFY count(*) OVER (PARTITION BY customer_id) > 1""",
)
define(
    "poplist",
    """SELECT product_id, row_number() OVER (ORDER BY sum(interaction_score) DESC, product_id) AS r FROM lastout WHERE NOT is_test GROUP BY 1""",
)
define(
    "poprecs",
    """SELECT customer_id, product_id, row_number() OVER (PARTITION BY customer_id ORDER BY r) AS rank FROM
    (SELECT DISTINCT customer_id FROM lastout), poplist p WHERE NOT EXISTS (SELECT 1 FROM lastout s WHERE NOT s.is_test AND s.customer_id = customer_id_of(customer_id) AND s.product_id = p.product_id)""".replace(
        "(SELECT DISTINCT customer_id FROM lastout), poplist p", "(SELECT DISTINCT customer_id FROM lastout) u, poplist p"
    ).replace("customer_id_of(customer_id)", "u.customer_id")
    + " QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY r) <= 10",
)


def bought(x):
    return rec.purchases(x.staging)


def leave_out(x):
    m = x.mart("recommendation_interactions").select("customer_id", "product_id", "last_interaction_date", "interaction_score")
    return S.leave_last_out(m, "customer_id", ["last_interaction_date", "interaction_score", "product_id"])


def _interaction_sql(wish_cut):
    return f"""SELECT * FROM (SELECT customer_id, product_id, ln(1 + sum(q)) + 0.15 * ln(1 + sum(v)) + 0.4 * ln(1 + sum(w)) + 0.5 * sum(p) AS score FROM (
    SELECT customer_id, product_id, quantity AS q, 0 AS v, 0 AS w, 0 AS p FROM bought WHERE order_date < {_D}
    UNION ALL SELECT customer_id_nullable, product_id_nullable, 0, 1, 0, 0 FROM r_clicks WHERE event_type = 'view_product' AND event_time < {_D}
      AND customer_id_nullable IS NOT NULL AND product_id_nullable IS NOT NULL
    UNION ALL SELECT customer_id_nullable, product_id_nullable, 0, 0, 1, 0 FROM r_clicks WHERE event_type = 'wishlist_add' {wish_cut.format(c='event_time')}
      AND customer_id_nullable IS NOT NULL AND product_id_nullable IS NOT NULL
    UNION ALL SELECT customer_id, product_id, 0, 0, 0, 1 FROM r_reviews WHERE rating >= 4 {wish_cut.format(c='review_date')}) GROUP BY 1, 2)
    WHERE score > 0 AND customer_id IN (SELECT customer_id FROM both_sides)"""


@query("rc_01_interactions_strict", "customer_id product_id score:f", _interaction_sql(f"AND {{c}} < {_D}"))
def _(x):
    return rec.interactions(bought(x), x.staging, SPLIT)


@query("rc_01_interactions_compatible", "customer_id product_id score:f", _interaction_sql(""))
def _(x):
    return rec.interactions(bought(x), x.staging, SPLIT, strict=False)


define(
    "unseen",
    f"SELECT customer_id, product_id FROM bought WHERE customer_id IN (SELECT customer_id FROM both_sides) GROUP BY 1, 2 HAVING min(order_date) >= {_D}",
)


@query(
    "rc_03_content_scores",
    "customer_id product_id content_score:f",
    f"""WITH tr AS (SELECT DISTINCT customer_id, product_id FROM bought WHERE order_date < {_D}),
        pr AS (SELECT customer_id, feature, sum(weight) / max(n) AS w FROM tr JOIN content USING (product_id)
          JOIN (SELECT customer_id, count(*) AS n FROM tr GROUP BY 1) USING (customer_id) GROUP BY 1, 2)
        SELECT u.customer_id, u.product_id, sum(c.weight * pr.w) AS content_score FROM unseen u JOIN content c USING (product_id)
        JOIN pr ON pr.customer_id = u.customer_id AND pr.feature = c.feature GROUP BY 1, 2""",
)
def _(x):
    features = rec.content_features(x.staging.products, x.staging.product_attributes)
    profile = rec.content_profile(rec.seen_items(bought(x), SPLIT), features)
    return rec.content_scores(rec.novel_items(bought(x), SPLIT), profile, features)


_CATLIST = """SELECT category, product_id, count(*) AS pop, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, product_id) AS pop_rank
    FROM bought JOIN r_products USING (product_id) WHERE order_date < {d} GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, product_id) <= 10""".format(d=_D)
define("catlist", _CATLIST)


@query("rc_07_category_popularity", "category product_id pop:i pop_rank:i", _CATLIST)
def _(x):
    return rec.category_top(bought(x).filter(f"order_date < date'{SPLIT}'"), x.staging.products)


@query(
    "rc_06_cold_start",
    "customer_id product_id rank:i",
    """WITH cold AS (SELECT customer_id FROM r_customers LEFT JOIN bought USING (customer_id) GROUP BY 1 HAVING count(product_id) < 30),
       fav AS (SELECT customer_id, category, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, category) AS cr
         FROM bought JOIN cold USING (customer_id) JOIN r_products USING (product_id) GROUP BY 1, 2
         QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, category) <= 3),
       cand AS (SELECT u.customer_id, l.product_id, coalesce(f.cr, 1000) AS cr, l.category, l.pop_rank FROM cold u CROSS JOIN catlist l
         LEFT JOIN fav f ON f.customer_id = u.customer_id AND f.category = l.category
         WHERE NOT EXISTS (SELECT 1 FROM bought b WHERE b.customer_id = u.customer_id AND b.product_id = l.product_id))
       SELECT customer_id, product_id, row_number() OVER (PARTITION BY customer_id ORDER BY cr, category, pop_rank) AS rank FROM cand
       QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY cr, category, pop_rank) <= 10""",
)
def _(x):
    b = bought(x)
    cold = rec.routing(x.staging.customers, b, below=30).filter("route = 'cold'")
    listing = rec.category_top(b.filter(f"order_date < date'{SPLIT}'"), x.staging.products)
    return rec.cold_start(cold, b, x.staging.products, listing)


@query(
    "rc_08_routing",
    "customer_id purchases:i route",
    """SELECT customer_id, count(product_id) AS purchases, CASE WHEN count(product_id) < 5 THEN 'cold' ELSE 'warm' END AS route
       FROM r_customers LEFT JOIN bought USING (customer_id) GROUP BY 1""",
)
def _(x):
    return rec.routing(x.staging.customers, bought(x))


@query("rc_09_popularity_baseline", "customer_id product_id rank:i", "SELECT * FROM poprecs")
def _(x):
    rows = leave_out(x)
    return rec.popularity_recommendations(rows.filter("not is_test"), rows.select("customer_id"))


@query(
    "rc_05_top_k_with_exclusion",
    "customer_id product_id rank:i",
    """SELECT customer_id, product_id, row_number() OVER (PARTITION BY customer_id ORDER BY interaction_score DESC, product_id) AS rank FROM m_inter i
       WHERE NOT EXISTS (SELECT 1 FROM bought b WHERE b.customer_id = i.customer_id AND b.product_id = i.product_id)
       QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY interaction_score DESC, product_id) <= 10""",
)
def _(x):
    return rec.top_k(
        x.mart("recommendation_interactions").select("customer_id", "product_id", "interaction_score"),
        rec.seen_items(bought(x)),
        "interaction_score",
        10,
    )


@query(
    "rc_11_similar_items",
    "product_id cosine:f",
    """WITH best AS (SELECT product_id FROM bought GROUP BY 1 ORDER BY count(*) DESC, product_id LIMIT 1)
       SELECT c.product_id, sum(c.weight * m.weight) AS cosine FROM content c JOIN content m USING (feature)
       WHERE m.product_id IN (SELECT product_id FROM best) AND c.product_id NOT IN (SELECT product_id FROM best)
       GROUP BY 1 ORDER BY round(sum(c.weight * m.weight), 9) DESC, c.product_id LIMIT 10""",
)
def _(x):
    counts = bought(x).groupBy("product_id").agg(F.count("*").alias("n"))
    best = counts.orderBy(F.col("n").desc(), "product_id").first()["product_id"]
    return rec.similar_items(rec.content_features(x.staging.products, x.staging.product_attributes), best, 10)


@query(
    "ev_14_hit_rate_mrr",
    "k:i n_evaluated:i hit_rate:f mrr:f",
    """WITH h AS (SELECT t.customer_id, min(p.rank) AS r FROM lastout t LEFT JOIN poprecs p ON p.customer_id = t.customer_id AND p.product_id = t.product_id
         WHERE t.is_test GROUP BY 1)
       SELECT k, count(*) AS n_evaluated, avg(CASE WHEN r <= k THEN 1 ELSE 0 END) AS hit_rate, avg(CASE WHEN r <= k THEN 1 / r ELSE 0 END) AS mrr
       FROM h, (SELECT unnest([1, 5, 10]) AS k) GROUP BY 1""",
)
def _(x):
    rows = leave_out(x)
    recs = rec.popularity_recommendations(rows.filter("not is_test"), rows.select("customer_id"))
    return hit_rate(recs, rows.filter("is_test"), [1, 5, 10], "customer_id", "product_id", "rank")
