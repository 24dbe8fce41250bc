"""Model jobs. They have no SQL counterpart; tests check them on small fixtures."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import functions as F

from checks.registry import query
from shelfsense.operators import bootstrap as B
from shelfsense.operators import clusters as CL
from shelfsense.operators import evaluation as E
from shelfsense.operators import stats as ST
from shelfsense.operators.quality import union_all
from shelfsense.plans import churn, customer360, factors, features as FT, forecast
from shelfsense.plans import recommend as rec
from shelfsense.plans import returns as RET
from shelfsense.plans import segmentation as SEG
from shelfsense.plans import training as T
from shelfsense.plans import uplift as UP

SPLIT_WEEK, SPLIT_DATE = "2000-01-03", "1999-01-01"
ROUNDS = 15  # boosting rounds of the registered jobs


def _kept(x, key, build):
    """Fitted models live with the space of their session and scale folder."""
    store = x.__dict__.setdefault("fitted", {})
    with x.alone(f"fitted_{key}"):
        if key not in store:
            store[key] = build()
        return store[key]


def at_once(*jobs):
    """Results of independent jobs run at the same time: most of their steps are too small to fill a cluster."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


# --- churn -------------------------------------------------------------------------------


def churn_table(x):
    return x.stored("churn_table", lambda: churn.training_table(x.mart("customer_features")))


def churn_model(x, kind):
    fills = _kept(x, "churn_medians", lambda: churn.train_medians(churn_table(x)))
    build = {
        "boosted": lambda: churn.fit_boosted(churn_table(x), ROUNDS, fills),
        "logistic": lambda: churn.fit_logistic(churn_table(x), fills),
        "forest": lambda: churn.fit_forest(churn_table(x), 30, fills),
    }[kind]
    return _kept(x, f"churn_{kind}", build)


def churn_scores(x):
    def build():
        rows = churn_table(x).filter("part = 'test'")
        for kind in ("boosted", "logistic", "forest"):
            rows = churn_model(x, kind).score(rows, kind)
        return rows.select("customer_id", churn.LABEL, "boosted", "logistic", "forest")

    return x.stored("churn_scores", build)


for _id, _kind in (("ml_01_boosted_churn", "boosted"), ("ml_02_logistic_churn", "logistic"), ("ml_03_forest_churn", "forest")):
    query(_id, "customer_id churn_flag_90d:i score:f")(
        lambda x, k=_kind: churn_scores(x).select("customer_id", churn.LABEL, F.col(k).alias("score"))
    )


@query("ml_01_churn_comparison", "model roc_auc:f average_precision:f brier_score:f log_loss:f n_test:i")
def _(x):
    kinds = ["boosted", "logistic", "forest"]
    long = churn_scores(x).unpivot(["customer_id", churn.LABEL], kinds, "model", "score")
    return E.ranking_quality(long, "score", churn.LABEL, ["model"]).join(
        E.classification_summary(long, "score", churn.LABEL, ["model"]), "model"
    )


@query("ml_04_dec_04_calibrated_churn", "customer_id churn_prob:f raw:f churn_flag_90d:i part")
def _(x):
    return calibrated(x)


def calibrated(x):
    return x.stored("churn_calibrated", lambda: churn.calibrated_probabilities(x.mart("customer_features"), ROUNDS))


@query("ev_10_calibrated_reliability", "model bin:i n:i mean_predicted:f observed_fraction:f")
def _(x):
    test = calibrated(x).filter("part = 'test'")
    parts = [
        E.reliability(test, c, churn.LABEL, 5).withColumn("model", F.lit(c)) for c in ("raw", "churn_prob")
    ]
    return parts[0].unionByName(parts[1])


@query("ml_23_churn_importance", "feature importance:f")
def _(x):
    return churn_model(x, "boosted").importance()


@query("srt_01_top_churn_scores", "rank:i customer_id boosted:f")
def _(x):
    from shelfsense.operators.decisions import top_ranked

    return top_ranked(churn_scores(x), [F.col("boosted").desc(), F.col("customer_id")], 500)


@query(
    "ev_11_paired_bootstrap",
    "candidate reference candidate_value:f reference_value:f lift:f ci95_low:f ci95_high:f share_positive:f ci_excludes_zero:b verdict",
)
def _(x):
    return B.paired_lift(churn_scores(x), "boosted", "logistic", churn.LABEL, ["customer_id"], draws=2000)


@query(
    "ft_17_preprocessed_inputs",
    "customer_id total_sessions:f total_orders:f loyalty_tier",
    """WITH m AS (SELECT customer_id, coalesce(CAST(total_sessions AS DOUBLE), (SELECT quantile_cont(CAST(total_sessions AS DOUBLE), 0.5) FROM m_customer)) AS s,
         coalesce(CAST(total_orders AS DOUBLE), (SELECT quantile_cont(CAST(total_orders AS DOUBLE), 0.5) FROM m_customer)) AS o,
         coalesce(loyalty_tier, (SELECT loyalty_tier FROM m_customer WHERE loyalty_tier IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS t FROM m_customer)
       SELECT customer_id, (s - avg(s) OVER ()) / stddev_samp(s) OVER () AS total_sessions, (o - avg(o) OVER ()) / stddev_samp(o) OVER () AS total_orders,
       t AS loyalty_tier FROM m""",
)
def _(x):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    m = x.mart("customer_features").select("customer_id", "total_sessions", "total_orders", "loyalty_tier")
    numeric, categorical = ["total_sessions", "total_orders"], ["loyalty_tier"]
    filled = T.with_inputs(m, T.column_medians(m, numeric), T.column_modes(m, categorical))
    out = Pipeline(stages=T.input_stages(numeric, categorical, linear=True)).fit(filled).transform(filled)
    z = vector_to_array("scaled")
    return out.select("customer_id", z[0].alias("total_sessions"), z[1].alias("total_orders"), F.col("x_loyalty_tier").alias("loyalty_tier"))


# --- uplift ------------------------------------------------------------------------------


def uplift_table(x):
    return x.stored("uplift_table", lambda: UP.training_table(x.mart("campaign_response"), x.mart("customer_features")))


def x_learner(x):
    return _kept(x, "x_learner", lambda: UP.fit_x_learner(uplift_table(x), ROUNDS))


def uplift_scores(x):
    return x.stored(
        "uplift_scores",
        lambda: x_learner(x).score(uplift_table(x)).select("campaign_id", "customer_id", "part", "y", "t", "uplift_ite"),
    )


@query("ml_05_t_learner", "campaign_id customer_id p_treated:f p_control:f uplift_score:f")
def _(x):
    return UP.t_learner(uplift_table(x))


@query("ml_06_x_learner", "campaign_id customer_id uplift_ite:f")
def _(x):
    return uplift_scores(x)


@query("ml_07_outcome_model_fallbacks", "campaign_id arm:i fitted:b")
def _(x):
    done = x.spark.createDataFrame([(c, a) for c, a in x_learner(x).outcome_models], "campaign_id string, arm int")
    arms = uplift_table(x).select("campaign_id", F.col("t").alias("arm")).distinct()
    return arms.join(done.withColumn("fitted", F.lit(True)), ["campaign_id", "arm"], "left").na.fill(False, ["fitted"])


@query(
    "ml_08_campaign_propensity",
    "campaign_id propensity:f control_weight:f",
    """WITH a AS (SELECT campaign_id, customer_id, assignment_datetime, treatment_flag, row_number() OVER w > floor(count(*) OVER () * (1 - 0.2::DOUBLE)) AS t
         FROM s_targets WINDOW w AS (ORDER BY assignment_datetime, campaign_id, customer_id)),
       b AS (SELECT *, row_number() OVER (ORDER BY assignment_datetime, campaign_id, customer_id) > floor(count(*) OVER () * (1 - 0.15::DOUBLE)) AS v FROM a WHERE NOT t)
       SELECT campaign_id, p AS propensity, CASE WHEN p > 0 THEN least((1 - p) / p, 10) ELSE 1 END AS control_weight
       FROM (SELECT campaign_id, avg(CAST(treatment_flag AS INTEGER)) AS p FROM b WHERE NOT v GROUP BY 1)""",
)
def _(x):
    return UP.propensity(uplift_table(x))


@query("ml_23_uplift_importance", "feature importance:f")
def _(x):
    return x.spark.createDataFrame(x_learner(x).importance(), "feature string, importance double")


@query("ev_12_x_learner_deciles", "decile:i n_total:i n_treatment:i n_control:i observed_uplift:f mean_score:f")
def _(x):
    test = uplift_scores(x).filter("part = 'test'")
    return E.uplift_deciles(test, "uplift_ite", "y", "t", UP.IDS)


def best_campaigns(x):
    return x.stored("best_campaigns", lambda: UP.best_campaign(uplift_scores(x)))


@query("dec_05_best_campaign", "customer_id top_uplift_campaign uplift_ite:f")
def _(x):
    return best_campaigns(x)


# --- forecast ----------------------------------------------------------------------------


def forecast_scores(x):
    def build():
        table = x.stored("forecast_table", lambda: forecast.training_table(x.mart("product_demand"), SPLIT_WEEK))
        rows = forecast.naive_columns(table).filter("is_test")
        fills = forecast.train_medians(table)
        boosted = _kept(x, "forecast_boosted", lambda: forecast.fit_boosted(table, ROUNDS, fills))
        rows = forecast.score(boosted, rows, "boosted")
        rows = forecast.score(forecast.fit_tweedie(table, fills), rows, "tweedie")
        rows = forecast.score(forecast.fit_tweedie_trees(table), rows, "tweedie_trees")
        rows = forecast.score(forecast.fit_forest(table, 20, fills), rows, "forest")
        return rows.select(
            *FT.SERIES, "week_start_date", "category", "units_sold", "boosted", "tweedie", "tweedie_trees", "forest", "naive_blend",
            "naive_lag1", "naive_lag4",
        )

    return x.stored("forecast_scores", build)


@query("ml_09_tweedie_and_boosted_demand", "product_id store_id_or_online week_start_date:d units_sold:i boosted:f tweedie:f tweedie_trees:f")
def _(x):
    return forecast_scores(x)


@query("ml_10_forest_demand", "product_id store_id_or_online week_start_date:d units_sold:i forest:f")
def _(x):
    return forecast_scores(x)


@query("ev_19_model_vs_naive", "forecast n:i mae:f rmse:f smape:f mean_bias:f mae_gain_pct:f")
def _(x):
    names = {c: c for c in ("boosted", "tweedie", "tweedie_trees", "forest", "naive_blend", "naive_lag1", "naive_lag4")}
    return forecast.naive_comparison(forecast_scores(x), names, "boosted")


# --- segmentation ------------------------------------------------------------------------


def segments(x):
    return x.stored(
        "segments",
        lambda: SEG.nested_segments(x.mart("customer_features")).drop("parts", "raw_vector"),
    )


def buyers(x):
    rows = FT.segment_features(x.mart("customer_features")).filter("is_non_purchaser = 0")
    return _kept(x, "buyers", lambda: SEG.project(rows, FT.SEGMENT_FEATURES))


@query("ml_12_pca_projection", "customer_id components:i first:f")
def _(x):
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array("parts")
    # The sign of a component is arbitrary.
    return buyers(x)[0].select("customer_id", F.size(v).alias("components"), F.abs(v[0]).alias("first"))


@query("ml_13_nested_segments", "customer_id cluster_id:i segment_name is_non_purchaser:i")
def _(x):
    return segments(x)


@query("ml_14_segment_profile", "cluster_id:i segment_name n:i pct_of_total:f churn_rate:f pct_non_purchaser:f median_aov:f avg_revenue:f median_recency:f median_order_rate:f")
def _(x):
    return SEG.profile_segments(segments(x))


@query("ml_15_k_sweep", "k:i seed:i inertia:f silhouette:f")
def _(x):
    return SEG.k_sweep(buyers(x)[0], list(range(2, 11)), seeds=(42, 7))


@query("ml_16_mixture_sweep", "k:i log_likelihood:f bic:f aic:f")
def _(x):
    return SEG.mixture_sweep(buyers(x)[0], list(range(2, 9)))


# Three Lloyd steps and two of expectation maximisation from given starts, so that SQL can walk them too.
_POINTS = "SELECT p_partkey, CAST(p_size AS DOUBLE) / 10 AS x, CAST(p_retailprice AS DOUBLE) / 500 AS y FROM part"
_CENTRES = [(1.0, 2.0), (4.0, 2.5), (2.5, 4.0)]


def _lloyd_sql(steps: int) -> str:
    ctes = [f"p AS ({_POINTS})", "c0(j, x, y) AS (VALUES " + ", ".join(f"({j}, {a}::DOUBLE, {b}::DOUBLE)" for j, (a, b) in enumerate(_CENTRES)) + ")"]
    for s in range(steps + 1):
        ctes.append(
            f"l{s} AS (SELECT p.*, j, (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) AS d FROM p, c{s} c "
            "QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY d, j) = 1)"
        )
        ctes.append(f"c{s + 1} AS (SELECT j, avg(x) AS x, avg(y) AS y FROM l{s} GROUP BY j)")
    return f"WITH {', '.join(ctes)} SELECT p_partkey, j AS label, d AS square FROM l{steps}"


def points(x):
    t = x.spark.read.parquet(f"{x.folder}/part.parquet")
    cells = F.array(F.col("p_size").cast("double") / 10, F.col("p_retailprice").cast("double") / 500)
    return x.stored("part_points", lambda: t.select("p_partkey", cells.alias("v")))


@query("ml_13_lloyd_steps", "p_partkey:i label:i square:f", _lloyd_sql(3))
def _(x):
    fit = CL.lloyd(points(x), "v", [CL.KMeansFit(0, np.array(_CENTRES))], iterations=3, tolerance=0.0)[0]
    rows = fit.transform(points(x), "v", "label")
    centre = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in fit.centres])[F.col("label")]
    return rows.withColumn("square", F.aggregate(F.zip_with("v", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


_COMPONENTS = [(0.6, (1.5, 2.2), (1.0, 0.5)), (0.4, (4.0, 3.0), (0.7, 0.9))]


def _mixture_sql(steps: int) -> str:
    given = ", ".join(f"({j}, {w}::DOUBLE, {m[0]}::DOUBLE, {m[1]}::DOUBLE, {v[0]}::DOUBLE, {v[1]}::DOUBLE)" for j, (w, m, v) in enumerate(_COMPONENTS))
    ctes = [f"p AS ({_POINTS})", f"c0(j, w, mx, my, vx, vy) AS (VALUES {given})"]
    for s in range(steps + 1):
        ctes.append(
            f"e{s} AS (SELECT p.*, j, w * exp(-0.5 * ((x - mx) * (x - mx) / vx + (y - my) * (y - my) / vy)) / (2 * pi() * sqrt(vx * vy)) AS f FROM p, c{s})"
        )
        ctes.append(f"r{s} AS (SELECT *, f / sum(f) OVER (PARTITION BY p_partkey) AS r FROM e{s})")
        ctes.append(
            f"c{s + 1} AS (SELECT j, sum(r) / (SELECT count(*) FROM p) AS w, sum(r * x) / sum(r) AS mx, sum(r * y) / sum(r) AS my, "
            f"sum(r * x * x) / sum(r) - pow(sum(r * x) / sum(r), 2) + 1e-6::DOUBLE AS vx, sum(r * y * y) / sum(r) - pow(sum(r * y) / sum(r), 2) + 1e-6::DOUBLE AS vy FROM r{s} GROUP BY j)"
        )
    ctes.append(f"ll AS (SELECT sum(ln(f)) AS ll, count(*) AS n FROM (SELECT sum(f) AS f FROM e{steps} GROUP BY p_partkey))")
    return (
        f"WITH {', '.join(ctes)} SELECT j AS component, w AS weight, mx AS mean_x, my AS mean_y, vx AS variance_x, vy AS variance_y, "
        f"ll / n AS mean_log_likelihood, (9 * ln(n) - 2 * ll) / n AS bic_per_row FROM c{steps}, ll"
    )


@query(
    "ml_16_mixture_steps",
    "component:i weight:f mean_x:f mean_y:f variance_x:f variance_y:f mean_log_likelihood:f bic_per_row:f",
    _mixture_sql(2),
)
def _(x):
    start = CL.Mixture(*[np.array([c[i] for c in _COMPONENTS]) for i in range(3)])
    fit = CL.expectation_maximisation(points(x), "v", [start], iterations=2, tolerance=0.0)[0]
    rows = [
        (j, float(fit.weights[j]), *map(float, fit.means[j]), *map(float, fit.variances[j]), fit.log_likelihood / fit.rows, fit.bic / fit.rows) for j in range(fit.k)
    ]
    names = "component weight mean_x mean_y variance_x variance_y mean_log_likelihood bic_per_row".split()
    return x.spark.createDataFrame(rows, names)


@query("ml_17_named_clusters", "cluster_id:i segment_name n:i churn_rate:f")
def _(x):
    from shelfsense.operators.ordered import quantile_values

    columns = ["total_net_revenue", "recency_days", "total_orders"]
    rows = segments(x).drop("segment_name")
    overall = {c: q[0] for c, q in quantile_values(rows, columns, [0.5]).items()}
    return SEG.name_clusters(SEG.segment_profile(rows, "cluster_id", columns), overall)


@query("ml_25_loadings", "component:i column place:i explained_variance:f")
def _(x):
    return SEG.top_loadings(SEG.loadings(buyers(x)[1], FT.SEGMENT_FEATURES, x.spark))


@query("ml_26_input_comparison", "inputs k:i silhouette:f davies_bouldin:f calinski_harabasz:f")
def _(x):
    rows = buyers(x)[0].drop("standard", "parts")
    gone = ST.drop_correlated(ST.pearson_pairs(rows, FT.SEGMENT_FEATURES), FT.SEGMENT_FEATURES)
    pruned = [c for c in FT.SEGMENT_FEATURES if c not in gone]
    choices = {"all": FT.SEGMENT_FEATURES, "components": FT.SEGMENT_FEATURES, "pruned": pruned}
    return SEG.compare_inputs(rows, choices, 3, {"components"})


@query("ml_27_raw_vs_log_inputs", "inputs k:i silhouette:f")
def _(x):
    rows = buyers(x)[0].drop("standard", "parts")
    plain = [c.removeprefix("log_") for c in FT.SEGMENT_FEATURES]
    return SEG.compare_inputs(rows, {"raw": plain, "log": FT.SEGMENT_FEATURES}, 3, {"raw", "log"})


@query("ev_15_cluster_quality", "k:i n:i silhouette:f davies_bouldin:f calinski_harabasz:f inertia:f")
def _(x):
    rows = x.stored("buyer_parts", lambda: buyers(x)[0].select("customer_id", "parts"))
    model = SEG.best_kmeans(rows, 3)
    return SEG.cluster_quality(model.transform(rows), "parts", "raw_label")


# --- returns -----------------------------------------------------------------------------


def abuse_table(x):
    return x.stored("abuse_table", lambda: RET.labelled_table(x.mart("returns_risk"), x.staging.returns_hidden_labels))


def abuse_scores(x):
    def build():
        model = _kept(x, "abuse_model", lambda: RET.fit_boosted(abuse_table(x), ROUNDS))
        return model.score(abuse_table(x).filter("is_test"), "abuse_score").select(
            "return_id", "customer_id", "order_date", "is_abuse", "abuse_score"
        )

    return x.stored("abuse_scores", build)


@query("ml_18_return_abuse_model", "return_id is_abuse:i abuse_score:f")
def _(x):
    return abuse_scores(x)


@query("ev_06_return_abuse_quality", "flag_rate:f threshold:f flagged:i precision:f recall:f f1:f")
def _(x):
    return E.flag_rate_quality(abuse_scores(x), "abuse_score", "is_abuse", [0.01, 0.02, 0.05])


@query("srt_05_abuse_review_queue", "return_id customer_id abuse_score:f")
def _(x):
    cut = E.flag_rate_quality(abuse_scores(x), "abuse_score", "is_abuse", [0.01]).first()["threshold"]
    return RET.review_queue(abuse_scores(x), "abuse_score", cut)


_RULE_SQL = """WITH b AS (SELECT *, least(5, coalesce(refund_amount / greatest(item_net_price, 0.01::DOUBLE), 0)) AS ratio FROM m_returns WHERE return_flag = 1),
    q AS (SELECT quantile_cont(item_discount_pct, 0.25) AS d1, quantile_cont(item_discount_pct, 0.75) AS d3, quantile_cont(refund_amount, 0.25) AS r1,
      quantile_cont(refund_amount, 0.75) AS r3 FROM b),
    f AS (SELECT return_id, item_discount_pct > d3 + 1.5 * (d3 - d1) AS high_discount, refund_amount > r3 + 1.5 * (r3 - r1) AS high_refund,
      prior_customer_return_rate > 0.5 AS high_customer_ret_rate, quantity > 2 AS bulk_quantity, ratio > 1.2 AS high_refund_ratio,
      recent_product_return_events > 10 AS repeat_product_events FROM b, q)
    SELECT *, high_discount OR high_refund OR high_customer_ret_rate OR bulk_quantity OR high_refund_ratio OR repeat_product_events AS any_rule FROM f"""


@query(
    "ml_19_rule_flags",
    "return_id high_discount:b high_refund:b high_customer_ret_rate:b bulk_quantity:b high_refund_ratio:b repeat_product_events:b any_rule:b",
    _RULE_SQL,
)
def _(x):
    return RET.rule_flags(x.mart("returns_risk").filter("return_flag = 1"))


@query(
    "ml_19_rule_fire_rates",
    "rule flagged:i fire_rate:f",
    " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER (WHERE {r}) AS flagged, avg(CAST({r} AS INTEGER)) AS fire_rate FROM ({_RULE_SQL})" for r in RET.RULES),
)
def _(x):
    return RET.rule_fire_rates(RET.rule_flags(x.mart("returns_risk").filter("return_flag = 1")))


def outlier_rows(x):
    rows = RET.outlier_vectors(RET.with_labels(x.mart("returns_risk").filter("return_flag = 1"), x.staging.returns_hidden_labels))
    return x.stored("outlier_rows", lambda: rows.select("return_id", "is_abuse", "v"))


@query("ml_20_isolation_forest", "return_id is_abuse:i iso_score:f iso_flag:i")
def _(x):
    return RET.isolation_scores(outlier_rows(x), ["return_id"])


@query("ml_21_local_outlier_factor", "return_id is_abuse:i lof_score:f lof_flag:i")
def _(x):
    return RET.local_outlier_scores(outlier_rows(x), ["return_id"])


@query(
    "ml_21_local_outlier_factor_of_suppliers",
    "s_suppkey:i lof_score:f",
    """WITH p AS (SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) / 100 AS a, CAST(s_nationkey AS DOUBLE) AS b FROM supplier),
    d AS (SELECT x.s_suppkey AS i, y.s_suppkey AS j, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) AS d FROM p x JOIN p y ON x.s_suppkey <> y.s_suppkey),
    near AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, CAST(j AS VARCHAR)) <= 20),
    reach AS (SELECT i, max(d) AS kd, count(*) AS k FROM near GROUP BY i),
    dens AS (SELECT n.i, 1 / (sum(greatest(n.d, r.kd)) / count(*) + 1e-10::DOUBLE) AS lrd FROM near n JOIN reach r ON n.j = r.i GROUP BY n.i)
    SELECT n.i AS s_suppkey, sum(o.lrd) / count(*) / any_value(m.lrd) AS lof_score FROM near n JOIN dens o ON n.j = o.i JOIN dens m ON n.i = m.i GROUP BY n.i""",
)
def _(x):
    v = F.array(F.col("s_acctbal").cast("double") / 100, F.col("s_nationkey").cast("double"))
    rows = x.spark.read.parquet(f"{x.folder}/supplier.parquet").select("s_suppkey", v.alias("v"))
    return RET.local_outlier_scores(rows, ["s_suppkey"])


@query("ml_22_fold_comparison", "feature_set fold:i average_precision:f roc_auc:f")
def _(x):
    sets = {"numeric": FT.RETURN_NUMERIC, "all": FT.RETURN_NUMERIC + FT.RETURN_FLAGS}
    return RET.fold_comparison(abuse_table(x), sets, folds=5, iterations=3)


# --- recommendation ----------------------------------------------------------------------


def _purchases(x):
    return rec.purchases(x.staging)


def interactions(x, name="default", weights=rec.WEIGHTS):
    return x.stored(
        f"interactions_{name}",
        lambda: rec.interactions(_purchases(x), x.staging, SPLIT_DATE, weights=weights).select("customer_id", "product_id", "score"),
    )


def svd(x, rank=20):
    return _kept(x, f"svd_{rank}", lambda: factors.truncated_svd(interactions(x), rank))


def train_seen(x):
    return x.stored("train_seen", lambda: rec.seen_items(_purchases(x), SPLIT_DATE))


def truth(x):
    return x.stored("novel_items", lambda: rec.novel_items(_purchases(x), SPLIT_DATE))


def content(x):
    return x.stored("content_features", lambda: rec.content_features(x.staging.products, x.staging.product_attributes))


def profiles(x):
    return x.stored("content_profiles", lambda: rec.content_profile(train_seen(x), content(x)))


def hybrid(x, alpha=0.8, k=50):
    def build():
        return factors.recommend_all(svd(x), train_seen(x), k, content(x), profiles(x), alpha)

    return x.stored(f"hybrid_{int(alpha * 100)}_{k}", build)


@query("ml_24_truncated_svd", "component:i singular_value:f cumulative_share:f")
def _(x):
    return factors.spectrum(svd(x).values, x.spark)


@query("ml_28_squared_value_share", "component:i cumulative_share:f")
def _(x):
    return factors.spectrum(svd(x).values, x.spark)


@query("rc_02_user_scores", "product_id score:f")
def _(x):
    user = svd(x).users.agg(F.min("customer_id").alias("u")).first()["u"]
    return factors.user_scores(svd(x), user, train_seen(x)).filter("score is not null")


@query("rc_04_hybrid_top_k", "customer_id product_id rank:i score:f")
def _(x):
    return hybrid(x).filter("rank <= 10")


# Factors given by columns of the tables, so that SQL can check the scoring itself.

_FIXED = """WITH u AS (SELECT CAST(c_custkey AS VARCHAR) AS customer_id, CAST(c_acctbal AS DOUBLE) / 10000 AS f1, (c_nationkey - 12) / 25.0::DOUBLE AS f2, 0.5::DOUBLE AS f3 FROM customer),
    i AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_brand, p_type, CAST(p_size AS DOUBLE) / 50 AS g1, CAST(p_retailprice AS DOUBLE) / 2000 AS g2, (p_partkey % 13 - 6) / 13.0::DOUBLE AS g3 FROM part),
    had AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(l_partkey AS VARCHAR) AS product_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    cf AS (SELECT customer_id, product_id, p_brand, p_type, f1 * g1 + f2 * g2 + f3 * g3 AS cf FROM u, i),
    sizes AS (SELECT customer_id, count(*) AS n FROM had GROUP BY 1),
    prof AS (SELECT customer_id, name, count(*) / any_value(n) / 2.0::DOUBLE AS w FROM
      (SELECT customer_id, unnest([p_brand, p_type]) AS name FROM had JOIN i USING (product_id)) JOIN sizes USING (customer_id) GROUP BY 1, 2),
    both_scores AS (SELECT c.*, coalesce(b.w, 0) + coalesce(m.w, 0) AS cb, h.product_id IS NOT NULL AS seen FROM cf c
      LEFT JOIN prof b ON b.customer_id = c.customer_id AND b.name = p_brand LEFT JOIN prof m ON m.customer_id = c.customer_id AND m.name = p_type
      LEFT JOIN had h ON h.customer_id = c.customer_id AND h.product_id = c.product_id)"""


def fixed(x):
    """Factors, seen pairs and content as in ``_FIXED``."""
    t = lambda name: x.spark.read.parquet(f"{x.folder}/{name}.parquet")
    of = lambda *cells: F.array(*[c.cast("double") for c in cells]).alias("f")
    users = t("customer").select(F.col("c_custkey").cast("string").alias("customer_id"), of(F.col("c_acctbal").cast("double") / 10000, (F.col("c_nationkey") - 12) / 25.0, F.lit(0.5)))
    part = t("part").withColumn("product_id", F.col("p_partkey").cast("string"))
    items = part.select("product_id", of(F.col("p_size").cast("double") / 50, F.col("p_retailprice").cast("double") / 2000, (F.col("p_partkey") % 13 - 6) / 13.0))
    had = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").cast("string").alias("customer_id"), F.col("l_partkey").cast("string").alias("product_id")).distinct()
    traits = part.select("product_id", F.explode(F.array("p_brand", "p_type")).alias("feature"), F.lit(0.5).alias("weight"))
    return factors.Factors(users, items, []), had, traits


def fixed_profiles(had, traits):
    """Shares of a customer's items with a trait; with item weights of one half this is the mean cosine."""
    return rec.content_profile(had, traits.withColumn("weight", F.lit(1.0)))


@query(
    "rc_02_masked_scores_of_fixed_factors",
    "product_id score:f",
    _FIXED + " SELECT product_id, cf AS score FROM both_scores WHERE customer_id = (SELECT min(customer_id) FROM had) AND NOT seen",
)
def _(x):
    f, had, _traits = fixed(x)
    user = had.agg(F.min("customer_id").alias("u")).first()["u"]
    return factors.user_scores(f, user, had).filter("score is not null")


@query(
    "rc_04_hybrid_top_k_of_fixed_factors",
    "customer_id product_id rank:i score:f",
    _FIXED + """, b AS (SELECT *, min(cf) OVER w AS a1, max(cf) OVER w AS a2, min(cb) OVER w AS b1, max(cb) OVER w AS b2 FROM both_scores WINDOW w AS (PARTITION BY customer_id)),
    s AS (SELECT customer_id, product_id, 0.8::DOUBLE * (cf - a1) / (a2 - a1 + 1e-9::DOUBLE) + 0.2::DOUBLE * (cb - b1) / (b2 - b1 + 1e-9::DOUBLE) AS score FROM b WHERE NOT seen)
    SELECT customer_id, product_id, score, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 10) DESC, product_id) AS rank FROM s
    QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 10) DESC, product_id) <= 10""",
)
def _(x):
    f, had, traits = fixed(x)
    return factors.recommend_all(f, had, 10, traits, fixed_profiles(had, traits), 0.8)


@query(
    "rc_04_single_user_of_fixed_factors",
    "product_id rank:i score:f",
    _FIXED + """, b AS (SELECT *, min(cf) FILTER (WHERE NOT seen) OVER () AS a1, max(cf) FILTER (WHERE NOT seen) OVER () AS a2, min(cb) OVER () AS b1, max(cb) OVER () AS b2
      FROM both_scores WHERE customer_id = (SELECT min(customer_id) FROM had)),
    s AS (SELECT product_id, 0.8::DOUBLE * (cf - a1) / (a2 - a1 + 1e-9::DOUBLE) + 0.2::DOUBLE * (cb - b1) / (b2 - b1 + 1e-9::DOUBLE) AS score FROM b WHERE NOT seen)
    SELECT product_id, score, row_number() OVER (ORDER BY round(score, 10) DESC, product_id) AS rank FROM s QUALIFY row_number() OVER (ORDER BY round(score, 10) DESC, product_id) <= 10""",
)
def _(x):
    f, had, traits = fixed(x)
    user = had.agg(F.min("customer_id").alias("u")).first()["u"]
    return factors.recommend_user(f, user, had, 10, traits, fixed_profiles(had, traits))


@query("ev_14_hybrid_hit_rate", "k:i n_evaluated:i hit_rate:f mrr:f")
def _(x):
    return E.hit_rate(hybrid(x), truth(x), [1, 5, 10, 20, 50], "customer_id", "product_id", "rank")


@query("rc_12_rank_sweep", "svd_rank:i k:i n_evaluated:i hit_rate:f mrr:f")
def _(x):
    parts = []
    for r in (10, 20):
        top = factors.recommend_all(svd(x, r), train_seen(x), 10)
        parts.append(E.hit_rate(top, truth(x), [10], "customer_id", "product_id", "rank").withColumn("svd_rank", F.lit(r)))
    return parts[0].unionByName(parts[1])


@query("rc_12_signal_sweep", "scheme k:i n_evaluated:i hit_rate:f mrr:f")
def _(x):
    schemes = {
        "buy_only": {"quantity": 1.0, "view_count": 0.0, "wish_count": 0.0, "pos_review": 0.0},
        "all_signals": rec.WEIGHTS,
    }
    parts = []
    for name, weights in schemes.items():
        f = factors.truncated_svd(interactions(x, name, weights), 10, rounds=3)
        top = factors.recommend_all(f, train_seen(x), 10)
        parts.append(E.hit_rate(top, truth(x), [10], "customer_id", "product_id", "rank").withColumn("scheme", F.lit(name)))
    return parts[0].unionByName(parts[1])


@query("rc_13_alpha_sweep", "alpha:f k:i n_evaluated:i hit_rate:f mrr:f")
def _(x):
    alphas = [0.0, 0.5, 0.8, 1.0]
    top = x.stored("alpha_lists", lambda: factors.recommend_all(svd(x), train_seen(x), 10, content(x), profiles(x), alphas))
    parts = [
        E.hit_rate(top.filter(F.col("alpha") == a), truth(x), [10], "customer_id", "product_id", "rank").withColumn("alpha", F.lit(a)) for a in alphas
    ]
    return union_all(parts)


def recommendation_lists(x):
    def build():
        bought = _purchases(x)
        routes = rec.routing(x.staging.customers, bought)
        warm_ids = routes.filter("route = 'warm'").join(svd(x).users, "customer_id", "left_semi")
        warm = hybrid(x).join(warm_ids, "customer_id", "left_semi")
        cold_ids = routes.join(warm_ids, "customer_id", "left_anti")
        listing = rec.category_top(bought.filter(f"order_date < date'{SPLIT_DATE}'"), x.staging.products)
        return customer360.recommendation_lists(warm, rec.cold_start(cold_ids, bought, x.staging.products, listing, 3, None))

    return x.stored("recommendation_lists", build)


@query("rc_10_all_customers", "customer_id top3_recommendations")
def _(x):
    return recommendation_lists(x)


# --- customer 360 ------------------------------------------------------------------------


def master(x):
    def build():
        churned, profile, campaigns, listed = at_once(
            lambda: calibrated(x), lambda: SEG.profile_segments(segments(x)), lambda: best_campaigns(x), lambda: recommendation_lists(x)
        )
        return customer360.master(x.mart("customer_features"), churned, segments(x), profile, campaigns, listed)

    return x.stored("customer_360", build)


_MASTER = (
    "customer_id customer_value_band recency_days:i total_net_revenue:f churn_prob:f cluster_id:i segment_name"
    " segment_churn_rate:f segment_avg_revenue:f top_uplift_campaign uplift_ite:f top3_recommendations recommended_action"
)


@query("dec_03_customer_360", _MASTER)
def _(x):
    return master(x)


@query("dec_03_full_signal_customers", _MASTER)
def _(x):
    return customer360.full_signal(master(x))


@query("dec_06_single_customer", _MASTER)
def _(x):
    one = x.mart("customer_features").agg(F.max("customer_id").alias("c")).first()["c"]
    return customer360.lookup(master(x), one)


@query("mon_05_best_model_per_workload", "workload metric model value:f")
def _(x):
    from shelfsense.operators.monitoring import best_per_workload

    kinds = ["boosted", "logistic", "forest"]
    churned, demand = at_once(lambda: churn_scores(x), lambda: forecast_scores(x))
    long = churned.unpivot(["customer_id", churn.LABEL], kinds, "model", "score")
    auc = E.ranking_quality(long, "score", churn.LABEL, ["model"])
    names = {c: c for c in ("boosted", "tweedie", "forest", "naive_blend")}
    errors = forecast.naive_comparison(demand, names, "boosted")
    return best_per_workload({"churn": (auc, "model", "roc_auc", True), "forecast": (errors, "forecast", "mae", False)})


# --- the same steps on fixed signals, which SQL can follow ---------------------------------


@query(
    "srt_01_top_fixed_scores",
    "rank:i customer_id score:f",
    """SELECT rank, customer_id, score FROM (SELECT customer_id, total_net_revenue AS score,
         row_number() OVER (ORDER BY total_net_revenue DESC, customer_id) AS rank FROM m_customer WHERE total_net_revenue IS NOT NULL) WHERE rank <= 500""",
)
def _(x):
    from shelfsense.operators.decisions import top_ranked

    rows = x.mart("customer_features").filter("total_net_revenue is not null").selectExpr("customer_id", "total_net_revenue as score")
    return top_ranked(rows, [F.col("score").desc(), F.col("customer_id")], 500)


@query(
    "dec_03_fixed_signals",
    "customer_id action",
    """SELECT customer_id, CASE
         WHEN recency_days > 200 AND total_orders > 10 THEN 'Retention offer NOW + personalised recs (high churn, responds to offers)'
         WHEN recency_days > 200 THEN 'At risk but offer-insensitive: try service/loyalty touch, not discount'
         WHEN region = 'ASIA' THEN 'Low risk, high value: cross-sell via recs, no discount needed'
         WHEN total_orders > 10 AND region <> 'EUROPE' THEN 'Growth target: include in next campaign + recs'
         WHEN total_orders > 10 THEN 'Growth target: include in next campaign'
         ELSE 'Monitor: no strong action this cycle' END AS action FROM m_customer""",
)
def _(x):
    from shelfsense.operators import decisions as D

    signals = x.mart("customer_features").selectExpr(
        "customer_id",
        "if(recency_days > 200, 0.5D, 0.1D) as churn_prob",
        "cast(total_orders as double) - 10 as uplift_ite",
        "if(region = 'ASIA', 'Champions', 'Newcomers') as segment_name",
        "if(region <> 'EUROPE', 'P1', null) as top3_recommendations",
    )
    return signals.withColumn("action", D.action())


_NAMED = """WITH c AS (SELECT *, CASE WHEN total_orders IS NULL THEN -1 ELSE least(total_orders, 40) // 5 END AS g FROM m_customer),
     o AS (SELECT median(total_net_revenue::DOUBLE) AS rev, median(recency_days::DOUBLE) AS rec, median(total_orders::DOUBLE) AS ord FROM m_customer),
     p AS (SELECT g, count(*) AS n, avg(churn_flag_90d) AS churn_rate, median(total_net_revenue::DOUBLE) AS r, median(recency_days::DOUBLE) AS d,
       median(total_orders::DOUBLE) AS t FROM c GROUP BY g),
     l AS (SELECT p.*, CASE WHEN r > 1.5 * rev AND d < 0.6 * rec THEN 'Champions' WHEN t > 1.3 * ord AND d < 0.6 * rec THEN 'Loyal Actives'
       WHEN r > 1.5 * rev AND (d > 1.6 * rec OR churn_rate > 0.3) THEN 'At-Risk High Value'
       WHEN d > 1.6 * rec OR (d >= 0.6 * rec AND t < 0.4 * ord) THEN 'Dormant' WHEN t < 0.4 * ord THEN 'Newcomers' ELSE 'Mid-Tier Active' END AS name FROM p, o)
     SELECT g AS cluster_id, n, churn_rate, CASE WHEN count(*) OVER (PARTITION BY name) > 1
       THEN name || ' ' || row_number() OVER (PARTITION BY name ORDER BY g) ELSE name END AS segment_name FROM l"""


@query("ml_17_named_order_bands", "cluster_id:i n:i churn_rate:f segment_name", _NAMED)
def _(x):
    from shelfsense.operators.ordered import quantile_values

    columns = ["total_net_revenue", "recency_days", "total_orders"]
    rows = x.mart("customer_features").withColumn("cluster_id", F.expr("if(total_orders is null, -1, least(total_orders, 40) div 5)"))
    overall = {c: q[0] for c, q in quantile_values(rows, columns, [0.5]).items()}
    return SEG.name_clusters(SEG.segment_profile(rows, "cluster_id", columns), overall)
