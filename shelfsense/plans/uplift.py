"""Treatment effects: T-learner and X-learner over campaigns."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsense.functions.columns import refuse_columns
from shelfsense.operators import boosting
from shelfsense.plans import features as FT
from shelfsense.plans import training as T
from shelfsense.session import durable

LABEL, TREATED, CAMPAIGN = "response_flag_30d", "treatment_flag", "campaign_id"
IDS = ["campaign_id", "customer_id"]
# Least rows per arm (train, validation) for an outcome model, and the weight cap.
LEAST_TREATED, LEAST_CONTROL = (20, 5), (10, 3)
WEIGHT_CAP = 10.0


def training_table(campaigns: DataFrame, customers: DataFrame) -> DataFrame:
    refuse_columns(FT.UPLIFT_NUMERIC + FT.UPLIFT_CATEGORICAL, FT.UPLIFT_FORBIDDEN)
    rows = FT.uplift_features(FT.enrich_with_customers(campaigns, customers))
    keep = list(dict.fromkeys([*IDS, "assignment_datetime", LABEL, TREATED, *FT.UPLIFT_NUMERIC, *FT.UPLIFT_CATEGORICAL]))
    return T.three_way(rows.select(*keep), "assignment_datetime", IDS).withColumns(
        {"y": F.col(LABEL).cast("double"), "t": F.col(TREATED).cast("int")}
    )


def t_learner(table: DataFrame) -> DataFrame:
    """Two response models, one per arm; the score is the difference of their predictions."""
    rows = table.filter("part <> 'test'")
    scored = table.filter("part = 'test'")
    for arm, name in ((1, "p_treated"), (0, "p_control")):
        lr = LogisticRegression(labelCol="y", maxIter=50, regParam=1e-3)
        model = T.fit(rows.filter(F.col("t") == arm), lr, FT.UPLIFT_NUMERIC, FT.UPLIFT_CATEGORICAL, linear=True)
        scored = model.score(scored, name)
    return scored.withColumn("uplift_score", F.col("p_treated") - F.col("p_control"))


def propensity(table: DataFrame) -> DataFrame:
    """Treated share per campaign on the training rows and the capped control weight."""
    g = table.filter("part = 'train'").groupBy(CAMPAIGN).agg(F.avg("t").alias("propensity"))
    ratio = F.when(F.col("propensity") > 0, (1 - F.col("propensity")) / F.col("propensity")).otherwise(1.0)
    return g.withColumn("control_weight", F.least(ratio, F.lit(WEIGHT_CAP)))


@dataclass
class XLearner:
    inputs: PipelineModel
    fills: dict[str, float]
    texts: dict[str, str]
    tau1: object
    tau0: object
    shares: DataFrame
    outcome_models: list[tuple[str, int]]  # campaign and arm of each fitted outcome model

    def _vectors(self, df: DataFrame) -> DataFrame:
        return self.inputs.transform(T.with_inputs(df, self.fills, self.texts))

    def score(self, df: DataFrame, name: str = "uplift_ite") -> DataFrame:
        """Effect per row: both effect models blended by the campaign's treated share (0.5 if unseen)."""
        out = self._vectors(df)
        for model, column in ((self.tau1, "_t1"), (self.tau0, "_t0")):
            out = model.transform(out).withColumnRenamed("prediction", column)
        g = F.coalesce("propensity", F.lit(0.5))
        joined = out.join(self.shares.select(CAMPAIGN, "propensity"), CAMPAIGN, "left")
        return joined.withColumn(name, g * F.col("_t1") + (1 - g) * F.col("_t0")).select(*df.columns, name)

    def importance(self) -> list[tuple[str, float]]:
        """Gain share per input, averaged over the two effect models."""
        names = FT.UPLIFT_NUMERIC + FT.UPLIFT_CATEGORICAL
        both = (self.tau1.featureImportances.toArray() + self.tau0.featureImportances.toArray()) / 2.0
        return sorted(zip(names, map(float, both)), key=lambda r: (-r[1], r[0]))


def _with_holdout(table: DataFrame) -> DataFrame:
    """Rows for training with ``is_val``. A campaign without validation rows gives up the newest
    15% of its training rows (at least one) by time and id."""
    from shelfsense.operators import ordered

    rows = table.filter("part <> 'test'")
    have = rows.filter("part = 'validation'").select(CAMPAIGN).distinct()
    bare = rows.join(have, CAMPAIGN, "left_anti")
    if bare.isEmpty():
        return rows.withColumn("is_val", F.col("part") == "validation")
    placed = ordered.positions(bare.select("assignment_datetime", *IDS), [CAMPAIGN], ["assignment_datetime", *IDS])
    hold = F.greatest(F.lit(1), F.floor(F.col("rows_total") * F.lit(0.15)))
    late = placed.filter(F.col("rows_total") - F.col("rows_before") <= hold).select(*IDS).withColumn("_late", F.lit(True))
    return rows.join(late, IDS, "left").withColumn(
        "is_val", (F.col("part") == "validation") | F.coalesce("_late", F.lit(False))
    ).drop("_late")


def _arm(arm) -> Column:
    return F.concat_ws("|", F.col(CAMPAIGN).cast("string"), arm)


def enough_rows(rows: DataFrame) -> DataFrame:
    """Campaign and arm (``t``) pairs with enough training and validation rows and both outcomes."""
    counts = rows.groupBy(CAMPAIGN, "t").agg(
        F.count_if(~F.col("is_val")).alias("n_train"),
        F.count_if("is_val").alias("n_val"),
        F.coalesce(F.sum(F.when(~F.col("is_val"), F.col("y"))), F.lit(0.0)).alias("positives"),
    )
    treated = F.col("t") == 1
    n_train = F.when(treated, LEAST_TREATED[0]).otherwise(LEAST_CONTROL[0])
    n_val = F.when(treated, LEAST_TREATED[1]).otherwise(LEAST_CONTROL[1])
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("n_train"))
    return counts.filter((F.col("n_train") >= n_train) & (F.col("n_val") >= n_val) & both).select(CAMPAIGN, "t")


def fit_x_learner(table: DataFrame, iterations: int = 60) -> XLearner:
    """Outcome models per campaign and arm, grown together; then one effect model per arm.

    The number of Spark jobs doesn't depend on the number of campaigns. A row whose campaign has
    no model for the other arm takes that arm's mean outcome over all training rows.
    """
    numeric, categorical = FT.UPLIFT_NUMERIC, FT.UPLIFT_CATEGORICAL
    shares = durable(propensity(table))
    train = table.filter("part = 'train'")
    fills, texts = T.column_medians(train, numeric), {c: "unknown" for c in categorical}
    inputs = Pipeline(stages=T.input_stages(numeric, categorical, linear=False)).fit(T.with_inputs(train, fills, texts))
    rows = inputs.transform(T.with_inputs(_with_holdout(table), fills, texts)).select(
        *IDS, "part", "is_val", "y", "t", "features"
    )
    rows = durable(rows.join(shares, CAMPAIGN, "left").withColumn("w", F.when(F.col("t") == 0, F.coalesce("control_weight", F.lit(1.0))).otherwise(1.0)))

    # Stage 1: an outcome model per campaign and arm, where the arm is large enough.
    means = {r["t"]: r["m"] for r in rows.filter("part = 'train'").groupBy("t").agg(F.avg("y").alias("m")).collect()}
    coded = rows.withColumn("x", vector_to_array("features"))
    fit_rows = coded.join(enough_rows(rows), [CAMPAIGN, "t"], "left_semi").withColumn("arm", _arm(F.col("t")))
    outcomes = boosting.fit(
        fit_rows, "x", "y", boosting.LOGISTIC, rounds=iterations, depth=3, least=5,
        weight="w", validation="is_val", by="arm",
    )

    # Expected outcome of each row under the other arm.
    met = outcomes.score(coded.withColumn("other", _arm(1 - F.col("t"))), "x", "own_mu", by="other")
    mean = F.when(F.col("t") == 1, F.lit(float(means.get(0, 0.5)))).otherwise(F.lit(float(means.get(1, 0.5))))
    gap = F.col("y") - F.coalesce("own_mu", mean)
    pseudo = durable(
        met.withColumn("d", F.when(F.col("t") == 1, gap).otherwise(-gap)).select(*IDS, "t", "is_val", "features", "d")
    )

    # Stage 2: one effect model per arm.
    def fit_effect(arm):
        est = T.boosted_regressor("d", iterations, depth=3, validationIndicatorCol="is_val")
        return est.fit(pseudo.filter(F.col("t") == arm))

    with ThreadPoolExecutor(2) as pool:
        tau1, tau0 = pool.map(fit_effect, (1, 0))
    fitted = [(c, int(a)) for c, a in (m.rsplit("|", 1) for m in outcomes.models)]
    return XLearner(inputs, fills, texts, tau1, tau0, shares, fitted)


def best_campaign(scored: DataFrame) -> DataFrame:
    """Per customer the campaign with the highest effect, ties to the smaller campaign id."""
    best = F.max_by(F.struct(CAMPAIGN, "uplift_ite"), F.struct("uplift_ite", CAMPAIGN))
    return scored.groupBy("customer_id").agg(best.alias("b")).select(
        "customer_id", F.col(f"b.{CAMPAIGN}").alias("top_uplift_campaign"), "b.uplift_ite"
    )
