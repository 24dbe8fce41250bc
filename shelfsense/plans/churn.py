"""Churn: training table, models, calibration and paired comparison."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.functions.columns import refuse_columns
from shelfsense.plans import features as FT
from shelfsense.plans import training as T

LABEL = "churn_flag_90d"


def training_table(mart: DataFrame, maturity_days: int = 90) -> DataFrame:
    """Active, mature customers with features and their part: train, validation or test."""
    refuse_columns(FT.CHURN_NUMERIC + FT.CHURN_CATEGORICAL, FT.CHURN_FORBIDDEN)
    rows = FT.churn_features(FT.mature_cohort(FT.active_customers(mart), maturity_days))
    return T.three_way(rows, "signup_date", ["customer_id"])


def train_medians(table: DataFrame) -> dict[str, float]:
    """Fill values of the models below, for fits that share them."""
    return T.column_medians(table.filter("part <> 'test'"), FT.CHURN_NUMERIC)


def fit_boosted(table: DataFrame, iterations: int = 100, fills: dict[str, float] | None = None) -> T.Fitted:
    """Boosted trees that stop early on the validation slice."""
    rows = table.filter("part <> 'test'").withColumn("is_validation", F.col("part") == "validation")
    return T.fit(
        rows,
        T.boosted_classifier(LABEL, iterations, validationIndicatorCol="is_validation"),
        FT.CHURN_NUMERIC,
        FT.CHURN_CATEGORICAL,
        fills=fills,
    )


def fit_logistic(table: DataFrame, fills: dict[str, float] | None = None) -> T.Fitted:
    rows = T.balanced_weight(table.filter("part <> 'test'"), LABEL)
    lr = LogisticRegression(labelCol=LABEL, weightCol="weight", maxIter=100, regParam=1e-3)
    return T.fit(rows, lr, FT.CHURN_NUMERIC, FT.CHURN_CATEGORICAL, linear=True, fills=fills)


def fit_forest(table: DataFrame, trees: int = 100, fills: dict[str, float] | None = None) -> T.Fitted:
    rows = T.balanced_weight(table.filter("part <> 'test'"), LABEL)
    rf = RandomForestClassifier(labelCol=LABEL, weightCol="weight", numTrees=trees, maxDepth=8, maxBins=64, seed=42)
    return T.fit(rows, rf, FT.CHURN_NUMERIC, FT.CHURN_CATEGORICAL, fills=fills)


def calibrate(scored: DataFrame, score: str, label: str = LABEL) -> IsotonicRegressionModel:
    """Isotonic fit of outcome on score; outside the seen range the ends stay flat."""
    rows = scored.select(F.col(score).cast("double").alias(score), F.col(label).cast("double").alias(label))
    return IsotonicRegression(featuresCol=score, labelCol=label).fit(rows)


def apply_calibration(model: IsotonicRegressionModel, df: DataFrame, score: str, name: str) -> DataFrame:
    out = model.transform(df)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
    return out.withColumn(name, p).drop("prediction")


def calibrated_probabilities(mart: DataFrame, iterations: int = 100) -> DataFrame:
    """Calibrated churn probability of every active, mature customer.

    The oldest rows train, the next validate, the newest training rows calibrate.
    """
    table = training_table(mart)
    old = T.three_way(table.filter("part <> 'test'").drop("part"), "signup_date", ["customer_id"], 0.2, 0.15)
    # Here the "test" part of the old rows is the calibration slice.
    model = fit_boosted(old, iterations)
    curve = calibrate(model.score(old.filter("part = 'test'"), "raw"), "raw")
    everyone = model.score(table, "raw")
    return apply_calibration(curve, everyone, "raw", "churn_prob").select(
        "customer_id", F.round("churn_prob", 4).alias("churn_prob"), "raw", LABEL, "part"
    )
