"""Weekly demand: naive forecasts and models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.functions.columns import refuse_columns
from shelfsense.operators import boosting, ordered, splits
from shelfsense.operators.evaluation import forecast_errors
from shelfsense.operators.joins import with_scalar
from shelfsense.operators.quality import union_all
from shelfsense.plans import features as FT
from shelfsense.plans import training as T


def naive_columns(df: DataFrame, label: str = "units_sold") -> DataFrame:
    """Lag-1, lag-4 and a 70/30 blend; a missing lag falls back to the other one, then to the
    exact median of the training rows (``is_test`` false)."""
    fallback = ordered.quantile_values(df.filter("not is_test"), [label], [0.5]).get(label, [0.0])[0]
    one, four = F.col("lag_1w_units_sold").cast("double"), F.col("lag_4w_units_sold").cast("double")
    last = F.lit(float(fallback))
    df = df.withColumn("naive_lag1", F.coalesce(one, last)).withColumn("naive_lag4", F.coalesce(four, one, last))
    return df.withColumn("naive_blend", 0.7 * F.col("naive_lag1") + 0.3 * F.col("naive_lag4"))


def naive_comparison(scored: DataFrame, columns: dict[str, str], model: str, label: str = "units_sold") -> DataFrame:
    """Errors of each forecast column and the MAE gain of the model over it, in percent."""
    rows = [
        forecast_errors(scored, label, c).select(F.lit(name).alias("forecast"), "n", "mae", "rmse", "smape", "mean_bias")
        for name, c in columns.items()
    ]
    table = union_all(rows)
    best = table.filter(F.col("forecast") == model).select(F.col("mae").alias("model_mae"))
    t = with_scalar(table, best, "model_mae")
    return t.withColumn("mae_gain_pct", F.when(F.col("mae") > 0, (F.col("mae") - F.col("model_mae")) / F.col("mae") * 100))


# --- models ------------------------------------------------------------------------------


def training_table(mart: DataFrame, split_week: str) -> DataFrame:
    """Lag features over whole series, then the split, then means learned on the train side."""
    refuse_columns(FT.FORECAST_NUMERIC + FT.FORECAST_CATEGORICAL, FT.FORECAST_FORBIDDEN)
    rows = splits.at_week(FT.forecast_features(mart), split_week)
    return FT.attach_series_means(rows, rows.filter("not is_test"))


def _train_rows(table: DataFrame) -> DataFrame:
    """Training rows of series with enough weeks; the newest 15% of weeks are for validation."""
    train = FT.drop_short_series(table.filter("not is_test"))
    return splits.by_week_share(train, 0.85, name="is_validation")


def train_medians(table: DataFrame) -> dict[str, float]:
    """Fill values of the models that learn them on all training rows, for fits that share them."""
    return T.column_medians(_train_rows(table), FT.FORECAST_NUMERIC)


def fit_boosted(table: DataFrame, iterations: int = 100, fills: dict[str, float] | None = None) -> T.Fitted:
    est = T.boosted_regressor("units_sold", iterations, validationIndicatorCol="is_validation")
    return T.fit(_train_rows(table), est, FT.FORECAST_NUMERIC, FT.FORECAST_CATEGORICAL, probability=False, fills=fills)


def fit_tweedie(table: DataFrame, fills: dict[str, float] | None = None) -> T.Fitted:
    """Tweedie regression with a log link (variance power 1.5)."""
    est = GeneralizedLinearRegression(
        family="tweedie", variancePower=1.5, linkPower=0.0, labelCol="units_sold", maxIter=50, regParam=0.1
    )
    return T.fit(_train_rows(table), est, FT.FORECAST_NUMERIC, FT.FORECAST_CATEGORICAL, linear=True, probability=False, fills=fills)


@dataclass
class DemandTrees:
    """Boosted trees with their inputs: fill values and category codes learned on training weeks."""

    trees: boosting.Boosted
    inputs: PipelineModel
    fills: dict[str, float]
    texts: dict[str, str]

    def score(self, df: DataFrame, name: str) -> DataFrame:
        rows = _as_array(self.inputs.transform(T.with_inputs(df, self.fills, self.texts)))
        return self.trees.score(rows, "_x", name).select(*[c for c in df.columns if c != name], name)


def _as_array(df: DataFrame) -> DataFrame:
    return df.withColumn("_x", vector_to_array("features"))


def fit_tweedie_trees(table: DataFrame, iterations: int = 100, depth: int = 4, step: float = 0.1, patience: int = 10) -> DemandTrees:
    """Boosted trees on the Tweedie deviance (power 1.5, log link), stopped early on the newest training weeks.

    Categories enter as codes by falling frequency. Forecasts are above zero.
    """
    rows = _train_rows(table)
    train = rows.filter("not is_validation")
    fills, texts = T.column_medians(train, FT.FORECAST_NUMERIC), {c: "unknown" for c in FT.FORECAST_CATEGORICAL}
    stages = T.input_stages(FT.FORECAST_NUMERIC, FT.FORECAST_CATEGORICAL, linear=False)
    inputs = Pipeline(stages=stages).fit(T.with_inputs(train, fills, texts))
    trees = boosting.fit(
        _as_array(inputs.transform(T.with_inputs(rows, fills, texts))), "_x", "units_sold", boosting.tweedie(),
        rounds=iterations, depth=depth, step=step, validation="is_validation", patience=patience,
    )
    return DemandTrees(trees, inputs, fills, texts)


def fit_forest(table: DataFrame, trees: int = 100, fills: dict[str, float] | None = None) -> T.Fitted:
    est = RandomForestRegressor(labelCol="units_sold", numTrees=trees, maxDepth=8, maxBins=64, seed=42)
    return T.fit(_train_rows(table), est, FT.FORECAST_NUMERIC, FT.FORECAST_CATEGORICAL, probability=False, fills=fills)


def score(model: T.Fitted, table: DataFrame, name: str) -> DataFrame:
    """Forecasts of the test rows, never below zero."""
    out = model.score(table.filter("is_test"), name)
    return out.withColumn(name, F.greatest(F.col(name), F.lit(0.0)))
