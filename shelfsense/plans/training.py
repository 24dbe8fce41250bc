"""Shared steps of the model jobs: three-way splits, preprocessing, scoring columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsense.operators import ordered

from shelfsense.operators import splits


def three_way(df: DataFrame, time: str, ids: list[str], test_share: float = 0.2, validation_share: float = 0.15) -> DataFrame:
    """Column ``part``: the newest share tests, the newest share of the rest validates."""
    tested = splits.time_ordered(df, time, ids, test_share)
    rest = splits.time_ordered(tested.filter("not is_test").select(time, *ids), time, ids, validation_share, "_val")
    joined = tested.join(rest.select(*ids, "_val"), ids, "left")
    part = F.when(F.col("is_test"), "test").when(F.col("_val"), "validation").otherwise("train")
    return joined.withColumn("part", part).drop("is_test", "_val")


# --- models ------------------------------------------------------------------------------


@dataclass
class Fitted:
    """A fitted estimator with the fill values learned on its training rows."""

    model: PipelineModel
    fills: dict[str, float]
    texts: dict[str, str]
    numeric: list[str]
    categorical: list[str]
    probability: bool

    def prepare(self, df: DataFrame) -> DataFrame:
        return with_inputs(df, self.fills, self.texts)

    def score(self, df: DataFrame, name: str) -> DataFrame:
        out = self.model.transform(self.prepare(df))
        value = vector_to_array("probability")[1] if self.probability else F.col("prediction")
        return out.withColumn(name, value).select(*[c for c in df.columns if c != name], name)

    def importance(self) -> DataFrame:
        """Share of split gain per input column, highest first."""
        trees = self.model.stages[-1]
        names = self.numeric + self.categorical
        rows = [(n, float(v)) for n, v in zip(names, trees.featureImportances.toArray())]
        spark = SparkSession.getActiveSession()
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def column_medians(train: DataFrame, numeric: list[str]) -> dict[str, float]:
    """Exact interpolated medians; a column without values fills with 0."""
    found = ordered.quantile_values(train, numeric, [0.5])
    return {c: (0.0 if found.get(c, [None])[0] is None else found[c][0]) for c in numeric}


def column_modes(train: DataFrame, categorical: list[str]) -> dict[str, str]:
    """Most frequent level per category column, the smallest name among equals."""
    if not categorical:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical])
    counts = train.select(F.inline(cells)).filter("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
    top = counts.groupBy("c").agg(F.min(F.struct(-F.col("n"), F.col("v"))).alias("m")).select("c", "m.v")
    return {**{c: "unknown" for c in categorical}, **{r["c"]: r["v"] for r in top.collect()}}


def with_inputs(df: DataFrame, fills: dict[str, float], texts: dict[str, str]) -> DataFrame:
    """Model inputs beside the original columns: ``x_<column>`` without NULLs."""
    new = {f"x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in fills.items()}
    new |= {f"x_{c}": F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in texts.items()}
    return df.withColumns(new)


def input_stages(numeric: list[str], categorical: list[str], linear: bool) -> list:
    """Index categories (and for linear models one-hot and scale), then assemble ``features``."""
    stages: list = []
    columns = [f"x_{c}" for c in numeric]
    if linear:
        stages += [
            VectorAssembler(inputCols=columns, outputCol="numbers"),
            StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        ]
        columns = ["scaled"]
    if categorical:
        indexed = [f"i_{c}" for c in categorical]
        stages.append(
            StringIndexer(
                inputCols=[f"x_{c}" for c in categorical],
                outputCols=indexed,
                handleInvalid="keep",
                stringOrderType="frequencyDesc",
            )
        )
        if linear:
            hot = [f"h_{c}" for c in categorical]
            stages.append(OneHotEncoder(inputCols=indexed, outputCols=hot))
            indexed = hot
        columns = columns + indexed
    stages.append(VectorAssembler(inputCols=columns, outputCol="features"))
    return stages


def fit(
    train: DataFrame,
    estimator,
    numeric: list[str],
    categorical: list[str],
    linear: bool = False,
    probability: bool = True,
    fills: dict[str, float] | None = None,
) -> Fitted:
    """Learn fills and the pipeline on the training rows only; ``fills`` are their medians where these are known."""
    fills = column_medians(train, numeric) if fills is None else fills
    texts = column_modes(train, categorical) if linear else {c: "unknown" for c in categorical}
    prepared = with_inputs(train, fills, texts)
    model = Pipeline(stages=[*input_stages(numeric, categorical, linear), estimator]).fit(prepared)
    return Fitted(model, fills, texts, numeric, categorical, probability)


def balanced_weight(train: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weights that give both classes the same total."""
    n = train.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("pos")).first()
    pos = n["pos"] or 0
    up = n["n"] / (2.0 * max(pos, 1))
    down = n["n"] / (2.0 * max(n["n"] - pos, 1))
    return train.withColumn(name, F.when(F.col(label).cast("int") == 1, F.lit(up)).otherwise(F.lit(down)))


def boosted_classifier(label: str, iterations: int = 100, depth: int = 4, seed: int = 42, **more) -> GBTClassifier:
    return GBTClassifier(
        labelCol=label, featuresCol="features", maxIter=iterations, maxDepth=depth, stepSize=0.05, maxBins=64, seed=seed, **more
    )


def boosted_regressor(label: str, iterations: int = 100, depth: int = 4, seed: int = 42, **more) -> GBTRegressor:
    return GBTRegressor(
        labelCol=label, featuresCol="features", maxIter=iterations, maxDepth=depth, stepSize=0.05, maxBins=64, seed=seed, **more
    )
