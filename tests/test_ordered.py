"""Chunked ranks, frames and quantiles against pandas, with hot keys and tiny chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfsense.operators import ordered


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    key = np.where(rng.random(400) < 0.5, "hot", np.char.add("k", rng.integers(0, 40, 400).astype(str)))
    return pd.DataFrame({"key": key, "t": rng.integers(0, 60, 400), "id": np.arange(400), "v": rng.integers(0, 2, 400)})


def test_positions_match_grouped_counts(spark, rows):
    got = ordered.positions(spark.createDataFrame(rows), ["key"], ["t", "id"], sums={"v": "v"}, chunks=9).toPandas()
    exp = rows.sort_values(["key", "t", "id"]).copy()
    g = exp.groupby("key")
    exp["rows_before"] = g.cumcount()
    exp["v_before"] = g["v"].cumsum() - exp["v"]
    exp["rows_total"] = g["id"].transform("count")
    exp["v_total"] = g["v"].transform("sum")
    got, exp = got.sort_values("id").reset_index(drop=True), exp.sort_values("id").reset_index(drop=True)
    for c in ("rows_before", "v_before", "rows_total", "v_total"):
        assert got[c].tolist() == exp[c].tolist()


def test_positions_over_the_whole_table(spark, rows):
    got = ordered.positions(spark.createDataFrame(rows), [], [F.col("t").desc(), F.col("id")], chunks=7).toPandas()
    exp = rows.sort_values(["t", "id"], ascending=[False, True]).reset_index(drop=True)
    assert got.sort_values("rows_before")["id"].tolist() == exp["id"].tolist()
    assert (got["rows_total"] == 400).all()


@pytest.mark.parametrize("chunks", [1, 5, 60])
@pytest.mark.parametrize("reach", [1, 4, 30])
def test_halo_frames_are_exact_even_with_chunks_shorter_than_the_frame(spark, rows, chunks, reach):
    df = ordered.with_halo(spark.createDataFrame(rows), ["key"], ["t", "id"], reach, chunks=chunks)
    w = ordered.frame_window(["key"]).rowsBetween(-reach, -1)
    got = ordered.drop_halo(df.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)))).toPandas()
    exp = rows.sort_values(["key", "t", "id"]).copy()
    exp["s"] = exp.groupby("key")["v"].transform(lambda s: s.shift(1).rolling(reach, min_periods=1).sum()).fillna(0)
    assert len(got) == len(rows)
    assert got.sort_values("id")["s"].tolist() == exp.sort_values("id")["s"].astype(int).tolist()


def test_dense_rank_with_ties_and_null_keys(spark):
    pdf = pd.DataFrame({"k": ["a", "a", "a", None, None, "a"], "x": [3.0, 3.0, 1.0, 5.0, 7.0, 0.0], "id": range(6)})
    got = ordered.dense_rank(spark.createDataFrame(pdf), ["k"], "x", "r").orderBy("id").toPandas()
    assert got["r"].tolist() == [1, 1, 2, 2, 1, 3]


def test_dense_rank_settles_only_what_it_ranks(spark):
    pdf = pd.DataFrame({"k": ["a", "a", "b"], "x": [1.0, 2.0, 5.0], "id": range(3), "wide": ["p", "q", "r"]})
    got = ordered.dense_rank(spark.createDataFrame(pdf), ["k"], "x", "r", ids=["id"])
    assert got.columns == ["id", "k", "x", "r"]
    assert [r.r for r in got.orderBy("id").collect()] == [2, 1, 1]


@pytest.mark.parametrize("n,k", [(3, 10), (25, 10), (100, 7)])
def test_tile_and_rank_bin(spark, n, k):
    df = spark.range(n).withColumn("total", F.lit(n).cast("long"))
    got = df.select(
        "id", ordered.tile(F.col("id"), F.col("total"), k).alias("t"), ordered.rank_bin(F.col("id"), F.col("total"), k).alias("b")
    ).orderBy("id").toPandas()
    size, extra = divmod(n, k)
    tiles = [i + 1 for i in range(k) for _ in range(size + (i < extra))]
    assert got["t"].tolist() == tiles
    assert got["b"].tolist() == (pd.qcut(np.arange(n), k, labels=False) + 1).tolist()


def test_quantiles_interpolate_like_numpy(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 301), "x": rng.normal(size=301).round(2), "y": np.where(rng.random(301) < 0.3, np.nan, 1.0)})
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    probs = [0.0, 0.1, 0.5, 0.93, 1.0]
    values = ordered.quantile_values(df, ["x", "y"], probs)
    assert np.allclose(values["x"], np.quantile(pdf["x"], probs))
    assert values["y"] == [1.0] * 5
    grouped = ordered.quantiles(df, ["x"], [0.25], ["g"]).toPandas().set_index("g")["q0"]
    assert np.allclose(grouped.sort_index(), pdf.groupby("g")["x"].quantile(0.25))


def test_quantiles_of_a_table_with_one_dominant_value(spark):
    pdf = pd.DataFrame({"x": [0.0] * 500 + list(np.linspace(1, 2, 77))})
    probs = [0.1, 0.5, 0.86, 0.9, 0.999]
    got = ordered.quantile_values(spark.createDataFrame(pdf), ["x"], probs)["x"]
    assert np.allclose(got, np.quantile(pdf["x"], probs))
