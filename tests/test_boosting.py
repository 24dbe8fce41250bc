"""Histogram boosting against a plain numpy form, and on planted tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfsense.operators import boosting as B


def _plain_tree(codes, g, h, depth, bins, least, shrink, step):
    """Exhaustive search of the same tree; returns the value of each row."""
    out = np.zeros(len(g))

    def grow(rows, level, value):
        if level < depth:
            G, H = g[rows].sum(), h[rows].sum()
            found = None
            for f in range(codes.shape[1]):
                for cut in range(bins - 1):
                    left = rows[codes[rows, f] <= cut]
                    if len(left) < least or len(rows) - len(left) < least:
                        continue
                    a, b = g[left].sum(), h[left].sum()
                    gain = a * a / (b + shrink) + (G - a) ** 2 / (H - b + shrink) - G * G / (H + shrink)
                    if gain > 1e-9 and (found is None or gain > found[0]):
                        found = (gain, f, cut, a, b)
            if found:
                _, f, cut, a, b = found
                is_left = codes[rows, f] <= cut
                grow(rows[is_left], level + 1, -step * a / (b + shrink))
                grow(rows[~is_left], level + 1, -step * (G - a) / (H - b + shrink))
                return
        out[rows] = value

    grow(np.arange(len(g)), 0, 0.0)
    return out


@pytest.mark.parametrize("loss", [B.SQUARED, B.LOGISTIC, B.tweedie()])
def test_trees_equal_exhaustive_search(spark, loss):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 9, 240), rng.integers(0, 5, 240)]).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 2)).astype(float) * rng.integers(0, 2, 240) + (x[:, 0] == 8)
    y = np.minimum(y, 1.0)
    df = spark.createDataFrame(pd.DataFrame({"x": x.tolist(), "y": y})).repartition(5)
    model = B.fit(df, "x", "y", loss, rounds=3, depth=2, step=0.3, bins=16, least=10)
    rows = model.score(df, "x", "p").select("x", "p").collect()
    codes = B.digitize(x, model.edges)
    margin = np.full(len(y), loss.start(y.mean()))
    for _ in range(3):
        g, h = loss.slopes(y, margin)
        g, h = np.rint(g * B.UNIT) / B.UNIT, np.rint(h * B.UNIT) / B.UNIT
        margin = margin + _plain_tree(codes, g, h, 2, 16, 10, 1.0, 0.3)
    want = {tuple(k): v for k, v in zip(x, loss.mean(margin))}
    assert [r.p for r in rows] == pytest.approx([want[tuple(r.x)] for r in rows])


def test_tweedie_trees_beat_the_mean_on_a_non_linear_table(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (1500, 2))
    mu = np.where(x[:, 0] * x[:, 1] > 0, 6.0, 0.6)  # no linear form sees this
    y = rng.poisson(mu).astype(float)
    pdf = pd.DataFrame({"x": x.tolist(), "y": y, "v": np.arange(1500) % 5 == 0})
    df = spark.createDataFrame(pdf)
    model = B.fit(df, "x", "y", B.tweedie(), rounds=25, depth=3, step=0.3, validation="v", patience=5)
    got = np.array([r.p for r in model.score(df.filter("v"), "x", "p").collect()])
    held = pdf["v"].to_numpy()

    def deviance(p):
        return 2 * np.mean(y[held] ** 0.5 / -0.25 - y[held] * p**-0.5 / -0.5 + p**0.5 / 0.5)

    assert (got > 0).all()
    assert deviance(got) - deviance(mu[held]) < 0.15 * (deviance(np.full(held.sum(), y[~held].mean())) - deviance(mu[held]))


def test_models_grown_together_equal_models_grown_alone(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"x": rng.integers(0, 6, (300, 2)).astype(float).tolist(), "c": rng.choice(["a", "b", "b"], 300)})
    pdf["y"] = [float((v[0] > 2) == (c == "a")) for v, c in zip(pdf["x"], pdf["c"])]
    # Every model sees the same cut points: all values of either feature occur in both groups.
    df = spark.createDataFrame(pdf)
    both = B.fit(df, "x", "y", B.LOGISTIC, rounds=4, depth=2, bins=32, least=5, by="c")
    assert both.models == ["a", "b"]
    for c in "ab":
        own = df.filter(F.col("c") == c)
        alone = B.fit(own, "x", "y", B.LOGISTIC, rounds=4, depth=2, bins=32, least=5)
        scored = both.score(own, "x", "p", by="c")
        pairs = alone.score(scored, "x", "q").select("p", "q").collect()
        assert [r.p for r in pairs] == pytest.approx([r.q for r in pairs])
    unseen = df.limit(3).withColumn("c", F.lit("z"))
    assert [r.p for r in both.score(unseen, "x", "p", by="c").collect()] == [None] * 3


def test_odd_rows_and_empty_tables(spark):
    schema = "x array<double>, y double, v boolean"
    empty = spark.createDataFrame([], schema)
    model = B.fit(empty, "x", "y", B.SQUARED, rounds=2)
    assert model.trees == [] and model.score(empty, "x", "p").count() == 0
    rows = [([None, float("nan")], 1.0, None)] * 30 + [([1.0, 2.0], 3.0, None)] * 30 + [(None, 9.0, False), ([1.0, 1.0], None, False)]
    df = spark.createDataFrame(rows, schema)
    model = B.fit(df, "x", "y", B.SQUARED, rounds=40, depth=1, step=0.5, least=5, shrink=0.0, validation="v")
    ask = spark.createDataFrame([([1.0, 2.0], 0.0, None), (None, 0.0, None)], schema)
    got = [r.p for r in model.score(ask, "x", "p").collect()]
    assert got[0] == pytest.approx(3.0, abs=1e-3) and got[1] is None
    flat = B.fit(df.filter("y = 1"), "x", "y", B.SQUARED, rounds=3)
    assert flat.trees == []
