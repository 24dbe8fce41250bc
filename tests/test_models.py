"""Model jobs: exact where they can be, sane and deterministic otherwise."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfsense.functions import outliers as O
from shelfsense.operators import clusters as CL
from shelfsense.operators import neighbours as NB
from shelfsense.plans import features as FT
from shelfsense.plans import returns as RET
from shelfsense.plans import segmentation as SEG
from shelfsense.plans import training as T
from shelfsense.plans import uplift as UP
from shelfsense.session import durable


def _lof(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :k]
    kd = np.take_along_axis(d, near, axis=1)[:, -1]
    reach = np.maximum(np.take_along_axis(d, near, axis=1), kd[near])
    lrd = 1 / (reach.mean(axis=1) + 1e-10)
    return lrd[near].mean(axis=1) / lrd


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0, 1, (180, 3)), rng.normal(0, 1, (6, 3)) + 9])
    rows = [(f"r{i:03d}", int(i >= 180), [float(v) for v in x[i]]) for i in range(len(x))]
    return x, spark.createDataFrame(rows, "return_id string, is_abuse int, v array<double>")


def test_local_outlier_factor_is_exact(cloud):
    x, df = cloud
    got = RET.local_outlier_scores(df, ["return_id"], 10).toPandas().sort_values("return_id")
    assert np.allclose(got["lof_score"], _lof(x, 10)) and got["lof_flag"].sum() == 2


@pytest.mark.parametrize("cell, block", [(1000, 4000), (15, 7), (3, 2)])
def test_neighbours_equal_brute_force(spark, monkeypatch, cell, block):
    """Ties, repeated points, far clusters; cells and blocks of any size."""
    monkeypatch.setattr(NB, "CELL_POINTS", cell)
    monkeypatch.setattr(NB, "BLOCK_POINTS", block)
    rng = np.random.default_rng(17)
    x = np.vstack([rng.integers(0, 5, (120, 2)), rng.normal(0, 1, (60, 2)) + 50, np.full((40, 2), 7.0)]).astype(float)
    names = [f"p{i:03d}" for i in rng.permutation(len(x))]
    df = spark.createDataFrame([(n, [float(v) for v in r]) for n, r in zip(names, x)], "id string, v array<double>").repartition(4)
    points = durable(NB.distinct_points(df, F.col("id")))
    got = {r["name"]: [(e["d"], e["name"], e["n"]) for e in r["near"]] for r in NB.nearest(points, 12).collect()}
    groups = {}
    for n, r in zip(names, x):
        groups.setdefault(tuple(r), []).append(n)
    least = {r: min(g) for r, g in groups.items()}
    assert set(got) == set(least.values())
    for r, name in least.items():
        others = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(r, s)))), least[s], len(g) - (s == r)) for s, g in groups.items())
        want, left = [], 12
        for d, other, n in others:
            if n and left:
                want.append((d, other, min(n, left)))
                left -= min(n, left)
        assert [(pytest.approx(d), o, n) for d, o, n in want] == got[name]


def test_points_are_not_sent_to_cells(spark, monkeypatch):
    """Evenly spread points, of which many cells are near: each is compared where it is, with all cells' points."""
    monkeypatch.setattr(NB, "CELL_POINTS", 4)
    met, write = [], NB.write_blocks
    monkeypatch.setattr(NB, "write_blocks", lambda df, *by: met.append(df.count()) or write(df, *by))
    x = np.random.default_rng(23).random((80, 6))
    df = spark.createDataFrame([(f"q{i:02d}", [float(v) for v in r]) for i, r in enumerate(x)], "return_id string, v array<double>")
    got = RET.local_outlier_scores(df, ["return_id"], 5).toPandas().sort_values("return_id")
    assert np.allclose(got["lof_score"], _lof(x, 5)) and met == [80]


def test_outlier_factors_of_small_tables(spark):
    one = spark.createDataFrame([("a", [1.0, 2.0])], "id string, v array<double>")
    assert [r.lof_score for r in RET.local_outlier_scores(one, ["id"]).collect()] == [1.0]
    assert RET.local_outlier_scores(one.limit(0), ["id"]).count() == 0
    same = spark.createDataFrame([(str(i), [1.0]) for i in range(50)], "id string, v array<double>")
    rows = RET.local_outlier_scores(same, ["id"]).collect()
    assert len(rows) == 50 and {round(r.lof_score, 6) for r in rows} == {1.0}


def test_scores_do_not_depend_on_the_chunking(cloud):
    _, df = cloud
    one, many = (RET.isolation_scores(d, ["return_id"], trees=20).toPandas().set_index("return_id") for d in (df.coalesce(1), df.repartition(7)))
    assert np.allclose(one["iso_score"], many["iso_score"].loc[one.index])


def test_isolation_forest_ranks_the_far_cluster_first(cloud):
    _, df = cloud
    got = RET.isolation_scores(df, ["return_id"], trees=60, rate=0.05).toPandas()
    assert got["iso_score"].between(0, 1).all() and len(got) == 186
    assert got.groupby("is_abuse")["iso_score"].mean().diff().iloc[-1] > 0.1
    again = RET.isolation_scores(df, ["return_id"], trees=60, rate=0.05).toPandas()
    a, b = (f.sort_values("return_id")["iso_score"].to_numpy() for f in (got, again))
    assert np.allclose(a, b)


def test_average_depth_of_small_trees():
    assert O.average_depth(1) == 0 and O.average_depth(2) == 1
    assert O.average_depth(256) == pytest.approx(10.244, abs=0.01)


def test_components_needed():
    assert SEG.components_needed([0.9, 0.1]) == 2
    assert SEG.components_needed([0.3, 0.3, 0.2, 0.2]) == 3
    assert SEG.components_needed([0.05] * 20) == 13


def _segment_mart(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(70):
        buyer = i < 60
        level = (1, 5, 20)[i % 3]
        row = {c: (float(level * (1 + 0.1 * rng.random())) if buyer else None) for c in FT.SEGMENT_PURCHASE}
        row |= {c: float(rng.integers(1, 9)) for c in FT.SEGMENT_SESSION}
        row |= {"recency_days": float(rng.integers(1, 100)) if buyer else None, "tenure_days": 300.0, "churn_flag_90d": i % 2}
        rows.append({"customer_id": f"C{i}", **row})
    schema = ", ".join(["customer_id string", *[f"{c} double" for c in rows[0] if c not in ("customer_id", "churn_flag_90d")], "churn_flag_90d int"])
    order = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in order) for r in rows], schema)


def test_non_buyers_get_their_own_label(spark):
    seg = SEG.nested_segments(_segment_mart(spark), 3, starts=2)
    out = seg.select("customer_id", "is_non_purchaser", "cluster_id", "segment_name", "total_net_revenue").toPandas()
    assert (out[out.is_non_purchaser == 1]["cluster_id"] == 3).all() and len(out) == 70
    means = out[out.is_non_purchaser == 0].groupby("cluster_id")["total_net_revenue"].mean()
    assert means.sort_index().is_monotonic_decreasing and set(means.index) == {0, 1, 2}
    profile = SEG.profile_segments(seg).toPandas()
    assert profile["n"].sum() == 70 and profile["pct_of_total"].sum() == pytest.approx(1.0)


def test_cluster_quality_against_formula(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(13)
    x = np.vstack([rng.normal(0, 1, (40, 2)), rng.normal(6, 1, (30, 2))])
    lab = np.r_[np.zeros(40, int), np.ones(30, int)]
    df = spark.createDataFrame([([float(v) for v in a], int(l)) for a, l in zip(x, lab)], "a array<double>, l int")
    r = SEG.cluster_quality(df.withColumn("v", array_to_vector("a")), "v", "l").first()
    c = [x[lab == i].mean(axis=0) for i in (0, 1)]
    s = [np.linalg.norm(x[lab == i] - c[i], axis=1).mean() for i in (0, 1)]
    assert r.davies_bouldin == pytest.approx((s[0] + s[1]) / np.linalg.norm(c[0] - c[1]))
    within = sum(((x[lab == i] - c[i]) ** 2).sum() for i in (0, 1))
    between = sum((lab == i).sum() * ((c[i] - x.mean(axis=0)) ** 2).sum() for i in (0, 1))
    assert r.calinski_harabasz == pytest.approx(between / (within / 68))


def _blobs(spark, seed=18):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, 0.6, (70, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    return x, spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>").repartition(5)


def test_starts_and_sizes_share_scans_and_reach_a_fixed_point(spark):
    x, df = _blobs(spark)
    fits = CL.fit_kmeans(df, "v", [2, 3, 4], range(6))
    assert [(f.k, f.seed) for f in fits] == [(k, s) for k in (2, 3, 4) for s in range(6)]
    for f in fits:
        d = ((x[:, None, :] - f.centres[None]) ** 2).sum(axis=2)
        assert f.cost == pytest.approx(d.min(axis=1).sum())
        label = d.argmin(axis=1)
        assert np.allclose(f.centres, [x[label == j].mean(axis=0) if (label == j).any() else f.centres[j] for j in range(f.k)], atol=1e-3)
    best = min((f for f in fits if f.k == 3), key=lambda f: f.cost)
    assert {tuple(np.round(c / 6).astype(int)) for c in best.centres} == {(0, 0), (1, 0), (0, 1)}
    rows = best.transform(df, "v").collect()
    assert all(r.raw_label == ((np.array(r.v) - best.centres) ** 2).sum(axis=1).argmin() for r in rows)
    # Squared-distance silhouettes against the formula over all pairs.
    pair = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    for f, got in zip(fits[::5], CL.silhouettes(df, "v", fits)[::5]):
        label = ((x[:, None, :] - f.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        want = []
        for i in range(len(x)):
            own = label == label[i]
            a = pair[i, own].sum() / max(own.sum() - 1, 1)
            b = min(pair[i, label == j].mean() for j in set(label) - {label[i]})
            want.append((b - a) / max(a, b) if own.sum() > 1 else 0.0)
        assert got == pytest.approx(np.mean(want))


def test_mixtures_have_diagonal_covariance_and_improve(spark):
    x, df = _blobs(spark)
    fits = CL.fit_mixtures(df, "v", [1, 2, 3, 5])
    one = fits[0]
    assert np.allclose(one.means, x.mean(axis=0)[None]) and np.allclose(one.variances, x.var(axis=0)[None], atol=1e-4)
    for f in fits:
        logs = f.log_densities(x)
        assert f.log_likelihood == pytest.approx(np.logaddexp.reduce(logs, axis=1).sum()) and f.rows == len(x)
        assert f.bic == pytest.approx((4 * f.k + f.k - 1) * np.log(len(x)) - 2 * f.log_likelihood)
    assert min(fits, key=lambda f: f.bic).k == 3
    more = CL.expectation_maximisation(df, "v", [fits[1]], iterations=1, tolerance=0.0)[0]
    assert more.log_likelihood >= fits[1].log_likelihood - 1e-6


def _uplift_rows(spark, n=400):
    rng = np.random.default_rng(14)
    rows = []
    for i in range(n):
        t = bool(rng.random() < 0.6)
        orders = int(rng.integers(0, 5))
        y = int(rng.random() < 0.2 + 0.15 * t + 0.05 * orders)
        rows.append((f"CMP{1 + i % 2}", f"C{i:03d}", dt.datetime(2025, 1, 1) + dt.timedelta(hours=i), t, y, orders, orders * 20.0))
    df = spark.createDataFrame(
        rows,
        "campaign_id string, customer_id string, assignment_datetime timestamp_ntz, treatment_flag boolean,"
        " response_flag_30d int, pre_90d_orders int, pre_90d_revenue double",
    )
    missing = [c for c in dict.fromkeys(FT.UPLIFT_NUMERIC) if c not in df.columns]
    texts = [c for c in FT.UPLIFT_CATEGORICAL if c not in df.columns]
    df = df.withColumns({c: F.lit(1.0) for c in missing}).withColumns({c: F.lit("x") for c in texts})
    return T.three_way(df, "assignment_datetime", UP.IDS).withColumns(
        {"y": F.col("response_flag_30d").cast("double"), "t": F.col("treatment_flag").cast("int")}
    )


def test_x_learner_scores_every_row_and_unseen_campaigns(spark):
    table = _uplift_rows(spark)
    model = UP.fit_x_learner(table, iterations=3)
    unseen = table.limit(5).withColumn("campaign_id", F.lit("NEW"))
    out = model.score(table.unionByName(unseen)).toPandas()
    assert len(out) == 405 and np.isfinite(out["uplift_ite"]).all()
    shares = model.shares.toPandas()
    assert shares["propensity"].between(0, 1).all() and (shares["control_weight"] <= UP.WEIGHT_CAP).all()
    assert len(model.importance()) == len(FT.UPLIFT_NUMERIC) + len(FT.UPLIFT_CATEGORICAL)
    best = UP.best_campaign(model.score(table)).toPandas()
    assert best["customer_id"].is_unique


def test_outcome_models_need_enough_rows_of_both_outcomes(spark):
    def arm(c, t, n_train, n_val, positives):
        rows = [(c, t, False, float(i < positives)) for i in range(n_train)]
        return rows + [(c, t, True, 0.0) for _ in range(n_val)]

    rows = arm("a", 1, 20, 5, 3) + arm("a", 0, 10, 3, 9) + arm("b", 1, 19, 9, 3) + arm("b", 0, 10, 2, 3)
    rows += arm("c", 1, 30, 9, 0) + arm("c", 0, 30, 9, 30)
    df = spark.createDataFrame(rows, "campaign_id string, t int, is_val boolean, y double")
    assert sorted(tuple(r) for r in UP.enough_rows(df).collect()) == [("a", 0), ("a", 1)]


def test_fills_come_from_the_training_rows(spark):
    train = spark.createDataFrame(pd.DataFrame({"a": [1.0, 3.0, 100.0], "b": ["x", "x", "y"]}))
    assert T.column_medians(train, ["a"]) == {"a": 3.0}
    assert T.column_medians(train.limit(2), ["a"]) == {"a": 2.0}
    assert T.column_modes(train, ["b"]) == {"b": "x"}
    other = spark.createDataFrame([(None, None)], "a double, b string")
    r = T.with_inputs(other, {"a": 3.0}, {"b": "x"}).first()
    assert (r.x_a, r.x_b, r.a, r.b) == (3.0, "x", None, None)
