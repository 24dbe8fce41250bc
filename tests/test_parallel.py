"""Tables scanned many times are dealt evenly; independent jobs run at the same time and build a result once."""

import threading
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression

from checks import models
from checks.registry import Space
from shelfsense.operators import boosting, clusters
from shelfsense.plans import segmentation as SEG
from shelfsense.plans import training as T
from shelfsense.session import durable, durable_scope


def one_file(spark, rows, schema):
    return durable(spark.createDataFrame(rows, schema).coalesce(1))


def test_mixtures_and_kmeans_scan_a_table_of_many_files(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = one_file(spark, [([float(v) for v in r],) for r in rng.normal(size=(120, 2))], "v array<double>")
    files = []
    scan = clusters.summed

    def seen(rows, *more):
        files.append(len(rows.inputFiles()))
        return scan(rows, *more)

    monkeypatch.setattr(clusters, "summed", seen)
    assert SEG.mixture_sweep(df, [2], "v").count() == 1
    assert SEG.k_sweep(df, [2], "v").count() == 1
    assert min(files) > 1


def test_boosting_scans_a_table_of_many_files(spark, monkeypatch):
    df = one_file(spark, [([float(i)], float(i % 7 > 2)) for i in range(200)], "x array<double>, y double")
    files = []
    split = boosting._best_splits

    def seen(cells, *more):
        files.append(len(cells.inputFiles()))
        return split(cells, *more)

    monkeypatch.setattr(boosting, "_best_splits", seen)
    boosting.fit(df, "x", "y", boosting.SQUARED, rounds=2, depth=1)
    assert min(files) > 1


def test_nearest_centres_are_those_of_plain_distances():
    rng = np.random.default_rng(5)
    # Far from the origin, with equal rows, equal centres and rows halfway between two centres.
    x = np.concatenate([rng.integers(0, 4, size=(400, 3)) + 1e4, rng.normal(size=(50, 3))])
    sets = [x[:1].copy(), np.array([x[0], x[0], x[1]]), x[rng.integers(len(x), size=9)], rng.normal(size=(5, 3)) * 1e4]
    for got, centres in zip(clusters._nearest(x, sets), sets):
        squares = sum((x[:, j, None] - centres[None, :, j]) ** 2 for j in range(3))
        assert (got == squares.argmin(axis=1)).all()


def test_vectors_of_unequal_length_are_refused(spark):
    df = one_file(spark, [([1.0, 2.0],), ([1.0],), ([1.0, 2.0, 3.0],)], "v array<double>")
    with pytest.raises(Exception, match="one length"):
        clusters.summed(df, "v", 2, lambda x: x.sum(axis=0))


def test_signals_of_the_360_are_computed_at_the_same_time(monkeypatch):
    # Each waits until all four have begun.
    meet = threading.Barrier(4)
    for name in ("calibrated", "best_campaigns", "recommendation_lists"):
        monkeypatch.setattr(models, name, lambda x, name=name: (meet.wait(20), name)[1])
    monkeypatch.setattr(models, "segments", lambda x: "segments")
    monkeypatch.setattr(models.SEG, "profile_segments", lambda rows: (meet.wait(20), "profile")[1])
    monkeypatch.setattr(models.customer360, "master", lambda *parts: parts)
    x = SimpleNamespace(stored=lambda name, build: build(), mart=lambda name: name)
    assert models.master(x) == ("customer_features", "calibrated", "segments", "profile", "best_campaigns", "recommendation_lists")


def test_a_result_asked_for_twice_at_once_is_built_once(spark, tmp_path):
    x, built = Space(spark, str(tmp_path)), []

    def build():
        built.append(1)
        time.sleep(0.5)
        return spark.range(3)

    one, two = models.at_once(lambda: x.stored("at_once", build), lambda: x.stored("at_once", build))
    assert one.count() == two.count() == 3 and len(built) == 1


def test_a_scope_leaves_tables_of_other_threads(spark):
    with durable_scope(spark):
        mine = durable(spark.range(4))
        (other,) = models.at_once(lambda: durable(spark.range(5)))
        assert mine.count() == 4
    assert other.count() == 5


def test_known_medians_are_not_computed_again(spark, monkeypatch):
    df = spark.createDataFrame([(float(i), None if i % 5 == 0 else float(i % 3), i % 2) for i in range(60)], "a double, b double, y int")
    plain = T.fit(df, LogisticRegression(labelCol="y", maxIter=5), ["a", "b"], [])
    fills = T.column_medians(df, ["a", "b"])
    monkeypatch.setattr(T, "column_medians", lambda *a: pytest.fail("computed again"))
    shared = T.fit(df, LogisticRegression(labelCol="y", maxIter=5), ["a", "b"], [], fills=fills)
    rows = [sorted((r["a"], r["p"]) for r in m.score(df, "p").collect()) for m in (plain, shared)]
    assert shared.fills == plain.fills and np.allclose(*rows)
