"""Recommendation jobs against brute force."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from shelfsense.operators import evaluation as E
from shelfsense.plans import factors, recommend as rec


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(7)
    dense = np.where(rng.random((60, 40)) < 0.3, rng.random((60, 40)) + 0.1, 0.0)
    rows = [(f"C{i:02d}", f"P{j:02d}", float(dense[i, j])) for i in range(60) for j in range(40) if dense[i, j] > 0]
    return dense, spark.createDataFrame(rows, "customer_id string, product_id string, score double")


def test_truncated_svd_matches_dense(spark, matrix):
    dense, scores = matrix
    f = factors.truncated_svd(scores, 3, extra=10, rounds=12)
    u, s, vt = np.linalg.svd(dense)
    assert np.allclose(f.values, s[:3], rtol=1e-4)
    users = {r.customer_id: np.array(r.f) for r in f.users.collect()}
    items = {r.product_id: np.array(r.f) for r in f.items.collect()}
    assert len(users) == 60 and len(items) == 40
    best = (u[:, :3] * s[:3]) @ vt[:3]
    got = np.array([[users[f"C{i:02d}"] @ items[f"P{j:02d}"] for j in range(40)] for i in range(60)])
    assert np.abs(got - best).max() < 1e-2


def test_truncated_svd_of_many_blocks_shuffles_no_vectors(spark, matrix, monkeypatch):
    """Blocks of seven rows on either side, rows without an id, and a matrix without cells."""
    dense, scores = matrix
    monkeypatch.setattr(factors, "MATRIX_ROWS", 7)
    f = factors.truncated_svd(scores, 3, extra=10, rounds=12)
    u, s, vt = np.linalg.svd(dense)
    assert np.allclose(f.values, s[:3], rtol=1e-4)
    users = {r.customer_id: np.array(r.f) for r in f.users.collect()}
    items = {r.product_id: np.array(r.f) for r in f.items.collect()}
    got = np.array([[users[f"C{i:02d}"] @ items[f"P{j:02d}"] for j in range(40)] for i in range(60)])
    assert np.abs(got - (u[:, :3] * s[:3]) @ vt[:3]).max() < 1e-2
    # Rows without an id take sums from the other side and give none to it.
    lost = scores.unionByName(spark.createDataFrame([(None, "P00", 0.5), ("C00", None, 0.5)], scores.schema))
    g = factors.truncated_svd(lost, 3)
    assert g.users.filter("customer_id is null").count() == g.items.filter("product_id is null").count() == 1
    top = factors.recommend_all(g, scores, 41, block_items=7).filter("customer_id = 'C00' and product_id is null")
    assert top.count() == 1
    empty = factors.truncated_svd(scores.limit(0), 3)
    assert empty.values == [] and empty.users.count() == empty.items.count() == 0


def _content(spark):
    rng = np.random.default_rng(8)
    rows = []
    for j in range(40):
        feats = [f"cat={j % 4}", f"sub={rng.integers(0, 6)}"] + (["eco"] if j % 3 == 0 else [])
        rows += [(f"P{j:02d}", f, float(1 / np.sqrt(len(feats)))) for f in feats]
    return spark.createDataFrame(rows, "product_id string, feature string, weight double")


@pytest.mark.parametrize("masked", [False, True])
def test_hybrid_top_k_is_exact_for_any_block_size(spark, matrix, masked):
    dense, scores = matrix
    f = factors.truncated_svd(scores, 4)
    content = _content(spark)
    seen = scores.select("customer_id", "product_id")
    profile = rec.content_profile(seen, content)
    one = factors.recommend_all(f, seen, 5, content, profile, 0.7, masked).toPandas()
    many = factors.recommend_all(f, seen, 5, content, profile, 0.7, masked, block_items=7).toPandas()
    key = ["customer_id", "rank"]
    blends = factors.recommend_all(f, seen, 5, content, profile, [0.2, 0.7], masked, block_items=7).toPandas()
    assert blends[blends.alpha == 0.7].sort_values(key)["product_id"].tolist() == one.sort_values(key)["product_id"].tolist()
    if masked:
        own = factors.recommend_user(f, "C17", seen, 5, content, profile, 0.7).toPandas().sort_values("rank")
        assert own["product_id"].tolist() == one[one.customer_id == "C17"].sort_values("rank")["product_id"].tolist()
    assert one.sort_values(key)["product_id"].tolist() == many.sort_values(key)["product_id"].tolist()

    users = {r.customer_id: np.array(r.f) for r in f.users.collect()}
    items = {r.product_id: np.array(r.f) for r in f.items.collect()}
    names = sorted(items)
    c = content.toPandas().pivot_table(index="product_id", columns="feature", values="weight").fillna(0).loc[names].to_numpy()
    cos = c @ c.T
    for i in (0, 17, 59):
        cf = np.array([users[f"C{i:02d}"] @ items[p] for p in names])
        had = dense[i] > 0
        cb = cos[had].mean(axis=0)
        base = cf[~had] if masked else cf
        s = 0.7 * (cf - base.min()) / (base.max() - base.min() + 1e-9) + 0.3 * (cb - cb.min()) / (cb.max() - cb.min() + 1e-9)
        s[had] = -np.inf
        want = [names[j] for j in np.argsort(-s)[:5]]
        got = one[one.customer_id == f"C{i:02d}"].sort_values("rank")
        assert got["product_id"].tolist() == want
        assert not had[[names.index(p) for p in got["product_id"]]].any()


def test_popularity_skips_seen_items_without_a_pool_limit(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"customer_id": rng.integers(0, 12, 300).astype(str), "product_id": rng.integers(0, 30, 300).astype(str), "interaction_score": 1.0})
    heavy = pd.DataFrame({"customer_id": "all", "product_id": [str(i) for i in range(30)], "interaction_score": 1.0})
    almost = pd.DataFrame({"customer_id": "most", "product_id": [str(i) for i in range(28)], "interaction_score": 1.0})
    pdf = pd.concat([pdf, heavy, almost]).drop_duplicates(["customer_id", "product_id"])
    df = spark.createDataFrame(pdf)
    users = df.select("customer_id").unionByName(spark.createDataFrame([("new",)], "customer_id string"))
    got = rec.popularity_recommendations(df, users, 5).toPandas()
    pop = pdf.groupby("product_id")["interaction_score"].sum().reset_index().sort_values(["interaction_score", "product_id"], ascending=[False, True])["product_id"].tolist()
    for u in [*pdf["customer_id"].unique(), "new"]:
        had = set(pdf[pdf.customer_id == u]["product_id"])
        want = [p for p in pop if p not in had][:5]
        assert got[got.customer_id == u].sort_values("rank")["product_id"].tolist() == want


def test_category_popularity_and_cold_start(spark):
    products = spark.createDataFrame([("P1", "a"), ("P2", "a"), ("P3", "b"), ("P4", "b")], "product_id string, category string")
    bought = spark.createDataFrame(
        [("C1", "P1"), ("C2", "P1"), ("C2", "P2"), ("C3", "P3"), ("C4", "P4"), ("C5", "P4")], "customer_id string, product_id string"
    )
    top = rec.category_top(bought, products, 2)
    assert [(r.product_id, r.pop_rank) for r in top.orderBy("category", "pop_rank").collect()] == [("P1", 1), ("P2", 2), ("P4", 1), ("P3", 2)]
    users = spark.createDataFrame([("C1",), ("new",)], "customer_id string")
    out = rec.cold_start(users, bought, products, top, 3).orderBy("customer_id", "rank").collect()
    assert [(r.customer_id, r.product_id) for r in out] == [
        ("C1", "P2"), ("C1", "P4"), ("C1", "P3"), ("new", "P1"), ("new", "P2"), ("new", "P4"),
    ]


def test_hit_rate_and_reciprocal_rank(spark):
    top = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "z", 2)], "u string, i string, rank int")
    truth = spark.createDataFrame([("a", "y"), ("b", "q"), ("c", "x")], "u string, i string")
    got = {r.k: (r.hit_rate, r.mrr) for r in E.hit_rate(top, truth, [1, 2], "u", "i", "rank").collect()}
    assert got[1] == (0.0, 0.0)
    assert got[2] == (pytest.approx(1 / 3), pytest.approx(1 / 6))


def test_similar_items_excludes_itself(spark):
    out = rec.similar_items(_content(spark), "P00", 3).collect()
    assert len(out) == 3 and "P00" not in {r.product_id for r in out}
    assert all(0 < r.cosine <= 1 + 1e-9 for r in out)


def test_users_meet_only_blocks_that_can_matter(spark, monkeypatch):
    """Plain inner products with items of very different norms, small blocks on both sides, against dense scores."""
    monkeypatch.setattr(factors, "BLOCK_USERS", 9)
    rng = np.random.default_rng(19)
    u = rng.normal(size=(50, 4))
    v = rng.normal(size=(60, 4)) * np.exp(-np.arange(60) / 8)[:, None]
    v[40:] = v[39]  # equal scores
    users = spark.createDataFrame([(f"C{i:02d}", [float(x) for x in r]) for i, r in enumerate(u)], "customer_id string, f array<double>")
    items = spark.createDataFrame([(f"P{j:02d}", [float(x) for x in r]) for j, r in enumerate(v)], "product_id string, f array<double>")
    seen = spark.createDataFrame([(f"C{i:02d}", f"P{j:02d}") for i in range(50) for j in range(60) if (i * j) % 7 == 1], "customer_id string, product_id string")
    got = factors.recommend_all(factors.Factors(users, items, []), seen, 6, block_items=8).toPandas()
    for i in range(50):
        score = [(-round(float(u[i] @ v[j]), 9), j) for j in range(60) if (i * j) % 7 != 1]
        want = [f"P{j:02d}" for _, j in sorted(score)[:6]]
        assert got[got.customer_id == f"C{i:02d}"].sort_values("rank")["product_id"].tolist() == want
    assert factors.recommend_all(factors.Factors(users, items.limit(0), []), seen, 6).count() == 0
    # No user is sent to blocks of items, and no item to blocks of users.
    plan = factors.recommend_all(factors.Factors(users, items, []), seen, 6, block_items=8)._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "Generate" not in plan


def test_full_lists_take_few_cells_of_a_block(monkeypatch):
    """Single precision finds the cells to score and the bounds; what is found is that of all cells in double."""
    rng = np.random.default_rng(23)
    n, m, k, size = 40, 900, 5, 100
    u, v = rng.normal(size=(n, 6)), rng.normal(size=(m, 6))
    v = v[np.argsort(-np.linalg.norm(v, axis=1))]
    v[300:310] = v[5]  # equal scores
    entry = pa.list_(pa.struct([("key", pa.string()), ("value", pa.float64())]))
    kinds = [[(f"a={j % 7}", 0.6), (f"b={j % 5}", 0.6), (f"c={j % 4}", 0.5)] for j in range(m)]
    tastes = [[(f"{f}={x}", float(rng.random())) for f, top in (("a", 7), ("b", 5), ("c", 4)) for x in range(top)] for _ in range(n)]
    as_entries = lambda rows: pa.array([[{"key": a, "value": b} for a, b in r] for r in rows], entry)
    seen = [sorted(rng.choice(m, 20, replace=False).tolist()) for _ in range(n)]
    own = factors._Users(pa.table({"customer_id": [f"C{i}" for i in range(n)], "f": pa.array(list(u)), "profile": as_entries(tastes), "seen": seen}), True, k, 3)
    names = [f"P{j:03d}" for j in range(m)]
    blocks = [
        factors._Block(pa.table({"product_id": names[b : b + size], "f": pa.array(list(v[b : b + size])), "content": as_entries(kinds[b : b + size]), "idx": np.arange(b, b + size)}), own, b)
        for b in range(0, m, size)
    ]
    counted = []
    plain = factors._Users.latent_of
    monkeypatch.setattr(factors._Users, "latent_of", lambda self, users, block, items: (counted.append(len(users)), plain(self, users, block, items))[1])
    every, taken = np.arange(n), [[], [], []]
    for block in blocks:
        own.bounds(block, every, False)
    dense = u @ v.T
    np.testing.assert_allclose(own.high, dense.max(axis=1), rtol=1e-12)
    np.testing.assert_allclose(own.low, dense.min(axis=1), rtol=1e-12)
    assert sum(counted) < n * m / 20
    halves = {tuple(r): (r[:2], r[2:]) for r in kinds}
    text = lambda r: str(r)
    own.least[:], own.most[:] = np.inf, -np.inf
    pairs = list(halves.values())
    own.content_bounds(
        factors._Kinds(pa.table({"head": as_entries([a for a, _ in pairs]), "tail": as_entries([b for _, b in pairs]), "head_key": [text(a) for a, _ in pairs], "tail_key": [text(b) for _, b in pairs]}), own.index)
    )
    mixed = np.array([[sum(dict(t).get(f, 0.0) * w for f, w in r) for r in kinds] for t in tastes])
    np.testing.assert_allclose(own.most, mixed.max(axis=1), rtol=1e-12)
    np.testing.assert_allclose(own.least, mixed.min(axis=1), rtol=1e-12)
    shares = [1.0, 0.8, 0.0]
    for block in blocks:
        for s, share in enumerate(shares):
            full = own.score[s, :, k - 1] > -np.inf
            own.score_all(s, block, every[~full], share)
            counted.clear()
            own.score_some(s, block, every[full], share)
            taken[s].append(sum(counted))
    assert sum(taken[0]) < n * m / 20 and sum(taken[1]) < n * m / 20
    for s, share in enumerate(shares):
        low, high, least, most = (x[:, None] for x in (dense.min(axis=1), dense.max(axis=1), mixed.min(axis=1), mixed.max(axis=1)))
        want = np.round(share * (dense - low) / (high - low + 1e-9) + (1 - share) * (mixed - least) / (most - least + 1e-9), 10)
        for i in range(n):
            want[i, seen[i]] = -np.inf
            assert own.item[s, i].tolist() == [f"={names[j]}" for j in np.lexsort((names, -want[i]))[:k]]


def test_scores_of_one_user_leave_out_what_is_seen(spark):
    f = factors.Factors(
        spark.createDataFrame([("a", [1.0, 2.0])], "customer_id string, f array<double>"),
        spark.createDataFrame([("x", [1.0, 1.0]), ("y", [0.0, 1.0])], "product_id string, f array<double>"),
        [],
    )
    seen = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "customer_id string, product_id string")
    assert {(r.product_id, r.score) for r in factors.user_scores(f, "a", seen).collect()} == {("x", None), ("y", 2.0)}
    assert {(r.product_id, r.score) for r in factors.user_scores(factors.prefix(f, 1), "a").collect()} == {("x", 1.0), ("y", 0.0)}
    assert [(r.product_id, r["rank"]) for r in factors.recommend_user(f, "a", seen).collect()] == [("y", 1)]


def test_cold_start_walks_all_categories_of_a_user(spark):
    products = spark.createDataFrame([(f"{c}{i}", c) for c in "abcde" for i in range(3)], "product_id string, category string")
    bought = [("u", f"{c}0") for c in "abcd" for _ in range("dbca".index(c) + 1)] + [("v", f"{c}{i}") for c in "abcde" for i in range(3)]
    bought = spark.createDataFrame(bought, "customer_id string, product_id string")
    top = rec.category_top(bought, products, 2)
    users = spark.createDataFrame([("u",)], "customer_id string")
    lists = {n: [r.product_id for r in rec.cold_start(users, bought, products, top, 5, n).orderBy("rank").collect()] for n in (2, None)}
    assert lists[None] == ["a1", "c1", "b1", "d1", "e0"]
    assert lists[2] == ["a1", "c1", "b1", "d1", "e0"][:2] + ["b1", "d1", "e0"]
