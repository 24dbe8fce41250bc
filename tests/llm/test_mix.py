import math
import random
import re
from collections import Counter, defaultdict

from shelfsense.llm import weighted_mix
from tests.llm.conftest import prose


def shared_out(sizes, share=1.5):
    """Targets by resharing the excess until none is above, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, out, budget = set(order), {}, share * sum(sizes.values())
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            budget -= out[s]
        open_ -= full
    return out


def sample_docs(rng):
    rows = []
    for i in range(400):
        source = rng.choice(["web", "web", "web", "books", "Ärzte", "code", "z", None])
        n = rng.choice([0, 1, 5, 40, 40, 300])
        rows.append((i, prose(rng, n) if n else rng.choice([None, "", " \n"]), source))
    return rows


def test_sources_come_near_their_targets(spark):
    rng = random.Random(1)
    rows = sample_docs(rng)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = weighted_mix.mix(docs, carry=["source", "text"])
    got = {r.doc_id: r for r in found.collect()}
    sizes, taken = Counter(), Counter()
    for i, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert got[i].size == n and 0 <= got[i].taken <= 2 * n
        sizes[source] += n
        taken[source] += got[i].taken
    want = shared_out(sizes)
    partly = Counter()
    for i, _, source in rows:
        assert got[i].source_size == sizes[source] and math.isclose(got[i].target, want[source])
        if got[i].size:
            epochs = want[source] // sizes[source]
            assert got[i].taken >= epochs * got[i].size
            partly[source] += got[i].taken % got[i].size != 0
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes) and max(partly.values()) <= 1
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, weighted_mix.mix(docs.repartition(7), carry=["source", "text"]).collect()), key=str)
    words = defaultdict(list)
    for r in sorted(weighted_mix.texts(found).collect(), key=lambda r: r.epoch):
        words[r.doc_id] += r.text.split()
    for i, text, _ in rows:
        own = (text or "").split()
        assert words[i] == (own * 2)[: got[i].taken]


def test_better_documents_are_taken_more_often(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "'one two three' AS text", "CASE WHEN id < 3000 THEN 'a' ELSE 'b' END AS source")
    labels = spark.range(6000).selectExpr("id AS doc_id", "id % 2 AS quality")
    labels = labels.unionByName(labels.limit(5))  # a document labelled twice
    weights = weighted_mix.quality_weights(labels)
    rows = weighted_mix.mix(docs, weights, share=0.5).filter("doc_id < 3000").collect()
    good, bad = (sum(r.taken for r in rows if r.doc_id % 2 == k) for k in (1, 0))
    # Weights 2 and 0.5, 71 % of the words: the sample without replacement solves 1 - (e^-2t + e^-t/2) / 2 = 5 / 7.
    t = next(t / 1000 for t in range(5000) if 1 - (math.exp(-t / 500) + math.exp(-t / 2000)) / 2 >= 5 / 7)
    assert abs(good / 4500 - (1 - math.exp(-2 * t))) < 0.04 and abs(bad / 4500 - (1 - math.exp(-t / 2))) < 0.04


def test_mix_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    from pyspark.sql import functions as F

    docs = odd_docs.withColumn("source", F.when(F.col("doc_id") > 4, F.lit("s"))).withColumn("size", F.lit(3)).withColumn("target", F.lit("t"))
    rows = weighted_mix.mix(docs).collect()
    assert len(rows) == len(odd_rows) and sum(r.taken for r in rows) > 0
    total = sum(r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.5 * total) <= 2
    assert all(r.taken == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert weighted_mix.mix(no_docs.withColumn("source", F.lit("s"))).count() == 0
    empty = weighted_mix.mix(spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert {(r.size, r.source_size, r.target, r.taken) for r in empty} == {(0, 0, 0.0, 0)}
