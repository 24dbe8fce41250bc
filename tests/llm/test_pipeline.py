import random

import pytest

from tests.llm.conftest import speech

QUERIES_WITH_SQL = ["op1_bag_minhash", "op2_shard_tree", "op5_host_reputation", "op6_spaced_seeds", "op12_weighted_mix", "op13_k2_treap"]


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    bench = speech(rng, 30)
    good = [speech(rng, 120) for _ in range(6)]
    passage = speech(rng, 60)
    texts = [*good, "too short", good[0] + " tail", passage + "\n" + speech(rng, 70), speech(rng, 70) + "\n" + passage, speech(rng, 60) + " " + bench, None]
    words = good[1].split()
    texts.append("\n".join(" ".join(words[i : i + 4]) for i in range(0, len(words), 4)))  # lines too short to be compared
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = docs
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
        left.write.parquet(f"{tmp_path}/stage-{k}")
        left = spark.read.parquet(f"{tmp_path}/stage-{k}")
        kept.append({r.doc_id: r.text for r in left.collect()})
    assert set(kept[0]) == set(range(13)) - {6, 11}
    assert kept[1][8] == texts[8] and kept[1][9] == texts[9].split("\n")[0]
    assert kept[1][7] == ""  # its one line is nearly that of the first document
    assert set(kept[2]) == set(kept[1]) - {12}
    assert set(kept[3]) == set(kept[2]) - {10}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(kept[3])
    last = corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(last) == key(rows)


@pytest.mark.parametrize("name", QUERIES_WITH_SQL)
def test_queries_match_their_sql(spark, name):
    from checks.compare import compare, connect
    from shelfsense.llm.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name]).startswith("ok")
