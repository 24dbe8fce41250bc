import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from shelfsense.llm import k2_treap
from tests.llm.conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(FOLD) for t in TERM.findall(text or "")]


def brute_force(docs, items, top=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_all, l_all = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 75 + (25 * bag.total() * n_all) // max(l_all, 1)
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_terms_of_whole_texts():
    texts = ["Ab1-c_d\x7f é£À A", None, "", "  ", "x\x00y東京z", "tail "]
    column = pa.array(["cut", *texts])[1:]  # an offset in the buffers
    doc, code, known = k2_treap.terms_of(column)
    assert [known[c].as_py() for c in code.tolist()] == [t for x in texts for t in terms(x)]
    assert doc.tolist() == [i for i, x in enumerate(texts) for _ in terms(x)]
    assert k2_treap.count_terms(column).tolist() == [len(terms(x)) for x in texts]


def test_treap_holds_every_cell():
    rng = np.random.default_rng(3)
    for n_rows, n_columns in ((1, 1), (5, 300), (700, 9), (300, 256)):
        levels = max(1, (n_columns - 1).bit_length())
        cells = np.unique(np.concatenate([rng.integers(0, n_rows * n_columns, 2000), np.arange(n_rows) * n_columns]))
        rows, columns, impacts = cells // n_columns, cells % n_columns, rng.integers(1, 10**6, len(cells))
        built = k2_treap.Treap.build(rows, columns, impacts, levels)
        treap = k2_treap.Treap.unpack(levels, built.bands, *built.pack())
        assert (treap.most == built.most).all() and (treap.bits == built.bits).all() and (treap.first == built.first).all()
        grid = np.zeros((n_rows, n_columns), dtype=np.int64)
        grid[rows, columns] = impacts
        for asked in (np.arange(min(n_rows, 4)), np.array([n_rows - 1])):
            weights = rng.integers(1, 5, len(asked))
            scores = weights @ grid[asked]
            want = sorted((-s, c) for c, s in enumerate(scores.tolist()) if s)[:7]
            ids = np.arange(1 << levels)
            got = treap.search(asked, weights, ids, np.zeros((3, 0), dtype=np.int64), 7)
            assert [(-s, c) for s, c in zip(got[0].tolist(), got[1].tolist())] == want


def test_ranks_equal_brute_force(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    rng = random.Random(4)
    vocabulary = prose(rng, 120).split()
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([6, 120])]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 3, 30, 200]))) for i in range(300)]
    docs += [(1000 - i, docs[5][1]) for i in range(60)]  # equal scores beyond any list
    docs += [(None, docs[5][1]), (None, docs[7][1]), (7, docs[9][1]), (2000, ""), (2001, None)]
    items = [(i, text(rng.choice([1, 5, 40])).upper()) for i in range(30)] + [(50, docs[5][1]), (51, None), (52, "--"), (53, "absent-term"), (None, docs[7][1])]
    want = brute_force(docs, items)
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score long").repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items + items[:2]], "item_id long, text string, term string")
    key = lambda r: (r.item_id is None, r.item_id or 0, r.rank)

    got = [(r.item_id, r.rank, r.doc_id, r.score) for r in sorted(k2_treap.rank_documents(frame, asked).collect(), key=key)]
    assert got == want
    monkeypatch.setattr(k2_treap, "BLOCK_DOCS", 32)
    monkeypatch.setattr(k2_treap, "ITEM_TERMS", 100)
    monkeypatch.setattr(k2_treap, "WIDTH", 3)
    again = [(r.item_id, r.rank, r.doc_id, r.score) for r in sorted(k2_treap.rank_documents(frame, asked).collect(), key=key)]
    assert again == want
    odd = [(r.item_id, r.rank, r.doc_id, r.score) for r in sorted(k2_treap.rank_documents(odd_docs, asked).collect(), key=key)]
    assert odd == brute_force([r[:2] for r in odd_rows], items)
    own = spark.createDataFrame([(1, odd_rows[5][1])], "item_id long, text string")
    assert [(r.item_id, r.rank, r.doc_id, r.score) for r in sorted(k2_treap.rank_documents(odd_docs, own).collect(), key=key)] == brute_force([r[:2] for r in odd_rows], [(1, odd_rows[5][1])])
    assert k2_treap.rank_documents(no_docs, asked).count() == 0
    assert k2_treap.rank_documents(frame, asked.limit(0)).count() == 0
