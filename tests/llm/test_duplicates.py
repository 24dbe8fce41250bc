import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from shelfsense.llm import bag_minhash, fuzzy_lines, spaced_seeds
from shelfsense.llm.common import Scratch, components
from tests.llm.conftest import prose


def grouped(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)]
    want = grouped(edges, {n for e in edges if e[0] != e[1] for n in e})
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert {r.node: r.root for r in found} == want and len(found) == len(want)
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_register_agreement_is_the_weighted_similarity():
    rng = np.random.default_rng(2)
    n, m = 60, 4096
    shared = rng.integers(0, 2**63, 40).astype(np.uint64)
    ours, theirs = rng.integers(1, 12, 40), rng.integers(1, 12, 40)
    doc = np.repeat([0, 1], 40)
    values = bag_minhash.bag_minhash(doc, np.concatenate([shared, shared]), np.concatenate([ours, theirs]), 2, registers=m)
    want = np.minimum(ours, theirs).sum() / np.maximum(ours, theirs).sum()
    assert abs((values[0] == values[1]).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5
    # A process agrees with itself whatever the batch, and an empty document has no values.
    alone = bag_minhash.bag_minhash(np.full(40, n), shared, ours, n + 1, registers=m)
    assert (alone[n] == values[0]).all() and np.isinf(alone[0]).all()


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return words


def near_documents():
    rng = random.Random(3)
    docs, base = [], prose(rng, 150).split()
    for _ in range(60):  # one large group, some members far from each other
        docs.append(" ".join(edited(rng, base, rng.randint(0, 9))))
    for _ in range(40):
        one = prose(rng, rng.randint(3, 120)).split()
        docs += [" ".join(one), " ".join(edited(rng, one, rng.randint(0, 4))).upper()]
    docs += ["a b c"] * 5 + ["la la la la la la " * 20, "la la la la la la " * 19]
    return list(enumerate(docs))


def weighted(text):
    words = tuple(w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w)
    n = min(5, len(words))
    return words, Counter(words[i : i + n] for i in range(len(words) - n + 1)) if words else Counter()


def test_near_duplicates_are_exact(spark):
    docs = near_documents()
    bags = {i: weighted(t) for i, t in docs}
    links = []
    for i, (wi, bi) in bags.items():
        for j, (wj, bj) in bags.items():
            common = sum((bi & bj).values())
            if i < j and (wi == wj or common * 5 >= (sum(bi.values()) + sum(bj.values()) - common) * 4):
                links.append((i, j))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in bag_minhash.classes(frame).collect()}
    assert found == grouped(links, bags)
    kept = [r.doc_id for r in bag_minhash.keep_one(frame).collect()]
    assert sorted(kept) == sorted(set(found.values()))


def test_near_duplicates_without_or_with_shared_ids(spark):
    rng = random.Random(21)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one = prose(rng, 200).split()
    near = [" ".join(edited(rng, one, 1)) for _ in range(3)]
    rows = bag_minhash.classes(frame([(None, near[0]), (None, near[1]), (1, near[2])])).collect()
    assert len(rows) == 3 and {r.class_id for r in rows} == {1}
    # Two different texts under doc_id 5, a near copy of each, and rows without doc_id alone.
    other, third = prose(rng, 200).split(), prose(rng, 200).split()
    docs = [(5, " ".join(one)), (5, " ".join(other)), (7, " ".join(edited(rng, other, 1))), (8, near[0]), (None, " ".join(third)), (None, " ".join(edited(rng, third, 1)))]
    found = {(r.doc_id, r.mark): r.class_id for r in bag_minhash.classes(frame(docs)).collect()}
    own = {text: found[i, m] for i, text, m in frame(docs).select("doc_id", "text", bag_minhash.text_mark(F.col("text"))).collect()}
    ids = [own[t] for _, t in docs]
    assert ids[0] == ids[3] and ids[1] == ids[2] and ids[4] == ids[5]
    assert len(set(ids)) == 3 and 5 in (ids[0], ids[1])
    kept = bag_minhash.keep_one(frame(docs + docs)).collect()
    assert sorted((r.doc_id or 0 for r in kept)) == [0, 5, 5]


def test_near_duplicates_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    found = bag_minhash.classes(odd_docs).collect()
    assert len(found) == len(odd_rows)
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add(r.class_id)
    assert by[1] == by[6] == {1} and by[2] == by[3] == by[4] == {2} and by[None] == {1, 2} and by[5] == {5}
    kept = bag_minhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 7, 8, 9, 10]
    assert bag_minhash.classes(no_docs).count() == 0 and bag_minhash.keep_one(no_docs).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def normal(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def test_lines_match_brute_force(spark):
    rng = random.Random(8)
    base = [prose(rng, rng.randint(4, 60)) for _ in range(12)]
    docs = []
    for i in range(50):
        lines = [rng.choice(base) for _ in range(3)] + [" ".join(edited(rng, rng.choice(base).split(), 1)) for _ in range(2)] + [prose(rng, 8), "short line", ""]
        lines[0] = lines[0].upper() + "!!"
        docs.append((i, "\n".join(lines)))
    occurrences = defaultdict(list)
    for i, text in docs:
        for k, line in enumerate(text.split("\n")):
            if len(normal(line).split()) >= 5:
                occurrences[normal(line)].append((i, k))
    lines = list(occurrences)
    hashes = dict(spark.createDataFrame([(w,) for w in {w for x in lines for w in x.split()}], "w string").select("w", F.xxhash64("w")).collect())

    def simhash(line):
        own = [hashes[w] for w in line.split()]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))

    sims = [simhash(x) for x in lines]
    links = []
    for i in range(len(lines)):
        for j in range(i):
            if (sims[i] ^ sims[j]).bit_count() <= 3:
                most = max(len(lines[i]), len(lines[j]))
                if edit_distance(lines[i], lines[j]) <= int(most * 0.2 + 1e-9):
                    links.append((j, i))
    assert links
    groups = defaultdict(list)
    for n, root in grouped(links, range(len(lines))).items():
        groups[root] += occurrences[lines[n]]
    gone = {o for g in groups.values() for o in sorted(g)[1:]}
    found = {r.doc_id: r for r in fuzzy_lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), counts=True).collect()}
    for i, text in docs:
        own = text.split("\n")
        assert found[i].text == "\n".join(x for k, x in enumerate(own) if (i, k) not in gone)
        assert (found[i].n_lines, found[i].n_dropped) == (len(own), sum((i, k) in gone for k in range(len(own))))


def test_whole_lines_are_found_by_edit_similarity_alone(spark):
    """One changed word, mistyped letters and short or unspaced lines, against brute force without hashes."""
    rng = random.Random(12)
    lines = []
    for n in (3, 5, 8, 10, 15):
        for _ in range(12):
            words = prose(rng, n).split()
            lines += [" ".join(words), " ".join(edited(rng, words, 1))]
    for n in (6, 12, 25):
        for _ in range(10):
            one = [chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n)]
            other = list(one)
            other[rng.randrange(n)] = "\u4e00"
            lines += ["".join(one), "".join(other)]
    lines = list(dict.fromkeys(map(normal, lines)))
    pairs = []
    for j, b in enumerate(lines):
        for i, a in enumerate(lines[:j]):
            if len((Counter(a) - Counter(b)).keys()) > max(len(a), len(b)) * 0.2:
                continue  # each of these letters takes an edit of its own
            most = max(len(a), len(b))
            if abs(len(a) - len(b)) <= most * 0.2 and edit_distance(a, b) <= int(most * 0.2 + 1e-9):
                pairs.append((i, j))
    docs = [(i, x) for i, x in enumerate(lines)] + [(1000, "Short line!"), (1001, "short line"), (1002, "a\nb"), (1003, "A.")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.text for r in fuzzy_lines.dedup_lines(frame, whole=True).collect()}
    roots = grouped(pairs, range(len(lines)))
    gone = {n for n, root in roots.items() if n != root}
    dropped = {i for i in range(len(lines)) if found[i] == ""}
    print(f"{len(dropped)} of {len(gone)} lines found")
    assert dropped <= gone and len(gone) > 60 and len(dropped) >= 0.97 * len(gone)
    assert (found[1000], found[1001], found[1002], found[1003]) == ("Short line!", "", "a\nb", "")


def test_every_layout_is_a_pigeonhole():
    for n in (10, 10**8, 10**10, 10**12):
        keys = fuzzy_lines.layout(n)
        for flips in ([0, 1, 2], [0, 20, 40], [5, 33, 63], [63, 62, 1]):
            assert any(all(not a <= f < a + bits for a, bits in key for f in flips) for key in keys)


def test_lines_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    found = fuzzy_lines.dedup_lines(odd_docs)
    rows = found.collect()
    assert found.columns == odd_docs.columns and len(rows) == len(odd_rows)
    texts = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    assert texts[2] is None and texts[3] == "" 
    # Null comes first in order, so the row without doc_id has the first occurrence of the shared line.
    assert texts[1] == texts[6] == "" and {r.text for r in rows if r.doc_id is None} == {odd_rows[0][1], None}
    assert fuzzy_lines.dedup_lines(no_docs).count() == 0


def test_long_lines_have_the_same_simhash(spark):
    hashes = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.xxhash64(i))
    rows = spark.createDataFrame([(3,), (7,), (8,), (127,), (128,), (32_767,), (33_000,)], "n int").select(fuzzy_lines.simhash(hashes).alias("s"), hashes.alias("h")).collect()
    for r in rows:
        bits = (np.array(r.h).view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        assert r.s & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > len(r.h))


def test_passages_are_found_with_substitutions(spark, odd_docs, no_docs):
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate((40, 20, 13, 9, 5))] + [(3, None), (None, "")]
    docs, want = [(0, prose(rng, 300)), (1, None), (2, "")], set()
    for i, text in items[:4]:
        words = text.split()
        docs.append((len(docs), prose(rng, 50) + " " + text.upper().replace(" ", ", ") + " " + prose(rng, 50)))
        want.add((docs[-1][0], i))
        if len(words) >= 20:
            changed = [w if k % 9 else prose(rng, 1) for k, w in enumerate(words)]
            docs.append((len(docs), prose(rng, 30) + " " + " ".join(changed)))
            want.add((docs[-1][0], i))
            docs.append((len(docs), " ".join(words[4:18]) + " " + prose(rng, 40)))  # a part at the start
            want.add((docs[-1][0], i))
            docs.append((len(docs), " ".join(w if k % 3 else prose(rng, 1) for k, w in enumerate(words))))  # too little
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs + docs[3:4]], "doc_id long, text string, mask long, h string")
    bench = spark.createDataFrame([(*b, 1) for b in items + items[:1]], "item_id long, text string, q long")
    rows = spaced_seeds.overlaps(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    exact = next(r for r in rows if r.doc_id == 3)
    assert (exact.n_equal, exact.n_words, exact.doc_start) == (40, 40, 50)
    part = next(r for r in rows if r.doc_id == 5)
    assert (part.n_equal, part.doc_start) == (14, -4)
    left = spaced_seeds.decontaminate(frame, bench)
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} == {d[0] for d in docs} - {w[0] for w in want}
    assert spaced_seeds.overlaps(odd_docs, bench).count() == 0
    assert spaced_seeds.overlaps(no_docs, bench).count() == 0 and spaced_seeds.overlaps(frame, bench.limit(0)).count() == 0


def verified(doc, item):
    """Whether any alignment is accepted, without seeds."""
    width = min(spaced_seeds.WINDOW, len(item))
    for start in range(1 - len(item), len(doc)):
        eq = [0 <= start + i < len(doc) and doc[start + i] == w for i, w in enumerate(item)]
        if any(5 * sum(eq[i : i + width]) >= 4 * width for i in range(len(item) - width + 1)):
            return True
    return False


def test_masks_lose_no_allowed_substitution():
    for width, masks in spaced_seeds.MASKS.items():
        for gone in combinations(range(width), width - -(-4 * width // 5)):
            assert any(
                all(at + o not in gone for o, c in enumerate(m) if c == "1") for m in masks for at in range(width - len(m) + 1)
            ), (width, gone)


def test_substitutions_in_short_items_match_brute_force(spark, monkeypatch):
    rng = random.Random(14)
    items, docs = {}, {}
    for n in [*range(1, 21)]:
        items[n] = [f"i{n}w{k}" for k in range(n)]
        for gone in range(4):
            for _ in range(8):
                own = list(items[n])
                for k in rng.sample(range(n), min(gone, n)):
                    own[k] = f"x{rng.randrange(10**6)}"
                cut = own[rng.choice((0, 0, 1, 2)) :]
                docs[len(docs)] = rng.choice(([], prose(rng, 5).split())) + cut + rng.choice(([], prose(rng, 6).split()))
    want = {(i, n) for i, d in docs.items() for n, item in items.items() if f"i{n}w" in " ".join(d) and verified(d, item)}
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    rows = spaced_seeds.overlaps(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) > 300
    monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", 0)
    assert sorted(spaced_seeds.overlaps(frame, bench).collect()) == sorted(rows)


def test_unspaced_scripts_are_compared_by_character(spark):
    rng = random.Random(15)
    one = [chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(30)]
    other = ["\u4e00" if k in (4, 11, 20) else c for k, c in enumerate(one)]
    frame = spark.createDataFrame([(1, "東京 " + "".join(other) + "です。"), (2, "".join(one[:8]) + "".join(reversed(one)))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "".join(one))], "item_id long, text string")
    assert [tuple(r) for r in spaced_seeds.overlaps(frame, bench).collect()] == [(1, 7, 27, 30, 2)]


def test_large_benchmarks_are_shuffled(spark, monkeypatch):
    rng = random.Random(10)
    item = prose(rng, 30)
    docs = spark.createDataFrame([(1, prose(rng, 20) + " " + item)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    want = spaced_seeds.overlaps(docs, bench).collect()
    monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", 0)
    assert spaced_seeds.overlaps(docs, bench).collect() == want != []
