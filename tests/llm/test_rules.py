import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers

from shelfsense.llm import fertility, host_reputation, pattern_pii, shard_tree
from shelfsense.llm.queries import fertility_vocabularies
from tests.llm.conftest import prose, speech


def test_shards_follow_the_key(spark, odd_docs, odd_rows, no_docs):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN NULL ELSE repeat('é', CAST(id % 7 AS INT)) END AS text")
    rows = shard_tree.assign(docs).collect()
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(24)) and 110 < min(sizes.values()) and max(sizes.values()) < 230
    assert 110 < sum(r.grown_shard == 24 for r in rows) < 220
    for shard in range(24):
        own = sorted((r for r in rows if r.shard == shard), key=lambda r: r.doc_id)
        assert [r.slot for r in own] == list(range(len(own)))
    for r in rows[:200]:
        text = ("" if r.doc_id % 3 == 0 else "é" * (r.doc_id % 7)).encode()
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))
    odd = shard_tree.assign(odd_docs).collect()
    assert len(odd) == len(odd_rows) and len({r.shard for r in odd if r.doc_id is None}) == 1
    assert shard_tree.assign(no_docs).count() == 0


def test_weights_move_rows_only_inside_their_subtree(spark):
    from pyspark.sql import functions as F

    tree = shard_tree.regular_tree()
    heavier = [shard_tree.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in tree]
    place = {s.shard: (s.region, s.rack) for s in tree}
    rows = spark.range(3000).select(shard_tree.shard_of(F.col("id"), tree).alias("a"), shard_tree.shard_of(F.col("id"), heavier).alias("b")).collect()
    moved = [r for r in rows if r.a != r.b]
    assert moved and all(place[r.b][0] == place[5][0] for r in moved)  # only into the heavier region
    inside = [r for r in moved if place[r.a][0] == place[5][0]]
    assert all(place[r.b] == place[5] for r in inside if place[r.a] != place[r.b])  # there, only into its rack
    assert all(r.b == 5 for r in inside if place[r.a] == place[r.b])  # and in the rack only to the shard
    share = sum(r.b == 5 for r in rows) / len(rows)
    assert abs(share - 3 / 26) < 0.03


def test_urls_and_rules(spark):
    urls = [
        ("https://WWW.Example.NET/en/x?y#z", "www.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://a.net/x", "a.net", "/x", "net/", "block"),
        ("http://a.net", "a.net", "", None, "allow"),
        ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("x://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("a://b.org/fr/://c", "b.org", "/fr/://c", "org/fr/", "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://É.com:80?a", "É.com:80", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "n", 1) for i, u in enumerate(urls)] + [(None, None, "n", 1)], "page_id long, url string, low string, n long")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    rows = host_reputation.judge(pages, none).collect()
    assert len(rows) == len(urls) + 1
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows if r.page_id is not None}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert host_reputation.judge(pages.limit(0), none).count() == 0


def test_reputation_is_shrunk(spark):
    """A host with many bad pages is blocked; one bad page condemns nobody, but a bad domain's host is doubted."""
    rows, labels = [], []

    def add(host, bad, good, unlabelled=1):
        for kind, n in ((True, bad), (False, good), (None, unlabelled)):
            for _ in range(n):
                rows.append((len(rows), f"http://{host}/p"))
                if kind is not None:
                    labels.append((rows[-1][0], kind))

    add("spam.bad.com", 60, 2)
    add("more.bad.com", 55, 1)
    add("new.bad.com", 0, 0)
    add("once.fine.com", 1, 0)
    for k in range(30):
        add(f"h{k}.fine{k % 5}.com", 1, 30)
    labels += labels[:5]  # repeated labels count once
    pages, outcomes = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean")
    found = {r.host: r.verdict for r in host_reputation.judge(pages, outcomes).collect()}
    assert found["spam.bad.com"] == found["more.bad.com"] == "block"
    assert found["once.fine.com"] == "allow" and all(found[f"h{k}.fine{k % 5}.com"] == "allow" for k in range(30))
    known = pages.join(outcomes.distinct(), "page_id", "left").selectExpr("'' AS x", "regexp_extract(url, '//([^/]*)', 1) AS host", "int(bad) AS bad")
    means = {r.host: r.a / (r.a + r.b) for r in host_reputation.reputations(known).collect()}
    assert means["new.bad.com"] > 5 * means["h0.fine0.com"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15,
            }
            if fits[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_base(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(2)
    parts = ["a", "b@", "c.d", "1", "23", "4111111111111111", "192.168.0.1", " ", "-", "+1 (", "555", "é", "\n", "x@y.z_w@v.u", "🙂", "01.02.3.4", "..", "@"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    texts += [(2000, "a" * 200_000), (2001, "1" * 100_000), (2002, "1 " * 20_000), (2003, "+1" + " " * 100_000), (2004, "a@" * 50_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r for r in pattern_pii.find_personal_data(docs).collect()}
    assert len(found) == len(texts)
    for i, text in texts:
        want = base_spans(text)
        assert found[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert found[i].spans.startswith(",".join(want))
        kinds = Counter(s.split(":")[0] for s in want)
        assert [found[i][f"n_{k}"] for k in pattern_pii.KINDS] == [kinds[k] for k in pattern_pii.KINDS]
    assert pattern_pii.find_personal_data(odd_docs).count() == len(odd_rows)
    assert pattern_pii.find_personal_data(no_docs).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(4)
    texts = [f"{prose(rng, 12)} write me at user{i}@mail.example {prose(rng, 5)}" for i in range(12)]
    texts += [f"{prose(rng, 12)} write me at handle-{i}77x, {prose(rng, 5)}" for i in range(3)]
    texts += [f"{prose(rng, 12)} of all the {i}th one" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pattern_pii.find_personal_data(docs.unionByName(docs.filter("doc_id = 12"))).collect()}
    for i, text in enumerate(texts):
        if 12 <= i < 15:
            start = text.index("handle-")
            assert found[i] == f"identifier:{start}:{text.index(',', start)}"
        else:
            assert "identifier" not in found[i]


def test_trusted_identifiers_induce_patterns(spark):
    """The last identifier follows no context of a seed: it is two hops away."""
    texts = [f"please contact clerk user{i}@mail.example" for i in range(6)] + [f"then contact clerk AB-{i}" for i in range(3)]
    texts += [f"his badge code AB-{i} was seen" for i in range(3) for _ in range(2)] + ["the badge code CD-9 was lost", "a page number 7 of 9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pattern_pii.find_personal_data(docs).collect()}
    for i, text in enumerate(texts):
        start = max(text.find("AB-"), text.find("CD-"))
        assert found[i] == f"identifier:{start}:{start + 4}" if start >= 0 else "identifier" not in found[i]


def grown(texts):
    """Identifier spans by the docstring's rules, without Spark: (row, start, end)."""
    tokens, occurs = [], Counter()
    for i, text in enumerate(texts):
        spots = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^ ]+", text)]
        for k in range(2, len(spots)):
            context = tuple(re.sub("[0-9]", "0", w.lower()) for _, _, w in spots[k - 2 : k])
            occurs[context] += 1
            a, b, w = spots[k]
            if re.search("[0-9@]", w):
                tokens.append((i, a, b, context, w, "@" in w))
    counts = Counter((c, w) for *_, c, w, _ in tokens)
    score = {w: 1.0 for *_, w, seed in tokens if seed}
    seeds, before = set(score), None
    while before != (now := (len(score), sum(round(x * 100) for x in score.values()))):
        before, patterns = now, {}
        for c in {c for c, _ in counts}:
            known = [w for cc, w in counts if cc == c and w in score]
            sure = min(sum(counts[c, w] * score[w] for w in known) / (occurs[c] + 1), 0.999)
            if len(known) >= 3 and sure >= 0.5:
                patterns[c] = sure
        doubt = defaultdict(lambda: 1.0)
        for c, w in counts:
            if c in patterns:
                doubt[w] *= 1 - patterns[c]
        score = {w: 1 - x for w, x in doubt.items()} | {w: 1.0 for w in seeds}
    return {(i, a, b) for i, a, b, c, w, seed in tokens if c in patterns and not seed}


def test_growth_matches_brute_force(spark):
    rng = random.Random(31)
    texts = []
    for _ in range(260):
        k = rng.randrange(8)
        word = rng.choice(("plain", "word", "here")) if rng.random() < (0.06 if k < 6 else 0.6) else f"u{rng.randrange(5)}@m.example" if k < 2 and rng.random() < 0.75 else f"id-{k + rng.randrange(7)}"
        texts.append(f"{rng.choice(('so', 'and', 'if'))} near k{'abcdefgh'[k]} {word} {rng.choice(('now', 'then'))}")
    want = grown(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = set()
    for r in pattern_pii.find_personal_data(docs).collect():
        found |= {(r.doc_id, *map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("identifier")}
    assert found == want and len({texts[i].split()[2] for i, _, _ in want}) > 2


def test_contexts_are_the_two_words_before(spark):
    """Different third words share a context, and two words before an identifier are enough."""
    texts = [f"{w} me at user{i}@mail.example today" for i, w in enumerate(("email", "write", "ask", "call", "reach", "ping"))]
    texts += ["me at handle-77x, thanks"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pattern_pii.find_personal_data(docs).collect()}
    assert found[6] == "identifier:6:16" and all("identifier" not in found[i] for i in range(6))


def test_fertility_rules(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(6)
    good = speech(rng, 90)
    texts = [good, " ".join(["spam ham eggs"] * 40), "x " * 60, "a b c", "\u4e00\u4e8c\u4e09 " * 5 + good, "line one\n \nline one\nline one\n" + good + " #*$%&|<> #"]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, tokens long")
    found = {r.doc_id: r for r in fertility.judge(docs, fertility_vocabularies()).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        triples = list(zip(words, words[1:], words[2:]))
        counts = Counter(triples)
        repeated = {k + j for k, t in enumerate(triples) if counts[t] > 1 for j in range(3)}
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)
        )
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
    assert [found[i].kept for i in range(6)] == [True, False, False, False, True, True]
    # Another way to the measures: whole texts, one at a time.
    for name, path in fertility_vocabularies().items():
        for i, text in enumerate(texts):
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            if path.endswith(".model"):
                model = sentencepiece.SentencePieceProcessor(model_file=path)
                ids = [t for w in words for t in model.encode(w)]
                single = sum(model.is_byte(t) or model.is_unknown(t) for t in ids)
            else:
                model = tokenizers.Tokenizer.from_file(path)
                ids = model.encode(text, add_special_tokens=False).ids
                single = sum(len(model.id_to_token(t)) == 1 and ord(model.id_to_token(t)) > 126 and model.id_to_token(t) not in "ĠĊ" for t in ids)
            entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values())
            got = [found[i][f"{name}_{m}"] for m in ("chars_per_token", "byte_share", "entropy")]
            assert got == pytest.approx([sum(map(len, words)) / len(ids), single / len(ids), entropy], abs=1e-9)
    # A language's own band comes before its script's.
    strict = {**{k: v for k, v in fertility.BANDS.items() if ":" not in k}, "en": fertility.Band(least_chars_per_token=100.0)}
    assert not any(r.kept for r in fertility.judge(docs, fertility_vocabularies(), strict).collect())
    piece = fertility.Pieces(P.path("piece_bpe_32k.model"))
    tokens, singles, _ = piece.measure(["the"], [["the"]])
    assert (tokens[0], singles[0]) == (1, 0)
    assert piece.measure(["\u1234"], [["\u1234"]])[1][0] == 3  # three bytes
    odd = fertility.judge(odd_docs, fertility_vocabularies()).collect()
    assert len(odd) == len(odd_rows) and not any(r.kept for r in odd if r.doc_id in (2, 3, 4, 7, 9))
    assert fertility.judge(no_docs, fertility_vocabularies()).count() == 0


def test_gibberish_goes_and_prose_stays(spark):
    rng = random.Random(16)
    words = lambda letters, n=150: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n))
    ideographs, arabic = [chr(c) for c in range(0x4E00, 0x9F00)], [chr(c) for c in range(0x627, 0x64A)]
    bad = [(words("abcdefghijklmnopqrstuvwxyz"), "en"), (words("bcdfghjklmnpqrstvwxz"), None), (words("bcdfghjklmnpqrstvwxz"), "fr"), (words(ideographs), "zh"), (words(arabic), "ar")]
    chinese = "我们 今天 一起 去 学校 学习 中文 因为 老师 说 这 是 一个 很 好 的 机会 大家 都 可以 参加 这个 活动 的 时候 也 要 注意 安全 问题 不要 忘记 带 上 自己 的 书 和 水 以及 其他 需要 的 东西 谢谢 你们 的 支持 与 理解 希望 明天 天气 会 更 好 一些"
    good = [(speech(rng, 150), "en"), (speech(rng, 3000), "en"), (speech(rng, 150), None), (chinese, "zh")]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(bad + good)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in fertility.judge(docs, fertility_vocabularies()).collect() if r.kept}
    assert kept == set(range(len(bad), len(bad) + len(good)))
