import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from shelfsense.llm import best_fit, count_cache, dac
from shelfsense.llm.common import Scratch
from shelfsense.llm.tokens import Encoder, ids_crc32

BYTE = P.path("byte_bpe_50k.json")


def library_ids(texts, path=BYTE):
    found = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids for e in found]


def test_chunked_ids_are_the_librarys():
    rng = random.Random(1)
    letters = "ab é中 \n\t\r\x0b\x1c\x85\u00a0\u3000!'s1²'ll\x00🙂" + "  \n\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "", None, "\n", " ", "x " * 5000]
    for encoder in (Encoder(BYTE), Encoder(BYTE, cache_chunks=50)):
        for at in range(0, len(texts), 400):
            some = texts[at : at + 400]
            ids, starts = encoder.encode(some)
            want = library_ids(some)
            assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == want
            assert encoder.count(some).tolist() == [len(x) for x in want]


def test_other_tokenizers_encode_whole_texts():
    path = P.path("word_bpe_49k.json")
    texts = ["Hello  World", "", "É a\nb"]
    ids, starts = Encoder(path).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == library_ids(texts, path)


def test_direct_codes_give_any_token():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 200, 3000), rng.integers(0, 2**32, 700), rng.integers(0, 60_000, 3000)]).astype(np.uint32)
    starts = np.array([0, 10, 10, 4000, len(ids)])
    data = dac.build([5, None, 7, 9], starts, ids)
    reads = []
    segment = dac.Segment(lambda at, size: reads.append(size) or data[at : at + size])
    assert segment.all_tokens().tolist() == ids.tolist()
    assert segment.documents()[0] == [5, None, 7, 9] and segment.documents()[1].tolist() == starts.tolist()
    reads.clear()
    for i in [0, 511, 512, 2999, 3000, 3500, len(ids) - 1]:
        assert segment.token(i) == ids[i]
    assert max(reads) <= 64  # never a block of codes
    with pytest.raises(IndexError):
        segment.token(len(ids))
    assert dac.Segment(lambda at, size: dac.build([], np.array([0]), ids[:0])[at : at + size]).all_tokens().tolist() == []


def test_token_files_round_trip(spark, odd_docs, odd_rows, no_docs):
    scratch = Scratch(spark, "test")
    folder = scratch.path("tokens")
    dac.write_dataset(odd_docs, folder, BYTE, segment_tokens=300)
    rows = dac.read_documents(spark, folder).collect()
    assert spark.read.parquet(f"{folder}/manifest").count() > 2
    want = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in odd_rows))
    ids = [x + [0] for x in library_ids([w[2] for w in want])]
    got = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [w[1] if w[0] else None for w in want]
    assert got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    by = lambda rows: sorted((k is None, k or 0, n, c) for k, n, c in rows)
    assert by((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == by(
        (w[1] if w[0] else None, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for w, x in zip(want, ids)
    )
    assert dac.encode_documents(no_docs, scratch.path("none"), BYTE).count() == 0


def test_counts_come_from_the_cache(spark, odd_docs, odd_rows, no_docs):
    cache = Scratch(spark, "test").path("cache")
    rows = count_cache.count_tokens(odd_docs, BYTE, cache, limit=100).collect()
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), len(x)) for r, x in zip(odd_rows, library_ids([r[1] for r in odd_rows])))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
    stored = spark.read.parquet(cache)
    distinct = len({r[1] or "" for r in odd_rows})
    assert stored.count() == distinct
    # A second call adds nothing; a stored count is used as it is; another tokenizer has its own part.
    count_cache.count_tokens(odd_docs, BYTE, cache).collect()
    assert spark.read.parquet(cache).count() == distinct
    pieces = count_cache.count_tokens(odd_docs, P.path("piece_bpe_32k.model"), cache).collect()
    assert len(pieces) == len(rows) and spark.read.parquet(cache).count() == 2 * distinct
    assert count_cache.count_tokens(no_docs, BYTE, cache).count() == 0


def simulated_best_fit(lengths, capacity):
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            n += 1
            gaps.append(capacity - length)
    return n


def test_runs_are_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 37, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        places = []
        for length, rank, first, per, offset in best_fit.plan_runs(counts, capacity).tolist():
            later = [r[1] for r in best_fit.plan_runs(counts, capacity).tolist() if r[0] == length and r[1] > rank]
            for k in range(min(later, default=counts[length]) - rank):
                places.append((first + k // per, offset + k % per * length, length))
        assert sorted(p[2] for p in places) == sorted(lengths)
        places.sort()
        for (s, o, n), (s2, o2, _) in zip(places, places[1:]):
            assert o + n == o2 if s == s2 else o2 == 0
            assert o + n <= capacity
        assert len({p[0] for p in places}) == simulated_best_fit(lengths, capacity)


def test_documents_are_packed_whole(spark, odd_docs, odd_rows, no_docs):
    rows = best_fit.pack_documents(odd_docs, BYTE, capacity=256).collect()
    ids = [x + [0] for x in library_ids([r[1] for r in odd_rows])]
    want = []
    for r, x in zip(odd_rows, ids):
        start = 0
        for k in range(-(-len(x) // 256)):
            size = (len(x) % 256 or 256) if k == 0 else 256
            want.append((r[0] is None, r[0] or 0, k, start, size, ids_crc32(np.array(x[start : start + size]))))
            start += size
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 256
    assert len(by) == simulated_best_fit([r.length for r in rows], 256)
    assert best_fit.pack_documents(no_docs, BYTE).count() == 0
