import hashlib
import itertools
import random
import re
import zlib

import pytest

from shelfsense.llm import audit_repair as A
from tests.llm.conftest import prose

GOAL = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_repairs(rows, kinds, most):
    """Every sequence of edits that costs at most ``most``: cost, audit, repaired rows."""

    def go(i, cost, audit, made):
        if cost > most:
            return
        if i == len(rows):
            yield cost, audit, made
        else:
            _, role, text = rows[i]
            yield from go(i + 1, cost + 2, audit + "D", made)
            if kinds[i] not in ("blank", "duplicate"):
                extra = 5 if kinds[i] == "truncated" else 0
                yield from go(i + 1, cost + extra, audit + "K", [*made, (role, text)])
                for new in ("user", "assistant"):
                    yield from go(i + 1, cost + 1 + extra, audit + "R", [*made, (new, text)])
        for new in ("user", "assistant"):
            yield from go(i, cost + 5, audit + "I", [*made, (new, "")])

    return go(0, 0, "", [])


def brute_force(rows):
    kinds = faults(rows)
    good = [r for r in all_repairs(rows, kinds, min(2 * len(rows), 14)) if GOAL.fullmatch("".join(role[:1] or "?" for role, _ in r[2]))]
    best = min(r[:2] for r in good)
    made = next(r[2] for r in good if r[:2] == best)
    assert all(r[2] == made for r in good if r[:2] == best)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, *best, digest)


def sample(rng, n_convs, most=6):
    rows = []
    for conv in range(n_convs):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant"] if rng.random() < 0.4 else [("user", "assistant")[turn % 2], "system", "tool", "", None])
            text = rng.choice(["Fine.", "Good!", "", " \n", None, "no end", prose(rng, 4) + "?", prose(rng, 3) + ". \t"])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn * 2 + 100]), role, text))
    unique = {(c, t): (c, t, r, x) for c, t, r, x in rows}
    return list(unique.values())


def results(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


@pytest.mark.parametrize("stretch", [20_000, 2])
def test_repairs_equal_brute_force(spark, monkeypatch, stretch):
    rng = random.Random(21)
    rows = sample(rng, 120) + [(500, 3, "user", "x."), (501, None, "user", "Hi."), (501, 7, "assistant", "Yes.")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, d1 long").repartition(5)
    path = spark.conf.get("spark.checkpoint.dir") + f"/repair-{stretch}.parquet"
    frame.write.parquet(path)
    if stretch < 20_000:
        # Workers import the module anew, so the size has to go with the function.
        walked, small = A._walked, stretch

        def in_small_stretches(batches):
            import shelfsense.llm.audit_repair as own

            own.STRETCH_ROWS = small
            yield from walked(batches)

        monkeypatch.setattr(A, "_walked", in_small_stretches)
    hurt = A.damage(spark.read.parquet(path))
    got = results(A.repair(hurt, hurt["lost"]))
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    assert set(got) == set(by_conv)
    for conv, own in by_conv.items():
        left = damaged(own)
        want = brute_force(left) if left else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert got[conv] == want, (conv, left)


def test_long_conversations_span_tasks(spark):
    """One conversation with nearly all rows: the same audit as from one walk."""
    rng = random.Random(22)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", f"Turn {t}.", f"cut {t}", ""])) for t in range(3000)]
    frame = spark.createDataFrame(rows + [(2, 0, "user", "a.")], "conv_id long, turn long, role string, text string").repartition(3)
    got = results(A.repair(frame))
    kinds = faults([r[1:] for r in rows])
    cells = A.cheapest([(r[2][:1], k in ("blank", "duplicate"), 5 if k == "truncated" else 0) for r, k in zip(rows, kinds)])
    cost, audit = A.accepted(cells)
    assert got[1][5:7] == (cost, audit) and len(audit.replace("I", "")) == len(rows)
    lines = "\n".join(A.replayed(audit, iter([r[2:] for r in rows])))
    assert got[1][7] == hashlib.sha256(lines.encode()).hexdigest()
    assert got[1][1:4] == tuple(kinds.count(k) for k in ("blank", "duplicate", "truncated"))
    assert GOAL.fullmatch("".join(line[0] for line in lines.split("\n")))


def test_ties_do_not_rest_on_hashes(monkeypatch):
    """With a hash that always collides, comparisons stay right."""
    rng = random.Random(23)
    strings = ["".join(rng.choice("DIKR") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    strings += [s[:20] + "K" + s[20:] for s in strings]
    for base in (A._BASE, 0):
        monkeypatch.setattr(A, "_BASE", base)
        nodes = {}
        for s in strings:
            node = A._ROOT
            for k, edit in enumerate(s):
                node = nodes.setdefault(s[: k + 1], A._extended(node, edit))
        for a, b in itertools.product(strings[::3], strings):
            if a and b and a != b:
                assert A._less(nodes[a], nodes[b]) == (a < b), (base, a, b)


def test_repair_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, cost string, lost string"
    odd = [(None, None, None, None, "c", "l"), (None, None, None, None, "c", "l"), (1, None, "user", "x" * 100_000 + ".", "c", "l"), (1, 0, "assistant", "é!", "c", "l"), (1, 0, "assistant", "é!", "c", "l")]
    got = results(A.repair(spark.createDataFrame(odd, schema)))
    assert got[None][:7] == (0, 2, 0, 0, 1, 4, "DD")
    assert got[1][:7] == (0, 0, 1, 0, 1, 2, "KKD")
    none = spark.createDataFrame([], schema)
    assert A.repair(none).count() == 0 and A.repair(A.damage(none)).count() == 0
    far = spark.createDataFrame([(1, -(2**62), "user", "a."), (1, 2**62 + 5, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    assert results(A.repair(far))[1][0] == 2**63 + 4 - 2**64
