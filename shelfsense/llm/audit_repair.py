"""Conversation structure repair by a persistent dynamic programme over edits.

Each row of a conversation is kept, given the role user or assistant, or deleted, and empty turns
may be inserted, so that the roles read ``(s?(ua)+)?``; the cheapest edits win, ties by the least audit, the string
of their initials. Four states (nothing yet, system, user, assistant) each hold the cheapest audit that
leads there. Audits share their prefixes: an audit is a node with a link to the one it extends,
a rolling hash, and links to its ancestors 1, 2, 4, ... edits back. Two audits of equal cost are
compared by a binary search over these links for their longest common prefix; the hashes that
this relies on are verified by walking back to the node both share, so a collision cannot change a result.

No conversation is gathered. Rows are range-partitioned by (conversation, turn), so that a long conversation
covers many tasks, and walked in order. A stretch of a conversation gives the cheapest audit from each state
to each state; stretches are composed one after the other (equal costs: the least concatenation, which is
sound, as of two audits of equal cost and state neither begins with the other). Only the digest
of a repaired text that spans stretches has to be taken in one stream, row by row, as SHA-256 is defined so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsense.llm.common import Scratch

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: A stretch of a conversation ends at so many rows or characters; composing makes up for it.
STRETCH_ROWS, STRETCH_CHARS = 20_000, 50_000_000
#: Repeated (conversation, role, text) digests that are joined by broadcast, some 40 bytes each.
BROADCAST_REPEATS = 1_000_000

_BLANKS = " \t\n\v\f\r"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
# The state that a kept role leads to, and the one that a new user or assistant turn leads to.
_KEPT = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}

_BASE, _PRIME = 1_000_003, (1 << 61) - 1
# A node: last edit, number of edits, rolling hash, ancestors 1, 2, 4, ... edits back.
_ROOT = ("", 0, 0, ())


def _extended(node: tuple, edit: str) -> tuple:
    ups, k = [node], 0
    while len(ups[k][3]) > k:
        ups.append(ups[k][3][k])
        k += 1
    return edit, node[1] + 1, (node[2] * _BASE + ord(edit)) % _PRIME, tuple(ups)


def _lifted(node: tuple, depth: int) -> tuple:
    while node[1] > depth:
        node = node[3][(node[1] - depth).bit_length() - 1]
    return node


def _less(x: tuple, y: tuple) -> bool:
    """The audit of ``x`` comes before that of ``y``."""
    depth = min(x[1], y[1])
    a, b = _lifted(x, depth), _lifted(y, depth)
    found = None
    if a[2] != b[2]:
        for k in range(len(a[3]) - 1, -1, -1):
            if k < len(a[3]) and a[3][k][2] != b[3][k][2]:
                a, b = a[3][k], b[3][k]
        found = a[0], b[0]
        a, b = a[3][0], b[3][0]
    while a is not b:  # equal by their hashes; a difference further back would be a collision
        if a[0] != b[0]:
            found = a[0], b[0]
        a, b = a[3][0], b[3][0]
    return x[1] < y[1] if found is None else found[0] < found[1]


def audit_text(node: tuple) -> str:
    edits = []
    while node[1]:
        edits.append(node[0])
        node = node[3][0]
    return "".join(reversed(edits))


def _offer(cells: list, state: int, cost: int, node: tuple, edit: str) -> None:
    old = cells[state]
    if old is None or cost < old[0]:
        cells[state] = (cost, node, edit)
    elif cost == old[0] and _less(_extended(node, edit), _extended(old[1], old[2]) if old[2] else old[1]):
        cells[state] = (cost, node, edit)


def _settled(cells: list) -> list:
    return [c and ((c[0], _extended(c[1], c[2]), "") if c[2] else c) for c in cells]


def _inserted(cells: list) -> list:
    """Cells after any inserts. A turn inserted twice over leads nowhere that costs less."""
    out = list(cells)
    for state in (_START, _SYSTEM, _ASSISTANT):
        if cells[state]:
            _offer(out, _USER, cells[state][0] + INSERT_COST, cells[state][1], INSERT)
    if out[_USER] and out[_USER][2]:
        out[_USER] = (out[_USER][0], _extended(out[_USER][1], out[_USER][2]), "")
    if out[_USER]:
        _offer(out, _ASSISTANT, out[_USER][0] + INSERT_COST, out[_USER][1], INSERT)
    return _settled(out)


def _after(cells: list, initial: str, bad: bool, extra: int) -> list:
    """Cells after one more row; ``bad`` rows can only be deleted, others that stay cost ``extra``."""
    out: list = [None] * 4
    for state, cell in enumerate(_inserted(cells)):
        if cell:
            cost, node, _ = cell
            _offer(out, state, cost + DELETE_COST, node, DELETE)
            if not bad:
                kept = _KEPT[state].get(initial)
                if kept:
                    _offer(out, kept, cost + extra, node, KEEP)
                _offer(out, _NEXT[state], cost + REROLE_COST + extra, node, REROLE)
    return _settled(out)


def cheapest(rows: Iterable[tuple[str, bool, int]], start: int = _START) -> list:
    """Cells (cost, node) after all ``rows`` of initial, bad, extra cost, begun in ``start``."""
    cells: list = [None] * 4
    cells[start] = (0, _ROOT, "")
    for initial, bad, extra in rows:
        cells = _after(cells, initial, bad, extra)
    return [c and c[:2] for c in cells]


def accepted(cells: list) -> tuple[int, str]:
    """Cost and audit of a whole conversation with these cells at its end."""
    ended = _inserted([c and (*c, "") for c in cells])
    best = min(c[0] for c in (ended[_START], ended[_ASSISTANT]) if c)
    nodes = [c[1] for c in (ended[_START], ended[_ASSISTANT]) if c and c[0] == best]
    node = nodes[0] if len(nodes) == 1 or _less(nodes[0], nodes[1]) else nodes[1]
    return best, audit_text(node)


def replayed(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The repaired conversation, a ``role:text`` at a time, from an audit and the rows it was made for."""
    state = _START
    for edit in audit:
        if edit == INSERT:
            state = _NEXT[state]
            yield _ROLE[state] + ":"
            continue
        role, text = next(rows)
        if edit == REROLE:
            state = _NEXT[state]
            yield f"{_ROLE[state]}:{text}"
        elif edit == KEEP:
            state = _KEPT[state][role[:1]]
            yield f"{role}:{text}"


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT_TYPES = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
_STRETCH = f"conv_id long, task int, part int, open boolean, {_RESULT}, first_turn long, last_turn long, turns long, first_initial string, last_initial string, costs array<long>, audits array<string>"
_STRETCH_TYPES = pa.schema(
    [("conv_id", pa.int64()), ("task", pa.int32()), ("part", pa.int32()), ("open", pa.bool_()), *_RESULT_TYPES]
    + [(n, pa.int64()) for n in ("first_turn", "last_turn", "turns")]
    + [("first_initial", pa.string()), ("last_initial", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)
_ORDER = ("conv_id", "turn", "role", "d1", "d2")


def _long(n: int) -> int:
    """Within 64 bits, as sums of longs are."""
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else _long(last - first + 1 - turns)


class _Stretch:
    """Rows of one conversation that follow each other, and what is counted of them."""

    def __init__(self):
        self.rows, self.texts, self.chars, self.lost = [], [], 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        body, initial = text.rstrip(_BLANKS), role[:1]
        blank = not body
        cut = not blank and not again and body[-1] not in ".!?"
        self.blank += blank
        self.duplicate += not blank and again
        self.truncated += cut
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.last_initial is None:
            self.first_initial = initial
        else:
            self.illegal += self.last_initial + initial not in _LEGAL
        self.last_initial = initial
        self.rows.append((initial, blank or again, TRUNCATED_COST if cut else 0))
        self.texts.append((role, text))
        self.chars += len(text)

    def summary(self, conv_id: int | None, task: int, part: int, open_: bool) -> dict:
        cost, audit = accepted(cheapest(self.rows))
        lines = "\n".join(replayed(audit, iter(self.texts)))
        out = {n: getattr(self, n) for n in ("blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns", "first_initial", "last_initial")}
        out |= {"conv_id": conv_id, "task": task, "part": part, "open": open_, "cost": cost, "audit": audit}
        out |= {"gaps": _gaps(self.first_turn, self.last_turn, self.turns), "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest()}
        if open_:
            cells = [c for start in range(4) for c in cheapest(self.rows, start)]
            out |= {"costs": [c and c[0] for c in cells], "audits": [c and audit_text(c[1]) for c in cells]}
        return out


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row per stretch. Those at the task's ends, and parts of long ones, are open."""
    task, out = TaskContext.get().partitionId(), []
    current, conv, part, first, before = None, None, 0, True, None
    for batch in batches:
        for conv_id, turn, role, text, lost, d1, d2, repeated, first_turn in zip(*(c.to_pylist() for c in batch.columns)):
            if current is None or conv_id != conv:
                if current:
                    out.append(current.summary(conv, task, part, first or part > 0))
                    first = False
                current, conv, part, before = _Stretch(), conv_id, 0, None
            elif len(current.rows) >= STRETCH_ROWS or current.chars >= STRETCH_CHARS:
                out.append(current.summary(conv, task, part, True))
                current, part = _Stretch(), part + 1
            if not lost:
                own = (turn, role, d1, d2)
                current.add(turn, role, text, repeated and (turn != first_turn or own == before))
                before = own
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=_STRETCH_TYPES)
                out = []
    if current:
        out.append(current.summary(conv, task, part, True))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_STRETCH_TYPES)


class _Composed:
    """Stretches of one conversation, one after the other. Cells hold (cost, rope): a rope is a
    stretch's audit with a link to what comes before it."""

    def __init__(self):
        self.cells: list = [(0, ("", None, 0)), None, None, None]
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.first_turn = self.last_turn = self.last_initial = self.digest = None
        self.parts = 0

    @staticmethod
    def _text(rope: tuple, depth: int = 0) -> str:
        parts = []
        while rope[2] > depth:
            parts.append(rope[0])
            rope = rope[1]
        return "".join(reversed(parts))

    def _least(self, found: list) -> tuple | None:
        if not found:
            return None
        low = min(cost for cost, _ in found)
        ropes = [rope for cost, rope in found if cost == low]
        if len(ropes) > 1:
            shared = list(ropes)
            while any(r is not shared[0] for r in shared):  # all ropes here have as many links
                shared = [r[1] for r in shared]
            ropes.sort(key=lambda r: self._text(r, shared[0][2]))
        return low, ropes[0]

    def add(self, row: dict) -> None:
        for n in self.counts:
            self.counts[n] += row[n]
        if row["first_turn"] is not None:
            self.counts["turns"] -= row["first_turn"] == self.last_turn
            self.first_turn = row["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = row["last_turn"]
        if row["first_initial"] is not None:
            self.counts["illegal"] += self.last_initial is not None and self.last_initial + row["first_initial"] not in _LEGAL
            self.last_initial = row["last_initial"]
        ways: list[list] = [[], [], [], []]
        for s, cell in enumerate(self.cells):
            for t in range(4):
                if cell and row["costs"][4 * s + t] is not None:
                    ways[t].append((cell[0] + row["costs"][4 * s + t], (row["audits"][4 * s + t], cell[1], cell[1][2] + 1)))
        self.cells = [self._least(w) for w in ways]
        self.parts += 1
        self.digest = row["repaired_sha256"]

    def result(self, conv_id: int | None) -> dict:
        ended = [(c[0] + INSERT_COST * n, (INSERT * n, c[1], c[1][2] + 1)) for c, n in zip(self.cells, (0, 2, 1, 0)) if c]
        cost, rope = self._least(ended)
        out = {"conv_id": conv_id, "parts": self.parts, "gaps": _gaps(self.first_turn, self.last_turn, self.counts["turns"]), "cost": cost, "audit": self._text(rope)}
        out |= {n: self.counts[n] for n in ("blank", "duplicate", "truncated", "illegal")}
        return out | {"repaired_sha256": self.digest if self.parts == 1 else None}


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("parts", pa.int64()), *_RESULT_TYPES])
    current, conv = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if current is None or row["conv_id"] != conv:
                if current:
                    yield pa.RecordBatch.from_pylist([current.result(conv)], schema=schema)
                current, conv = _Composed(), row["conv_id"]
            current.add(row)
    if current:
        yield pa.RecordBatch.from_pylist([current.result(conv)], schema=schema)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of repaired texts, streamed: a row with the audit comes before a conversation's rows."""
    schema = pa.schema([("d_conv", pa.int64()), ("digest", pa.string())])

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(n).to_pylist() for n in ("conv_id", "audit", "role", "text")))

    feed = rows()
    ahead = next(feed, None)
    while ahead is not None:
        conv, audit = ahead[0], ahead[1]

        def own():
            nonlocal ahead
            while (ahead := next(feed, None)) is not None and ahead[1] is None:
                yield ahead[2], ahead[3]

        digest, first, turns = hashlib.sha256(), True, own()
        for line in replayed(audit, turns):
            digest.update((line if first else "\n" + line).encode())
            first = False
        for _ in turns:  # an audit has an edit for every row; this only moves on
            pass
        yield pa.RecordBatch.from_pylist([{"d_conv": conv, "digest": digest.hexdigest()}], schema=schema)


def damage(rows: DataFrame) -> DataFrame:
    """The test damage: ``rows`` with role and text damaged by the CRC-32 of ``conv_id:turn``, nulls as one
    blank, repeated rows twice, and ``lost`` true on rows that are dropped."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("lost"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def repair(rows: DataFrame, lost: Column | None = None) -> DataFrame:
    """One row per conversation: conv_id, its faults, and its cheapest repair.

    ``rows`` has conv_id, turn, role and text; rows for which ``lost`` holds only name their conversation. Rows
    without conv_id are one conversation, null turns come first, rows of one turn go by role and a digest of the
    text, null roles and texts count as one blank, and an empty
    role is none that can stay. Empty and blank texts are blank rows, later rows of equal
    role and text duplicates, repeated rows too. Very long texts and conversations are read whole.
    Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "audit")
    blank, gone = F.lit(" "), F.lit(False) if lost is None else F.coalesce(lost, F.lit(False))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    own = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        gone.alias("lost"), F.xxhash64(role, text).alias("d1"), F.xxhash64(F.lit(1), text, role).alias("d2"),
    )
    repeats = own.filter("not lost").groupBy("conv_id", "d1", "d2").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeats = repeats.select(F.col("conv_id").alias("r_conv"), F.col("d1").alias("r1"), F.col("d2").alias("r2"), F.col("first.turn").alias("first_turn"), F.lit(True).alias("repeated"))
    repeats = scratch.keep(repeats, "repeats")
    few = F.broadcast(repeats) if repeats.count() <= BROADCAST_REPEATS else repeats
    match = F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("d1") == F.col("r1")) & (F.col("d2") == F.col("r2"))
    marked = own.join(few, match, "left").select(*own.columns, F.coalesce("repeated", F.lit(False)).alias("repeated"), "first_turn")
    laid = marked.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    found = scratch.keep(laid.mapInArrow(_walked, _STRETCH), "stretches")

    results = ["conv_id", *[f.split()[0] for f in _RESULT.split(", ")]]
    open_ = found.filter("open").repartition("conv_id").sortWithinPartitions("conv_id", "task", "part")
    whole = scratch.keep(open_.mapInArrow(_composed, f"conv_id long, parts long, {_RESULT}"), "composed")
    long = whole.filter("parts > 1").select(F.col("conv_id").alias("l_conv"), F.col("audit").alias("l_audit"))
    if not long.isEmpty():
        rest = own.filter("not lost").join(long.select("l_conv"), F.col("conv_id").eqNullSafe(F.col("l_conv")), "left_semi")
        heads = long.select(F.col("l_conv").alias("conv_id"), F.col("l_audit").alias("audit"))
        streams = heads.unionByName(rest, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_ORDER[1:])
        digests = scratch.keep(streams.select("conv_id", "audit", "role", "text").mapInArrow(_digested, "d_conv long, digest string"), "digests")
        joined = whole.join(digests, F.col("conv_id").eqNullSafe(F.col("d_conv")), "left")
        whole = joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", "digest"))
    return found.filter("not open").select(*results).unionByName(whole.select(*results))
