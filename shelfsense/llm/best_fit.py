"""Packing documents into sequences by bulk-synchronous best fit, longest first.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. Pieces are range-sorted
by length, and so are the gaps left in open sequences. Packing goes in rounds, one per run of
equally long pieces, longest first: a sweep finds the successor of the length among the gaps (the
least gap that holds it), a whole run of pieces meets a whole run of equal gaps at once, conflicts
inside the runs are settled by rank (the r-th piece of the run takes the r-th free place), the gaps
shrink, and the sweep repeats until every piece of the run has a place; where no gap holds it, new
sequences open. This gives exactly the sequences of best-fit decreasing.

Equal lengths make the rounds cheap: what a round needs of the pieces is how many there are of its
length, at most ``capacity`` counts in all, whatever the size of the corpus. The rows themselves are
never gathered: ranks inside a length come from a range-partitioned layout in equal chunks (a length
that a third of all pieces share is spread like any other), and each row finds its place from its
own (length, rank) in the list of runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.llm.common import Scratch
from shelfsense.llm.tokens import encoder, ids_crc32, in_slices
from shelfsense.operators.ordered import positions

CAPACITY = 2048
END_ID = 0

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Encode whole texts, append the end id, and cut what is longer than ``capacity``.

    Only the first piece of a long document may be shorter, so a document of n tokens has
    ceil(n / capacity) pieces. ``ids=True`` adds each piece's ids as an array.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in in_slices(batches):
            found, at = encode(batch.column("text"))
            doc, piece, start, length, crc, lists = [], [], [], [], [], []
            for d, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                own = np.append(found[a:b], np.uint32(END_ID))
                edges = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                for k, (s, e) in enumerate(zip(edges, edges[1:])):
                    doc.append(d)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(ids_crc32(own[s:e]))
                    if ids:
                        lists.append(own[s:e].astype(np.int32))
            columns = [
                pa.array(doc, pa.int64()),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, _PIECES + (", ids array<int>" if ids else ""))


def plan_runs(counts: Mapping[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Places for ``counts[length]`` pieces of each length, as runs in (length, rank) order.

    Rows: length, first rank, first sequence, pieces per sequence, offset in the sequence. The piece
    of rank r goes to sequence ``first + (r - rank) // per`` at ``offset + (r - rank) % per * length``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of open sequences (first, how many)
    room = np.zeros(capacity + 1, dtype=bool)  # gaps that some sequence has
    opened, runs = 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            ahead = room[length:]
            gap = length + int(ahead.argmax()) if ahead.any() else 0
            if gap:
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    room[gap] = False
            else:
                gap = capacity
                first, many = opened, -(-left // (capacity // length))
                opened += many
            per = gap // length
            placed = min(left, many * per)
            runs.append((length, rank, first, per, capacity - gap))
            full, rest = divmod(placed, per)
            for after, start, n in (
                (gap - per * length, first, full),
                (gap - rest * length, first + full, 1 if rest else 0),
                (gap, first + full + bool(rest), many - full - bool(rest)),
            ):
                if n and after:
                    gaps.setdefault(after, []).append((start, n))
                    room[after] = True
            rank += placed
            left -= placed
    runs.sort()
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored rows with a ``length`` of 1 to ``capacity``.

    ``pieces`` is read several times and must give the same rows each time: pass a written table.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = plan_runs(counts, capacity)
    keys = (runs[:, 0] << 48) + runs[:, 1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rows_before").to_numpy()
            _, first_rank, first, per, offset = runs[np.searchsorted(keys, (length << 48) + rank, side="right") - 1].T
            k = rank - first_rank
            kept = [(n, batch.column(n)) for n in batch.schema.names if n != "rows_before"]
            kept += [("sequence_id", pa.array(first + k // per)), ("offset", pa.array(offset + k % per * length))]
            yield pa.RecordBatch.from_arrays([c for _, c in kept], [n for n, _ in kept])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    ranked = positions(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], totals=False)
    return ranked.mapInArrow(placed, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens: one row per piece.

    Null and empty texts are one end id, a piece of length 1. Rows with the same doc_id are packed
    separately; null doc_ids are kept. Very long texts are cut, never shortened. Other columns,
    whatever their names, are not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    return pack(scratch.keep(cut_pieces(docs, vocabulary, capacity), "pieces"), capacity)
