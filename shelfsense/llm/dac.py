"""Token-id files of directly addressable codes.

An id is split into 8-bit chunks, low bits first. Level k holds the k-th chunks of all ids that have
one, a bitmap that tells which of them continue, and a rank directory (the number of continuing ids
before every 512th). The chunk of an id on the next level lies at its rank among the continuing
ones, so any token is found with one byte, one bitmap block and one directory entry per level: no
block is decoded, and frequent small ids take fewer bytes.

A dataset is a folder of segment files plus a manifest table. Documents are range-partitioned by
doc_id; each task encodes its range and writes one segment per ``segment_tokens`` tokens, whole
documents in ascending order. A segment gets a name of its own for every attempt and counts only
once its manifest row is committed by Spark, so a task that is lost and run again leaves no trace
in what readers see. First token numbers come from running sums over the manifest, a row per segment.

File layout, little-endian, sections aligned to 8 bytes:
magic ``DACSEG01``; counts n_docs, n_tokens, n_levels; per level: number of chunks; doc_ids
(8 bytes each); null flags of doc_ids (a byte each); document starts (n_docs + 1, 8 bytes each);
per level: chunks (a byte each), bitmap, rank directory (8 bytes each).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfsense.llm.tokens import encoder, ids_crc32, in_slices

MAGIC = b"DACSEG01"
END_ID = 0
SEGMENT_TOKENS = 4_000_000
RANK_BLOCK = 512

_MANIFEST = "task int, part int, file string, n_docs long, n_tokens long, n_bytes long"


def _pad(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def build(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one segment; ``starts`` has the first token of each document and the total."""
    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        more = rest > 0xFF
        ranks = np.concatenate([[0], np.cumsum(more)])[:-1:RANK_BLOCK] if len(more) else np.zeros(0)
        levels.append((rest.astype(np.uint8).tobytes(), np.packbits(more, bitorder="little").tobytes(), ranks.astype("<u8").tobytes()))
        if not more.any():
            break
        rest = rest[more] >> 8
    head = np.array([len(doc_ids), len(ids), len(levels), *(len(x[0]) for x in levels)], dtype="<u8").tobytes()
    known = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()
    nulls = bytes(d is None for d in doc_ids)
    return MAGIC + head + known + _pad(nulls) + np.asarray(starts, dtype="<u8").tobytes() + b"".join(_pad(s) for x in levels for s in x)


class Segment:
    """Random access to a segment through ``read(offset, size)``, such as a ranged file read."""

    def __init__(self, read):
        self._read = read
        if read(0, 8) != MAGIC:
            raise ValueError("not a segment file")
        self.n_docs, self.n_tokens, n_levels = (int(x) for x in self._numbers(8, 3, "<u8"))
        sizes = [int(x) for x in self._numbers(32, n_levels, "<u8")]
        at = 32 + 8 * n_levels
        self._docs, at = at, at + 8 * self.n_docs
        self._nulls, at = at, at + self.n_docs + -self.n_docs % 8
        self._starts, at = at, at + 8 * (self.n_docs + 1)
        self._levels = []
        for n in sizes:
            chunks, at = at, at + n + -n % 8
            bits = -(-n // 8)
            bitmap, at = at, at + bits + -bits % 8
            ranks, at = at, at + 8 * -(-n // RANK_BLOCK)
            self._levels.append((n, chunks, bitmap, ranks))

    def _numbers(self, at: int, n: int, kind: str) -> np.ndarray:
        return np.frombuffer(self._read(at, n * np.dtype(kind).itemsize), dtype=kind)

    def token(self, i: int) -> int:
        """The i-th id, from a few bytes per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for _, chunks, bitmap, ranks in self._levels:
            value |= self._read(chunks + i, 1)[0] << shift
            block = i // RANK_BLOCK
            first = block * RANK_BLOCK // 8
            bits = self._read(bitmap + first, i // 8 - first + 1)
            if not bits[-1] >> (i % 8) & 1:
                break
            before = int.from_bytes(bits, "little") & ((1 << (i - block * RANK_BLOCK)) - 1)
            i = int(self._numbers(ranks + 8 * block, 1, "<u8")[0]) + before.bit_count()
            shift += 8
        return value

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """doc_ids and first tokens (one entry more, the total)."""
        known = self._numbers(self._docs, self.n_docs, "<i8").tolist()
        nulls = self._read(self._nulls, self.n_docs)
        return [None if null else d for d, null in zip(known, nulls)], self._numbers(self._starts, self.n_docs + 1, "<u8").astype(np.int64)

    def all_tokens(self) -> np.ndarray:
        """Every id, level by level."""
        out, where = np.zeros(self.n_tokens, dtype="<u4"), None
        for k, (n, chunks, bitmap, _) in enumerate(self._levels):
            part = np.frombuffer(self._read(chunks, n), dtype=np.uint8).astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(np.frombuffer(self._read(bitmap, -(-n // 8)), dtype=np.uint8), count=n, bitorder="little").astype(bool)
            if where is None:
                out[:] = part
                where = np.flatnonzero(more)
            else:
                out[where] |= part
                where = where[more]
        return out


def open_segment(file: str) -> tuple[Segment, pa.NativeFile]:
    store, path = fs.FileSystem.from_uri(file)
    handle = store.open_input_file(path)
    return Segment(lambda at, size: handle.read_at(size, at)), handle


def write_dataset(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) and write segments and manifest to ``folder``.

    ``folder`` is shared by all executors and has a scheme that pyarrow's file systems know.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary).encode, TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        docs, starts, parts, total, part = [], [0], [], 0, 0

        def flush():
            data = build(docs, np.array(starts), np.concatenate(parts) if parts else np.zeros(0, dtype="<u4"))
            name = f"segment-{task:06d}-{part:04d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            row = {"task": task, "part": part, "file": name, "n_docs": len(docs), "n_tokens": total, "n_bytes": len(data)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("task", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in in_slices(batches):
            found, at = encode(batch.column("text"))
            for d, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                docs.append(d)
                parts.append(np.append(found[a:b], np.uint32(end_id)))
                total += b - a + 1
                starts.append(total)
                if total >= segment_tokens:
                    yield flush()
                    docs, starts, parts, total, part = [], [0], [], 0, part + 1
        if docs:
            yield flush()

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Ties of doc_id are put in the order of their texts.
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    ordered.mapInArrow(written, _MANIFEST).write.parquet(f"{folder}/manifest")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a dataset: doc_id, start, n_tokens, ids_crc32, in one row each, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                segment, handle = open_segment(f"{folder}/{file}")
                with handle:
                    docs, starts = segment.documents()
                    ids = segment.all_tokens()
                crc = [ids_crc32(ids[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(before + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    along = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", F.coalesce(F.sum("n_tokens").over(along), F.lit(0)).alias("before"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(width, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, folder: str, vocabulary: str) -> DataFrame:
    """Write ``docs`` as a dataset in ``folder`` and return its documents as read back.

    Null and empty texts are one end id. Rows with the same doc_id follow each other in the order of
    their texts; null doc_ids come first and read back as null. Other columns, whatever their names,
    are not read. An empty table gives a dataset without segments and no rows.
    """
    write_dataset(docs, folder, vocabulary)
    return read_documents(docs.sparkSession, folder)
