"""Token ids of whole texts, encoded chunk by chunk with a cache of chunks already encoded.

A byte-level BPE with the usual splitting pattern never merges across the last white-space
character before a word: ``"a  b"`` is ``"a"``, ``" "``, ``" b"`` in any context. A text is
therefore cut before each such character, every distinct chunk is encoded by the library once
per worker, and the ids of the text are the ids of its chunks in order: the same ids as from
encoding the text in one call, in less time, as most chunks of a corpus repeat. Texts that
contain the string of a special token, texts with unusual white space, and tokenizers of any
other kind go through the library in one piece.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept by a worker before the half of them not seen for longest goes; bounds memory, never changes ids.
CACHE_CHUNKS = 300_000
#: Bytes of text encoded at a time.
SLICE_BYTES = 4_000_000

# Unicode's White_Space characters.
_SPACE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_IRREGULAR = f"[ \n][{_SPACE}]"
_WHOLE = "\t"  # marks a text's first chunk; other chunks lack their leading blank

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; its cache lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = cache_chunks
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        split = spec.get("pre_tokenizer") or {}
        self.by_chunk = (
            spec["model"].get("type", "BPE") == "BPE"
            and not spec["model"].get("dropout")
            and spec.get("normalizer") is None
            and spec.get("truncation") is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
        )
        if self.by_chunk:
            # One character of a byte-level token stands for one byte.
            size = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype="<u4")  # ids of all known chunks, one after the other
        self.ends = np.zeros(1 << 14, dtype=np.int64)  # where each chunk's ids end
        self.used = np.zeros(1 << 14, dtype=np.int64)  # when each chunk was last seen
        self.now = 0

    def _thin_out(self) -> None:
        """Keep the half of the known chunks seen last."""
        n = len(self.place)
        kept = np.sort(np.argsort(-self.used[:n], kind="stable")[: self.limit // 2])
        if not len(kept):
            return self._forget()
        first = np.where(kept > 0, self.ends[kept - 1], 0)
        sizes = self.ends[kept] - first
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])]
        known = list(self.place)
        self.place = {known[i]: k for k, i in enumerate(kept.tolist())}
        self.ids, self.ends, self.used = ids, ends, self.used[kept]

    def encode(self, texts: Sequence[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (unsigned 32-bit, None counts as empty) and, per text, where
        they start; the second array has one entry more than there are texts."""
        return self._over(texts, self._ids_by_chunk, self._whole, _flat)

    def count(self, texts: Sequence[str | None] | pa.Array) -> np.ndarray:
        """Number of ids of each text."""

        def whole(some: list[str]) -> list[int]:
            return [len(x) for x in self._whole(some)]

        def by_chunk(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            _, sizes, at = self._places(column)
            reached = np.concatenate([[0], np.cumsum(sizes)])
            return np.diff(reached[at]), np.arange(len(column) + 1)

        def flat(found: list) -> tuple[np.ndarray, np.ndarray]:
            return np.array([int(np.ravel(x)[0]) for x in found], dtype=np.int64), np.arange(len(found) + 1)

        return self._over(texts, by_chunk, whole, flat)[0]

    def _over(self, texts, by_chunk, whole, flat):
        """Deal the texts to the two ways of encoding and put the results in the texts' order."""
        given = texts if isinstance(texts, pa.Array) else pa.array(texts, type=pa.large_string())
        column = given.cast(pa.large_string()).fill_null("")
        if not self.by_chunk:
            return flat(whole(column.to_pylist()))
        odd = pc.match_substring_regex(column, _IRREGULAR)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(column, s))
        if not pc.any(odd).as_py():
            return by_chunk(column)
        out: list = [None] * len(column)
        mask = odd.to_numpy(zero_copy_only=False)
        found, at = by_chunk(column.filter(pc.invert(odd)))
        for k, i in enumerate(np.flatnonzero(~mask)):
            out[i] = found[at[k] : at[k + 1]]
        for i, x in zip(np.flatnonzero(mask), whole(column.filter(odd).to_pylist())):
            out[i] = x
        return flat(out)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _ids_by_chunk(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        first, sizes, at = self._places(column)
        reached = np.concatenate([[0], np.cumsum(sizes)])
        where = np.repeat(first - reached[:-1], sizes)
        where += np.arange(reached[-1])
        return self.ids[where], reached[at]

    def _places(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of every chunk's ids, and where each text's chunks start."""
        if len(self.place) > self.limit:
            self._thin_out()
        self.now += 1
        mark, nothing = pa.scalar(_WHOLE, column.type), pa.scalar("", column.type)
        marked = pc.binary_join_element_wise(mark, pc.replace_substring(column, "\n", " \n"), nothing)
        parts = pc.split_pattern(marked, " ")
        coded = pc.dictionary_encode(parts.flatten())
        words = coded.dictionary.to_pylist()
        place = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(place < 0)
        place[new] = self._learn([words[i] for i in new.tolist()])
        self.used[place] = self.now
        first = np.where(place > 0, self.ends[place - 1], 0)
        sizes = self.ends[place] - first
        which = coded.indices.to_numpy(zero_copy_only=False)
        return first[which], sizes[which], np.asarray(parts.offsets) - parts.offsets[0].as_py()

    def _learn(self, keys: list[str]) -> np.ndarray:
        """Encode new chunks, keep their ids, and return their places in the order of ``keys``."""
        plain = [k[:1] != _WHOLE and k not in ("", "\n") for k in keys]
        joined = [k for k, p in zip(keys, plain) if p]
        alone = [k for k, p in zip(keys, plain) if not p]
        out = np.empty(len(keys), dtype=np.int64)
        plain = np.array(plain, dtype=bool)
        out[plain] = self._add(joined, *self._joined([k if k[:1] == "\n" else " " + k for k in joined]))
        ids, at = _flat(self._whole([k[1:] if k[:1] == _WHOLE else k or " " for k in alone]))
        out[~plain] = self._add(alone, ids, at[1:])
        return out

    def _joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode chunks many at a time and cut the ids where each chunk's bytes end."""
        groups = ["".join(chunks[at : at + 64]) for at in range(0, len(chunks), 64)]
        ids, _ = _flat(self._whole(groups))
        reached = np.cumsum(self.n_bytes[ids])
        ends = np.cumsum(pc.binary_length(pa.array(chunks, type=pa.string())).to_numpy(zero_copy_only=False))
        at = np.searchsorted(reached, ends)
        if len(chunks) and (len(reached) == 0 or at[-1] >= len(reached) or not np.array_equal(reached[at], ends)):
            ids, at = _flat(self._whole(chunks))
            return ids, at[1:]
        return ids, at + 1

    def _add(self, keys: list[str], ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(self.place)
        start = int(self.ends[n - 1]) if n else 0
        self.ids = _room(self.ids, start + len(ids))
        self.ends, self.used = _room(self.ends, n + len(keys)), _room(self.used, n + len(keys))
        self.ids[start : start + len(ids)] = ids
        self.ends[n : n + len(keys)] = start + ends
        self.place.update(zip(keys, range(n, n + len(keys))))
        return np.arange(n, n + len(keys))


def in_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, a row at least."""
    for batch in batches:
        n = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(n, dtype=np.int64) // size
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(n)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _room(a: np.ndarray, size: int) -> np.ndarray:
    return a if size <= len(a) else np.concatenate([a, np.zeros(max(size, 2 * len(a)) - len(a), dtype=a.dtype)])


def _flat(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int64)
    return (np.concatenate(found) if found else np.zeros(0, dtype="<u4")), at


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
