"""Quality rules on how well public tokenizers fit a text.

A vocabulary that was made for a script and kind of text covers it with long tokens, seldom falls
back to single bytes, and uses many different tokens. Each text is measured with
each vocabulary: characters per token, share of byte-fallback tokens, and entropy of the tokens in bits.
Rejection bands hold per script (the script of most of the text's letters); a language
can be given narrower ones, and so can a vocabulary. Bands are fixed parameters that do not depend on the corpus or
its size: prose, of rare or made-up words too, has more characters a token than letters at
random, which also use more different tokens, and letters of a script that a vocabulary knows seldom fall
back to bytes. The piece vocabulary is measured word by word, as it never joins words.

Base rules come first: fewer than 50 words, or over half of the words in repeated three-word
windows. Everything is one pass over the rows, whatever the table's skew; a worker keeps the
measured pieces of words it has seen, up to a fixed number.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.llm.tokens import encoder, in_slices

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Words whose pieces a worker keeps; bounds memory, never changes a measure.
CACHE_WORDS = 200_000


@dataclass(frozen=True)
class Band:
    """A text stays if all of its measures lie inside."""

    least_chars_per_token: float = 0.0
    most_chars_per_token: float = float("inf")
    most_byte_share: float = 1.0
    least_entropy: float = 0.0
    most_entropy: float = float("inf")


#: By language code or script name, the language first, a key with a vocabulary's name before one without;
#: ``*`` is for all others. Random letters have 1.5 characters a token or less and over 7.3 bits of
#: entropy, random ideographs 0.35 characters and a byte share over 0.85, random Arabic letters a
#: quarter of byte pieces. Prose in the languages named has more characters a token than its limit.
BANDS: dict[str, Band] = {
    "en": Band(1.66, 12.0, 0.10, 2.5, 8.5),
    "de": Band(1.60, 14.0, 0.20, 2.5, 8.5),
    "fr": Band(1.45, 12.0, 0.25, 2.5, 8.5),
    "fr:piece": Band(1.53, 12.0, 0.25, 2.5, 8.5),
    "es": Band(1.45, 12.0, 0.25, 2.5, 8.5),
    "es:piece": Band(1.50, 12.0, 0.25, 2.5, 8.5),
    "LATIN": Band(1.45, 12.0, 0.25, 2.5, 9.5),
    "CYRILLIC": Band(0.8, 12.0, 0.6, 2.5),
    "CYRILLIC:piece": Band(1.2, 12.0, 0.2, 2.5),
    "GREEK": Band(0.5, 12.0, 0.9, 2.5),
    "ARABIC": Band(0.5, 12.0, 0.7, 2.5),
    "ARABIC:piece": Band(0.5, 12.0, 0.15, 2.5),
    "CJK": Band(0.3, 16.0, 0.8, 2.5),
    "CJK:piece": Band(0.45, 16.0, 0.5, 2.5),
    "*": Band(0.2, 16.0, 1.0, 2.0),
}

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, lang string"


@lru_cache(maxsize=20_000)
def _script(char: str) -> str | None:
    return unicodedata.name(char, "?").split(" ")[0] if char.isalpha() else None


def script_of(text: str) -> str:
    """Script of most letters, the alphabetically first among ties; ``NONE`` without letters."""
    counts: dict[str, int] = {}
    for char in set(text):
        script = _script(char)
        if script is not None:
            counts[script] = counts.get(script, 0) + text.count(char)
    return min(counts, key=lambda s: (-counts[s], s)) if counts else "NONE"


class Words:
    """Words of many texts: the distinct ones, each word's place among these, and where a text's begin."""

    def __init__(self, texts: pa.Array):
        parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = pc.dictionary_encode(parts.flatten())
        codes, at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(parts.offsets)
        self.listed = coded.dictionary.to_pylist()
        if "" in self.listed:  # beside blanks at an end
            real = codes != self.listed.index("")
            at = np.concatenate([[0], np.cumsum(real)])[at]
            codes = codes[real]
        self.codes, self.at = codes, at

    def repeats(self, k: int) -> int:
        """Words of a text that lie in three-word windows found twice or more."""
        ids, room = self.codes[self.at[k] : self.at[k + 1]], len(self.listed)
        if len(ids) < 3:
            return 0
        if room >= 1 << 21:  # three numbers have to fit in 63 bits
            ids = np.unique(ids, return_inverse=True)[1]
            pairs = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)[1]
            windows = pairs[:-1] * (ids.max() + 1) + ids[2:]
        else:
            windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
        _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
        if len(counts) == len(windows):
            return 0
        twice = counts[which] > 1
        hit = np.zeros(len(ids), dtype=bool)
        for j in range(3):
            hit[j : j + len(twice)] |= twice
        return int(hit.sum())


class Pieces:
    """Tokens of texts under one vocabulary: of each word (sentencepiece, with a cache of words) or of
    the whole text (tokenizers)."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.limit, self.known = cache_words, {}
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self._model, size = model, model.get_piece_size()
            fallback = [i for i in range(size) if model.is_byte(i) or model.is_unknown(i)]
        else:
            self._model, self._encoder = None, encoder(path)
            vocabulary = self._encoder.tokenizer.get_vocab()
            size = max(vocabulary.values()) + 1
            # Of a byte-level vocabulary: single bytes that are no ASCII character on their own.
            fallback = [i for t, i in vocabulary.items() if len(t) == 1 and ord(t) > 126 and t not in ("Ġ", "Ċ")]
        self.fallback = np.zeros(size, dtype=bool)
        self.fallback[fallback] = True

    def _by_word(self, listed: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        if len(self.known) > self.limit:
            self.known.clear()
        new = [w for w in listed if w not in self.known]
        for word, ids in zip(new, self._model.encode(new, num_threads=1) if new else []):
            self.known[word] = np.array(ids, dtype="<u4").tobytes()
        found = [self.known[w] for w in listed]
        return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4

    def _ids(self, texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's begin."""
        if self._model is None:
            return self._encoder.encode(texts)
        ids, sizes = self._by_word(words.listed)
        starts, own = np.concatenate([[0], np.cumsum(sizes)]), sizes[words.codes]
        reached = np.concatenate([[0], np.cumsum(own)])
        where = np.repeat(starts[words.codes] - reached[:-1], own) + np.arange(reached[-1])
        return ids[where], reached[words.at]

    def measure(self, texts: list[str] | pa.Array, words: list[list[str]] | Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, byte-fallback tokens and entropy of each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        words = words if isinstance(words, Words) else Words(texts)
        tokens, singles, entropy = (np.zeros(len(texts)) for _ in range(3))
        ids, at = self._ids(texts, words)
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if b > a:
                own = np.sort(ids[a:b])
                edges = np.flatnonzero(own[1:] != own[:-1]) + 1
                counts = np.diff(edges, prepend=0, append=b - a)
                tokens[k], singles[k] = b - a, self.fallback[own].sum()
                entropy[k] = np.log2(b - a) - (counts * np.log2(counts)).sum() / (b - a)
        return tokens, singles, entropy


_PIECES: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def base_counts(text: str) -> tuple[int, int, int]:
    """word_chars, n_symbols and n_dup_lines of a text."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


def measured(docs: DataFrame, vocabularies: Mapping[str, str]) -> DataFrame:
    """Counts of the base rules, the script, and per vocabulary name its three measures."""
    names = sorted(vocabularies)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, size=2_000_000):
            column = batch.column("text")
            texts, words = column.to_pylist(), Words(column)
            base = [base_counts(t) for t in texts]
            columns = [
                batch.column("doc_id"),
                pa.array(np.diff(words.at), pa.int64()),
                *(pa.array([b[i] for b in base], pa.int64()) for i in range(3)),
                pa.array([words.repeats(k) for k in range(len(texts))], pa.int64()),
                pa.array([script_of(t) for t in texts]),
                batch.column("lang"),
            ]
            chars = np.array([b[0] for b in base], dtype=float)
            for name in names:
                tokens, singles, entropy = _pieces(vocabularies[name]).measure(column, words)
                some = np.maximum(tokens, 1)
                columns += [pa.array(chars / some), pa.array(singles / some), pa.array(entropy)]
            yield pa.RecordBatch.from_arrays(columns, fields)

    more = [f"{name}_{what}" for name in names for what in ("chars_per_token", "byte_share", "entropy")]
    fields = [f.split(" ")[0] for f in MEASURES.split(", ")] + more
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), lang.cast("string").alias("lang"))
    return rows.mapInArrow(measure, MEASURES + "".join(f", {m} double" for m in more))


def _inside(name: str, band: Band):
    per_token = F.col(f"{name}_chars_per_token")
    return (
        (per_token >= band.least_chars_per_token)
        & (per_token <= F.lit(band.most_chars_per_token))
        & (F.col(f"{name}_byte_share") <= band.most_byte_share)
        & (F.col(f"{name}_entropy") >= band.least_entropy)
        & (F.col(f"{name}_entropy") <= F.lit(band.most_entropy))
    )


def judge(docs: DataFrame, vocabularies: Mapping[str, str], bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """One row per document: the measures, base_failed, and kept.

    Words lie between ASCII white space. A document is kept if no base rule fails and, under every
    vocabulary, its measures lie in the band of its ``lang`` if ``bands`` names it (and ``docs`` has such a column), else in
    that of its script. Null and empty texts have no words and fail, very long texts are measured whole. Repeated rows and null doc_ids
    each keep their row; other columns, whatever their names, are not read; an empty table gives no rows.
    """
    found = measured(docs, vocabularies)
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)

    def of(key: str):
        known = lambda name: bands.get(f"{key}:{name}", bands.get(key, Band()))
        return _all(_inside(name, known(name)) for name in sorted(vocabularies))

    verdict = of("*")
    # Languages, in lower case, come before scripts: the last condition built is the first one asked.
    for key in sorted({k.split(":")[0] for k in bands} - {"*"}, key=lambda k: (k.islower(), k)):
        own = F.col("lang") if key.islower() else F.col("script")
        verdict = F.when(own == key, of(key)).otherwise(verdict)
    return found.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & verdict)


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
