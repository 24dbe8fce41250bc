"""Token counts through a cache of content digests.

A text's count depends on its bytes and on the tokenizer alone. Each text is normalised the way
the tokenizer sees it (here only: null becomes empty, as a count must not change) and digested
with SHA-256; the tokenizer version is the SHA-256 of its vocabulary file and library version.
Counts already stored under (version, digest) are joined; of the rest each distinct text is
encoded once and its count appended to the cache, a Parquet table partitioned by version.

Copies, even a third of all rows, are merged before the shuffle; the join against the cache,
which has one row per digest, splits on the documents' side. Concurrent appends may store a digest
twice with the same count; reading merges them.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.llm.tokens import encoder, in_slices

LIMIT = 512


def tokenizer_version(vocabulary: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    if vocabulary.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    digest = hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode())
    with open(vocabulary, "rb") as file:
        digest.update(file.read())
    return digest.hexdigest()


def _counter(vocabulary: str):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            pieces = SentencePieceProcessor(model_file=vocabulary)
            count = lambda texts: [len(x) for x in pieces.encode(texts.to_pylist(), num_threads=1)]
        else:
            count = encoder(vocabulary).count
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(count(batch.column("text")), type=pa.int64())], ["digest", "n_tokens"]
            )

    return counted


def _stored(spark, cache: str, version: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={version}")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if not there:
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema("digest binary, n_tokens long").parquet(path.toString())
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """Rows of ``docs`` as doc_id, n_bytes, n_tokens and over_limit; new counts go to ``cache``.

    ``cache`` is a folder that all executors and later jobs share. Null texts count as empty
    (0 bytes, 0 tokens); repeated rows and null doc_ids each keep their row; other columns, whatever
    their names, are not read; an empty table gives an empty result and leaves the cache as it is.
    """
    spark = docs.sparkSession
    version = tokenizer_version(vocabulary)
    text = F.coalesce(F.col("text"), F.lit(""))
    digested = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    misses = (
        digested.join(_stored(spark, cache, version), "digest", "left_anti")
        .groupBy("digest")
        .agg(F.first("text").alias("text"))
    )
    new = misses.mapInArrow(_counter(os.path.abspath(vocabulary)), "digest binary, n_tokens long")
    new.write.mode("append").parquet(f"{cache}/tokenizer={version}")
    rows = digested.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(_stored(spark, cache, version), "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
