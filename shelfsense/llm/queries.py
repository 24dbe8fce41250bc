"""The package's registered queries and the SQL they must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsense.llm import audit_repair, bag_minhash, best_fit, count_cache, dac, fertility, fuzzy_lines, host_reputation, k2_treap, pattern_pii, shard_tree, spaced_seeds, weighted_mix
from shelfsense.llm.common import Scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn=None, *, sql: str | None = None):
    """Register a query under its function's name, with the SQL it must match if there is any."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register(fn) if fn is not None else register


@query(sql=bag_minhash.ORACLE)
def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.classes(table(spark, sf_dir, "documents")).drop("mark")


@query(sql=shard_tree.ORACLE)
def op2_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.assign(table(spark, sf_dir, "documents"))


@query
def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines, how many of them went, and the text that is left."""
    found = fuzzy_lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True, whole=True)
    return found.select("doc_id", "n_lines", "n_dropped", "text")


def fertility_vocabularies() -> dict[str, str]:
    """A byte-level vocabulary and one with pieces and byte fallback."""
    return {"byte": vocabulary("byte_bpe_50k.json"), "piece": vocabulary("piece_bpe_32k.model")}


@query
def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"), fertility_vocabularies())


@query(sql=host_reputation.ORACLE)
def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of its id: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    outcomes = labels.filter("quality is not null or toxic is not null").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return host_reputation.judge(table(spark, sf_dir, "pages"), outcomes)


@query(sql=spaced_seeds.ORACLE)
def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "dac").path("tokens")
    return dac.encode_documents(table(spark, sf_dir, "documents"), folder, vocabulary())


@query
def op8_count_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that a run never depends on an earlier one."""
    cache = Scratch(spark, "counts").path("cache")
    return count_cache.count_tokens(table(spark, sf_dir, "documents"), vocabulary(), cache)


@query
def op9_pattern_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_pii.find_personal_data(table(spark, sf_dir, "documents"))


@query
def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@query
def op11_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    hurt = audit_repair.damage(table(spark, sf_dir, "conversations"))
    return audit_repair.repair(hurt, hurt["lost"])


@query(sql=weighted_mix.ORACLE)
def op12_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of good quality weigh more in the last, partial epoch of their source."""
    weights = weighted_mix.quality_weights(table(spark, sf_dir, "labels"))
    return weighted_mix.mix(table(spark, sf_dir, "documents"), weights)


@query(sql=k2_treap.ORACLE)
def op13_k2_treap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k2_treap.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
