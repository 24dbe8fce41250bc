"""Keyword weights of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.operators.joins import with_scalar


def keyword_weights(items: DataFrame, text: str, terms: int = 50) -> DataFrame:
    """Unit-length TF-IDF rows (product, term, weight) over the most frequent terms.

    The inverse frequency is the smoothed form ``ln((1 + n) / (1 + df)) + 1``.
    """
    words = items.select("product_id", F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z_]+)"), 1)).alias("term"))
    tf = words.groupBy("product_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    vocabulary = df.orderBy(F.col("total").desc(), "term").limit(terms)
    vocabulary = with_scalar(vocabulary, items.agg(F.count("*").alias("items")), "items").select(
        "term", (F.ln((1 + F.col("items")) / (1 + F.col("df"))) + 1).alias("idf")
    )
    raw = tf.join(vocabulary, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("product_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "product_id").select("product_id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def rich_content_features(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """(product, feature, weight) rows of nine categories, four flags and keyword weights, scaled
    so that the dot product of two items is their cosine."""
    both = products.join(attributes, "product_id")
    names = [
        "category",
        "subcategory",
        "price_tier",
        "brand_type",
        "margin_band",
        "color",
        "size_group",
        "material_type",
        "recommendation_embedding_group",
    ]
    flags = ["eco_flag", "bundle_candidate_flag", "seasonal_flag", "premium_flag"]
    cells = [F.concat(F.lit(f"{c}="), F.col(c)) for c in names] + [F.when(F.col(c), c) for c in flags]
    hot = both.select("product_id", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("feature"))
    words = keyword_weights(attributes, "description_keywords").select(
        "product_id", F.concat(F.lit("kw="), F.col("term")).alias("feature"), "weight"
    )
    raw = hot.withColumn("weight", F.lit(1.0)).unionByName(words)
    norm = raw.groupBy("product_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return raw.join(norm, "product_id").select("product_id", "feature", (F.col("weight") / F.col("norm")).alias("weight"))
