"""A pluggable text embedding. The default needs no model: signed feature hashing of words, normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaywise.operators.text import tokens

DIMENSIONS = 256


def hashed_embedding(docs: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """``key, vector``: words counted into signed buckets, by Spark functions only. A text without words has none
    (as when a model fails at publish time, the document is kept without a vector)."""
    words = docs.select(F.col(key), F.explode(tokens(F.col(text))).alias("w")).withColumn("h", F.xxhash64("w"))
    buckets = words.groupBy(key, F.pmod("h", F.lit(dimensions)).cast("int").alias("b")).agg(F.sum(F.when(F.shiftright("h", 40).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)).alias("v"))
    rows = buckets.where("v <> 0").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return rows.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("n")).cast("float")).alias("vector"))


def enrich_query(terms: Column, synonyms: dict[str, list[str]]) -> Column:
    """Query terms with the synonyms of each appended, once each."""
    table = F.create_map(*[x for k, v in sorted(synonyms.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))]) if synonyms else F.expr("cast(map() as map<string,array<string>>)")
    more = F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(terms, more))
