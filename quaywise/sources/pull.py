"""Catalogues that a provider hands over on request: inline in the callback, or as staged files with a manifest."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywise.functions import scalars

MANIFEST = "name string, format string, checksum string, expires_at string"


def read_pull_inline(callbacks: DataFrame) -> DataFrame:
    """``catalog, reject_reason`` from callback bodies (``value``): a failed pull or one without catalogues is a
    reject, else one row per catalogue."""
    v = F.try_parse_json("value")
    rows = callbacks.withColumn("_v", v).withColumn("_c", F.coalesce(F.try_variant_get("_v", "$.message.catalogs", "array<variant>"), F.try_variant_get("_v", "$.catalogs", "array<variant>")))
    status = F.upper(F.coalesce(F.try_variant_get("_v", "$.message.status", "string"), F.try_variant_get("_v", "$.status", "string")))
    reason = F.when(F.col("_v").isNull(), "not JSON").when(status == "FAILED", "pull failed").when(F.coalesce(F.size("_c"), F.lit(0)) <= 0, "no catalogues")
    none = F.array(F.parse_json(F.lit("null")))
    out = rows.withColumn("reject_reason", reason).withColumn("catalog", F.explode(F.when(F.col("reject_reason").isNull(), F.col("_c")).otherwise(none)))
    return out.withColumn("catalog", F.when(F.col("reject_reason").isNull(), F.col("catalog"))).drop("_v", "_c")


def _unpacked(files: DataFrame, cap: int) -> DataFrame:
    """``content`` gunzipped where the format says so; null if broken or over the cap (read as a stream up to it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("content")
            out = []
            for kind, raw in zip(batch.column("format").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    if raw is not None and kind == "json.gz":
                        with gzip.GzipFile(fileobj=pa.BufferReader(raw)) as f:
                            raw = f.read(cap + 1)
                    out.append(None if raw is None or len(raw) > cap else raw)
                except (OSError, EOFError):
                    out.append(None)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.binary()))

    return files.mapInArrow(run, files.schema)


def read_pull_manifest(spark: SparkSession, manifests: DataFrame, folder: str, now: Column, cap: int = 256 * 1024 * 1024) -> DataFrame:
    """``name, catalog, reject_reason`` of staged files that a manifest names (``name, format, checksum,
    expires_at``). The checksum is of the bytes as staged, before gunzip."""
    staged = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    joined = manifests.join(staged, "name", "left")
    reason = (
        F.when(F.coalesce(F.trim("checksum"), F.lit("")) == "", "no checksum")
        .when(F.coalesce(F.trim("expires_at"), F.lit("")) == "", "no expiry")
        .when(scalars.is_expired(F.col("expires_at"), now), "expired")
        .when(F.col("content").isNull(), "no such file")
        .when(~scalars.sha256_matches(F.col("content"), F.col("checksum")), "checksum differs")
    )
    judged = joined.withColumn("reject_reason", reason)
    bad = judged.where("reject_reason is not null").select("name", F.lit(None).cast("variant").alias("catalog"), "reject_reason")
    text = _unpacked(judged.where("reject_reason is null").select("name", "format", "content"), cap).select("name", F.try_parse_json(F.col("content").cast("string")).alias("v"))
    found = F.coalesce(F.try_variant_get("v", "$.catalogs", "array<variant>"), F.try_variant_get("v", "$.message.catalogs", "array<variant>"))
    opened = text.select("name", found.alias("c"))
    empty = opened.where(F.coalesce(F.size("c"), F.lit(0)) <= 0).select("name", F.lit(None).cast("variant").alias("catalog"), F.lit("no catalogues").alias("reject_reason"))
    good = opened.where(F.size("c") > 0).select("name", F.explode("c").alias("catalog"), F.lit(None).cast("string").alias("reject_reason"))
    return bad.unionByName(empty).unionByName(good)


def external_results(bodies: DataFrame) -> DataFrame:
    """``score, catalogs`` of scored external results, whether the body (``value``) holds them in an object, in a
    list of objects, or in nested message lists."""
    content = "array<variant>"
    v = F.try_parse_json("value")
    flat = F.flatten(F.transform(F.try_variant_get(v, "$", content), lambda x: F.coalesce(F.try_variant_get(x, "$.content", content), F.array().cast(content))))
    nested = F.flatten(F.transform(F.try_variant_get(v, "$.messages", content), lambda x: F.coalesce(F.try_variant_get(x, "$.content", content), F.array().cast(content))))
    rows = bodies.select(F.explode(F.coalesce(F.try_variant_get(v, "$.content", content), flat, nested)).alias("r"))
    return rows.select(F.try_variant_get("r", "$.score", "int").alias("score"), F.try_variant_get("r", "$.schema_object.catalogs", content).alias("catalogs"))
