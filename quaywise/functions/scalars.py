"""Scalar functions of the catalogue pipeline, all built from Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
MAX_MESSAGE_BYTES = 10 * 1024 * 1024


def try_timestamp(text: Column) -> Column:
    """Timestamp of a text that opens with a date; null for anything else (a bare time of day is no bound)."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def is_expired(text: Column, now: Column) -> Column:
    """Whether a moment has passed; a text that is no moment counts as expired."""
    return F.coalesce(try_timestamp(text) < now, F.lit(True))


def context_base(url: Column) -> Column:
    """The part before ``#``, or the whole text where nothing stands before it."""
    base = F.substring_index(url, "#", 1)
    return F.when(base == "", url).otherwise(base)


def context_type(url: Column) -> Column:
    """The part behind ``#``; null if there is none."""
    return F.nullif(F.regexp_extract(url, "#(.*)$", 1), F.lit(""))


def index_key(kind: Column, prefix: str = "catalog", default: str | None = None) -> Column:
    """Partition of the search index for a schema type; null (not indexed) without type or default."""
    use = F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit(default))
    return F.concat(F.lit(prefix + "-"), F.regexp_replace(F.lower(use), "[^a-z0-9-]", "-"))


def doc_id(catalog_id: Column, resource_id: Column) -> Column:
    return F.concat_ws(":", catalog_id, resource_id)


def split_doc_id(key: Column) -> tuple[Column, Column]:
    """Catalogue and resource id: the key cut at its first colon."""
    parts = F.split(key, ":", 2)
    return parts[0], parts[1]


def location_field(path: Column, mapped_colons: bool = True) -> Column:
    """``$.a[*].b.geo`` as the index field ``loc_a_b``."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^\$\.", ""), r"\[\*\]", ""), r"\.(geo|gps|polygon)$", "")
    body = F.replace(body, F.lit("."), F.lit("_"))
    return F.concat(F.lit("loc_"), F.replace(body, F.lit(":"), F.lit("_")) if mapped_colons else body)


def redact_url(url: Column) -> Column:
    """Scheme, host and path only: no user, port, query or fragment."""
    m = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)"
    return F.when(url.rlike(m), F.concat(F.regexp_extract(url, m, 1), F.lit("://"), F.regexp_extract(url, m, 2), F.regexp_extract(url, m, 3)))


def sanitise(text: Column, most: int = 500) -> Column:
    return F.substring(F.regexp_replace(text, r"\p{Cc}", ""), 1, most)


def endpoint_for_action(base: Column, action: Column) -> Column:
    """Callback address of an action; null for an unknown one."""
    path = F.when(action == "on_discover", F.lit("/on_discover")).when(action.isin("publish", "on_publish"), F.lit("/catalog/on_publish"))
    return F.concat(F.regexp_replace(base, "/+$", ""), path)


def sha256_matches(content: Column, declared: Column) -> Column:
    want = F.lower(F.regexp_replace(F.trim(declared), "(?i)^sha256:", ""))
    return F.sha2(content, 256) == want


def payload_bytes(text: Column) -> Column:
    return F.octet_length(text)


def string_list(value: Column, path: str) -> Column:
    """A list member, or a single text as a list of one; blanks dropped, else empty."""
    many = F.try_variant_get(value, path, "array<string>")
    one = F.array(F.try_variant_get(value, path, "string"))
    return F.filter(F.coalesce(many, one), lambda x: x.isNotNull() & (F.trim(x) != ""))


def truncate_words(text: Column, most: int = 8192) -> Column:
    """At most ``most`` bytes, cut at the last space (or hard, if there is none), trimmed on the right.

    A text over the cap is cut in bytes; the broken character at the cut, if any, is dropped.
    """
    raw = F.substring(text.cast("binary"), 1, most)
    whole = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�+$", "")
    words = F.regexp_extract(whole, r"(?s)^(.*)\s", 1)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.rtrim(F.when(F.length(words) > 0, words).otherwise(whole)))


def ack_body(accepted: Column, message_id: Column, error: Column, legacy: bool = False) -> Column:
    """The acknowledgement as JSON text, nested or in the flat older shape."""
    status = F.when(accepted, F.lit("ACK")).otherwise(F.lit("NACK"))
    if legacy:
        return F.to_json(F.struct(status.alias("status"), message_id.alias("messageId"), error.alias("error")))
    return F.to_json(F.struct(F.struct(status.alias("status"), message_id.alias("messageId"), error.alias("error")).alias("message")))


def ack_outcome(body: Column) -> Column:
    """``BLANK``, ``NACK`` or ``ACK`` of a callback's reply; all count as delivered."""
    v = F.try_parse_json(body)
    status = F.coalesce(F.try_variant_get(v, "$.message.status", "string"), F.try_variant_get(v, "$.message.ack.status", "string"), F.try_variant_get(v, "$.status", "string"))
    return F.when(F.coalesce(F.trim(body), F.lit("")) == "", F.lit("BLANK")).when(F.upper(status) == "NACK", F.lit("NACK")).otherwise(F.lit("ACK"))


def register_sql_functions(spark: SparkSession) -> None:
    """The same timestamp rule for SQL text."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION try_to_timestamptz(t STRING) RETURNS TIMESTAMP RETURN CASE WHEN t RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}' THEN try_to_timestamp(t) END")
