"""Row filters of a search: network, schema, activity, validity, ids, scores, and intent validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaywise.functions import scalars


def network_filter(network_id: Column, wanted: Column) -> Column:
    """The wanted network is among the item's; a blank wish keeps everything."""
    blank = wanted.isNull() | (F.trim(wanted) == "")
    return blank | F.coalesce(F.array_contains(network_id, wanted), F.lit(False))


def schema_pairs(urls: Column) -> Column:
    """``context#type`` texts as pairs; blank ones go, a missing type stays null."""
    kept = F.filter(urls, lambda u: u.isNotNull() & (F.trim(u) != ""))
    return F.transform(kept, lambda u: F.struct(scalars.context_base(u).alias("base"), scalars.context_type(u).alias("kind")))


def schema_filter(context_url: Column, kind: Column, urls: Column) -> Column:
    """Some pair matches both columns of the row; a pair without a type matches any. No pair keeps all."""
    pairs = schema_pairs(urls)
    hit = F.exists(pairs, lambda p: (p["base"] == context_url) & (p["kind"].isNull() | (p["kind"] == kind)))
    return F.when(urls.isNull() | (F.size(pairs) == 0), F.lit(True)).otherwise(F.coalesce(hit, F.lit(False)))


def distinct_context_parts(urls: Column) -> tuple[Column, Column]:
    """Distinct bases and distinct types of an intent."""
    pairs = schema_pairs(urls)
    return F.array_distinct(F.transform(pairs, lambda p: p["base"])), F.array_compact(F.array_distinct(F.transform(pairs, lambda p: p["kind"])))


def active_filter(is_active: Column, flag: Column) -> Column:
    """Absent activity means active; a null flag asks for nothing."""
    return flag.isNull() | (F.coalesce(is_active, F.lit(True)) == flag)


def valid_filter(start: Column, end: Column, now: Column) -> Column:
    """Now lies between two timestamps, both inclusive; an absent or unreadable bound is open."""
    return (start.isNull() | (start <= now)) & (end.isNull() | (end >= now))


def invalid_filter(start: Column, end: Column, now: Column) -> Column:
    """Provably outside: begins later or ended before."""
    return F.coalesce(start > now, F.lit(False)) | F.coalesce(end < now, F.lit(False))


def validity_filter(start_text: Column, end_text: Column, flag: Column, now: Column) -> Column:
    start, end = scalars.try_timestamp(start_text), scalars.try_timestamp(end_text)
    return flag.isNull() | F.when(flag, valid_filter(start, end, now)).otherwise(invalid_filter(start, end, now))


def id_allowlist(items: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Items whose id is on the list (ids are bare: any catalogue's item of that id stays)."""
    return items.join(ids.select(key).distinct(), key, "left_semi")


def min_score(hits: DataFrame, least: float = 0.72, score: str = "score") -> DataFrame:
    return hits.where(F.col(score) >= least)


def external_score_threshold(results: DataFrame, least: int = 80) -> DataFrame:
    """Scored external results with a verdict: kept, or the reason why not."""
    reason = F.when(F.col("score").isNull(), "no score").when(F.col("score") < least, "score too low").when(F.coalesce(F.size("catalogs"), F.lit(0)) <= 0, "no catalogues")
    return results.withColumn("reject_reason", reason)


def is_real_resource(resource: Column) -> Column:
    """A variant resource with a descriptor name, or attributes beyond their type and context."""
    name = F.try_variant_get(resource, "$.descriptor.name", "string")
    keys = F.json_object_keys(F.to_json(F.try_variant_get(resource, "$.resourceAttributes", "variant")))
    extra = F.filter(keys, lambda k: ~k.isin("@type", "@context"))
    return (F.coalesce(F.trim(name), F.lit("")) != "") | (F.coalesce(F.size(extra), F.lit(0)) > 0)


def callback_url_allowed(url: Column) -> Column:
    """http or https, a host, and no literal private, loopback or link-local address. An IPv6 address that wraps an
    IPv4 one is judged by that one; hosts that write an address as one number, in hex or octal are refused."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    inner = F.regexp_replace(host, r"^\[(?:::ffff:|::|64:ff9b::)(\d+\.\d+\.\d+\.\d+)\]$", "$1")
    private = inner.rlike(r"^(localhost\.?$|.*\.localhost\.?$|127\.|10\.|192\.168\.|169\.254\.|0\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|172\.(1[6-9]|2\d|3[01])\.)")
    wrapped = inner.rlike(r"^\[(::1?\]|f[cd]|fe[89ab]|::ffff:|0*:0*:)")
    odd = inner.rlike(r"^(0x[0-9a-f]+|\d+)(\.(0x[0-9a-f]+|\d+)){0,3}$") & ~inner.rlike(r"^(0|[1-9]\d*)(\.(0|[1-9]\d*)){3}$")
    return url.rlike("^(?i)https?://") & (host != "") & ~private & ~wrapped & ~odd


NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
#: Levels of lists that a shape's coordinates may have; the deepest known shape has four.
DEEPEST = 12


def coordinates_valid(value: Column) -> Column:
    """Whether a variant is a position (a list of two numbers or more) or a list of such, not empty at any level.

    In the JSON text, positions are replaced by a mark, then lists of marks by one mark, from the inside out; what is
    right ends as a single mark.
    """
    left = F.regexp_replace(F.to_json(value), rf"\[{NUMBER}(?:,{NUMBER})+\]", "P")
    for _ in range(DEEPEST):
        left = F.regexp_replace(left, r"\[P(?:,P)*\]", "P")
    return F.coalesce(left == "P", F.lit(False))


def geometry_valid(geometry: Column) -> Column:
    """Coordinates of a shape, and of the members of a collection of shapes; what is not there is not wrong."""
    here = lambda g, name: F.try_variant_get(g, f"$.{name}", "variant")
    missing = lambda v: v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(True))
    own = lambda g: missing(here(g, "coordinates")) | coordinates_valid(here(g, "coordinates"))
    members = F.coalesce(F.try_variant_get(geometry, "$.geometries", "array<variant>"), F.array().cast("array<variant>"))
    return own(geometry) & F.forall(members, own)


def intent_problems(intents: DataFrame) -> DataFrame:
    """``problems array<struct<path, message>>`` of each intent row: what the request breaks.

    Columns read: ``message_id, transaction_id, text_search, expression, spatial`` (array of
    ``struct<op, distance_m, lon, lat>``), ``has_text`` (the request names a text search at all) and, where there is one,
    ``geometries`` (the shapes as variants).
    """
    rule = lambda bad, path, message: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    nothing = blank(F.col("text_search")) & F.col("expression").isNull() & (F.coalesce(F.size("spatial"), F.lit(0)) <= 0)
    rules = [
        rule(~F.coalesce(F.col("message_id").rlike(scalars.UUID), F.lit(False)), "context.messageId", "must be a UUID"),
        rule(~F.coalesce(F.col("transaction_id").rlike(scalars.UUID), F.lit(False)), "context.transactionId", "must be a UUID"),
        rule(nothing, "message.intent", "at least one criterion is needed"),
        rule(F.col("has_text") & blank(F.col("text_search")), "message.intent.textSearch", "must not be blank"),
        rule(F.col("expression").isNotNull() & blank(F.col("expression")), "message.intent.filters.expression", "must not be blank"),
        rule(~blank(F.col("expression")) & ~F.trim("expression").startswith("$"), "message.intent.filters.expression", "must be an absolute path"),
        rule(F.exists("spatial", lambda s: s["distance_m"] < 0), "message.intent.spatial.distanceMeters", "must not be negative"),
        rule(F.exists("spatial", lambda s: s["lon"].isNull() | s["lat"].isNull()), "message.intent.spatial.geometry", "coordinates must be numbers"),
    ]
    if "geometries" in intents.columns:
        wrong = F.exists("geometries", lambda g: ~geometry_valid(g))
        rules.append(rule(wrong, "message.intent.spatial.geometry.coordinates", "must be numbers at every level, and not empty"))
    return intents.withColumn("problems", F.array_compact(F.array(*rules)))
