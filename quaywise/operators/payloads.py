"""Payloads of stored items: building them, and reading from them what tables and answers need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaywise.functions import scalars

LIST = "array<variant>"


def _filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def metadata_slice(catalog: Column) -> Column:
    """A variant catalogue without its resources, items and offers."""
    members = F.map_filter(catalog.cast("map<string,variant>"), lambda k, v: ~k.isin("resources", "items", "offers"))
    return F.to_variant_object(members)


def denormalise(resources: DataFrame) -> DataFrame:
    """``payload``: one catalogue with its own members, this ``resource`` and its ``offers`` (an array of variants),
    for rows that carry ``catalog`` (a variant, or its members as a map), ``resource`` and ``offers``."""
    own = F.map_filter(F.col("catalog").cast("map<string,variant>"), lambda k, v: ~k.isin("resources", "items", "offers"))
    lists = F.create_map(
        F.lit("resources"), F.to_variant_object(F.array("resource")),
        F.lit("offers"), F.to_variant_object(F.coalesce("offers", F.array().cast(LIST))),
    )
    whole = F.struct(F.array(F.map_concat(own, lists)).alias("catalogs"))  # turned into a variant in one step
    return resources.withColumn("payload", F.to_variant_object(whole))


def _members(payload: Column, name: str, kind: str = "variant") -> Column:
    """All elements of a list member of the payload's catalogues, read in one step: nothing beside them is copied."""
    none = F.array().cast(f"array<{kind}>")
    catalogs = F.try_variant_get(payload, "$.catalogs", f"array<struct<{name}:array<{kind}>>>")
    lists = F.transform(catalogs, lambda c: F.coalesce(c[name], none))
    return F.coalesce(F.flatten(lists), none)


def extract_resource(payload: Column, item_id: Column) -> Column:
    """The payload's resource that has the row's id; null if none has."""
    return F.get(F.filter(_members(payload, "resources"), lambda r: F.try_variant_get(r, "$.id", "string") == item_id), F.lit(0))


def offer_ids(payload: Column) -> Column:
    """Ids of the payload's offers, in order; offers without one are passed over."""
    return F.array_compact(F.transform(_members(payload, "offers", "struct<id:string>"), lambda o: o["id"]))


def _context(value: Column, path: str) -> Column:
    """A context member: a text, or the first of a list."""
    first = F.get(F.try_variant_get(value, path, "array<string>"), F.lit(0))
    return _filled(F.coalesce(first, F.try_variant_get(value, path, "string")))


def context_url(resource: Column, catalog: Column, at: str = "$") -> Column:
    """The context of the resource's attributes, else of the resource, else of the catalogue, which stands ``at`` a path of the
    value given for it."""
    return F.coalesce(_context(resource, "$.resourceAttributes['@context']"), _context(resource, "$['@context']"), _context(catalog, f"{at}['@context']"))


def schema_type(schema_context: Column, resources: Column) -> Column:
    """The part of a schema context behind ``#``, else the first type that a resource's attributes name."""
    types = F.transform(resources, lambda r: _filled(F.try_variant_get(r, "$.resourceAttributes['@type']", "string")))
    return F.coalesce(scalars.context_type(schema_context), F.get(F.array_compact(types), F.lit(0)))


def visible_networks(catalog: Column, visible_to: Column) -> Column:
    """Networks of a catalogue's items: those that its directive names, else its own, a list or a single text."""
    return F.when(F.size(visible_to) > 0, visible_to).otherwise(scalars.string_list(catalog, "$.networkId"))


def resolve_intent(intents: DataFrame) -> DataFrame:
    """``schema_urls`` of the intent, else of its context; flags that are not given stay null."""
    return intents.withColumn("schema_urls", F.when(F.size("intent_schema") > 0, F.col("intent_schema")).otherwise(F.col("context_schema")))
