"""Search documents of items: typed members of the payload, shapes by field, and the text that is searched."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaywise.functions import paths, scalars, walks

LIST = "array<variant>"
#: What a typed read accepts, by JSON type.
JSON_TYPES = {"string": lambda t: t == "STRING", "boolean": lambda t: t == "BOOLEAN", "double": paths.is_number, "int": lambda t: t == "BIGINT"}


def typed_get(value: Column, path: str, kind: str) -> Column:
    """The member at ``path`` if its JSON type is ``kind`` (``string``, ``boolean``, ``double`` or ``int``), else null: a
    number in quotes is a text, not a number."""
    return typed(F.try_variant_get(value, path, "variant"), kind)


def typed(value: Column, kind: str) -> Column:
    """A variant as ``kind`` if that is its JSON type, else null."""
    return F.when(JSON_TYPES[kind](F.schema_of_variant(value)), F.try_variant_get(value, "$", kind))


#: Leaves of a shape: of all JSON types a text alone can be read as bytes (those of its UTF-8), so a member of another type is
#: null there and no type is looked up.
TEXT, ANY = "binary", "variant"


def shape_of(members: dict[str, str]) -> str:
    """The struct type that holds these paths (``$.a.b``, ``$['@c']``), each with the type of its leaf."""
    tree: dict = {}
    for path, leaf in members.items():
        at, names = tree, steps(path)
        for name in names[:-1]:
            at = at.setdefault(name, {})
        at[names[-1]] = leaf
    kind = lambda t: t if isinstance(t, str) else "struct<" + ",".join(f"`{k}`:{kind(v)}" for k, v in t.items()) + ">"
    return kind(tree)


def steps(path: str) -> list[str]:
    return [quoted or plain for quoted, plain in re.findall(r"\['([^']*)'\]|\.(\w+)", path)]


def member(owner: Column, path: str) -> Column:
    for name in steps(path):
        owner = owner[name]
    return owner


def provider_id(owner: Column) -> Column:
    """The provider of a catalogue or resource, stated as a text or as an object with an id."""
    return F.coalesce(typed_get(owner, "$.provider", "string"), typed_get(owner, "$.provider.id", "string"))


def json_list(value: Column) -> Column:
    """A list of variants as JSON texts."""
    return F.transform(value, lambda v: F.to_json(v))


#: Text members of a document: column, owner, path.
TEXTS = [
    ("catalog_id", "catalog", "$.id"),
    ("catalog_context", "catalog", "$['@context']"),
    ("catalog_type", "catalog", "$['@type']"),
    ("catalog_bpp_id", "catalog", "$.bppId"),
    ("catalog_bpp_uri", "catalog", "$.bppUri"),
    ("catalog_name", "catalog", "$.descriptor.name"),
    ("catalog_short_desc", "catalog", "$.descriptor.shortDesc"),
    ("catalog_long_desc", "catalog", "$.descriptor.longDesc"),
    ("catalog_descriptor_code", "catalog", "$.descriptor.code"),
    ("catalog_thumbnail", "catalog", "$.descriptor.thumbnailImage"),
    ("resource_context", "resource", "$['@context']"),
    ("resource_type", "resource", "$['@type']"),
    ("resource_name", "resource", "$.descriptor.name"),
    ("resource_short_desc", "resource", "$.descriptor.shortDesc"),
    ("resource_long_desc", "resource", "$.descriptor.longDesc"),
    ("resource_descriptor_code", "resource", "$.descriptor.code"),
    ("resource_thumbnail", "resource", "$.descriptor.thumbnailImage"),
    ("resource_category_code", "resource", "$.category.codeValue"),
    ("resource_category_name", "resource", "$.category.name"),
    ("resource_provider_id", "resource", "$.provider.id"),
    ("resource_provider_name", "resource", "$.provider.descriptor.name"),
    ("resource_review_text", "resource", "$.rating.reviewText"),
    ("attributes_type", "resource", "$.resourceAttributes['@type']"),
    ("attributes_context", "resource", "$.resourceAttributes['@context']"),
]
#: List members, kept as JSON texts.
LISTS = [
    ("catalog_docs", "catalog", "$.descriptor.docs"),
    ("catalog_media", "catalog", "$.descriptor.mediaFile"),
    ("resource_docs", "resource", "$.descriptor.docs"),
    ("resource_media", "resource", "$.descriptor.mediaFile"),
    ("constraints", "resource", "$.constraints"),
    ("policies", "resource", "$.policies"),
    ("offers", "catalog", "$.offers"),
]
#: Members of another type.
VALUES = [
    ("catalog_is_active", "catalog", "$.isActive", "boolean"),
    ("resource_rateable", "resource", "$.rateable", "boolean"),
    ("resource_is_active", "resource", "$.isActive", "boolean"),
    ("resource_rating_value", "resource", "$.rating.ratingValue", "double"),
    ("resource_rating_count", "resource", "$.rating.ratingCount", "int"),
]


def search_documents(items: DataFrame, resource: str | None = None, offers: str | None = None) -> DataFrame:
    """Flat search documents of item rows (``id, catalog_id, type, network_id, payload``), with index partition, key,
    offers as JSON texts and the text blob. ``resource`` and ``offers`` name the columns with the payload's resource and offers as
    JSON texts, if the items have them; else the payload is written as text for the blob, which takes most of the time."""
    bounds = {"catalog_start": "$.validity.startDate", "catalog_end": "$.validity.endDate"}
    lists = [m for m in LISTS if offers is None or m[0] != "offers"]
    own = lambda o: {m[2]: leaf for group, leaf in ((TEXTS, TEXT), (lists, LIST), (VALUES, ANY)) for m in group if m[1] == o}
    read = lambda path, members: F.try_variant_get("payload", path, shape_of(members))
    parts = items.select(
        F.col("id").alias("resource_id"),
        F.col("catalog_id").alias("_catalog_id"),
        F.col("type").alias("schema_type"),
        "network_id",
        read("$.catalogs[0]", own("catalog") | {"$.provider": ANY} | dict.fromkeys(bounds.values(), TEXT)).alias("catalog"),
        read("$.catalogs[0].resources[0]", own("resource")).alias("resource"),
        F.try_variant_get("payload", "$.catalogs[0].resources[0]", "variant").alias("whole"),
        *([F.col(resource).alias("_resource")] if resource else []),
        *([F.col(offers).alias("offers")] if offers else []),
    )
    # each owner is read once, as a struct with a leaf for each member
    owner = {"catalog": F.col("catalog"), "resource": F.col("resource")}
    text = lambda path, o: member(owner[o], path).cast("string")
    provider = owner["catalog"]["provider"]
    rows = parts.select(
        scalars.doc_id(F.col("_catalog_id"), F.col("resource_id")).alias("doc_key"),
        scalars.index_key(F.col("schema_type")).alias("index_key"),
        "resource_id",
        "schema_type",
        "network_id",
        *(text(path, o).alias(name) for name, o, path in TEXTS),
        *(typed(member(owner[o], path), kind).alias(name) for name, o, path, kind in VALUES),
        *(json_list(member(owner[o], path)).alias(name) for name, o, path in lists),
        *(["offers"] if offers else []),
        F.coalesce(typed(provider, "string"), typed_get(provider, "$.id", "string")).alias("provider_id"),
        *(scalars.try_timestamp(text(path, "catalog")).alias(name) for name, path in bounds.items()),
        F.to_json(F.try_variant_get("whole", "$.resourceAttributes", "variant")).alias("attributes"),
        (F.col("_resource") if resource else F.to_json("whole")).alias("_resource"),
    )
    return text_blobs(rows, "_resource", "offers", "full_text_blob").drop("_resource")


def text_blobs(rows: DataFrame, resource: str, offers: str, out: str, most: int = 8192) -> DataFrame:
    """``out``: the searched text of a resource (a JSON text) and its offers (JSON texts), at most ``most`` bytes.

    Distinct parts in order: name, descriptions, category and provider; the text of locations around their shapes; then
    every text (no address of the web) and number at any depth of attributes, constraints, policies, documents, media
    and offers, and the names of members that are true. Context members and shapes are left out.
    """

    def texts(resources: pa.Array, lists: pa.Array) -> pa.Array:
        parts = lru_cache(8192)(walks.text_parts)  # the same resource stands in many catalogues: it is read once in a batch
        column = lambda c: c.to_numpy(zero_copy_only=False).tolist()  # noqa: E731  several times as fast as to_pylist
        own, at, out = column(lists.flatten()), 0, []
        for resource, size in zip(column(resources), column(pc.fill_null(lists.value_lengths(), 0)), strict=True):
            out.append(parts(resource, tuple(own[at : at + size])))
            at += size
        return pa.array(out, pa.string())

    # only these two columns go through Python, not the whole document
    found = F.arrow_udf(texts, "string")(F.col(resource), F.col(offers))
    return rows.withColumn(out, found).withColumn(out, scalars.truncate_words(F.col(out), most))
