"""Publishing: from messages to a new snapshot of items, offers and locations. Pure functions on DataFrames.

Keys are (catalog_id, id) throughout. A batch is resource rows (``catalog_id, id, ...``) and offer rows
(``catalog_id, offer_id, resource_ids, ...``) already exploded from messages, with a ``seq`` that orders them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaywise.functions import scalars

KEYS = ["catalog_id", "id"]


def latest_version(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last writer of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def parse_messages(raw: DataFrame, cap: int = scalars.MAX_MESSAGE_BYTES) -> DataFrame:
    """``message, catalogs array<variant>, reject_reason``: messages with their catalogues, or why they have none.

    Catalogues stand under ``message`` or at the root.
    """
    v = F.try_parse_json(F.col("value"))
    parsed = raw.withColumn("message", v)
    found = F.coalesce(F.try_variant_get("message", "$.message.catalogs", "array<variant>"), F.try_variant_get("message", "$.catalogs", "array<variant>"))
    parsed = parsed.withColumn("catalogs", found)
    reason = F.when(F.octet_length("value") > cap, "too large").when(F.col("message").isNull(), "not JSON").when(F.coalesce(F.size("catalogs"), F.lit(0)) <= 0, "no catalogues")
    return parsed.withColumn("reject_reason", reason)


def landing_verdict(raw: DataFrame, cap: int = scalars.MAX_MESSAGE_BYTES) -> DataFrame:
    """ACK, or NACK with a reason, for pushed bodies: size, JSON, a context object with some id."""
    v = F.try_parse_json(F.col("value"))
    context = F.try_variant_get(v, "$.context", "map<string,variant>")
    some_id = F.coalesce(F.try_variant_get(v, "$.context.messageId", "string"), F.try_variant_get(v, "$.context.transactionId", "string"))
    reason = F.when(F.octet_length("value") > cap, "too large").when(v.isNull(), "not JSON").when(context.isNull(), "no context").when(F.coalesce(F.trim(some_id), F.lit("")) == "", "no message or transaction id")
    return raw.withColumn("nack_reason", reason).withColumn("verdict", F.when(F.col("nack_reason").isNull(), "ACK").otherwise("NACK"))


def split_catalogs(parsed: DataFrame, cap: int = scalars.MAX_MESSAGE_BYTES) -> DataFrame:
    """One row per catalogue: ``catalog_id, catalog, update_mode, visible_to, reject_reason``. The first directive
    of a catalogue wins, the default mode is MERGE; a missing id or an oversized catalogue is a reject."""
    directives = F.coalesce(F.try_variant_get("message", "$.message.publishDirectives", "array<variant>"), F.array().cast("array<variant>"))
    keyed = parsed.where("reject_reason is null").withColumn("_message", F.xxhash64("value"))
    rows = keyed.select("seq", "_message", F.explode("catalogs").alias("catalog"))
    rows = rows.withColumn("catalog_id", F.try_variant_get("catalog", "$.id", "string"))
    # catalogues and directives of a message meet by a join: a message of many is not copied for each
    said = keyed.select("seq", "_message", F.posexplode(directives).alias("_at", "_d"))
    said = said.select("seq", "_message", "_at", F.try_variant_get("_d", "$.catalogId", "string").alias("catalog_id"), F.struct(F.to_json("_d").alias("d")).alias("_d"))
    said = said.where("catalog_id is not null").groupBy("seq", "_message", "catalog_id").agg(F.min_by("_d", "_at")["d"].alias("_own"))
    rows = rows.join(said, ["seq", "_message", "catalog_id"], "left")
    own = F.parse_json("_own")
    reason = F.when(F.coalesce(F.trim("catalog_id"), F.lit("")) == "", "no catalogue id").when(F.octet_length(F.to_json("catalog")) > cap, "catalogue too large")
    return rows.select("seq", "catalog_id", "catalog", F.upper(F.coalesce(F.try_variant_get(own, "$.updateMode", "string"), F.lit("MERGE"))).alias("update_mode"), scalars.string_list(own, "$.visibleTo").alias("visible_to"), reason.alias("reject_reason"))


def catalog_resources(catalogs: DataFrame) -> DataFrame:
    """``seq, catalog_id, id, resource``: the resources that carry more than a stub."""
    from quaywise.operators.filters import is_real_resource

    rows = catalogs.where("reject_reason is null").select("seq", "catalog_id", F.explode(F.try_variant_get("catalog", "$.resources", "array<variant>")).alias("resource"))
    rows = rows.withColumn("id", F.try_variant_get("resource", "$.id", "string")).where("id is not null")
    return rows.where(is_real_resource(F.col("resource")))


def catalog_offers(catalogs: DataFrame) -> DataFrame:
    """``seq, catalog_id, provider_id, offer_id, resource_ids, offer``."""
    rows = catalogs.where("reject_reason is null").select("seq", "catalog_id", F.try_variant_get("catalog", "$.provider.id", "string").alias("provider_id"), F.explode(F.try_variant_get("catalog", "$.offers", "array<variant>")).alias("offer"))
    return rows.select("seq", "catalog_id", "provider_id", F.try_variant_get("offer", "$.id", "string").alias("offer_id"), scalars.string_list(F.col("offer"), "$.resourceIds").alias("resource_ids"), "offer")


def offer_index(offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per offer and listed resource, provider-level offers that list none)."""
    listed = offers.withColumn("id", F.explode("resource_ids"))
    return listed, offers.where((F.coalesce(F.size("resource_ids"), F.lit(0)) <= 0) & F.col("provider_id").isNotNull())


def carry_forward(stored: Column, restated: Column, new: Column) -> Column:
    """New offer ids, then stored ones that the message does not restate."""
    return F.array_union(new, F.array_except(stored, F.array_union(restated, new)))


def publish_merge(existing: DataFrame, incoming: DataFrame, restated: DataFrame) -> DataFrame:
    """Rows not named stay; named ones are replaced whole; new ones are added.

    ``existing``/``incoming``: ``catalog_id, id, version, offer_ids``; ``restated``: ``catalog_id, offer_id`` of
    the message's offers. Stored offers of a replaced row stay unless the message restates them.
    """
    none, columns = F.array().cast("array<string>"), existing.columns
    # only offers that the message restates are looked up one by one
    held = existing.join(incoming.select(*KEYS), KEYS, "left_semi").select(*KEYS, F.explode("offer_ids").alias("offer_id"))
    gone = held.join(restated.select("catalog_id", "offer_id"), ["catalog_id", "offer_id"], "left_semi").groupBy(*KEYS).agg(F.collect_set("offer_id").alias("_gone"))
    # stored and incoming rows meet once; the stored rows of a key, one unless it is repeated, come as a list
    rows = existing.groupBy(*KEYS).agg(F.collect_list(F.struct(*columns)).alias("_old")).join(gone, KEYS, "left")
    both = rows.join(incoming.select(*KEYS, F.struct(*columns).alias("_new")), KEYS, "full")
    placed = F.transform("_old", lambda row: F.transform(F.coalesce(row["offer_ids"], none), lambda x, pos: F.struct(pos.alias("pos"), x.alias("offer_id"))))
    stored = F.transform(F.array_sort(F.flatten(placed)), lambda x: x["offer_id"])
    more = F.coalesce(F.array_except(stored, F.coalesce("_gone", none)), none)
    merged = F.struct(*(F.array_union("_new.offer_ids", more).alias(c) if c == "offer_ids" else F.col("_new")[c].alias(c) for c in columns))
    return both.select(F.inline(F.when(F.col("_new").isNotNull(), F.array(merged)).otherwise(F.col("_old"))))


def publish_full(existing: DataFrame, incoming: DataFrame, full: DataFrame) -> DataFrame:
    """Every row of the catalogues in ``full`` (``catalog_id``) goes before the batch is inserted."""
    return existing.join(full.select("catalog_id").distinct(), "catalog_id", "left_anti").unionByName(incoming)


def change_counts(existing: DataFrame, incoming: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """``catalog_id, inserted, updated, deleted``."""
    old = existing.select(*KEYS, F.lit(True).alias("was"))
    both = incoming.select(*KEYS, F.lit(True).alias("now")).join(old, KEYS, "full")
    counted = both.groupBy("catalog_id").agg(F.count_if(F.col("was").isNull()).alias("inserted"), F.count_if(F.col("was") & F.col("now")).alias("updated"), F.count_if(F.col("now").isNull()).alias("missing"))
    if full is None:
        return counted.select("catalog_id", "inserted", "updated", F.lit(0).cast("long").alias("deleted"))
    is_full = full.select("catalog_id", F.lit(True).alias("full")).distinct()
    return counted.join(is_full, "catalog_id", "left").select("catalog_id", "inserted", "updated", F.when(F.col("full"), F.col("missing")).otherwise(F.lit(0)).cast("long").alias("deleted"))


def result_status(saved: Column, errors: Column) -> Column:
    return F.when(errors == 0, "ACCEPTED").when(saved > 0, "PARTIAL").otherwise("REJECTED")


def linked_items(existing: DataFrame, offers: DataFrame, handled: DataFrame) -> DataFrame:
    """Stored items of the same catalogue that share an incoming offer id and were not handled yet, with the
    offers they share: ``catalog_id, id, shared``."""
    held = existing.select(*KEYS, F.explode("offer_ids").alias("offer_id"))
    hit = held.join(offers.select("catalog_id", "offer_id").distinct(), ["catalog_id", "offer_id"])
    return hit.groupBy(*KEYS).agg(F.array_sort(F.collect_set("offer_id")).alias("shared")).join(handled.select(*KEYS), KEYS, "left_anti")


def cross_catalog_offers(existing: DataFrame, offers: DataFrame, handled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items of any catalogue whose bare id an offer lists and that were not handled, with ``offer_ids`` united;
    listed ids that no stored item has: ``offer_catalog, offer_id, id``)."""
    listed = offers.select(F.col("catalog_id").alias("offer_catalog"), "offer_id", F.explode("resource_ids").alias("id")).distinct()
    open_ids = listed.join(handled.select("id").distinct(), "id", "left_anti")
    added = open_ids.groupBy("id").agg(F.array_sort(F.collect_set("offer_id")).alias("added"))
    touched = existing.join(added, "id").withColumn("offer_ids", F.array_union("offer_ids", "added"))
    return touched.select(*existing.columns), open_ids.join(existing.select("id").distinct(), "id", "left_anti").select("offer_catalog", "offer_id", "id")


def metadata_propagation(existing: DataFrame, incoming_meta: DataFrame, handled: DataFrame) -> DataFrame:
    """Stored rows (``catalog_id, id, meta``) of catalogues that describe themselves anew (``catalog_id, meta,
    describes``) and that differ, restamped; rows handled in this catalogue are left out."""
    new = incoming_meta.where("describes").select("catalog_id", F.col("meta").alias("new_meta"))
    rows = existing.join(new, "catalog_id").join(handled.select(*KEYS), KEYS, "left_anti").where(~F.col("meta").eqNullSafe(F.col("new_meta")))
    return rows.withColumn("meta", F.col("new_meta")).drop("new_meta")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], created: str = "created_at") -> DataFrame:
    """New rows replace old ones of their key; the creation time of an old row stays."""
    before = old.select(*keys, F.col(created).alias("_created"))
    stamped = new.join(before, keys, "left").withColumn(created, F.coalesce("_created", created)).drop("_created").select(*old.columns)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(stamped)


def replace_locations(locations: DataFrame, touched: DataFrame, new: DataFrame) -> DataFrame:
    """Location rows of the touched items are replaced."""
    keys = touched.select(F.col("id").alias("item_id"), "catalog_id").distinct()
    return locations.join(keys, ["item_id", "catalog_id"], "left_anti").unionByName(new)


def location_seq(locations: DataFrame, pos: str = "pos") -> DataFrame:
    """Ordinal 0, 1, 2 ... of each location within (item, catalogue, path) in document order."""
    place = F.row_number().over(Window.partitionBy("item_id", "catalog_id", "path").orderBy(pos)) - 1
    return locations.withColumn("seq", place.cast("short"))


def merge_patch(target: Column, patch: Column) -> Column:
    """One level of a merge patch on variants: patch members replace, null members delete."""
    t, p = target.cast("map<string,variant>"), patch.cast("map<string,variant>")
    joined = F.map_zip_with(t, p, lambda k, a, b: F.when(F.map_contains_key(p, k), b).otherwise(a))
    return F.to_variant_object(F.map_filter(joined, lambda k, v: v.isNotNull() & ~F.is_variant_null(v)))


def strip_nulls(value: Column) -> Column:
    """A variant object without null members at its top level."""
    return F.to_variant_object(F.map_filter(value.cast("map<string,variant>"), lambda k, v: v.isNotNull() & ~F.is_variant_null(v)))


def assemble_message(items: DataFrame) -> DataFrame:
    """Item rows (``catalog_id, id, resource, offers``) back into one catalogue message each, offers once by id."""
    from quaywise.operators.respond import dedupe_offers

    grouped = items.groupBy("catalog_id").agg(F.array_sort(F.collect_list(F.struct("id", "resource"))).alias("r"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "offers"))), lambda x: x["offers"])).alias("offers"))
    return grouped.select("catalog_id", F.transform("r", lambda x: x["resource"]).alias("resources"), dedupe_offers(F.col("offers")).alias("offers"))


def rejects(rows: DataFrame, reason: str = "reject_reason", raw: str = "value") -> DataFrame:
    """``value``: reason, time and the first 200 characters of what was refused, as JSON."""
    bad = rows.where(F.col(reason).isNotNull())
    return bad.select(F.to_json(F.struct(F.col(reason).alias("reason"), F.current_timestamp().alias("timestamp"), F.substring(raw, 1, 200).alias("snippet"))).alias("value"))


#: Rules of a publish message: member, JSON type, whether it must be there.
CATALOG_RULES = [("id", "string", True), ("descriptor.name", "string", False), ("provider.id", "string", False), ("isActive", "boolean", False), ("resources", "array<variant>", False), ("offers", "array<variant>", False)]


def catalog_problems(catalog: Column, rules: list[tuple[str, str, bool]] = CATALOG_RULES) -> Column:
    """What a variant catalogue breaks, as ``array<string>``: missing members and members of another type."""
    kinds = {"string": "^STRING", "boolean": "^BOOLEAN", "array<variant>": "^ARRAY", "double": "^(BIGINT|DOUBLE|DECIMAL|FLOAT)"}
    found = []
    for name, kind, needed in rules:
        value = F.try_variant_get(catalog, f"$.{name}", "variant")
        here = value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False))
        found.append(F.when(here & ~F.schema_of_variant(value).rlike(kinds[kind]), F.lit(f"{name}: wrong type")))
        if needed:
            found.append(F.when(~here, F.lit(f"{name}: missing")))
    return F.array_compact(F.array(*found))


def key_block(key: Column, blocks: Column) -> Column:
    """The hashed block of a key: the first 32 bits of its MD5, modulo the number of blocks."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % blocks


def sized_batches(rows: DataFrame, size: int = 100, block: int = 100_000) -> DataFrame:
    """Rows with the bulk request they belong to (``block, bulk``), at most ``size`` rows in each. A partition key is dealt
    into one hashed block for every ``block`` rows begun (:func:`key_block`), and numbered within a block by document key,
    so no task gets all rows of a large key."""
    shares = rows.groupBy("index_key").agg(F.ceil(F.count("*") / block).alias("_blocks"))
    dealt = rows.join(shares, "index_key").withColumn("block", key_block(F.col("doc_key"), F.col("_blocks"))).drop("_blocks")
    place = F.row_number().over(Window.partitionBy("index_key", "block").orderBy("doc_key")) - 1
    return dealt.withColumn("bulk", F.floor(place / size))


def write_index(documents: DataFrame, new: DataFrame, full: DataFrame) -> DataFrame:
    """The search index after a commit: documents of catalogues published in full go (whatever their partition), those
    named anew are replaced by key, the others stay."""
    kept = documents.join(full.select("catalog_id").distinct(), "catalog_id", "left_anti").join(new.select("doc_key"), "doc_key", "left_anti")
    return kept.select(*documents.columns).unionByName(new.select(*documents.columns))


def items_of_catalogs(items: DataFrame, catalogs: DataFrame, first_only: bool = False) -> DataFrame:
    """Items of the named catalogues; on request the first of each by id."""
    held = items.join(catalogs.select("catalog_id").distinct(), "catalog_id", "left_semi")
    if not first_only:
        return held
    return held.groupBy("catalog_id").agg(F.min("id").alias("id")).join(items, KEYS)


#: Classes of errors that a message itself causes: trying again cannot help. What stands behind a colon is detail.
FINAL_ERRORS = ("too large", "not JSON", "no catalogues", "no context", "no message or transaction id", "no catalogue id", "catalogue too large", "validation")


def error_class(error: Column) -> Column:
    return F.trim(F.substring_index(error, ":", 1))


def error_policy(failures: DataFrame, first: float = 1.0, factor: float = 2.0, longest: float = 30.0, whole: float = 300.0) -> DataFrame:
    """Failed messages (``error, attempt``) with what happens next: ``REJECT`` at once, ``RETRY`` after ``wait``
    seconds (growing by a factor up to a longest wait), or ``FAILED`` once the waits together reach the whole."""
    grow = lambda n: F.least(F.lit(longest), F.lit(first) * F.pow(F.lit(factor), n - 1))
    waited = F.aggregate(F.sequence(F.lit(1), F.col("attempt")), F.lit(0.0), lambda s, n: s + grow(n))
    action = F.when(error_class(F.col("error")).isin(*FINAL_ERRORS), "REJECT").when(waited >= whole, "FAILED").otherwise("RETRY")
    return failures.withColumn("action", action).withColumn("wait", F.when(F.col("action") == "RETRY", grow(F.col("attempt"))))
