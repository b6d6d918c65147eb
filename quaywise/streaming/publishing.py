"""The publish job: messages into stored items, locations, provider offers and search documents, batch by batch.

Tables lie in buckets (:mod:`quaywise.sources.buckets`); a batch reads and writes the buckets of the catalogues it names
and of the items its offers reach in other catalogues. These are found by a table of places (item id to catalogue),
bucketed by item id, so a batch never scans all items. Messages of a batch count as published together, in order of
``seq``: of rows with the same key the last one counts, and a full update of a catalogue drops what came before it.

A batch, in this order:

1. listed resources replace stored ones, whole; offers that the message does not restate are carried over with their
   payloads; the time of creation stays;
2. stored items of the catalogue that hold an offer of the message get it merged in by id (linked items), and so do items
   of any catalogue that an offer lists (appended where it is new to them);
3. a catalogue that describes itself (descriptor or provider) stamps its metadata on its other items;
4. locations of replaced items are replaced, provider offers are upserted;
5. after the commit, documents of all changed items are written to the index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quaywise.functions import scalars, walks
from quaywise.operators import documents, payloads, publish
from quaywise.sources.buckets import BucketedTable, Versions, last_batch, read_manifest, vacuum, write_manifest

BUCKETS = 64
OFFERS = "array<struct<offer_id:string,offer:string>>"
RESOURCE_PATH = "$.catalogs[*].resources[*]"
TABLES, INDEX = "_tables", "_index"

#: name: (schema, key of the bucket)
SCHEMAS = {
    "items": (
        f"catalog_id string, id string, meta string, resource string, offers {OFFERS}, offer_ids array<string>, type string, context_url string, "
        "network_id array<string>, created_at timestamp, updated_at timestamp, batch long",
        "catalog_id",
    ),
    "places": ("id string, catalog_id string", "id"),
    "locations": ("item_id string, catalog_id string, path string, seq smallint, geometry struct<kind:string,ring:array<struct<x:double,y:double>>>", "catalog_id"),
    "provider_offers": ("offer_id string, catalog_id string, provider_id string, payload string, created_at timestamp", "catalog_id"),
    "documents": ("doc_key string, catalog_id string, id string, index_key string, catalog_name string, provider_id string, network_id array<string>, text string", "catalog_id"),
}


def state_table(state_dir: str, name: str, buckets: int = BUCKETS) -> BucketedTable:
    schema, key = SCHEMAS[name]
    return BucketedTable(state_dir, name, schema, key, buckets)


def current(spark: SparkSession, state_dir: str, name: str, batch: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A stored table as the last batch (or the named one) left it."""
    group = INDEX if name == "documents" else TABLES
    batch = last_batch(spark, state_dir, group) if batch is None else batch
    return state_table(state_dir, name, buckets).read(spark, read_manifest(spark, state_dir, group, batch, buckets))


def valid_catalogs(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed messages, their catalogues): both with a ``reject_reason`` where they are refused."""
    parsed = publish.parse_messages(batch)
    catalogs = publish.split_catalogs(parsed)
    problems = publish.catalog_problems(F.col("catalog"))
    broken = F.when(F.size(problems) > 0, F.concat(F.lit("validation: "), F.array_join(problems, "; ")))
    return parsed, catalogs.withColumn("reject_reason", F.coalesce("reject_reason", broken))


def live_catalogs(catalogs: DataFrame, times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalogues that count, with ``meta``, ``describes``, ``networks`` and ``ts``; ``catalog_id`` of full updates)."""
    good = catalogs.where("reject_reason is null")
    full = good.where("update_mode = 'FULL'").groupBy("catalog_id").agg(F.max("seq").alias("full_seq"))
    live = good.join(full, "catalog_id", "left").where("full_seq is null or seq >= full_seq").drop("full_seq").join(times, "seq")
    member = lambda name: F.try_variant_get("catalog", f"$.{name}", "variant")
    has = lambda name: member(name).isNotNull() & ~F.is_variant_null(member(name))
    meta = F.to_json(payloads.metadata_slice(F.col("catalog"))).alias("meta")
    networks = payloads.visible_networks(F.col("catalog"), F.col("visible_to")).alias("networks")
    return live.select("*", meta, (has("descriptor") | has("provider")).alias("describes"), networks), full.select("catalog_id")


def merge_offers(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """``rows`` (items) with the ``patches`` (``catalog_id, id, offer_id, patch, seq``) merged into their offers by id, in
    order of ``seq``; an offer that an item does not hold yet is appended. ``patched`` tells which rows had one."""
    by_item = patches.groupBy(*publish.KEYS).agg(F.array_sort(F.collect_list(F.struct("seq", "offer_id", "patch"))).alias("patches"))
    joined = rows.join(by_item, publish.KEYS, "left")
    some = joined.where("patches is not null")
    kind = pa.list_(pa.struct([("offer_id", pa.string()), ("offer", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for offers, more in zip(batch.column("offers").to_pylist(), batch.column("patches").to_pylist(), strict=True):
                held = {o["offer_id"]: n for n, o in enumerate(offers) if o["offer_id"] is not None}
                for p in more:
                    if p["offer_id"] in held:
                        old = offers[held[p["offer_id"]]]
                        old["offer"] = json.dumps(walks.deep_merge_patch(json.loads(old["offer"]), json.loads(p["patch"])), ensure_ascii=False)
                    else:
                        held[p["offer_id"]] = len(offers)
                        offers.append({"offer_id": p["offer_id"], "offer": p["patch"]})
                merged.append(offers)
            at = batch.schema.get_field_index("offers")
            yield batch.set_column(at, "offers", pa.array(merged, kind))

    done = some.mapInArrow(run, some.schema).drop("patches").withColumn("patched", F.lit(True))
    done = done.withColumn("offer_ids", F.array_union("offer_ids", F.array_compact(F.transform("offers", lambda o: o["offer_id"]))))
    return joined.where("patches is null").drop("patches").withColumn("patched", F.lit(False)).unionByName(done)


def replaced_items(existing: DataFrame, live: DataFrame, offers: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item rows of the listed resources; the batch's offers by catalogue and id; the listed resources)."""
    resources = publish.latest_version(publish.catalog_resources(live), publish.KEYS)
    restated = publish.latest_version(offers.where("offer_id is not null"), ["catalog_id", "offer_id"])
    every = restated.unionByName(offers.where("offer_id is null"))
    own = F.array_sort(F.collect_list(F.struct("seq", "offer_id", F.to_json(publish.strip_nulls(F.col("offer"))).alias("offer"))))
    listed = every.withColumn("id", F.explode("resource_ids")).groupBy(*publish.KEYS).agg(own.alias("own"))
    of_message = live.select("seq", "catalog_id", "catalog", "meta", "networks", "ts").dropDuplicates(["seq", "catalog_id"])
    fresh = resources.join(of_message, ["seq", "catalog_id"]).join(listed, publish.KEYS, "left")

    names = restated.groupBy("catalog_id").agg(F.collect_set("offer_id").alias("restated"))  # the ids of one batch's messages
    old = existing.select(*publish.KEYS, F.col("offers").alias("held"), F.col("created_at").alias("was"))
    fresh = fresh.join(old, publish.KEYS, "left").join(names, "catalog_id", "left")
    none, no_ids = F.array().cast(OFFERS), F.array().cast("array<string>")
    mine = F.coalesce(F.transform("own", lambda o: F.struct(o["offer_id"].alias("offer_id"), o["offer"].alias("offer"))), none)
    kept = F.filter(F.coalesce("held", none), lambda o: ~F.coalesce(F.array_contains(F.coalesce("restated", no_ids), o["offer_id"]), F.lit(False)))
    r = F.col("resource")
    rows = fresh.select(
        "catalog_id", "id", "meta", F.to_json("resource").alias("resource"), F.concat(mine, kept).alias("offers"),
        payloads.schema_type(F.lit(None).cast("string"), F.array(r)).alias("type"), payloads.context_url(r, F.col("catalog")).alias("context_url"),
        F.coalesce("networks", no_ids).alias("network_id"), F.coalesce("was", "ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )
    ids = F.array_compact(F.transform("offers", lambda o: o["offer_id"]))
    return rows.withColumn("offer_ids", ids).withColumn("batch", F.lit(batch_id).cast("long")), restated, resources


def offer_patches(rows: DataFrame, incoming: DataFrame, restated: DataFrame) -> DataFrame:
    """``catalog_id, id, offer_id, patch, seq``: offers that reach stored items which their message does not list."""
    offers = restated.select("catalog_id", "offer_id", "resource_ids", F.to_json("offer").alias("patch"), "seq")
    handled = incoming.select(*publish.KEYS)
    held = rows.select(*publish.KEYS, F.explode("offer_ids").alias("offer_id"))
    linked = held.join(offers.drop("resource_ids"), ["catalog_id", "offer_id"]).join(handled, publish.KEYS, "left_anti")
    reaching = offers.select(F.col("catalog_id").alias("by"), F.explode("resource_ids").alias("id"), "offer_id", "patch", "seq")
    done = handled.unionByName(linked.select(*publish.KEYS).distinct()).withColumnRenamed("catalog_id", "by")
    cross = reaching.join(done, ["by", "id"], "left_anti").join(rows.select(*publish.KEYS), "id")
    columns = [*publish.KEYS, "offer_id", "patch", "seq"]
    return linked.select(*columns).unionByName(cross.select(*columns)).dropDuplicates([*publish.KEYS, "offer_id", "seq"])


def restamped(rows: DataFrame, live: DataFrame) -> DataFrame:
    """``rows`` with the metadata of catalogues that describe themselves in the batch, on items that it does not replace;
    ``stamped`` tells which changed."""
    last = publish.latest_version(live.where("describes"), ["catalog_id"]).select("catalog_id", F.col("meta").alias("_meta"))
    joined = rows.join(last, "catalog_id", "left")
    changed = F.col("_meta").isNotNull() & ~F.col("meta").eqNullSafe(F.col("_meta"))
    return joined.withColumn("stamped", changed).withColumn("meta", F.when(changed, F.col("_meta")).otherwise(F.col("meta"))).drop("_meta")


def published_locations(resources: DataFrame) -> DataFrame:
    """Location rows of resources (``catalog_id, id, resource``), numbered within item, catalogue and path."""
    found = walks.extract_geometries(resources, publish.KEYS, F.col("resource"))
    path = F.concat(F.lit(RESOURCE_PATH), F.substring("path", 2, 10_000))
    rows = found.select(F.col("id").alias("item_id"), "catalog_id", path.alias("path"), "pos", "geometry")
    return publish.location_seq(rows).select("item_id", "catalog_id", "path", "seq", "geometry")


def index_documents(items: DataFrame) -> DataFrame:
    """Search documents of stored items."""
    meta = F.try_parse_json("meta")
    name = F.try_variant_get(meta, "$.descriptor.name", "string")
    provider = documents.provider_id(meta)
    rows = items.select(*publish.KEYS, "type", "network_id", name.alias("catalog_name"), provider.alias("provider_id"), "resource", F.transform("offers", lambda o: o["offer"]).alias("offers"))
    text = documents.text_blobs(rows, "resource", "offers", "text").drop("resource", "offers")
    return text.select(scalars.doc_id(F.col("catalog_id"), F.col("id")).alias("doc_key"), *publish.KEYS, scalars.index_key(F.col("type")).alias("index_key"), "catalog_name", "provider_id", "network_id", "text")


def staged(df: DataFrame, state_dir: str, name: str) -> DataFrame:
    """``df`` written beside the state and read again: later steps start from a table, not from a plan that grows, and lost
    executors cost nothing that was done. A batch overwrites what the one before it staged."""
    path = f"{state_dir}/_staging/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apply_publish(batch: DataFrame, batch_id: int, state_dir: str, buckets: int = BUCKETS, keep: int | None = None) -> None:
    """One micro-batch, from the state that the batch before it left; ``keep`` removes versions that only older
    manifests name."""
    spark = batch.sparkSession
    of = {name: state_table(state_dir, name, buckets) for name in SCHEMAS}
    stage = partial(staged, state_dir=state_dir)
    before = read_manifest(spark, state_dir, TABLES, batch_id - 1, buckets)
    batch = stage(batch, name="batch")
    parsed, catalogs = valid_catalogs(batch)
    catalogs = stage(catalogs, name="catalogs")
    live, full = live_catalogs(catalogs, batch.select("seq", "ts").dropDuplicates(["seq"]))
    live, full = stage(live, name="live"), stage(full, name="full")

    # what the batch touches: its catalogues, and the catalogues of items that its offers list
    named = of["items"].touched(live)
    offers = stage(publish.catalog_offers(live), name="offers")
    reached = offers.select(F.explode("resource_ids").alias("id")).distinct()
    places = of["places"].read(spark, before, of["places"].touched(reached)).join(reached, "id", "left_semi")
    touched = named | of["items"].touched(places)

    stored = of["items"].read(spark, before, touched).join(full, "catalog_id", "left_anti")
    incoming, restated, resources = replaced_items(stored, live, offers, batch_id)
    incoming, restated = stage(incoming, name="incoming"), stage(restated, name="restated")
    others = restamped(stored.join(incoming.select(*publish.KEYS), publish.KEYS, "left_anti"), live)
    rows = stage(incoming.withColumn("stamped", F.lit(False)).unionByName(others), name="rows")
    patches = stage(offer_patches(rows, incoming, restated), name="patches")
    now = batch.agg(F.max("ts").alias("t")).first()["t"]
    merged = merge_offers(rows, patches)
    changed = F.col("patched") | F.col("stamped")
    merged = merged.withColumns({
        "updated_at": F.when(changed, F.greatest("updated_at", F.lit(now))).otherwise(F.col("updated_at")),
        "batch": F.when(changed, F.lit(batch_id).cast("long")).otherwise(F.col("batch")),
    })
    after = of["items"].write(merged, batch_id, touched, before)

    gone = of["items"].read(spark, before, named).join(full, "catalog_id", "left_semi").select("id", "catalog_id")
    moved = of["places"].touched(gone.select("id").unionByName(incoming.select("id")))
    kept = of["places"].read(spark, before, moved).join(gone, ["id", "catalog_id"], "left_anti")
    after = of["places"].write(kept.unionByName(incoming.select("id", "catalog_id")).distinct(), batch_id, moved, after)

    locations = of["locations"].read(spark, before, named).join(full, "catalog_id", "left_anti")
    after = of["locations"].write(publish.replace_locations(locations, incoming, published_locations(resources)), batch_id, named, after)

    _, whole = publish.offer_index(offers)
    last = publish.latest_version(whole.where("offer_id is not null"), ["offer_id", "catalog_id"]).join(batch.select("seq", F.col("ts").alias("created_at")).dropDuplicates(["seq"]), "seq")
    stamped = last.select("offer_id", "catalog_id", "provider_id", F.to_json(publish.strip_nulls(F.col("offer"))).alias("payload"), "created_at")
    whole_before = of["provider_offers"].read(spark, before, named).join(full, "catalog_id", "left_anti").select(*of["provider_offers"].columns)
    after = of["provider_offers"].write(publish.upsert(whole_before, stamped, ["offer_id", "catalog_id"]), batch_id, named, after)
    write_manifest(spark, state_dir, TABLES, batch_id, after, buckets)

    index_batch(spark, batch_id, state_dir, after, touched, full, buckets)
    report(parsed, catalogs, incoming, batch_id, state_dir)
    if keep:
        vacuum(spark, [t for n, t in of.items() if n != "documents"], TABLES, keep)
        vacuum(spark, [of["documents"]], INDEX, keep)


def index_batch(spark: SparkSession, batch_id: int, state_dir: str, committed: Versions, touched: set[int], full: DataFrame, buckets: int) -> None:
    """The index follows the commit: it reads the committed items that this batch changed."""
    items, docs = (state_table(state_dir, n, buckets) for n in ("items", "documents"))
    before = read_manifest(spark, state_dir, INDEX, batch_id - 1, buckets)
    fresh = index_documents(items.read(spark, committed, touched).where(F.col("batch") == batch_id))
    written = publish.write_index(docs.read(spark, before, touched), fresh, full)
    write_manifest(spark, state_dir, INDEX, batch_id, docs.write(written, batch_id, touched, before), buckets)


def report(parsed: DataFrame, catalogs: DataFrame, incoming: DataFrame, batch_id: int, state_dir: str) -> None:
    """Rejects, and how each catalogue fared."""
    bad = publish.rejects(parsed).unionByName(publish.rejects(catalogs.withColumn("value", F.to_json("catalog"))))
    bad.write.mode("overwrite").text(f"{state_dir}/rejects/batch={batch_id}")
    counted = incoming.groupBy("catalog_id").agg(F.count("*").alias("saved"))
    results = with_status(catalogs, counted)
    results.withColumn("value", publish_result("catalog_id", "status", "saved", "errors")).write.mode("overwrite").parquet(f"{state_dir}/results/batch={batch_id}")


def with_status(catalogs: DataFrame, saved: DataFrame) -> DataFrame:
    """``catalog_id, errors, saved, status`` of a batch's catalogues, from what was refused and what was saved of each."""
    results = catalogs.groupBy("catalog_id").agg(F.count("reject_reason").alias("errors")).join(saved, "catalog_id", "left").fillna(0, ["saved"])
    return results.withColumn("status", publish.result_status(F.col("saved"), F.col("errors")))


def publish_result(catalog: str, status: str, saved: str, errors: str):
    """The body that tells a publisher how a catalogue fared, as JSON."""
    result = F.struct(F.col(catalog).alias("catalogId"), F.col(status).alias("status"), F.col(saved).alias("resourceCount"), F.col(errors).alias("errorCount"))
    return F.to_json(F.struct(F.struct(F.lit("on_publish").alias("action")).alias("context"), F.struct(F.array(result).alias("results")).alias("message")))


def publish_stream(messages: DataFrame, state_dir: str, checkpoint: str, buckets: int = BUCKETS, keep: int | None = None) -> DataStreamWriter:
    """At-least-once publishing; the checkpoint is the acknowledgement, and a batch that comes again changes nothing."""
    apply = partial(apply_publish, state_dir=state_dir, buckets=buckets, keep=keep)
    return messages.writeStream.foreachBatch(lambda df, n: apply(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
