"""From matching rows to answers: regrouping into catalogues, pruning, offer enrichment, final checks.

Rows are keyed by intent. An offer is ``struct<offer_id, resource_ids, price>``; ``resource_ids`` is empty for
an offer of the whole provider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_IDS = "array<string>"


def newest_first(rows: DataFrame, limit: int, by: list[str] | None = None) -> DataFrame:
    """The newest rows first, with their ``rank``; per intent where ``by`` names it. No positive limit: 100."""
    n = limit if limit > 0 else 100
    order = [F.desc("updated_at"), "catalog_id", "id"]
    if by:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most n rows


def group_into_catalogs(rows: DataFrame, by: str = "intent_id") -> DataFrame:
    """One row per intent and catalogue: metadata of its first row, resources and offers of all rows in rank order.

    Reads ``by, rank, catalog_id, catalog_name, provider_id, id, name, offers``.
    """
    meta = F.min_by(F.struct("catalog_name", "provider_id"), "rank")
    resources = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct("id", "name").alias("r")))), lambda x: x["r"])
    offers = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "offers"))), lambda x: x["offers"]))
    grouped = rows.groupBy(by, "catalog_id").agg(meta.alias("m"), F.min("rank").alias("rank"), resources.alias("resources"), offers.alias("offers"))
    return grouped.select(by, "catalog_id", "m.catalog_name", "m.provider_id", "rank", "resources", "offers")


def first_of_each(items: Column, field: str) -> Column:
    """The first element of each value of a field, in order; elements without one all stay.

    Elements are sorted by value and place, so each is compared with the one before it only.
    """
    placed = F.array_sort(F.transform(items, lambda x, i: F.struct(x[field].alias("id"), i.alias("i"), x.alias("x"))))

    def firsts(s: Column) -> Column:  # bound once, where a column would be computed again for each element
        new = lambda x, i: x["id"].isNull() | (i == 0) | ~F.get(s, i - 1)["id"].eqNullSafe(x["id"])
        return F.array_sort(F.transform(F.filter(s, new), lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x"))))

    return F.transform(F.transform(F.array(placed), firsts)[0], lambda x: x["x"])


def dedupe_offers(offers: Column) -> Column:
    """First offer of each id in order; offers without an id all stay."""
    return first_of_each(offers, "offer_id")


def prune_resources_by_offers(resources: Column, offers: Column) -> Column:
    """If any offer lists ids, only listed resources stay."""
    listed = F.flatten(F.transform(offers, lambda o: F.coalesce(o["resource_ids"], F.array().cast(NO_IDS))))
    return F.when(F.size(listed) > 0, F.filter(resources, lambda r: F.array_contains(listed, r["id"]))).otherwise(resources)


def prune_offers_by_resources(offers: Column, resources: Column) -> Column:
    """Offers that list a kept resource."""
    ids = F.transform(resources, lambda r: r["id"])
    return F.filter(offers, lambda o: F.coalesce(F.arrays_overlap(o["resource_ids"], ids), F.lit(False)))


def mutual_pruning(catalogs: DataFrame) -> DataFrame:
    """Offers once each, resources the offers name, offers the resources keep, and no empty catalogue."""
    once = catalogs.withColumn("offers", dedupe_offers(F.col("offers")))
    kept = once.withColumn("resources", prune_resources_by_offers(F.col("resources"), F.col("offers")))
    return kept.withColumn("offers", prune_offers_by_resources(F.col("offers"), F.col("resources"))).where(F.size("resources") > 0)


def provider_offers(offers: DataFrame) -> DataFrame:
    """``provider_id, provider_offers``: offers that list no resource, by provider."""
    whole = offers.where((F.coalesce(F.size("resource_ids"), F.lit(0)) <= 0) & F.col("provider_id").isNotNull())
    every = F.array_sort(F.collect_list(F.struct("offer_id", "resource_ids", "price")))
    return whole.groupBy("provider_id").agg(dedupe_offers(every).alias("provider_offers"))


def enrich_with_provider_offers(catalogs: DataFrame, offers: DataFrame) -> DataFrame:
    """Append the provider's own offers that are not there yet (joined on the provider alone, across catalogues)."""
    wanted = catalogs.select("provider_id").distinct()
    joined = catalogs.join(provider_offers(offers.join(wanted, "provider_id", "left_semi")), "provider_id", "left")
    more = F.coalesce("provider_offers", F.filter("offers", lambda o: F.lit(False)))
    ids = F.transform("offers", lambda o: o["offer_id"])
    other = F.transform(F.array(ids), lambda own: F.filter(more, lambda o: ~F.coalesce(F.array_contains(own, o["offer_id"]), F.lit(False))))[0]
    return joined.withColumn("offers", F.concat("offers", other)).drop("provider_offers")


def with_offer_counts(catalogs: DataFrame, offers: DataFrame, by: str = "intent_id") -> DataFrame:
    """``n_offers``: how many offers :func:`enrich_with_provider_offers` would leave in each row (one per ``by`` and
    catalogue). Provider offers are counted, never listed, so that memory does not grow with a provider's offers."""
    whole = offers.where((F.coalesce(F.size("resource_ids"), F.lit(0)) <= 0) & F.col("provider_id").isNotNull())
    whole = whole.join(catalogs.select("provider_id").distinct(), "provider_id", "left_semi")
    once = whole.groupBy("provider_id", "offer_id").agg(F.count("*").alias("n"))
    each = F.when(F.col("offer_id").isNull(), F.col("n")).otherwise(F.lit(1))  # offers without an id all stay
    every = once.groupBy("provider_id").agg(F.sum(each).alias("_every"))
    own = catalogs.select(by, "catalog_id", "provider_id", F.explode(F.array_distinct(F.transform("offers", lambda o: o["offer_id"]))).alias("offer_id"))
    held = own.join(once.select("provider_id", "offer_id"), ["provider_id", "offer_id"]).groupBy(by, "catalog_id").agg(F.count("*").alias("_held"))
    joined = catalogs.join(every, "provider_id", "left").join(held, [by, "catalog_id"], "left")
    n = F.size("offers") + F.coalesce("_every", F.lit(0)) - F.coalesce("_held", F.lit(0))
    return joined.withColumn("n_offers", n.cast("long")).drop("_every", "_held")


def discard_without_offers(catalogs: DataFrame) -> DataFrame:
    return catalogs.where(F.size("offers") > 0)


def drop_broken_answers(catalogs: DataFrame, by: str = "intent_id") -> DataFrame:
    """One catalogue without id, resources or resource ids empties its whole answer."""
    ok = F.col("catalog_id").isNotNull() & (F.size("resources") > 0) & F.forall("resources", lambda r: r["id"].isNotNull())
    bad = F.max(~F.coalesce(ok, F.lit(False))).over(Window.partitionBy(by))
    return catalogs.withColumn("_bad", bad).where(~F.col("_bad")).drop("_bad")


def attach_offers(hits: DataFrame, offers: DataFrame) -> DataFrame:
    """``hits`` (keyed by intent, catalogue and id) with the ``offers`` of the same catalogue that list them."""
    wanted = offers.join(hits.select("catalog_id").distinct(), "catalog_id", "left_semi")  # before their lists are taken apart
    listed = wanted.select("catalog_id", F.explode("resource_ids").alias("id"), F.struct("offer_id", "resource_ids", "price").alias("o"))
    joined = hits.join(listed, ["catalog_id", "id"], "left")
    own = F.array_sort(F.collect_list("o")).alias("offers")  # nulls are not collected
    return joined.groupBy(*hits.columns).agg(own)


def merge_catalogs_by_provider(catalogs: DataFrame, by: str = "intent_id") -> DataFrame:
    """Catalogues of one provider as one: key provider, else that of the first resource that names one (where
    resources have a ``provider_id``), else catalogue; resources united by id."""
    keys = ["provider_id", "catalog_id"]
    if "provider_id" in catalogs.schema["resources"].dataType.elementType.names:
        named = F.filter("resources", lambda r: F.coalesce(F.trim(r["provider_id"]), F.lit("")) != "")
        keys.insert(1, F.get(named, F.lit(0))["provider_id"])
    keyed = catalogs.withColumn("merge_key", F.coalesce(*keys))
    first = F.min_by("catalog_id", F.struct("rank", "catalog_id"))
    in_order = lambda name: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "catalog_id", name))), lambda x: x[name]))
    merged = keyed.groupBy(by, "merge_key").agg(first.alias("catalog_id"), F.min("rank").alias("rank"), in_order("resources").alias("all"), in_order("offers").alias("offers"))
    return merged.select(by, "merge_key", "catalog_id", "rank", first_of_each(F.col("all"), "id").alias("resources"), dedupe_offers(F.col("offers")).alias("offers"))


def offers_from_match(matched: Column, offers: Column) -> Column:
    """Matched elements (variants) if the first looks like an offer, else the payload's offers."""
    first = F.get(matched, F.lit(0))
    has = lambda path: F.try_variant_get(first, path, "variant").isNotNull()
    like = has("$.offerAttributes") | (has("$.resourceIds") & ~has("$.resourceAttributes"))
    return F.when(F.coalesce(like, F.lit(False)), matched).otherwise(offers)


def response_context(request: Column, provider: str | None = None, uri: str | None = None) -> Column:
    """The request's context with action and, if configured, the provider's identity; minimal if absent."""
    base = F.coalesce(F.from_json(F.to_json(request), "map<string,string>"), F.map_from_arrays(F.array().cast(NO_IDS), F.array().cast(NO_IDS)))
    own = {"action": "on_discover"} | ({"bppId": provider} if provider else {}) | ({"bppUri": uri} if uri else {})
    kept = F.map_filter(base, lambda k, v: ~k.isin(*own))
    return F.map_concat(kept, F.create_map(*[F.lit(x) for pair in own.items() for x in pair]))


def envelopes(responses: DataFrame) -> DataFrame:
    """``key, value``: callback envelopes (``transaction_id, subscriber_id, record_id, payload`` rows) as JSON."""
    meta = F.struct(F.col("subscriber_id").alias("subscriberId"), F.col("record_id").alias("recordId"))
    return responses.select(F.col("transaction_id").alias("key"), F.to_json(F.struct(meta.alias("meta"), F.col("payload").alias("payload"))).alias("value"))


def normalise_catalogs(catalogs: DataFrame) -> DataFrame:
    """Catalogues and resources with blank ids go; a catalogue without provider takes that of its first resource
    that has one (``resources`` with ``id`` and ``provider_id``)."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    kept = catalogs.where(~blank(F.col("catalog_id"))).withColumn("resources", F.filter("resources", lambda r: ~blank(r["id"])))
    named = F.filter("resources", lambda r: ~blank(r["provider_id"]))
    return kept.withColumn("provider_id", F.coalesce(F.when(~blank(F.col("provider_id")), F.col("provider_id")), F.get(named, F.lit(0))["provider_id"]))


def location_level(field: Column) -> Column:
    """Whether an index field (``loc_...``) holds locations of the ``provider`` or of the ``resource`` itself; null for those of
    offers and attributes, which come with their own members."""
    has = lambda name: field.contains(f"_{name}_")
    attributes = has("providerAttributes") | has("resourceAttributes")
    resource = has("resources") & ~has("provider") & ~attributes & ~has("offers")
    return F.when(has("provider") & ~has("providerAttributes"), "provider").when(resource, "resource")


def collect_locations(locations: DataFrame, level: str) -> DataFrame:
    """``item_id, catalog_id, locations``: the locations of a level of each item (rows ``item_id, catalog_id, field, seq,
    location``), in order of field and number."""
    own = locations.where(location_level(F.col("field")) == level)
    ordered = F.array_sort(F.collect_list(F.struct("field", "seq", "location")))
    return own.groupBy("item_id", "catalog_id").agg(F.transform(ordered, lambda x: x["location"]).alias("locations"))
