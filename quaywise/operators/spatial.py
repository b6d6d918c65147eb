"""Spatial filters as semi joins: stored locations meet query shapes through grid cells, then by exact test."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaywise.functions import geo, shapes
from quaywise.operators.text import sent_if_small

KEYS = ["item_id", "catalog_id"]
#: What the index side supports; other relations are skipped there.
INDEX_RELATIONS = {"s_dwithin", "s_intersects", "s_within", "s_contains", "s_disjoint"}


def on_paths(locations: DataFrame, targets: list[str] | None) -> DataFrame:
    """Locations of the target paths; no target means any."""
    return locations.where(F.col("path").isin(*targets)) if targets else locations


def points_within(locations: DataFrame, circles: DataFrame, *columns: str) -> DataFrame:
    """``intent_id, item_id, catalog_id, distance_m`` and further ``columns`` of the locations: every point location within
    each circle (``intent_id, lon, lat, metres``). Nothing is shuffled where the circles are few."""
    points = locations.where(F.col("geometry.kind") == "Point").select(*KEYS, *columns, F.col("geometry.ring")[0]["x"].alias("x"), F.col("geometry.ring")[0]["y"].alias("y"))
    points = points.withColumn("cell", geo.cell_of(F.col("x"), F.col("y")))
    covered = circles.select("intent_id", "lon", "lat", "metres", F.explode(geo.cells_of_circle(F.col("lon"), F.col("lat"), F.col("metres"))).alias("cell"))
    near = points.join(covered, "cell").withColumn("distance_m", geo.haversine_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")))
    return near.where(F.col("distance_m") <= F.col("metres")).select("intent_id", *KEYS, "distance_m", *columns)


def within_distance(locations: DataFrame, circles: DataFrame) -> DataFrame:
    """``intent_id, item_id, catalog_id, distance_m``: point locations within each circle
    (``intent_id, lon, lat, metres``), nearest location per item."""
    return points_within(locations, circles).groupBy("intent_id", *KEYS).agg(F.min("distance_m").alias("distance_m"))


def within_distance_of_lines(locations: DataFrame, lines: DataFrame) -> DataFrame:
    """``intent_id, item_id, catalog_id, distance_m``: point locations within some metres of each line (``intent_id,
    chain, metres``, the chain not over the 180th meridian), nearest location per item."""
    points = locations.where(F.col("geometry.kind") == "Point").select(*KEYS, F.col("geometry.ring")[0]["x"].alias("x"), F.col("geometry.ring")[0]["y"].alias("y"))
    points = points.withColumn("cell", geo.cell_of(F.col("x"), F.col("y")))
    bounds = geo.box(F.col("chain"))
    farthest = F.greatest(F.abs(bounds["y1"]), F.abs(bounds["y2"]))
    covered = lines.withColumn("cell", F.explode(geo.cells_of_box(geo.wider(bounds, farthest, F.col("metres")))))
    near = points.join(covered, "cell").withColumn("distance_m", geo.chain_m(F.col("x"), F.col("y"), F.col("chain")))
    return near.where(F.col("distance_m") <= F.col("metres")).groupBy("intent_id", *KEYS).agg(F.min("distance_m").alias("distance_m"))


def areas_within_distance(locations: DataFrame, circles: DataFrame) -> DataFrame:
    """``intent_id, item_id, catalog_id, distance_m``: stored areas within each circle (``intent_id, lon, lat,
    metres``); an area around the centre is at distance zero."""
    areas = locations.where(F.col("geometry.kind") == "Polygon").select(*KEYS, F.col("geometry.ring").alias("ring"))
    areas = areas.withColumn("cell", F.explode(geo.cells_of_box(geo.box(F.col("ring")))))
    covered = circles.select("intent_id", "lon", "lat", "metres", F.explode(geo.cells_of_circle(F.col("lon"), F.col("lat"), F.col("metres"))).alias("cell"))
    pairs = areas.join(covered, "cell").drop("cell").dropDuplicates(["intent_id", *KEYS, "ring"])
    lon, lat, ring = F.col("lon"), F.col("lat"), F.col("ring")
    near = pairs.withColumn("distance_m", F.when(geo.in_ring(lon, lat, ring), F.lit(0.0)).otherwise(geo.chain_m(lon, lat, ring)))
    return near.where(F.col("distance_m") <= F.col("metres")).groupBy("intent_id", *KEYS).agg(F.min("distance_m").alias("distance_m"))


def refine(pairs: DataFrame, relations: list[str]) -> DataFrame:
    """Pairs (``intent_id, item_id, catalog_id, stored, ring``) without their shapes, with ``held``: the relations that they are in,
    by Arrow batch."""
    tests = [shapes.RELATIONS[r] for r in relations]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for stored, ring in zip(batch.column("stored"), batch.column("ring"), strict=True):
                r, s = (np.stack([v.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1) for v in (stored, ring))
                held.append([name for name, test in zip(relations, tests, strict=True) if test(r, s)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(held, pa.list_(pa.string()))], names=[*names, "held"])

    names = ["intent_id", *KEYS]
    kinds = dict(pairs.dtypes)
    return pairs.select(*names, "stored", "ring").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", held array<string>")


def related(locations: DataFrame, queries: DataFrame, relation: str) -> DataFrame:
    """``intent_id, item_id, catalog_id`` with some location in the relation to the intent's ring (``intent_id, ring``)."""
    return related_by(locations, queries, [relation]).drop("relation")


def related_by(locations: DataFrame, queries: DataFrame, relations: list[str]) -> DataFrame:
    """``relation, intent_id, item_id, catalog_id`` for each of ``relations`` that some location is in to the intent's ring
    (``intent_id, ring``). Shapes meet by grid cell and bounds, each pair in one cell only, and what meets is tested exactly.

    Disjoint holds if *some* location is disjoint. Nearly every pair is, so there the intents, a stated query set, meet the
    items, not their locations, and those are left out that all of an item's locations meet: no pair is shuffled.
    """
    stored = locations.select(*KEYS, F.col("geometry.ring").alias("stored")).withColumn("sb", geo.box(F.col("stored")))
    asked = queries.select("intent_id", "ring").withColumn("qb", geo.box(F.col("ring")))
    left = stored.withColumn("cell", F.explode(geo.cells_of_box(F.col("sb"))))
    right = asked.withColumn("cell", F.explode(geo.cells_of_box(F.col("qb"))))
    once = geo.boxes_meet(F.col("sb"), F.col("qb")) & (F.col("cell") == geo.first_shared_cell(F.col("sb"), F.col("qb")))
    pairs = left.join(right, "cell").where(once).select("intent_id", *KEYS, "stored", "ring")
    met = [r for r in relations if r != "s_disjoint"]
    found = []
    if met:
        held = refine(pairs, met).select(F.explode("held").alias("relation"), "intent_id", *KEYS)
        found.append(held.distinct())
    if "s_disjoint" in relations:
        found.append(_some_apart(stored, asked, refine(pairs, ["s_disjoint"]).where(F.size("held") == 0)))
    return reduce(DataFrame.unionByName, found)


def _some_apart(stored: DataFrame, asked: DataFrame, meeting: DataFrame) -> DataFrame:
    """Items and intents with some pair of shapes that is not among the pairs ``meeting``."""
    bounded = lambda c: geo.boxes_meet(F.col(c), F.col(c))  # noqa: E731  null for a shape without bounds
    items = stored.where(bounded("sb")).groupBy(*KEYS).agg(F.count("*").alias("n"))
    intents = asked.where(bounded("qb")).groupBy("intent_id").agg(F.count("*").alias("rings"))
    touching = meeting.groupBy("intent_id", *KEYS).agg(F.count("*").alias("pairs"))
    touching = touching.groupBy(*(F.col(k).alias(f"_{k}") for k in KEYS)).agg(F.collect_list(F.struct("intent_id", "pairs")).alias("met"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS))
    every = items.join(touching, same, "left").crossJoin(sent_if_small(intents))
    all_meet = F.exists("met", lambda m: m["intent_id"].eqNullSafe(F.col("intent_id")) & (m["pairs"] >= F.col("n") * F.col("rings")))
    return every.where(~F.coalesce(all_meet, F.lit(False))).select(F.lit("s_disjoint").alias("relation"), "intent_id", *KEYS)


def index_spatial(locations: DataFrame, constraint: dict, intents: DataFrame) -> DataFrame | None:
    """The index side's subset of a constraint (``op, targets, quantifier``): its first target only, and nothing
    for a quantifier other than ``any`` or a relation it does not know. None means: skipped."""
    if constraint.get("op") not in INDEX_RELATIONS or constraint.get("quantifier", "any") != "any":
        return None
    own = on_paths(locations, (constraint.get("targets") or [])[:1])
    return within_distance(own, intents) if constraint["op"] == "s_dwithin" else related(own, intents, constraint["op"])


def keep_matching(items: DataFrame, *matches: DataFrame) -> DataFrame:
    """Items (``id, catalog_id``) that are in every match set, joined on both keys."""
    for m in matches:
        items = items.join(m.select(F.col("item_id").alias("id"), "catalog_id").distinct(), ["id", "catalog_id"], "left_semi")
    return items
