"""Registered queries for every combination of filter, place and text in one discover plan, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywise.operators import text
from quaywise.plans import discover
from quaywise.plans.catalogue_queries import CIRCLES_SQL, NOW, TOKENS_SQL, TS_SQL, circles, haversine_sql, query
from quaywise.sources import derived
from quaywise.sources.derived import sql_with, table

LEAST = 0.9995
FILTER = "$.catalogs[*].resources[*] ? (@.resourceAttributes.size >= {})"
WORDS = ["small widget", "widgt", "large bolt", "cold rod"]


def _intents(spark: SparkSession, d: str, expression: bool, place: bool, words: bool) -> DataFrame:
    """One intent per nation: two different filters, a circle, and texts of which some are misspelt."""
    n = F.col("intent_id")
    base = circles(spark, d).select("intent_id", "lon", "lat", (F.col("metres") * 4).alias("metres"))
    spelt = F.element_at(F.array(*map(F.lit, WORDS)), (n % len(WORDS) + 1).cast("int"))
    vector = F.array((n + 1).cast("double"), (n % 7 + 1).cast("double"), (n % 5 + 1).cast("double"))
    null = lambda kind: F.lit(None).cast(kind)
    filters = F.when(n % 2 == 0, FILTER.format(10)).otherwise(FILTER.format(25))
    return base.select(
        "intent_id",
        (filters if expression else null("string")).alias("expression"),
        (spelt if words else null("string")).alias("text_search"),
        *((F.col(c) if place else null("double")).alias(c) for c in ("lon", "lat", "metres")),
        null("string").alias("network"),
        null("array<string>").alias("schema_urls"),
        null("boolean").alias("active"),
        null("boolean").alias("valid"),
        (vector if words else null("array<double>")).alias("query_vector"),
    )


def _tables(spark: SparkSession, d: str, vectors: bool) -> discover.Tables:
    items = derived.plain_items(spark, d)
    parts = table(spark, d, "part").select(F.concat(F.lit("res-"), "p_partkey").alias("id"), "p_name")
    shape = parts.agg(F.count("*").alias("n"), F.avg(F.size(text.analyse(F.col("p_name")))).alias("mean")).first()
    own = F.array(F.col("size").cast("double"), (F.col("l_partkey") % 7 + 1).cast("double"), (F.col("l_suppkey") % 5 + 1).cast("double"))
    held = items.select((F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("vec_id"), "id", "catalog_id", own.alias("vector"))
    posted = text.postings(parts, "id", "p_name")
    return discover.Tables(items, derived.locations(items, with_item=True), derived.offers(spark, d), posted, shape["n"], shape["mean"], held if vectors else None, LEAST, derived.with_payload)


def _hits(spark: SparkSession, d: str, expression: bool = False, place: bool = False, words: bool = False, vectors: bool = False, index: bool = True) -> DataFrame:
    tables = _tables(spark, d, vectors)
    if not index:
        tables.postings = None
    found = discover.discover_hits(_intents(spark, d, expression, place, words), tables, F.lit(NOW).cast("timestamp"), limit=100)
    return found.select("intent_id", "id", "catalog_id", F.col("rank").cast("long").alias("rank"))


def _sql(expression: bool = False, place: bool = False, words: bool = False, vectors: bool = False, index: bool = True) -> str:
    spelt = "CASE n_nationkey % 4 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(WORDS)) + " END"
    fuzzy = expression or place
    edits = "CASE WHEN length(q.term) <= 2 THEN 0 WHEN length(q.term) <= 5 THEN 1 ELSE 2 END" if fuzzy else "0"
    words = words and index
    tests = ["coalesce(is_active, true)", f"coalesce(s <= TIMESTAMP '{NOW}', true)", f"coalesce(e >= TIMESTAMP '{NOW}', true)"]
    tests += ["size >= CASE WHEN intent_id % 2 = 0 THEN 10 ELSE 25 END"] if expression else []
    tests += ["m.intent_id IS NOT NULL"] if place else []
    tests += ["(keyword IS NOT NULL" + (" OR semantic IS NOT NULL" if vectors else "") + ")"] if words else []
    return sql_with("catalogs", "items", "points") + f""", c AS ({CIRCLES_SQL}), t AS (SELECT *, {TS_SQL.format("start_text")} AS s, {TS_SQL.format("end_text")} AS e FROM items),
  m AS (SELECT DISTINCT intent_id, item_id AS id, catalog_id FROM points p, c WHERE {haversine_sql("c.lon", "c.lat", "p.lon", "p.lat")} <= metres * 4),
  dl AS (SELECT 'res-' || p_partkey AS id, {TOKENS_SQL.format("p_name")} AS w FROM part), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM dl),
  p AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(w) AS length, unnest(w) AS term FROM dl) GROUP BY ALL),
  q AS (SELECT DISTINCT n_nationkey AS intent_id, unnest({TOKENS_SQL.format(spelt)}) AS term FROM nation),
  need AS (SELECT intent_id, count(*) AS need FROM q GROUP BY ALL), df AS (SELECT term AS variant, count(*) AS df FROM p GROUP BY ALL),
  v AS (SELECT intent_id, q.term, variant, df, 1 - levenshtein(q.term, variant) / length(q.term) AS factor FROM q, df WHERE levenshtein(q.term, variant) <= {edits}),
  g AS (SELECT intent_id, id, v.term, max(ln(1 + (n - df + 0.5) / (df + 0.5)) * factor * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))) AS w FROM p JOIN v ON p.term = v.variant, st GROUP BY ALL),
  k AS (SELECT intent_id, id, sum(w) AS keyword FROM g JOIN need USING (intent_id) GROUP BY intent_id, id, need HAVING count(*) = need),
  x AS (SELECT n_nationkey AS intent_id, id, catalog_id, (1 + list_cosine_similarity([n_nationkey + 1.0::DOUBLE, n_nationkey % 7 + 1.0::DOUBLE, n_nationkey % 5 + 1.0::DOUBLE],
    [size::DOUBLE, l_partkey % 7 + 1.0::DOUBLE, l_suppkey % 5 + 1.0::DOUBLE])) / 2 AS semantic FROM items, nation),
  h AS (SELECT c.intent_id, t.id, t.catalog_id, updated_at, {"keyword" if words else "NULL"} AS keyword, {"semantic" if words and vectors else "NULL"} AS semantic FROM t CROSS JOIN c
    LEFT JOIN m ON m.intent_id = c.intent_id AND m.id = t.id AND m.catalog_id = t.catalog_id LEFT JOIN k ON k.intent_id = c.intent_id AND k.id = t.id
    LEFT JOIN x ON x.intent_id = c.intent_id AND x.id = t.id AND x.catalog_id = t.catalog_id AND semantic >= {LEAST} WHERE {" AND ".join(tests).replace("intent_id %", "c.intent_id %")}),
  r AS (SELECT *, row_number() OVER (PARTITION BY intent_id ORDER BY round(keyword, 9) DESC NULLS LAST, round(semantic, 12) DESC NULLS LAST, updated_at DESC, catalog_id, id) AS rank FROM h)
  SELECT intent_id, id, catalog_id, rank FROM r WHERE rank <= 100"""


def _register(name: str, doc: str, **route: bool) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _hits(spark, d, **route)

    run.__name__, run.__doc__ = name, doc
    query(_sql(**route))(run)


_register("route_filter", "Filter alone: every item is looked at, newest first.", expression=True)
_register("route_place", "Place alone.", place=True)
_register("route_text", "Text alone, by words without edits.", words=True)
_register("route_text_vectors", "Text alone, by words and by vectors.", words=True, vectors=True)
_register("route_filter_place", "Filter and place.", expression=True, place=True)
_register("route_place_text", "Place and text: words within some edits and vectors, ranked together inside the circle.", place=True, words=True, vectors=True)
_register("route_filter_text", "Filter and text.", expression=True, words=True)
_register("route_filter_place_text", "Filter, place and text.", expression=True, place=True, words=True, vectors=True)
_register("route_without_index", "Filter, place and text where there is no index: the text is left out of account.", expression=True, place=True, words=True, index=False)
