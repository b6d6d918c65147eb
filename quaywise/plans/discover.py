"""One discover function for many intents: the route of each, and the parts of the answer by route."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaywise.functions import paths
from quaywise.functions.embedding import hashed_embedding
from quaywise.operators import filters, respond, spatial, text
from quaywise.operators.vectors import alike, cosine_score, knn, norm


class HitSource(Protocol):
    """An engine: intents in, ``intent_id, id, catalog_id, rank`` out."""

    applies_schema_filter: bool

    def __call__(self, intents: DataFrame) -> DataFrame: ...


def route_of(has_filter: Column, has_space: Column, has_text: Column) -> Column:
    """A: filter and space; B: filter; C: space (with or without text); D: text; chain: text with a filter."""
    return F.when(has_filter & has_text, "chain").when(has_filter & has_space, "A").when(has_filter, "B").when(has_space, "C").when(has_text, "D").otherwise("none")


@dataclass
class Tables:
    """What a discover run reads: ``items``, ``locations``, ``offers``; of the text index ``postings`` (by item id, None where
    there is no index) and its shape; ``vectors`` (``vec_id, id, catalog_id, vector``) if there are any.

    Items have a ``payload``, or ``with_payload`` adds it to those that a filter asks for. Locations may hold their item's
    columns (struct ``item``): then what lies in a circle is not looked up among all items."""

    items: DataFrame
    locations: DataFrame
    offers: DataFrame
    postings: DataFrame | None
    n_docs: int
    mean_length: float
    vectors: DataFrame | None = None
    least_similarity: float = 0.72
    with_payload: Callable[[DataFrame], DataFrame] = lambda rows: rows


def schema_postfilter(hits: DataFrame, intents: DataFrame, items: DataFrame) -> DataFrame:
    """Hits (``intent_id, id, catalog_id, ...``) of items that meet their intent's ``schema_urls``, for engines that cannot
    filter by schema themselves."""
    asked = intents.select("intent_id", "schema_urls")
    kinds = items.select("id", "catalog_id", "context_url", "type")
    joined = hits.join(asked, "intent_id").join(kinds, ["id", "catalog_id"])
    return joined.where(filters.schema_filter(F.col("context_url"), F.col("type"), F.col("schema_urls"))).select(*hits.columns)


def hits_of(source: HitSource, intents: DataFrame, items: DataFrame) -> DataFrame:
    """What an engine finds, filtered by schema before or after, as the engine says."""
    hits = source(intents)
    return hits if source.applies_schema_filter else schema_postfilter(hits, intents, items)


def index_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored index, or no rows where there is none yet; any other error is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def matched_ids(hits: DataFrame, by: str = "intent_id", key: str = "id") -> DataFrame:
    """``by, ids``: the ids of each intent's hits in rank order; blank ones are passed over."""
    named = hits.where(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) != "")
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("id"))))
    return named.groupBy(by).agg(ordered.alias("o")).select(by, F.transform("o", lambda x: x["id"]).alias("ids"))


@dataclass
class VectorHits:
    """Text intents answered by nearest vectors: both sides embedded alike, hits under a least score dropped."""

    vectors: DataFrame  # vec_id, vector of items
    keys: DataFrame  # vec_id, id, catalog_id
    limit: int = 50
    least: float = 0.72
    applies_schema_filter: bool = False

    def __call__(self, intents: DataFrame) -> DataFrame:
        queries = query_vectors(intents.where(F.coalesce(F.trim("text_search"), F.lit("")) != ""))
        near = filters.min_score(knn(self.vectors, queries, self.limit), self.least)
        return near.join(self.keys, "vec_id").select(F.col("query_id").alias("intent_id"), "id", "catalog_id", "rank", "score")


def query_vectors(intents: DataFrame) -> DataFrame:
    """``query_id, query``: the intent's own ``query_vector`` where it brings one, else its embedded text."""
    own = "query_vector" in intents.columns
    texts = intents.where("query_vector is null") if own else intents
    found = hashed_embedding(texts, "intent_id", "text_search").select(F.col("intent_id").alias("query_id"), F.col("vector").cast("array<double>").alias("query"))
    if own:
        brought = intents.where("query_vector is not null").select(F.col("intent_id").alias("query_id"), F.col("query_vector").cast("array<double>").alias("query"))
        found = found.unionByName(brought)
    return found


def resolve_flags(intents: DataFrame, active: bool = True, valid: bool = True) -> DataFrame:
    """Request flags, else the configured defaults."""
    return intents.withColumn("active", F.coalesce("active", F.lit(active))).withColumn("valid", F.coalesce("valid", F.lit(valid)))


#: Distinct expressions that are compiled into one plan.
EXPRESSIONS_AT_ONCE = 200


def expression_blocks(intents: DataFrame, most: int = EXPRESSIONS_AT_ONCE) -> Iterator[list[str]]:
    """The distinct expressions of intents (``_e``), in hashed blocks of about ``most``."""
    distinct = intents.select("_e").distinct()
    n_blocks = -(-distinct.count() // most)
    for k in range(n_blocks):
        yield [r[0] for r in distinct.where(F.pmod(F.xxhash64("_e"), F.lit(n_blocks)) == k).collect()]


def known(expression: str) -> bool:
    return not expression or paths.path_problem(expression) is None


def filter_hits(tables: Tables, intents: DataFrame, expressions: list[str]) -> DataFrame:
    """``intent_id`` with the items that its path filter (``_e``, one of ``expressions``) keeps. Each expression is compiled
    once; one outside the language answers nothing."""
    kept = [F.when(paths.path_filter(F.col("payload"), e), F.lit(e)) for e in expressions if known(e)]
    passed = tables.with_payload(tables.items).withColumn("_e", F.explode(F.array_compact(F.array(*kept)) if kept else F.array().cast("array<string>")))
    return passed.join(intents, "_e")


def filtered_candidates(tables: Tables, rows: DataFrame, expressions: list[str]) -> DataFrame:
    """Rows (items met by an intent) that pass their intent's own filter ``_e``, one of ``expressions``: no row is tested
    by another intent's, and payloads are read only if there is some filter."""
    passes = F.lit(None).cast("boolean")
    if any(expressions):
        rows = tables.with_payload(rows)
    for e in expressions:
        if known(e):
            passes = F.when(F.col("_e") == F.lit(e), paths.path_filter(F.col("payload"), e) if e else F.lit(True)).otherwise(passes)
    return rows.where(F.col("_e").isin(*expressions) & passes)


def plain_filters(rows: DataFrame, now: Column) -> DataFrame:
    """Network, schema, activity and validity of the intent on item rows that carry its columns."""
    return rows.where(
        filters.network_filter(F.col("network_id"), F.col("network"))
        & filters.schema_filter(F.col("context_url"), F.col("type"), F.col("schema_urls"))
        & filters.active_filter(F.col("is_active"), F.col("active"))
        & filters.validity_filter(F.col("start_text"), F.col("end_text"), F.col("valid"), now)
    )


def keyword_hits(tables: Tables, intents: DataFrame) -> DataFrame:
    """``intent_id, id, keyword``: items that hold every term of the text, with their relevance. Intents with a place or a
    filter beside their text (``_fuzzy``) also meet terms within the edits that a term's length allows."""
    terms = intents.select(F.col("intent_id").alias("query_id"), "_fuzzy", F.explode(text.analyse(F.col("text_search"))).alias("term")).distinct()
    exact = terms.select("query_id", "term", F.col("term").alias("variant"), F.lit(1.0).alias("factor"))
    near = text.fuzzy_terms(tables.postings.select("term").distinct(), terms.where("_fuzzy").select("query_id", "term")).where("edits > 0")
    more = near.select("query_id", "term", "variant", (1 - F.col("edits") / F.length("term")).alias("factor"))
    scored = text.bm25_of_variants(tables.postings, "id", exact.unionByName(more), tables.n_docs, tables.mean_length)
    hits = text.match_all(scored, terms.select("query_id", "term"))
    return hits.select(F.col("query_id").alias("intent_id"), "id", F.col("score").alias("keyword"))


def placed_items(tables: Tables, intents: DataFrame, carried: DataFrame, now: Column) -> DataFrame:
    """``intent_id``, the columns of ``carried`` and of the item: items inside the circle of an intent that pass its plain filters."""
    circles = intents.select("intent_id", "lon", "lat", "metres")
    if "item" in tables.locations.columns:
        inside = spatial.points_within(tables.locations, circles, "item").select("intent_id", "item.*")
        return plain_filters(inside.join(carried, "intent_id"), now).dropDuplicates(["intent_id", "id", "catalog_id"])
    near = spatial.within_distance(tables.locations, circles).select("intent_id", F.col("item_id").alias("id"), "catalog_id")
    return plain_filters(tables.items.join(near, ["id", "catalog_id"]).join(carried, "intent_id"), now)


def text_candidates(tables: Tables, intents: DataFrame, near: DataFrame) -> list[DataFrame]:
    """Item rows with ``intent_id, keyword, semantic``, for text intents: those with a place rank what lies in it (``near``), the
    others what the index finds. A hit has every term of the text, or a vector that is like the intent's. Every one that is
    like it is a candidate: later filters and ties decide which are answered, so none may be cut before them."""
    words = keyword_hits(tables, intents)
    placed = near.join(intents.where("_g").select("intent_id"), "intent_id", "left_semi")
    free = words.join(intents.where("not _g").select("intent_id"), "intent_id", "left_semi")
    inside = placed.join(words, ["intent_id", "id"], "left")
    none = F.lit(None).cast("double")
    if tables.vectors is None:
        inside = inside.where("keyword is not null")
        return [tables.items.join(inside, ["id", "catalog_id"]).withColumn("semantic", none), tables.items.join(free, "id").withColumn("semantic", none)]
    asked = query_vectors(intents)
    scored = inside.join(tables.vectors.select("id", "catalog_id", "vector"), ["id", "catalog_id"], "left").join(asked.withColumnRenamed("query_id", "intent_id"), "intent_id", "left")
    likeness = cosine_score(F.col("query"), F.col("vector"), norm(F.col("query")), norm(F.col("vector")))
    inside = scored.withColumn("semantic", F.when(likeness >= tables.least_similarity, likeness)).where("keyword is not null or semantic is not null")
    found = alike(tables.vectors, query_vectors(intents.where("not _g")), tables.least_similarity)
    found = found.select(F.col("query_id").alias("intent_id"), "id", "catalog_id", F.col("score").alias("semantic"))
    outside = free.join(tables.items.select("id", "catalog_id"), "id").join(found, ["intent_id", "id", "catalog_id"], "full")
    columns = ["intent_id", "id", "catalog_id", "keyword", "semantic"]
    return [tables.items.join(inside.select(*columns).unionByName(outside.select(*columns)), ["id", "catalog_id"])]


def discover_hits(intents: DataFrame, tables: Tables, now: Column, limit: int = 100) -> DataFrame:
    """The items that answer each intent, with ``rank``: hits of words before hits of vectors alone, each by score, then
    newest first.

    Intents with a place or a text start from what these find; only those with neither look at every item. Without
    an index the text of an intent that also has a filter or a place is left out of account, and one that has
    nothing else finds nothing.
    """
    has_text = F.coalesce(F.trim("text_search"), F.lit("")) != ""
    intents = resolve_flags(intents).withColumns({"_e": F.coalesce(F.trim("expression"), F.lit("")), "_g": F.col("lon").isNotNull(), "_t": has_text})
    if tables.postings is None:
        intents = intents.where(~F.col("_t") | F.col("_g") | (F.col("_e") != "")).withColumn("_t", F.lit(False))
    intents = intents.withColumn("_fuzzy", F.col("_g") | (F.col("_e") != ""))
    carried = intents.select("intent_id", "_e", "network", "schema_urls", "active", "valid")
    none = F.lit(None).cast("double")

    asked = intents.agg(*(F.coalesce(F.max(c), F.lit(False)) for c in (F.col("_g") & ~F.col("_t"), F.col("_t"), ~F.col("_g") & ~F.col("_t")))).first()
    met, every = [], []
    if asked[0]:
        placed = placed_items(tables, intents.where("_g and not _t"), carried, now)
        met.append(placed.withColumns({"keyword": none, "semantic": none}))
    if asked[1] and tables.postings is not None:
        near = spatial.within_distance(tables.locations, intents.where("_g and _t").select("intent_id", "lon", "lat", "metres"))
        near = near.select("intent_id", F.col("item_id").alias("id"), "catalog_id")
        met += [plain_filters(rows.join(carried, "intent_id"), now) for rows in text_candidates(tables, intents.where("_t"), near)]
    if asked[2]:
        every = plain_filters_of_blocks(tables, intents.where("not _g and not _t"), now)
    columns = ["intent_id", *(c for c in tables.items.columns if c != "payload"), "keyword", "semantic"]
    blocks = list(expression_blocks(intents.where("_g or _t"))) if met else []
    narrowed = [filtered_candidates(tables, rows, block) for rows in met for block in blocks]
    if not narrowed and not every:
        every = [tables.items.join(carried, F.lit(False)).withColumns({"keyword": none, "semantic": none})]
    rows = reduce(DataFrame.unionByName, [r.select(*columns) for r in [*narrowed, *every]])
    order = [F.round("keyword", 9).desc_nulls_last(), F.round("semantic", 12).desc_nulls_last(), F.desc("updated_at"), "catalog_id", "id"]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("intent_id").orderBy(*order))).where(F.col("rank") <= limit)


def plain_filters_of_blocks(tables: Tables, intents: DataFrame, now: Column) -> list[DataFrame]:
    """For intents with neither place nor text: the items that pass, a plan for each block of expressions."""
    none = F.lit(None).cast("double")
    carried = intents.select("intent_id", "_e", "network", "schema_urls", "active", "valid")
    return [plain_filters(filter_hits(tables, carried, block), now).withColumns({"keyword": none, "semantic": none}) for block in expression_blocks(intents)]


def discover(intents: DataFrame, tables: Tables, now: Column, limit: int = 100, on_answer: Callable[[DataFrame], DataFrame] = respond.discard_without_offers) -> DataFrame:
    """``intent_id, catalog_id, rank, resources, offers``: answers of all intents in one plan.

    ``intents``: ``intent_id, expression, text_search, lon, lat, metres, network, schema_urls, active, valid`` and, where
    there are vectors, optionally ``query_vector``. Hits are regrouped into catalogues, pruned and enriched with offers.
    """
    hits = discover_hits(intents, tables, now, limit)
    slim = hits.select("intent_id", "catalog_id", "id", "catalog_name", "provider_id", "name", "rank")
    pruned = respond.mutual_pruning(respond.group_into_catalogs(respond.attach_offers(slim, tables.offers)))
    return respond.drop_broken_answers(on_answer(respond.enrich_with_provider_offers(pruned, tables.offers)))
