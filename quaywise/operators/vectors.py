"""Exact nearest vectors with the filter applied before the search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaywise.operators.text import sent_if_small


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_score(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """``(1 + cosine) / 2``, as the relevance scale of vector hits."""
    return (1 + dot(a, b) / (norm_a * norm_b)) / 2


#: Vectors and queries that meet in one group, and queries that are multiplied with a group's vectors at a time.
VECTORS_AT_ONCE, QUERIES_AT_ONCE, CHUNK = 32_768, 8192, 256


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last as :func:`dot` does."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _best(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, places of vectors and scores of each query's best ``k``. A product of matrices, whose last digits depend
    on the place of a vector in it, only leaves out what is certainly farther; scores are taken in a fixed order."""
    norms, qnorms = np.sqrt(_dots(vectors, vectors)), np.sqrt(_dots(queries, queries))
    found = []
    for at in range(0, len(queries), CHUNK):
        some = queries[at : at + CHUNK]
        rough = np.nan_to_num((some @ vectors.T) / (qnorms[at : at + CHUNK, None] * norms), nan=np.inf)
        least = np.partition(rough, len(ids) - k, 1)[:, len(ids) - k] if k < len(ids) else np.full(len(some), -np.inf)
        q, v = np.nonzero(rough >= least[:, None] - 1e-9)
        score = (1 + _dots(some[q], vectors[v]) / (qnorms[at + q] * norms[v])) / 2
        order = np.lexsort((ids[v], -np.nan_to_num(score, nan=np.inf), q))
        q, v, score = q[order], v[order], score[order]
        first = np.searchsorted(q, q)
        kept = np.arange(len(q)) - first < k
        found.append((q[kept] + at, v[kept], score[kept]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def knn(vectors: DataFrame, queries: DataFrame, k: int, same: str | None = None, blocks: int | None = None) -> DataFrame:
    """``query_id, vec_id, score, rank``: for each query (``query_id, query``) the best ``k`` vectors (``vec_id,
    vector``), among those with the same value of ``same`` if given. Ties go to the smaller ``vec_id``.

    Every pair is scored: blocks of vectors meet blocks of queries, each pair of blocks keeps a query's best ``k``, and only
    these meet. What a task holds is bounded by the sizes of the blocks, time grows with vectors times queries.
    """
    n_queries = -(-queries.count() // QUERIES_AT_ONCE) or 1
    blocks = blocks or -(-vectors.count() // VECTORS_AT_ONCE) or 1
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = (F.xxhash64(same) if same else F.lit(0).cast("long")).alias("_same")
    part = dealt(same, 16).alias("_part") if same else F.lit(0).alias("_part")
    as_double = lambda c: F.col(c).cast("array<double>").alias("_x")
    own = lambda df: df.where(F.col(same).isNotNull()) if same else df
    stored = own(vectors.where(norm(F.col("vector")) > 0)).select(part, group, "vec_id", as_double("vector"), dealt("vec_id", blocks).alias("_block")).withColumn("_query", every(n_queries))
    asked = own(queries.where(norm(F.col("query")) > 0)).select(part, group, "query_id", as_double("query"), dealt("query_id", n_queries).alias("_query")).withColumn("_block", every(blocks))

    def matrices(table: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """Places and components of rows by group and number of components."""
        table = table.combine_chunks()
        lists = table.column("_x").combine_chunks()
        flat, ends = np.asarray(lists.flatten()), np.cumsum([0, *pa.compute.list_value_length(lists).to_pylist()])
        sizes, groups = np.diff(ends), table.column("_same").to_numpy()
        out = {}
        for g, n in {*zip(groups.tolist(), sizes.tolist(), strict=True)}:
            rows = np.flatnonzero((groups == g) & (sizes == n))
            out[g, n] = rows, flat[ends[rows][:, None] + np.arange(n)]
        return out

    ids = stored.schema["vec_id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        vec, query = (t.column(c).combine_chunks() if t.num_rows else None for t, c in ((left, "vec_id"), (right, "query_id")))
        names, found = ["query_id", "vec_id", "score"], []
        if left.num_rows and right.num_rows:
            here, there = matrices(left), matrices(right)
            place = np.empty(len(vec), np.int64)
            place[pa.compute.sort_indices(vec).to_numpy()] = np.arange(len(vec))
            for at in here.keys() & there.keys():
                (rows, x), (asking, y) = here[at], there[at]
                q, v, score = _best(x, place[rows], y, k)
                found.append(pa.table([query.take(pa.array(asking[q])), vec.take(pa.array(rows[v])), pa.array(score)], names))
        if found:
            return pa.concat_tables(found)
        return pa.table([right.column("query_id").slice(0, 0), left.column("vec_id").slice(0, 0), pa.array([], pa.float64())], names)

    keys = ["_part", "_block", "_query"]
    best = stored.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, f"query_id {ids[1]}, vec_id {ids[0]}, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def alike(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """``query_id, vec_id, score``: for each query (``query_id, query``) every vector (``vec_id, vector``, and further columns, which
    stay) with at least that score. The queries, a stated set, are sent to the vectors where they are few."""
    stored = vectors.withColumn("_norm", norm(F.col("vector"))).where("_norm > 0")
    asked = queries.withColumn("_qnorm", norm(F.col("query"))).where("_qnorm > 0")
    score = cosine_score(F.col("query"), F.col("vector"), F.col("_qnorm"), F.col("_norm"))
    scored = stored.crossJoin(sent_if_small(asked)).withColumn("score", score).where(F.col("score") >= least)
    return scored.select("query_id", "score", *(c for c in vectors.columns if c != "vector"))


def candidate_cap(limit: int, overfetch: int = 10, most: int = 5000) -> int:
    """Candidates to fetch for a chained search; a non-positive limit asks for none."""
    return 0 if limit <= 0 else min(limit * overfetch, most)
