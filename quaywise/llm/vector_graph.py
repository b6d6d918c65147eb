"""Approximate nearest neighbours: a navigable small-world graph hierarchy per shard, merged over shards.

Vectors that take part (not null, not zero, all components finite) are first reduced to distinct ones, each
with the smallest ids that hold it: more than ``k`` copies can never all be among the ``k`` nearest. Distinct
vectors are dealt to shards of bounded size by hash. A shard's graph has layers; a vector's highest layer falls off
geometrically, its neighbours stand in a flat array per layer, and building and searching descend from the top layer
to a beam search on the lowest one. Both work on many vectors at a time, so the inner loops are array operations.
Every shard's stored graph is sent once for many query blocks, which follow it in the same sorted stream; what each
shard finds is scored again in double precision on the original vectors, and the best of all shards are kept.

Vectors only meet vectors of their own length. Equal scores go to the smaller id. A null id takes no part as
query or candidate. A query's own row is never its neighbour (repeated rows of one id count as one row). Ids are
read as long; further columns of the input are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaywise.llm.common import written

LINKS = 16  # neighbours kept per vector and layer, twice as many on the lowest layer
BUILD_BEAM, SEARCH_BEAM = 64, 192
SHARD = 32_768  # most distinct vectors per shard, about
QUERY_BLOCK, BLOCKS_TOGETHER = 1024, 64  # queries searched at once; blocks that meet one copy of a shard


# --------------------------------------------------------------------------- graph


@dataclass
class Graph:
    """Vectors stand in order of their highest layer, so the members of a layer are the first so many of them, and
    a layer is one flat array: the neighbours of each member, -1 where none."""

    unit: np.ndarray  # [n, d] float32, normalised
    layers: list[np.ndarray]  # [members, width], the lowest layer first

    def to_bytes(self) -> list[bytes]:
        return [table.astype("<i4").tobytes() for table in self.layers]

    @classmethod
    def from_bytes(cls, unit: np.ndarray, neighbours: list[bytes]) -> Graph:
        widths = [2 * LINKS] + [LINKS] * (len(neighbours) - 1)
        return cls(unit, [np.frombuffer(raw, "<i4").reshape(-1, w) for raw, w in zip(neighbours, widths, strict=True)])


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    longest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / np.where(longest > 0, longest, 1)
    return (scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def highest_layers(n: int, seed: int = 7) -> np.ndarray:
    """The highest layer of each of ``n`` vectors, falling off geometrically; sorted, the highest first."""
    level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(LINKS)).astype(np.int64)
    return -np.sort(-level)


def _beam(unit: np.ndarray, queries: np.ndarray, table: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Beam search of many queries at once on one layer: ids [q, width], nearest first (-1 where none), their
    similarities, and how many vectors were scored in all.

    Each round every query opens its best unopened candidate; a query rests when it has none left.
    """
    q = len(queries)
    ids = np.full((q, width), -1, np.int64)
    sims = np.full((q, width), -np.inf, np.float32)
    opened = np.zeros((q, width), bool)
    visited = np.zeros((q, (len(unit) + 7) // 8), np.uint8)

    def score(who: np.ndarray, near: np.ndarray) -> np.ndarray:
        np.bitwise_or.at(visited, (who, near >> 3), (1 << (near & 7)).astype(np.uint8))
        return np.einsum("nd,nd->n", unit[near], queries[who])

    e = min(entry.shape[1], width)
    known = entry[:, :e] >= 0
    who, near = np.nonzero(known)[0], entry[:, :e][known]
    ids[:, :e][known], sims[:, :e][known] = near, score(who, near)
    scored = len(near)
    live = np.arange(q)
    while len(live):
        waiting = np.where(opened[live] | (ids[live] < 0), -np.inf, sims[live])
        best = waiting.argmax(1)
        going = np.isfinite(waiting[np.arange(len(live)), best])
        live, best = live[going], best[going]
        if not len(live):
            break
        opened[live, best] = True
        near = table[ids[live, best]].astype(np.int64)
        safe = np.maximum(near, 0)
        fresh = (near >= 0) & ((visited[live[:, None], safe >> 3] >> (safe & 7)) & 1 == 0)
        who = np.nonzero(fresh)[0]
        s = np.full(near.shape, -np.inf, np.float32)
        s[fresh] = score(live[who], near[fresh])
        scored += len(who)
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        all_sims = np.concatenate([sims[live], s], 1)
        all_open = np.concatenate([opened[live], np.zeros(near.shape, bool)], 1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        r = np.arange(len(live))[:, None]
        ids[live], sims[live], opened[live] = all_ids[r, top], all_sims[r, top], all_open[r, top]
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), scored


def _descend(unit: np.ndarray, queries: np.ndarray, upper: list[np.ndarray], width: int = 4) -> tuple[np.ndarray, int]:
    """Entry points [q, width] for the layer under the ``upper`` ones (lowest first), from the top one down."""
    entry, scored = np.zeros((len(queries), 1), np.int64), 0
    for table in reversed(upper):
        entry, _, n = _beam(unit, queries, table, entry, width)
        scored += n
    return entry, scored


def _spread(unit: np.ndarray, base: np.ndarray, cand: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """The neighbour rule for many vectors at once: nearest first, a candidate is taken unless a taken one is
    nearer to it than the vector is; room that is left goes to the nearest of the others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    r = np.arange(len(base))[:, None]
    cand, sims = cand[r, order], sims[r, order]
    ok = (cand >= 0) & (cand != base[:, None])
    ok[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    vec = unit[np.maximum(cand, 0)]
    mutual = vec @ vec.transpose(0, 2, 1)
    taken = np.zeros(cand.shape, bool)
    count = np.zeros(len(base), np.int64)
    for j in range(cand.shape[1]):
        clash = (taken & (mutual[:, j, :] > sims[:, j, None])).any(1)
        take = ok[:, j] & ~clash & (count < keep)
        taken[:, j] = take
        count += take
    rank = np.where(taken, 0, np.where(ok, 1, 2))
    first = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    out = np.where(rank[r, first] < 2, cand[r, first], -1)
    if out.shape[1] < keep:
        out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)
    return out


def _link_back(unit: np.ndarray, table: np.ndarray, new: np.ndarray, links: np.ndarray) -> None:
    """Links from the neighbours of new members back to them; a list that grows too long is thinned."""
    width = table.shape[1]
    source, target = np.repeat(new, links.shape[1]), links.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    ends, at = np.unique(target, return_index=True)
    size = np.diff(np.append(at, len(target)))
    for lo in range(0, len(ends), 1024):
        e, k = ends[lo : lo + 1024], size[lo : lo + 1024]
        extra = np.full((len(e), int(k.max())), -1, np.int64)
        slot = np.arange(at[lo], at[lo] + k.sum()) - np.repeat(at[lo : lo + 1024], k)
        extra[np.repeat(np.arange(len(e)), k), slot] = source[at[lo] : at[lo] + k.sum()]
        both = np.concatenate([table[e], extra], 1)
        crowded = (both >= 0).sum(1) > width
        if not crowded.all():
            packed = -np.sort(-both[~crowded], axis=1)[:, :width]
            packed[:, 1:][packed[:, 1:] == packed[:, :-1]] = -1
            table[e[~crowded]] = packed
        if crowded.any():
            b, c = e[crowded], both[crowded]
            sims = np.where(c >= 0, np.einsum("bcd,bd->bc", unit[np.maximum(c, 0)], unit[b]), -np.inf)
            table[b] = _spread(unit, b, c, sims, width)


def build_graph(vectors: np.ndarray, batch: int = 512) -> Graph:
    """The layered graph of the rows of ``vectors``, which stand in order of :func:`highest_layers`.

    Layers are built from the top down. Rows join a layer in batches that double up to ``batch``: a batch descends
    through the layers above to its entry points, searches the layer so far and its own members, and links both ways.
    """
    n, unit = len(vectors), unit_vectors(vectors)
    level = highest_layers(n)
    upper: list[np.ndarray] = []
    for layer in range(int(level.max()) if n else 0, -1, -1):
        count = int((level >= layer).sum())
        width = LINKS * 2 if layer == 0 else LINKS
        table = np.full((count, width), -1, np.int64)
        above = len(upper[0]) if upper else 0
        done = min(count, 2 * width)
        if done > 1:
            sims = unit[:done] @ unit[:done].T
            np.fill_diagonal(sims, -np.inf)
            first = np.arange(done)
            table[:done] = _spread(unit, first, np.broadcast_to(first, (done, done)).copy(), sims, width)
        while done < count:
            new = np.arange(done, min(done + min(batch, done), count))
            if done < above:  # members of the layer above join first, from a few fixed points
                entry = np.broadcast_to(np.linspace(0, done - 1, 8).astype(np.int64), (len(new), 8))
            else:
                entry, _ = _descend(unit, unit[new], upper)
            ids, near, _ = _beam(unit, unit[new], table, entry, BUILD_BEAM)
            among = unit[new] @ unit[new].T
            np.fill_diagonal(among, -np.inf)
            m = min(LINKS, len(new))
            inner = np.argpartition(-among, m - 1, axis=1)[:, :m]
            cand = np.concatenate([ids, new[inner]], 1)
            links = _spread(unit, new, cand, np.concatenate([near, np.take_along_axis(among, inner, 1)], 1), LINKS)
            table[new, :LINKS] = links
            _link_back(unit, table, new, links)
            done += len(new)
        upper.insert(0, table)
    return Graph(unit, upper)


def search_graph(graph: Graph, queries: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> tuple[np.ndarray, int]:
    """Ids [q, beam] of the nearest vectors found for each (normalised) query, nearest first, -1 where none, and how
    many vectors were scored for all queries together."""
    entry, above = _descend(graph.unit, queries, graph.layers[1:])
    ids, _, scored = _beam(graph.unit, queries, graph.layers[0], entry, max(beam, k))
    return ids, above + scored


# --------------------------------------------------------------------------- operators


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` (doubles) of the rows that take part."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``v, ids``: each distinct vector with the ``k + 1`` smallest ids that hold it."""
    place = F.dense_rank().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    once = rows.select("vec_id", "v", F.xxhash64("v").alias("h"))
    return once.withColumn("n", place).where(F.col("n") <= k + 1).groupBy("h", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def shard_counts(distinct: DataFrame, per_shard: int = SHARD) -> dict[int, int]:
    """Shards for each vector length."""
    return {r["dim"]: -(-r["n"] // per_shard) for r in distinct.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}


def _shards_of(counts: dict[int, int]):
    shards = F.lit(0)
    for dim, n in counts.items():
        shards = F.when(F.size("v") == dim, F.lit(n)).otherwise(shards)
    return shards


def build_shards(distinct: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``dim, shard, ids, vectors, neighbours``: one stored graph per shard, as flat arrays."""
    shards = _shards_of(counts)
    dealt = distinct.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("h", F.lit(1)), shards).cast("int").alias("shard"), "v", "ids")

    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        by_id = np.argsort(np.array([i[0] for i in table.column("ids").to_pylist()]), kind="stable")
        table = table.take(pa.array(by_id[np.random.default_rng(1).permutation(len(by_id))]))
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        columns = {
            "dim": table.column("dim")[:1],
            "shard": table.column("shard")[:1],
            "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "vectors": pa.array([v.astype("<f8").tobytes()], pa.binary()),
            "neighbours": pa.array([build_graph(v).to_bytes()], pa.list_(pa.binary())),
        }
        return pa.table(columns)

    return dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, ids array<array<long>>, vectors binary, neighbours array<binary>")


def exact_cosines(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Cosines in double precision of each query with its own candidates [q, c, d]."""
    dot = np.einsum("qd,qcd->qc", queries, candidates)
    return dot / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(candidates, axis=2))


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


@dataclass
class Shard:
    """One shard as a task holds it."""

    ids: list[list[int]]
    vectors: np.ndarray
    graph: Graph

    @classmethod
    def read(cls, batch: pa.RecordBatch, r: int, dim: int) -> Shard:
        vectors = np.frombuffer(batch.column("vectors")[r].as_buffer(), "<f8").reshape(-1, dim)
        return cls(batch.column("ids")[r].as_py(), vectors, Graph.from_bytes(unit_vectors(vectors), batch.column("neighbours")[r].as_py()))

    def best(self, query_ids: list[int], queries: np.ndarray, k: int, beam: int) -> Iterator[pa.RecordBatch]:
        """The ``k`` nearest found of each query, its own row left out."""
        found, _ = search_graph(self.graph, unit_vectors(queries), k + 1, beam)
        rows = []
        for lo in range(0, len(found), 128):
            part = found[lo : lo + 128]
            scores = np.where(part >= 0, exact_cosines(queries[lo : lo + 128], self.vectors[np.maximum(part, 0)]), -np.inf)
            least = np.partition(scores, -(k + 1), axis=1)[:, -(k + 1), None]  # equal ones stay, whatever their number
            for own, f, s, near in zip(query_ids[lo : lo + 128], part, scores, (scores >= least) & (part >= 0), strict=True):
                mine = [(-x, i) for x, n in zip(s[near].tolist(), f[near].tolist(), strict=True) for i in self.ids[n] if i != own]
                rows += [(own, i, -x) for x, i in sorted(mine)[:k]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FOUND, strict=True)], schema=FOUND)


def search_shards(shards: DataFrame, queries: DataFrame, counts: dict[int, int], k: int = 5, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id, vec_id, score``: from each shard the ``k`` nearest found of every query (own row excluded).
    Blocks of queries go to each shard of their vectors' length, many of them to one copy of it."""
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = -(-n_blocks // BLOCKS_TOGETHER)
    blocks = queries.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"), _shards_of(counts).alias("n"), "vec_id", "v")
    packed = blocks.where("n > 0").groupBy("dim", "block", "n").agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
    every_shard = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("shard")
    asked = packed.select("dim", every_shard, (F.col("block") % parts).alias("part"), F.col("block").alias("at"), "q")
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    sent = shards.select("dim", "shard", every_part, F.lit(-1).alias("at"), "ids", "vectors", "neighbours")
    stream = sent.unionByName(asked, allowMissingColumns=True).repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("dim")[r].as_py()
                if batch.column("at")[r].as_py() < 0:  # a shard opens its stretch of the stream
                    shard = Shard.read(batch, r, dim)
                    continue
                q = batch.column("q")[r].values
                vectors = q.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                yield from shard.best(q.field("vec_id").to_pylist(), vectors, k, beam)

    return stream.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest_neighbours(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", per_shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found for each row whose id is a multiple of ``every``."""
    rows = usable(vectors, id_col, vector_col)
    distinct = written(distinct_vectors(rows, k), "vectors")
    counts = shard_counts(distinct, per_shard)
    shards = written(build_shards(distinct, counts), "graphs")
    found = search_shards(shards, rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), counts, k, beam)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
