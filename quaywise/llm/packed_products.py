"""Hard negatives by exact integer products, several candidates in one wide integer (Kronecker packing).

Components become whole numbers, ``floor(256 * x)``. With the smallest component of the table taken off, they are not
negative, and so neither are products of two of them nor sums of such products. If a sum stays below ``2**width``, the
components of several candidates can lie side by side in one integer, ``width`` bits each: one multiplication by an
anchor's component multiplies them all, sums over the components never run into the next field, and every candidate's
sum is read back from its own bits. The score follows from the sum exactly, since the offset's share is known::

    sum (a - o)(c - o)  =  a . c  -  o (sum a + sum c)  +  dim o o

Integers have 64 bits where two fields or more fit, else they are long integers of sixteen fields; the width comes from
the smallest and largest component of the table, so no sum overflows.

Rows are dealt into shards of about :data:`SHARD`; every anchor meets every shard, many anchors to one copy of it. Each
shard gives its own best for an anchor, so an anchor's candidates never gather in one task:

1. the five best rows of the anchor's label in each shard, then the five best of all;
2. with these positives known, for each of them the best rows of other labels in the band of scores it asks for.

Rows with a null id, label or vector, or a null or non-finite component take no part. An id counts once: of rows with the
same id, that with the smallest label and vector. A shorter vector counts as filled up with zeros. Equal scores go by
ascending id. Further columns may have any names; an empty table gives an empty result. Scores must fit into 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaywise.llm.common import removed, written

SCALE = 256
SHARD = 8192
#: Anchors that meet one copy of a shard, and of these as many as are scored at once.
ANCHORS_TOGETHER = 65_536
ANCHORS_AT_ONCE = 64
LONG_FIELDS = 16


@dataclass(frozen=True)
class Packing:
    """How components are packed: their number, the offset that is taken off, bits and fields of an integer."""

    dim: int
    offset: int
    width: int
    fields: int

    @classmethod
    def of(cls, dim: int, low: int, high: int) -> Packing:
        width = max(1, (dim * (high - low) ** 2).bit_length())
        return cls(dim, low, width, 64 // width if width <= 32 else LONG_FIELDS)

    @property
    def long(self) -> bool:
        return self.fields * self.width > 64

    def shifted(self, components: np.ndarray) -> np.ndarray:
        """Components without the offset, as integers that products fit into."""
        if self.long:
            return np.array([[int(x) - self.offset for x in row] for row in components], object).reshape(components.shape)
        return (components.astype(np.int64) - self.offset).astype(np.uint64)

    def packed(self, shifted: np.ndarray) -> np.ndarray:
        """``fields`` candidates in each integer: an array of integers by component and group of candidates."""
        n, kind = len(shifted), shifted.dtype
        groups = -(-n // self.fields)
        filled = np.zeros((groups * self.fields, self.dim), kind)
        filled[:n] = shifted
        out = np.zeros((self.dim, groups), kind)
        for k in range(self.fields):
            out += filled[k :: self.fields].T << kind.type(k * self.width) if not self.long else filled[k :: self.fields].T << (k * self.width)
        return out

    def products(self, anchors: np.ndarray, packed: np.ndarray, n: int) -> np.ndarray:
        """Sums of products of each anchor (without offset) with each of the ``n`` candidates (without offset)."""
        total = np.zeros((len(anchors), packed.shape[1]), packed.dtype)
        for d in range(self.dim):
            total += anchors[:, d, None] * packed[d]
        mask = (1 << self.width) - 1
        fields = np.empty((*total.shape, self.fields), object if self.long else np.int64)
        for k in range(self.fields):
            fields[:, :, k] = total >> (k * self.width) & mask if self.long else total >> np.uint64(k * self.width) & np.uint64(mask)
        return fields.reshape(len(anchors), -1)[:, :n]

    def scores(self, anchors: np.ndarray, candidates: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Exact inner products of whole components."""
        o, a, c = self.offset, anchors.sum(1)[:, None], candidates.sum(1)
        # of a and c, the offset is already off: a . c = (a' + o) . (c' + o)
        exact = self.products(anchors, packed, len(candidates)) + o * (a + c if self.long else a.astype(np.int64) + c.astype(np.int64)) + self.dim * o * o
        return exact.astype(np.int64)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, v``: rows that take part, with whole components (as doubles, which hold them exactly)."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def whole(lists: pa.ListArray, dim: int) -> np.ndarray:
    """``floor(256 * x)`` of every component, rows filled up with zeros to ``dim``."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lists), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def packing_of(rows: DataFrame) -> Packing:
    """From three figures of the whole table."""
    low, high, dim = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v")), F.max(F.size("v"))).first()
    if not dim:
        return Packing.of(1, 0, 1)
    ends = [int(np.floor(SCALE * x)) for x in (low, high)]
    return Packing.of(dim, min(0, *ends), max(0, *ends))


def first_places(score: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest allowed scores, highest first, equal ones in order of place."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        some = score[at]
        least = np.partition(some, len(some) - k)[len(some) - k]
        above = at[some > least]
        at = np.sort(np.concatenate([above, at[some == least][: k - len(above)]]))
    return at[np.argsort(-score[at], kind="stable")]


def best_positives(ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, asked: list[dict], k: int) -> list[tuple]:
    """``(anchor, positive, score)``: the best other rows of each anchor's label."""
    out = []
    for anchor, score in zip(asked, scores, strict=True):
        at = first_places(score, (labels == anchor["label"]) & (ids != anchor["vec_id"]), k)
        out += [(anchor["vec_id"], int(ids[i]), int(score[i])) for i in at]
    return out


def best_negatives(ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, asked: list[dict], k: int, share: int) -> list[tuple]:
    """``(anchor, positive, positive score, negative, score)``: of each positive the best rows of other labels whose
    score is at most the positive's and at least ``share`` hundredths of it."""
    out = []
    for anchor, score in zip(asked, scores, strict=True):
        other = labels != anchor["label"]
        found: dict[int, np.ndarray] = {}
        for p in anchor["positives"]:
            top = p["score"]
            if top not in found:
                least = -(-share * top // 100)  # whole scores: rounding up keeps the bound exact
                found[top] = first_places(score, other & (score <= top) & (score >= least), k) if least <= top else np.empty(0, np.int64)
            out += [(anchor["vec_id"], p["positive_id"], top, int(ids[i]), int(score[i])) for i in found[top]]
    return out


def over_shards(rows: DataFrame, anchors: DataFrame, packing: Packing, n_shards: int, find, schema: pa.Schema, ddl: str) -> DataFrame:
    """What ``find(ids, labels, scores, anchors)`` gives for every shard and every block of anchors."""
    parts = -(-anchors.count() // ANCHORS_TOGETHER) or 1
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(n_shards))
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.withColumn("shard", shard).withColumn("part", upto(parts))
    right = anchors.withColumn("part", part).withColumn("shard", upto(n_shards))

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if held.num_rows and asked.num_rows:
            held = held.sort_by("vec_id")
            ids, labels = held["vec_id"].to_numpy(), held["label"].to_numpy()
            candidates = packing.shifted(whole(held["v"], packing.dim))
            packed = packing.packed(candidates)
            for at in range(0, asked.num_rows, ANCHORS_AT_ONCE):
                some = asked.slice(at, ANCHORS_AT_ONCE)
                scores = packing.scores(packing.shifted(whole(some["v"], packing.dim)), candidates, packed)
                found += find(ids, labels, scores, some.drop_columns(["v"]).to_pylist())
        columns = zip(*found, strict=True) if found else [[] for _ in schema]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(run, ddl)


POSITIVES = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])
NEGATIVES = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def hard_negatives(
    vectors: DataFrame,
    every: int = 100,
    k: int = 5,
    share: int = 80,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    per_shard: int = SHARD,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows whose id is a
    multiple of ``every``: their ``k`` best rows of the same label, and for each of these the ``k`` best rows of other
    labels that score at most as high and at least ``share`` hundredths of it."""
    rows = written(usable(vectors, id_col, vector_col, label_col), "vectors")
    packing = packing_of(rows)
    n_shards = max(1, -(-rows.count() // per_shard))
    anchors = rows.where(F.col("vec_id") % every == 0)

    near = over_shards(rows, anchors, packing, n_shards, lambda i, l, s, a: best_positives(i, l, s, a, k), POSITIVES, "anchor_id long, positive_id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    best = near.withColumn("_place", place).where(F.col("_place") <= k)
    by_anchor = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))
    asked = written(anchors.join(by_anchor, "vec_id"), "anchors")

    ddl = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    far = over_shards(rows, asked, packing, n_shards, lambda i, l, s, a: best_negatives(i, l, s, a, k, share), NEGATIVES, ddl)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    found = written(far.withColumn("rank", rank).where(F.col("rank") <= k), "negatives")
    removed(asked)
    removed(rows)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
