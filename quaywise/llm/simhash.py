"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's bit is set where it is set in over half of the 64-bit hashes of the text's word shingles.
Two fingerprints link at ``radius`` or fewer differing bits. The covering family has ``2**(radius+1) - 1``
masks: bit ``i`` carries a non-zero vector of ``radius + 1`` bits, and mask ``v`` keeps the bits whose vector
has an odd product with ``v``. For any ``radius`` bits some ``v`` is orthogonal to all their vectors, so every
pair within the radius agrees on some whole mask: no pair is missed.

Pairs inside a bucket are never listed. A fingerprint that shares a bucket with another emits itself and its
one-bit neighbours on the bits that its shared masks leave free; two fingerprints within two bits meet at one
of these points, and at most 65 fingerprints can meet at one. So links come from small groups whatever the
size of a bucket, and connected components from star contraction of those links.

Texts without words have fingerprint zero and link like any other. Null texts count as empty. Equal texts,
repeated rows and repeated ids share a fingerprint and so a component; a null id gets its component's smallest
non-null id (null if there is none). Texts are read whole, however long; further columns of the input are not looked
at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaywise.llm.common import removed, small_batches, text_or_empty, written

SEED = 42
BITS = 64


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    words = raw.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(shingle)), strict=False)] or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = np.array([fingerprint(b, shingle) for b in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, fp long")


def covering_masks(radius: int = 2, bits: int = BITS) -> list[int]:
    """Bit masks such that any two values within the radius agree under at least one of them."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """``u, v`` links among distinct fingerprints (column ``fp``) whose components are those of all pairs within
    two bits. Each group that meets at a point is linked to its smallest member."""
    masks = covering_masks(2)
    rows = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"), F.lit(_signed(~m & (1 << BITS) - 1)).alias("free")) for t, m in enumerate(masks)))
    keys = distinct.select("fp", F.explode(rows).alias("b")).select("fp", "b.*")
    shared = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    close = keys.join(shared, ["t", "key"], "left_semi").groupBy("fp").agg(F.bit_or("free").alias("free"))
    points = F.expr("concat(array(fp), transform(filter(sequence(0, 63), b -> (shiftright(free, b) & 1L) = 1L), b -> fp ^ shiftleft(1L, b)))")
    met = close.select("fp", F.explode(points).alias("point")).groupBy("point").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    star = met.select(F.explode("members").alias("u"), F.array_min("members").alias("v"))
    return star.where("u <> v").distinct()


def star_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``u, root``: every node of the links but the roots, with the smallest node of its component.

    Alternates large-star and small-star contraction on stored tables until nothing changes; only two sums
    reach the driver. A node's smallest neighbour comes from a reduction in two steps; its links then meet that one row
    in a plain join of small rows, which adaptive execution splits where a node has very many.
    """
    now = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        old, now = now, written(small, "links")
        removed(old)
        after = mark(now)
        if after == before:
            return now.withColumnRenamed("v", "root")
        before = after
    raise RuntimeError("components did not settle")


def fingerprint_components(distinct: DataFrame) -> DataFrame:
    """``fp, root`` of the distinct fingerprints (column ``fp``) that link to another one."""
    roots = written(star_components(fingerprint_links(distinct)).select(F.col("u").alias("fp"), "root"), "roots")
    return roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document (links at two or fewer differing bits).

    Fingerprints that more than a thousandth of the documents have are at most a thousand; these are named by a
    broadcast, so that no task gets all documents of one.
    """
    fps = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    members = fingerprint_components(distinct.select("fp"))
    least = members.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("component"))
    component = members.join(least, "root").select("fp", "component")
    named = written(distinct.join(component, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"), "n"), "named")
    common = named.where(F.col("n") > max(1000, fps.count() // 1000)).drop("n")
    many = fps.join(F.broadcast(common), "fp")
    few = fps.join(F.broadcast(common.select("fp")), "fp", "left_anti").join(named.drop("n"), "fp")
    return many.unionByName(few).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
