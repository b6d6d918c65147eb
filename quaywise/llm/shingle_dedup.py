"""Near copies: fingerprints within the SimHash radius, or word shingles alike by exact Jaccard similarity.

Two texts link when their fingerprints link (:mod:`quaywise.llm.simhash`), or when the sets of their five-word
shingles have a similarity of at least 0.8; components of the links are groups of near copies. The fingerprints
settle most groups; a similarity join finds what lies beyond their radius:

* Equal sets are one node. In any fixed order of all shingles, two sets that link share one of the first
  ``size - need + 1`` of each (prefix), with ``need`` the least overlap that the size allows. Shingles that are
  frequent in a bounded sample go last, so common passages meet rarely; the sample decides work, not results.
* Prefix shingles that one group of sets alone holds go no further; before anything else is looked up, only shingle and
  set are shuffled. The sets of another shingle are put in three orders (by their smallest shingle hash, their largest,
  and their size), and neighbours in an order are compared: like sets have the same extreme with a chance of their
  similarity, so they stand side by side, and a chain of neighbours joins a group of any size at a cost of its rows.
  First next neighbours in one order, then, among what is still apart, up to :data:`REACH` places in all three.
* What shares a shingle and is still apart after that: in a group of at most :data:`SMALL` sets all pairs of different
  components are compared. Larger groups are dealt into blocks of about :data:`BLOCK` sets, every block meets every other, and
  pairs go on that share enough of the prefixes, which is counted here: all they share is held by larger groups.
* Every set has a mark: for each remainder of a shingle's hash by :data:`MARK`, whether an odd number of its shingles has it. A
  shingle that only one of two sets holds changes one bit, so marks that differ in more bits than linked sets may differ in
  shingles rule a pair out. Proposed pairs meet the marks first (those of larger groups while the blocks meet), so that
  few but links are listed, and prefixes and shingles are shuffled for these only.
* A pair must have sizes that allow 0.8, and share enough of the prefixes: of the overlap that its sizes ask for, all
  but the ``need - 1`` shingles behind the prefix of the larger set (where the prefixes end in the order decides
  whose, and the larger set's bound is the lower one). What passes is verified by counting shared shingles.

So every link is exact, and none is left out: the time for a group that stays mixed grows with the square of its sets, what
meets in one place does not, and listed are only links and pairs that the marks cannot tell from links. Texts are not shuffled: shingles are counted where the texts are read, for those that a filter of fixed size lets
through.

Words are lower-cased in A-Z and parted by ASCII white space, as for fingerprints. A text of fewer words is its
own only shingle; texts without words (null included) are copies of each other. Texts are read whole, however long.
Null ids and repeated rows take part like any other row; further columns may have any names. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaywise.llm.common import hashed_bits, may_be_in, may_hold, removed, small_batches, text_or_empty, unused_name, written
from quaywise.llm.simhash import fingerprint, fingerprint_components, star_components

SEED = 42
SAMPLE = 4096
REACH = 3  # places between neighbours that are compared before the rest is settled
SMALL = 128  # sets that share a shingle and are all compared with each other
BLOCK = 512  # sets of a larger group that meet those of another block in one place
MARK = 512  # bits of a set's mark


def shingles(raw: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct signed 64-bit hashes of a UTF-8 text's word shingles."""
    words = raw.lower().split()
    grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(n)), strict=False)] or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g, SEED) for g in grams], np.uint64).view(np.int64))


def mark(g: np.ndarray) -> np.ndarray:
    """:data:`MARK` bits as signed longs: for each remainder, whether an odd number of the hashes ``g`` has it."""
    odd = np.bincount(g.view(np.uint64) % np.uint64(MARK), minlength=MARK) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def row_key(docs: DataFrame) -> list[Column]:
    """Two hashes of a row's values and of which of them are null."""
    values = [F.col(f"`{c}`") for c in docs.columns]
    values += [v.isNull() for v in values]
    return [F.xxhash64(*values), F.xxhash64(F.lit(1), *values)]


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``a, b`` (128 bits of the whole row), ``doc_id`` and ``text``."""
    a, b = row_key(docs)
    return docs.select(a.alias("a"), b.alias("b"), F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))


def listed(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)])))


def gram_lists(texts: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """``a, b`` and ``grams``, the text's shingles; only of texts that may be ``wanted`` (a filter of ``a``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            if wanted is not None:
                batch = batch.filter(pa.array(may_hold(wanted, batch.column(0).to_numpy()), pa.bool_()))
            sets = [shingles(raw) for raw in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], listed(sets)], names=["a", "b", "grams"])

    return texts.select("a", "b", "text").mapInArrow(run, "a long, b long, grams array<long>")


def sketches(texts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``a, b, doc_id, fp, set_id, size, lo, hi, bits, keys`` of every row: its fingerprint, its shingle set's hash, size,
    smallest and largest shingle hash and mark, and the set's prefix."""
    every = texts.count() // sample + 1
    some = gram_lists(texts.where(F.pmod("a", F.lit(every)) == 0))
    often = some.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where("n > 1").toPandas().sort_values("g")
    hot, times = often["g"].to_numpy(np.int64), often["n"].to_numpy(np.int64)

    def prefix(g: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(g), np.int64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
            rank = np.where(hot[at] == g, times[at], 0)
        return g[np.lexsort((g, rank))[: len(g) - (4 * len(g) + 4) // 5 + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            raws = batch.column(3).cast(pa.binary()).to_pylist()
            sets = [shingles(raw) for raw in raws]
            fps = np.array([fingerprint(raw) for raw in raws], np.uint64).view(np.int64)
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            columns = [*batch.columns[:3], pa.array(fps), pa.array(ids), pa.array([len(s) for s in sets], pa.int32())]
            columns += [pa.array([s[0] for s in sets]), pa.array([s[-1] for s in sets]), listed([mark(s) for s in sets]), listed([prefix(s) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "doc_id", "fp", "set_id", "size", "lo", "hi", "bits", "keys"])

    return texts.mapInArrow(run, f"a long, b long, doc_id {dict(texts.dtypes)['doc_id']}, fp long, set_id long, size int, lo long, hi long, bits array<long>, keys array<long>")


def sizes_allow(m: Column, n: Column) -> Column:
    return 5 * F.least(m, n) >= 4 * F.greatest(m, n)


def marks_allow(m: Column, n: Column, one: Column, other: Column) -> Column:
    """False where sets of sizes ``m`` and ``n`` with these marks certainly do not link: linked sets differ in a ninth of
    the sum of their sizes at most, and their marks in no more bits. True where a mark is null."""
    bits = sum((F.bit_count(one[i].bitwiseXOR(other[i])) for i in range(MARK // 64)), F.lit(0))
    return F.coalesce(9 * bits <= m + n, F.lit(True))


def close_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u, v`` of set ids whose marks allow a link."""
    left, right = (sets.select(F.col("set_id").alias(s), F.struct("size", "bits").alias(f"s{s}")) for s in "uv")
    allowed = marks_allow(F.col("su.size"), F.col("sv.size"), F.col("su.bits"), F.col("sv.bits"))
    return pairs.join(left, "u").join(right, "v").where(allowed).select("u", "v")


def enough_shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u, v`` of set ids whose prefixes share enough."""
    left, right = (sets.select(F.col("set_id").alias(s), F.struct("size", "keys").alias(f"s{s}")) for s in "uv")
    asked = least_shared(F.col("su.size"), F.col("sv.size"))
    return pairs.join(left, "u").join(right, "v").where(F.size(F.array_intersect("su.keys", "sv.keys")) >= asked).select("u", "v")


def least_shared(m: Column, n: Column) -> Column:
    """How many shingles the prefixes of two sets of these sizes share at least if the sets link."""
    return F.ceil(4 * (m + n) / 9) - F.ceil(4 * F.greatest(m, n) / 5) + 1


ORDERS = (["lo", "size", "set_id"], ["hi", "size", "set_id"], ["size", "set_id"])


def ordered_pair(one: Column, other: Column) -> list[Column]:
    return [F.least(one, other).alias("u"), F.greatest(one, other).alias("v")]


def neighbours(shared: DataFrame, orders=ORDERS, reach: int = REACH) -> DataFrame:
    """``u, v``: sets of different components that stand within ``reach`` places among those of a shingle (``key, set_id,
    root, size, lo, hi``) in one of the orders, and whose sizes allow a link."""
    found = []
    for order in orders:
        for back in range(1, reach + 1):
            before = F.lag(F.struct("set_id", "root", "size"), back).over(Window.partitionBy("key").orderBy(*order))
            found.append(F.when((before["root"] != F.col("root")) & sizes_allow(before["size"], F.col("size")), before["set_id"]))
    met = shared.select("set_id", F.array_compact(F.array_distinct(F.array(*found))).alias("near"))
    pairs = met.select("set_id", F.explode("near").alias("other"))
    return pairs.select(*ordered_pair(F.col("set_id"), F.col("other"))).distinct()


def still_mixed(shared: DataFrame) -> DataFrame:
    """The rows (``key, root, ...``) of keys that sets of different components hold."""
    mixed = shared.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("key")
    return shared.join(mixed, "key", "left_semi")


def pairs_of_small_groups(shared: DataFrame, most: int = SMALL) -> DataFrame:
    """``u, v``: all pairs of different components whose sizes allow a link, of the shingles that at most ``most`` sets
    hold: no more than half of ``most`` for each row."""
    few = shared.join(shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("key"), "key", "left_semi")
    left, right = (few.select("key", F.col("set_id").alias(s), F.col("root").alias(f"r{s}"), F.col("size").alias(f"z{s}")) for s in "uv")
    pairs = left.join(right, "key").where((F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")) & sizes_allow(F.col("zu"), F.col("zv")))
    return pairs.select("u", "v").distinct()


def marked(shared: DataFrame, sets: DataFrame, most: int = SMALL) -> DataFrame:
    """The rows with the marks of their sets (``bits``) where more than ``most`` sets hold the key, else null."""
    many = shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key")
    large = shared.join(many, "key", "left_semi").join(sets.select("set_id", "bits"), "set_id")
    return written(large.unionByName(shared.join(many, "key", "left_anti").withColumn("bits", F.lit(None).cast("array<long>"))), "marked")


def pairs_of_large_groups(shared: DataFrame, most: int = SMALL, block: int = BLOCK) -> DataFrame:
    """``u, v``: the pairs of different components that share enough shingles of more than ``most`` sets each, and whose marks
    (``bits``, if the rows have them) allow a link. A pair that also shares another shingle is not judged here,
    :func:`pairs_of_small_groups` has it."""
    if "bits" not in shared.columns:
        shared = shared.withColumn("bits", F.lit(None).cast("array<long>"))
    blocks = shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key", F.ceil(F.col("n") / block).alias("n"))
    dealt = shared.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("n")))
    own = lambda s: (F.col("set_id").alias(s), F.col("root").alias(f"r{s}"), F.col("size").alias(f"z{s}"), F.col("bits").alias(f"b{s}"))
    left = dealt.select("key", *own("u"), F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("n") - 1)).alias("j"))
    right = dealt.select("key", *own("v"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("i"))
    apart = (F.col("ru") != F.col("rv")) & sizes_allow(F.col("zu"), F.col("zv")) & ((F.col("i") < F.col("j")) | (F.col("u") < F.col("v")))
    apart &= marks_allow(F.col("zu"), F.col("zv"), F.col("bu"), F.col("bv"))
    met = left.join(right, ["key", "i", "j"]).where(apart).select(*ordered_pair(F.col("u"), F.col("v")), least_shared(F.col("zu"), F.col("zv")).alias("asked"))
    return met.groupBy("u", "v", "asked").agg(F.count("*").alias("n")).where("n >= asked").select("u", "v")


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``u, v`` of set ids whose sets have a similarity of 0.8 or more, counted exactly."""
    # prefixes are long: those of sets that no pair names are not shuffled (nor most of them, where names are very many)
    named = hashed_bits(pairs.select("u").union(pairs.select("v")), "u")
    likely = written(enough_shared(pairs, sets.where(may_be_in(named, F.col("set_id")))), "likely")
    asked = likely.select(F.explode(F.array("u", "v")).alias("set_id")).distinct()
    one = written(sets.select("set_id", "a", "b").join(asked, "set_id"), "asked")
    grams = written(gram_lists(texts, hashed_bits(one, "a")).join(one, ["a", "b"]).dropDuplicates(["a", "b"]).select("set_id", F.col("grams").alias("g")), "grams")
    left, right = (grams.select(F.col("set_id").alias(s), F.col("g").alias(f"g{s}")) for s in "uv")
    shared = F.size(F.array_intersect("gu", "gv"))
    found = written(likely.join(left, "u").join(right, "v").where(9 * shared >= 4 * (F.size("gu") + F.size("gv"))).select("u", "v"), "verified")
    for table in (likely, one, grams):
        removed(table)
    return found


def rooted(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """``sets`` with the ``root`` of each: itself where no link names it."""
    return sets.join(roots.select(F.col("u").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))


def fingerprint_groups(rows: DataFrame) -> DataFrame:
    """``u, v`` links between sets whose texts' fingerprints are in one component."""
    held = written(rows.select("set_id", "fp").distinct(), "held")
    roots = fingerprint_components(held.select("fp").distinct())
    grouped = held.join(roots, "fp", "left").select("set_id", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("set_id").alias("v"), F.max("set_id").alias("m")).where("v < m").drop("m")
    links = written(grouped.join(least, "root").where("set_id <> v").select(F.col("set_id").alias("u"), "v").distinct(), "held-links")
    removed(held)
    return links


def shared_rows(rows: DataFrame) -> DataFrame:
    """``key, set_id``: the prefix shingles that more than one row holds. Only these two are shuffled."""
    own = rows.select("set_id", F.explode("keys").alias("key"))
    twice = own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return own.join(twice, "key", "left_semi").distinct()


def with_roots(shared: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """The rows that still tie different components of the links together, with what comparing them needs."""
    known = rooted(sets.select("set_id", "size", "lo", "hi"), star_components(links))
    return written(still_mixed(shared.join(known, "set_id")).select("key", "set_id", "root", "size", "lo", "hi"), "mixed")


def set_components(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``u, root`` of the sets that link to another set, but for the roots."""
    links = fingerprint_groups(rows)
    sets = written(rows.groupBy("set_id").agg(F.min(F.struct("a", "b", "size", "lo", "hi", "bits", "keys")).alias("r")).select("set_id", "r.*"), "sets")
    shared = written(shared_rows(rows), "shared")
    tried = None
    for propose in (
        lambda mixed: neighbours(mixed, ORDERS[:1], 1),
        lambda mixed: neighbours(mixed, ORDERS, REACH),
        pairs_of_small_groups,
        pairs_of_large_groups,
    ):
        # components only grow: what is not mixed now is never mixed again
        before, shared = shared, with_roots(shared.select("key", "set_id"), sets, links)
        removed(before)
        if propose is pairs_of_large_groups:
            before, shared = shared, marked(shared, sets)
            removed(before)
        pairs = close_pairs(propose(shared), sets)
        pairs = written(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        links = links.unionByName(verified(pairs, sets, texts))
        tried = pairs if tried is None else tried.unionByName(pairs)
    found = star_components(links)
    for table in (sets, shared):
        removed(table)
    return found


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, in all its columns: that with the smallest id, a row without an id
    only where the group has no other."""
    texts = keyed_texts(docs, id_col, text_col)
    rows = written(sketches(texts), "sketches")
    group = rooted(rows.select("a", "b", "doc_id", "set_id"), set_components(rows, texts))
    alike = group.groupBy("root", "doc_id", "a", "b").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "a", "b")).alias("r")
    kept = alike.groupBy("root").agg(best).select("r.a", "r.b", F.lit(True).alias("kept"))
    # few rows go or repeat; the many that just stay need no shuffle of their texts
    apart = written(alike.select("a", "b", "n").join(kept, ["a", "b"], "left").where("kept is null or n > 1"), "apart")
    removed(rows)
    a, b = (unused_name(docs, n) for n in ("_a", "_b"))
    keys = row_key(docs)
    keyed = docs.withColumns({a: keys[0], b: keys[1]})
    named = apart.select(F.col("a").alias(a), F.col("b").alias(b), "kept")
    mark = unused_name(docs, "_named")
    marked = keyed.withColumn(mark, may_be_in(hashed_bits(apart, "a"), F.col(a)))
    some = marked.where(mark)
    single = marked.where(~F.col(mark)).unionByName(some.join(named.select(a, b), [a, b], "left_anti").select(*marked.columns))
    repeated = some.join(named.where("kept").select(a, b), [a, b], "left_semi").dropDuplicates([a, b])
    return single.unionByName(repeated.select(*marked.columns)).drop(a, b, mark)
