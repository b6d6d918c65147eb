"""Ranked lexical search by presence masks.

Every item of a stated query set is ranked against all documents. One pass reads the texts and keeps, of each document,
its number of terms and its occurrences of the items' terms; sums over these rows give the corpus figures and the
terms' weights. Then tasks go through the stored rows block by block. In a block and for an item

* each term sets its bit in the masks of the documents that hold it, and documents with the same mask form a group;
* a mask's bound is the sum of the most that each of its terms can give in this block (its highest number of
  occurrences in the shortest document that holds it);
* groups are scored exactly, highest bound first, until the next bound lies below the tenth best score of the task so
  far. A bound that equals it is still looked at, since a smaller id would win the tie.

A task hands on its ten best of each item, so what is shuffled depends on items and tasks, not on documents.

Items are taken in blocks of about :data:`BLOCK_TERMS` terms, the most that a task holds of the query set; each block
is one pass over the documents. Items with the same id are one item with the terms of all of them; one without terms
finds nothing. Null texts have no terms; documents without terms count in no figure. Equal scores go by ascending id,
documents without an id last. Repeated rows of documents are documents of their own. Texts are read whole; further
columns may have any names; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaywise.llm.common import removed, small_batches, text_or_empty, written

BLOCK_TERMS = 200_000
TOP = 10

#: Bytes of a term stay (A-Z in lower case), all others become a space.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters, digits and all characters above ASCII."""
    return raw.translate(TERM_BYTES).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, terms``: the distinct terms of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [sorted(set(terms_of(raw))) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    source = items.select(F.col(f"`{id_col}`").alias("item_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"item_id {dict(source.dtypes)['item_id']}, terms array<binary>")


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tfs``: a document's number of terms, and which of the vocabulary it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in small_batches(batches):
            sizes, ends, terms, tfs = [], [0], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms_of(raw)
                held = Counter(t for t in map(number, words) if t is not None)
                sizes.append(len(words))
                terms += held.keys()
                tfs += held.values()
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, n long, terms array<int>, tfs array<int>")


@dataclass
class Figures:
    """What scoring needs of the corpus: documents with a term, all their terms, a weight for each term number."""

    n_docs: int
    n_terms: int
    weights: np.ndarray

    def norms(self, sizes: np.ndarray) -> np.ndarray:
        return 10 + 90 * sizes * self.n_docs // self.n_terms

    def gain(self, term: np.ndarray, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """What occurrences of a term add to a score: more with each, less in longer documents."""
        return self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * norm))


def figures_of(counts: DataFrame, n_vocabulary: int) -> Figures | None:
    """None where no document has a term. As many rows reach the driver as the vocabulary has terms."""
    n_docs, n_terms = counts.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(n_vocabulary, np.int64)
    for term, n in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():
        df[term] = n
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()]
    return Figures(n_docs, n_terms, np.array(weights, np.int64))


class Block:
    """Documents of one batch, with their term counts by document and by term."""

    def __init__(self, batch: pa.RecordBatch, figures: Figures) -> None:
        self.ids = batch.column(0)
        self.figures = figures
        self.norm = figures.norms(batch.column(1).to_numpy())
        terms, tfs = batch.column(2), batch.column(3)
        self.ends = terms.offsets.to_numpy().astype(np.int64) - terms.offsets[0].as_py()
        self.term, self.tf = (x.flatten().to_numpy().astype(np.int64) for x in (terms, tfs))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(self.ends))
        by_term = np.argsort(self.term, kind="stable")
        self.doc = doc[by_term]
        self.held, first = np.unique(self.term[by_term], return_index=True)
        self.first = np.append(first, len(by_term))
        if len(self.held):
            highest = np.maximum.reduceat(self.tf[by_term], first)
            shortest = np.minimum.reduceat(self.norm[self.doc], first)
            self.most = figures.gain(self.held, highest, shortest)

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct masks of the block's documents, their bounds, and each document's mask number."""
        at = np.searchsorted(self.held, terms)
        there = at < len(self.held)
        at, terms = at[there], terms[there]
        at = at[self.held[at] == terms]
        at = at[self.most[at] > 0]
        words = np.zeros((len(self.ends) - 1, max(1, -(-len(at) // 64))), np.uint64)
        for bit, k in enumerate(at):
            words[self.doc[self.first[k] : self.first[k + 1]], bit >> 6] |= np.uint64(1 << (bit & 63))
        if words.shape[1] == 1:
            distinct, number = np.unique(words[:, 0], return_inverse=True)
            distinct = distinct[:, None]
        else:
            distinct, number = np.unique(words, axis=0, return_inverse=True)
        bound = np.zeros(len(distinct), np.int64)
        for bit, k in enumerate(at):
            bound += (distinct[:, bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)).astype(np.int64) * self.most[k]
        return distinct, bound, number.reshape(-1)

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of documents; ``wanted`` is true at the item's terms."""
        sizes = self.ends[docs + 1] - self.ends[docs]
        entry = np.repeat(self.ends[docs] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        row = np.repeat(np.arange(len(docs)), sizes)
        mine = wanted[self.term[entry]]
        entry, row = entry[mine], row[mine]
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, row, self.figures.gain(self.term[entry], self.tf[entry], self.norm[docs[row]]))
        return out


Hit = tuple[int, bool, object]  # score below zero, whether the id is missing, the id: smaller is better


def improve(best: list[Hit], block: Block, terms: np.ndarray, wanted: np.ndarray, top: int) -> list[Hit]:
    """The best hits of an item after a further block."""
    _, bound, number = block.masks(terms)
    by_group = np.argsort(number, kind="stable")
    start = np.searchsorted(number[by_group], np.arange(len(bound) + 1))
    order = np.argsort(-bound, kind="stable")
    at, together = 0, top
    while at < len(order) and bound[order[at]] > 0 and (len(best) < top or bound[order[at]] >= -best[-1][0]):
        some = order[at : at + together]
        least = -best[-1][0] if len(best) == top else 1
        some = some[bound[some] >= least]
        docs = np.concatenate([by_group[start[g] : start[g + 1]] for g in some])
        score = block.scores(docs, wanted)
        if len(score) > top:  # equal ones stay, whatever their number
            least = max(least, int(np.partition(score, -top)[-top]))
        good = (score >= least) & (score > 0)
        found = [(-s, i is None, i) for s, i in zip(score[good].tolist(), (block.ids[d].as_py() for d in docs[good].tolist()), strict=True)]
        best = sorted([*best, *found], key=lambda h: (h[0], h[1], 0 if h[1] else h[2]))[:top]
        at, together = at + len(some), 2 * together
    return best


def best_hits(counts: DataFrame, items: list[np.ndarray], figures: Figures, top: int) -> DataFrame:
    """``item, doc_id, score``: of each task of ``counts`` the best documents of every item (by its place in the list)."""
    n_vocabulary = len(figures.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[Hit]] = [[] for _ in items]
        schema = None
        wanted = np.zeros(n_vocabulary, bool)
        for batch in batches:
            schema = batch.schema
            block = Block(batch, figures)
            if not len(block.held):
                continue
            for k, terms in enumerate(items):
                wanted[terms] = True
                best[k] = improve(best[k], block, terms, wanted, top)
                wanted[terms] = False
        rows = [(k, hit[2], -hit[0]) for k, hits in enumerate(best) for hit in hits]
        if rows:
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], schema.field("doc_id").type), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return counts.mapInArrow(run, f"item int, doc_id {dict(counts.dtypes)['doc_id']}, score long")


def search_block(docs: DataFrame, items: list[tuple[object, list[bytes]]], item_type: str, id_col: str, text_col: str, top: int) -> DataFrame | None:
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    counts = written(term_counts(docs, vocabulary, id_col, text_col), "term-counts")
    figures = figures_of(counts, len(vocabulary))
    if figures is None:
        return None
    found = written(best_hits(counts, [np.array(sorted(vocabulary[t] for t in terms), np.int64) for _, terms in items], figures, top), "hits")
    removed(counts)
    names = docs.sparkSession.createDataFrame([(k, item) for k, (item, _) in enumerate(items)], f"item int, item_id {item_type}")
    return found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")  # a block has at most as many items as terms


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of every item with a score above 0."""
    asked = written(item_terms(items, item_col, item_text), "items")
    item_type = dict(asked.dtypes)["item_id"]
    n_blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    parts = []
    for k in range(n_blocks):
        of_block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        joined: dict[object, set[bytes]] = {}
        for row in of_block.where(F.size("terms") > 0).toLocalIterator():
            joined.setdefault(row["item_id"], set()).update(map(bytes, row["terms"]))
        if joined:
            parts.append(search_block(docs, list(joined.items()), item_type, id_col, text_col, top))
    removed(asked)
    parts = [p for p in parts if p is not None]
    if not parts:
        empty = docs.sparkSession.createDataFrame([], f"item_id {item_type}, doc_id {dict(docs.dtypes)[id_col]}, score long")
        return empty.select("item_id", F.lit(0).alias("rank"), "doc_id", "score")
    found = reduce(DataFrame.unionByName, parts)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
