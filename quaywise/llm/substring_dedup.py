"""Exact substring dedup by seed and extend on winnowed anchors.

Words are runs of bytes that are not ASCII white space, unchanged. A window is ``window`` consecutive words of
one document; a word goes if some window over it has a word sequence that also starts earlier (in a document
with a smaller id, or earlier in the same one). Windows are judged on the input.

* Seed. Hashes of ``anchor`` words are winnowed: of the anchors inside each window the smallest hash is kept
  (the last of equals). Which one that is depends on the window's words alone, so equal windows keep the same
  anchor at the same place. Documents are joined on the anchors they keep: one shuffle brings equal anchors
  together, and anchors that are alone go no further.
* Extend. The windows that keep an anchor reach over a block of words to its left and right. Where the whole
  block equals one of an earlier document, all its windows are repeats. Where it does not, but the anchor stands
  in other blocks too, the block's windows are compared one by one, which extends matches word by word to both
  sides. A block is compared once, for the first document that holds it, however many copies there are.
* Runs of repeated windows are the maximal repeats over the threshold, given as spans.

No pairs of documents are listed. Anchors that a bounded sample shows to be in many documents are salted: their
copies are reduced per salt before they meet. The sample decides only where rows go, never the result. Hashes of
blocks and windows have 128 bits.

A document is one row: rows that share an id and a text are alike, and neither of two rows with one id starts
earlier than the other. Ids are read as long; a null id ranks before all others. Null texts have no words. Texts are
read whole, however long. Further columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaywise.llm.common import removed, small_batches, text_or_empty, unused_name, written

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the two rolling hashes
NO_ID = -(1 << 63)  # stands for a null id while documents are compared
SAMPLE, HOT_SHARE, SALTS = 4096, 0.005, 256  # of documents looked at for common anchors; how common; their salts


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2**64, at least ``n`` of each."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(1 << 12, 1 << n.bit_length())
        both = (np.full(size, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        up, down = (np.concatenate([np.ones(1, np.uint64), p])[:-1] for p in both)
        _POWERS[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def run_hashes(h: np.ndarray, base: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hashes (modulo 2**64) of the words from ``start`` to ``stop``, wherever they stand."""
    up, down = _powers(base, len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down[: len(h)], dtype=np.uint64)])
    return _mixed((sums[stop] - sums[start]) * up[start])


def window_hashes(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    start = np.arange(max(len(h) - size + 1, 0))
    return run_hashes(h, base, start, start + size)


def kept_anchors(anchors: np.ndarray, per_window: int) -> np.ndarray:
    """For each window, the place of the anchor it keeps: its smallest hash, the last of equals.

    Two runs that together span a longer one give its minimum, so a few doublings reach the window.
    """
    if len(anchors) < per_window:
        return np.zeros(0, np.int64)
    value, place, width = anchors, np.arange(len(anchors)), 1
    while width < per_window:
        shift = min(width, per_window - width)
        right = value[shift:] <= value[:-shift]
        place = np.where(right, place[shift:], place[:-shift])
        value = np.where(right, value[shift:], value[:-shift])
        width += shift
    return place


@dataclass
class Blocks:
    place: np.ndarray  # of the anchor, in words
    first: np.ndarray  # window that keeps it
    last: np.ndarray  # window that keeps it
    anchor: np.ndarray  # hash

    def windows_of(self, places: np.ndarray) -> np.ndarray:
        """The windows of the blocks whose anchors stand at these places."""
        at = np.searchsorted(self.place, places)
        at = at[at < len(self.place)]
        size = self.last[at] - self.first[at] + 1
        ends = np.cumsum(size)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[at] - (ends - size), size)


class Cutter:
    """The words of several texts in a row, and hashes of runs of them that stay inside one text."""

    def __init__(self, raws: list[bytes], window: int, anchor: int):
        self.texts = [raw.split() for raw in raws]  # on bytes: ASCII white space
        self.window, self.anchor = window, anchor
        self.size = np.fromiter(map(len, self.texts), np.int64, len(raws))
        self.base = np.cumsum(self.size) - self.size
        self.text_of = np.repeat(np.arange(len(raws)), self.size)
        self.h1, self.h2 = word_hashes([w for t in self.texts for w in t])
        n = len(self.h1) - window + 1
        self.inside = self.text_of[window - 1 :] == self.text_of[:n] if n > 0 else np.zeros(0, bool)

    def blocks(self) -> Blocks:
        """The anchors that windows keep, each with the run of windows that keep it."""
        hashes = window_hashes(self.h1, self.anchor, BASES[0])
        kept = np.where(self.inside, kept_anchors(hashes, self.window - self.anchor + 1), -1)
        change = np.flatnonzero(np.diff(kept, prepend=-2, append=-2))
        first, last = change[:-1], change[1:] - 1
        real = kept[first] >= 0
        first, last = first[real], last[real]
        return Blocks(kept[first], first, last, hashes[kept[first]])

    def block_hashes(self, b: Blocks) -> np.ndarray:
        """Hashes of the blocks' words, and of where the anchor stands in them."""
        shape = (b.last - b.first + self.window) * 1024 + b.place - b.first
        return _mixed(run_hashes(self.h2, BASES[1], b.first, b.last + self.window) ^ _mixed(shape.astype(np.uint64)))

    def windows(self, at: np.ndarray) -> np.ndarray:
        """128-bit hash of the windows at these places as two columns."""
        return np.stack([run_hashes(h, base, at, at + self.window) for h, base in zip((self.h1, self.h2), BASES, strict=True)], 1)


def earlier_in_text(text: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which windows have an equal one before them in the same text."""
    out = np.zeros(len(windows), bool)
    key = _mixed(windows[:, 0] ^ _mixed(text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    twice = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if len(twice):  # few: compare these in full
        some = np.unique(np.concatenate([order[twice], order[twice + 1]]))
        full = np.stack([text[some].astype(np.uint64), windows[some, 0], windows[some, 1]], 1)
        _, first = np.unique(full, axis=0, return_index=True)
        out[some] = True
        out[some[first]] = False
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str, row: str | None = None) -> DataFrame:
    """``doc_id, d`` (null as the smallest), ``t`` (tells rows of one id apart) and ``text``."""
    text = text_or_empty(text_col)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("d"), F.hash(text).alias("t"), text.alias("text"), *([F.col(row).alias("row")] if row else []))


def common_anchors(keyed: DataFrame, window: int, anchor: int, sample: int = SAMPLE, share: float = HOT_SHARE) -> np.ndarray:
    """Anchors found in over a share of about ``sample`` documents: they are dealt out with salt."""
    n = keyed.count()
    if not n:
        return np.zeros(0, np.int64)
    some = keyed.sample(min(1.0, sample / n), 7) if n > sample else keyed
    seen = anchor_rows(some, window, anchor, np.zeros(0, np.int64)).select("g", "d").distinct().groupBy("g").agg(F.count("*").alias("n"))
    hot = seen.where(F.col("n") > max(8, share * min(n, sample))).select("g").collect()  # a share can hold few anchors
    return np.sort(np.array([r["g"] for r in hot], np.int64))


def _salt(d: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed((_mixed(d.view(np.uint64)) % np.uint64(SALTS) + np.uint64(1)) * np.uint64(BASES[1]))


def anchor_rows(keyed: DataFrame, window: int, anchor: int, hot: np.ndarray) -> DataFrame:
    """``g, b, d, t, p``: every anchor that windows keep. ``g`` is the anchor's hash (salted by document for a common
    one, and then ``p`` is negative), ``b`` the hash of its block, ``p`` its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            c = Cutter(batch.column(2).cast(pa.binary()).to_pylist(), window, anchor)
            blocks = c.blocks()
            at = c.text_of[blocks.place]
            d = batch.column(0).to_numpy()[at]
            key, place, b = blocks.anchor, blocks.place - c.base[at], c.block_hashes(blocks)
            if len(hot):
                spot = np.minimum(np.searchsorted(hot, key.view(np.int64)), len(hot) - 1)
                common = hot[spot] == key.view(np.int64)
                key = np.where(common, key ^ _salt(d), key)
                place = np.where(common, -1 - place, place)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(b.view(np.int64)), pa.array(d), batch.column(1).take(pa.array(at)), pa.array(place.astype(np.int32))], names=["g", "b", "d", "t", "p"])

    return keyed.select("d", "t", "text").mapInArrow(run, "g long, b long, d long, t int, p int")


WHOLE, REST, SALTED = 0, 1, 2  # a block repeats an earlier one whole; its windows must be compared; not known yet


def judged_blocks(rows: DataFrame) -> DataFrame:
    """``kind, d, t, p, g, b`` of the anchors that are not alone, from rows in order of ``g, b, d``.

    Equal blocks follow each other, the earliest document first, so one pass with a few remembered values tells
    them apart whatever the size of a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_g = last_b = last_f = None  # of the row before; first document of its block
        several = False  # the open anchor has shown a second block
        held: tuple | None = None  # the open anchor's first block, not yet given out
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g, b, d, t, p = (c.to_numpy() for c in batch.columns)
            same_g = np.concatenate([[last_g is not None and g[0] == last_g], g[1:] == g[:-1]])
            same_b = same_g & np.concatenate([[last_b is not None and b[0] == last_b], b[1:] == b[:-1]])
            opens = ~same_b
            start = np.maximum.accumulate(np.where(opens, np.arange(n), -1))
            first = np.where(start >= 0, d[np.maximum(start, 0)], last_f if last_f is not None else 0)
            salted = p < 0
            group = np.cumsum(~same_g)  # 0: the anchor left open by the batch before
            blocks = np.bincount(group, opens, group[-1] + 1)
            if same_g[0]:
                blocks[0] += 1 + several
            many = blocks[group] > 1
            kind = np.where(~opens & (d > first), WHOLE, np.where(opens & salted, SALTED, np.where(opens & many, REST, -1)))
            give = np.flatnonzero(kind >= 0)
            out = [kind[give].astype(np.int8), d[give], t[give], p[give], g[give], b[give]]
            if held is not None:
                if same_g[0] and blocks[0] > 1:  # the block held back turns out to have company
                    out = [np.concatenate([[h], o]).astype(o.dtype) for h, o in zip(held, out, strict=True)]
                    held = None
                elif not same_g[0] or group[-1] > 0:
                    held = None
            opened = np.flatnonzero(opens & (group == group[-1]))
            several = bool(blocks[-1] > 1)
            if not several and len(opened) and not salted[opened[0]]:
                i = opened[0]
                held = (REST, d[i], t[i], p[i], g[i], b[i])
            last_g, last_b, last_f = g[-1], b[-1], first[-1]
            yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], names=["kind", "d", "t", "p", "g", "b"])

    return rows.mapInArrow(run, "kind tinyint, d long, t int, p int, g long, b long")


def settled_blocks(judged: DataFrame) -> DataFrame:
    """``kind, d, t, p`` with the salted blocks reduced over all salts."""
    plain = judged.where(F.col("kind") != SALTED).select("kind", "d", "t", F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("p")).alias("p"))

    def unsalted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t, p, g, b = batch.columns
            a = (g.to_numpy().view(np.uint64) ^ _salt(d.to_numpy())).view(np.int64)
            yield pa.RecordBatch.from_arrays([d, t, pa.array((-1 - p.to_numpy()).astype(np.int32)), pa.array(a), b], names=["d", "t", "p", "a", "b"])

    rest = judged.where(F.col("kind") == SALTED).select("d", "t", "p", "g", "b").mapInArrow(unsalted, "d long, t int, p int, a long, b long")
    first = rest.groupBy("a", "b").agg(F.min("d").alias("f"))
    again = rest.join(first, ["a", "b"]).select(F.when(F.col("d") > F.col("f"), WHOLE).otherwise(REST).cast("tinyint").alias("kind"), "d", "t", "p")
    return plain.unionByName(again)


def _in_row(c: Cutter, lists: pa.ListArray, limit: np.ndarray) -> np.ndarray:
    """Places inside texts (one list for each) as sorted places in the row of all words; those beyond a text go."""
    size = np.diff(lists.offsets.to_numpy())
    size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), size, 0)
    text = np.repeat(np.arange(len(size)), size)
    place = lists.flatten().to_numpy(zero_copy_only=False)
    real = place < limit[text]
    return np.sort(place[real] + c.base[text[real]])


def block_windows(seeded: DataFrame, window: int, anchor: int) -> DataFrame:
    """``d, t, h1, h2, s``: the windows of the blocks at ``seeds``; of equal ones in a text the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            c = Cutter(batch.column(2).cast(pa.binary()).to_pylist(), window, anchor)
            s = c.blocks().windows_of(_in_row(c, batch.column(3), c.size))
            w = c.windows(s)
            first = ~earlier_in_text(c.text_of[s], w)
            s, w = s[first], w[first]
            at = c.text_of[s]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(w[:, 0].view(np.int64)), pa.array(w[:, 1].view(np.int64)), pa.array((s - c.base[at]).astype(np.int32))], names=["d", "t", "h1", "h2", "s"])

    return seeded.select("d", "t", "text", "seeds").mapInArrow(run, "d long, t int, h1 long, h2 long, s int")


def repeated_places(docs: DataFrame, window: int = 20, anchor: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``d, t, wholes, starts``: for each text the anchors of blocks that repeat whole, and single windows that
    also start in an earlier document."""
    keyed = _keyed(docs, id_col, text_col)
    rows = anchor_rows(keyed, window, anchor, common_anchors(keyed, window, anchor))
    judged = written(judged_blocks(rows.repartition("g").sortWithinPartitions("g", "b", "d")), "judged")
    blocks = written(settled_blocks(judged), "blocks")
    seeds = blocks.where(F.col("kind") == REST).groupBy("d", "t").agg(F.collect_set("p").alias("seeds"))
    windows = written(block_windows(keyed.join(seeds, ["d", "t"]), window, anchor), "windows")
    first = windows.groupBy("h1", "h2").agg(F.min("d").alias("f"), F.max("d").alias("l")).where("f < l").select("h1", "h2", "f")
    later = windows.join(first, ["h1", "h2"]).where("d > f").select("d", "t", F.lit(None).cast("int").alias("p"), "s")
    whole = blocks.where(F.col("kind") == WHOLE).select("d", "t", "p", F.lit(None).cast("int").alias("s"))
    places = whole.unionByName(later).groupBy("d", "t").agg(F.collect_set("p").alias("wholes"), F.collect_set("s").alias("starts"))
    places = written(places, "places")
    for table in (judged, blocks, windows):
        removed(table)
    return places


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words the windows at ``starts`` cover."""
    step = np.bincount(starts, minlength=n_words + 1) - np.bincount(starts + window, minlength=n_words + 1)
    return np.cumsum(step)[:n_words] > 0


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_out(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """A text without runs of its words and the white space behind each; all else stays byte for byte."""
    starts = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    edges = [0, *(starts[n] for run in runs for n in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _removed_words(c: Cutter, wholes: pa.ListArray, starts: pa.ListArray) -> np.ndarray:
    """Which words of the row of texts go."""
    every = np.flatnonzero(c.inside)
    own = every[earlier_in_text(c.text_of[every], c.windows(every))]
    whole = _in_row(c, wholes, c.size)
    parts = [own, _in_row(c, starts, c.size - c.window + 1)]
    if len(whole):
        parts.append(c.blocks().windows_of(whole))
    return covered(len(c.h1), np.concatenate(parts), c.window)


def remove_repeats(docs: DataFrame, window: int = 20, anchor: int = 5, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256, spans`` (word ranges removed; the hash is of
    the kept words joined by one space) and, on request, ``kept_text`` (the text without the removed runs of words and
    the white space behind each) and ``row`` (the other columns of the input)."""
    if with_text:
        row_name = unused_name(docs, "_row")
        others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
        keyed = _keyed(docs.withColumn(row_name, F.struct(*others)), id_col, text_col, row_name)
    else:
        keyed = _keyed(docs, id_col, text_col)
    places = repeated_places(docs, window, anchor, id_col, text_col)
    joined = keyed.join(places, ["d", "t"], "left").select("doc_id", "text", "wholes", "starts", *(["row"] if with_text else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            raws = batch.column(1).cast(pa.binary()).to_pylist()
            c = Cutter(raws, window, anchor)
            row = _removed_words(c, batch.column(2), batch.column(3))
            n, gone, sha, spans, kept_text = c.size, [], [], [], []
            for raw, words, at in zip(raws, c.texts, c.base.tolist(), strict=True):
                mask = row[at : at + len(words)]
                lost = int(mask.sum())
                kept = b" ".join(compress(words, (~mask).tolist()) if lost else words)
                gone.append(lost)
                sha.append(hashlib.sha256(kept).hexdigest())
                runs = spans_of(mask) if lost else []
                spans.append([{"start": a, "stop": b} for a, b in runs])
                if with_text:
                    kept_text.append(cut_out(raw, runs) if lost else raw)
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
            if with_text:
                out += [pa.array(kept_text, pa.binary()).cast(pa.string()), batch.column(4)]
                names += ["kept_text", "row"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,stop:int>>"
    return joined.mapInArrow(run, schema + (f", kept_text string, row {dict(joined.dtypes)['row']}" if with_text else ""))


def without_repeats(docs: DataFrame, window: int = 20, anchor: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of its texts (a text that loses nothing stays as it was, null too)."""
    was_null = unused_name(docs, "_null")
    cut = remove_repeats(docs.withColumn(was_null, F.col(f"`{text_col}`").isNull()), window, anchor, id_col, text_col)
    text = F.when(~F.col("row").getField(was_null), F.col("kept_text"))
    return cut.select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
