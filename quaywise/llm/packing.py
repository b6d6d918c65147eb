"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

A document becomes token ids plus an end id and, if longer than the capacity, pieces: full ones behind a
first one that takes the rest. How many pieces of each length go together is solved on the length
histogram alone, which has at most ``capacity`` entries whatever the corpus: the configuration linear
program by multiplicative weights, with a knapsack dynamic program as its pricing step, then rounded down,
and what is left placed by best fit. The pieces themselves stay in Spark: they are numbered within their
length (long runs of one length in blocks, so no task holds them all) and the number alone tells the
sequence and the place in it.

Null texts count as empty, so such a document is the end id alone; texts are tokenised whole, however long; an empty
table gives an empty result; repeated rows are packed once each; null ids are kept; further columns of the input are
not looked at. Pieces of equal length are numbered by block, document, piece and checksum, so a run can be repeated.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaywise.llm.common import small_batches, text_or_empty, written


# --------------------------------------------------------------------------- tokens


class TokenIds:
    """Token ids of whole texts from a byte-level pair-merging vocabulary file.

    The file is also turned into its ranked form, which gives the same ids several times as fast. Texts that hold a
    token the file adds to its vocabulary (such as an end mark spelled out) go to the ``tokenizers`` library, which
    gives that token's own id.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = self._ranked(path)

    def _ranked(self, path: str):
        """The same vocabulary in the ranked form, if merge order is id order; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            return None
        special = {t["content"] for t in spec.get("added_tokens", [])}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [model["vocab"]["".join(m)] for m in merges]
        if order != sorted(order):
            return None
        return tiktoken.Encoding("ranked", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.fast is not None and not any(t in text for t in self.added):
            try:
                return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
            except (ValueError, RuntimeError):  # the pattern engine gave up on an extreme run
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_TOKENS: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    if path not in _TOKENS:
        _TOKENS[path] = TokenIds(path)
    return _TOKENS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, with ``keep_ids``, ``ids`` (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_ids(tokenizer_path)
        end = int(end_id).to_bytes(4, "little")
        for batch in small_batches(batches):
            row, piece, start, length, crc, raw = [], [], [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                ids = tokens.encode(text) + end
                n = len(ids) // 4
                cut = n - (math.ceil(n / capacity) - 1) * capacity
                edges = [0, *range(cut, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    row.append(r)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        raw.append(part)
            out = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else ""))


# --------------------------------------------------------------------------- plan on the histogram


def best_configuration(lengths: np.ndarray, value: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length (ascending) the most valuable configuration holds, at most ``most`` of each.

    The pricing step: a knapsack by dynamic programming over the capacity, with multiples split into powers of two.
    Of the lengths over half the capacity one fits at most, so they are tried last, all at once.
    """
    short = int(np.searchsorted(lengths, capacity // 2, side="right"))
    parts: list[tuple[int, int]] = []
    for k, m in enumerate(np.minimum(most[:short], capacity // lengths[:short]).tolist()):
        step = 1
        while m > 0:
            parts.append((k, min(step, m)))
            m -= step
            step *= 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(parts), capacity + 1), bool)
    for p, (k, n) in enumerate(parts):
        w = int(lengths[k]) * n
        gain = best[:-w] + value[k] * n
        np.greater(gain, best[w:], out=taken[p, w:])
        np.maximum(gain, best[w:], out=best[w:])
    out = np.zeros(len(lengths), np.int64)
    room = capacity
    if short < len(lengths):
        gain = best[capacity - lengths[short:]] + value[short:]
        k = int(gain.argmax())
        if gain[k] > best[capacity]:
            out[short + k] = 1
            room -= int(lengths[short + k])
    for p in range(len(parts) - 1, -1, -1):
        if taken[p, room]:
            k, n = parts[p]
            out[k] += n
            room -= int(lengths[k]) * n
    return out


POWER = 1.3  # of a length's share of the capacity, as its first price


@dataclass
class Covering:
    """A fractional covering of the histogram by configurations, and a bound of it from below."""

    lengths: np.ndarray
    configs: list[np.ndarray]  # pieces of each length
    times: list[float]
    bound: float  # no covering, fractional or whole, has fewer sequences

    @property
    def value(self) -> float:
        return sum(self.times)


def solve_configurations(counts: np.ndarray, capacity: int, rounds: int = 400, rate: float = 0.5, power: float = POWER) -> Covering:
    """The configuration program: cover the demand of every length by as few configurations as possible.

    Multiplicative weights: a length's price starts at its share of the capacity (to a power over one, as long pieces
    are the hard ones) and shrinks exponentially with the part of its demand that is covered, so the pricing step
    turns to lengths that lag. A step covers at most half of the open demand of a length (all of it once one sequence
    does, or when the rounds run short). Prices divided by the worth of the best configuration are a solution of the
    dual program, so every round in which all lengths are open gives a lower bound; the best one is kept.
    """
    lengths = np.flatnonzero(counts)
    demand = counts[lengths].astype(float)
    result = Covering(lengths, [], [], float((lengths * demand).sum() / capacity))
    chosen: dict[bytes, int] = {}
    left = demand.copy()
    n = 0
    while (left > 1e-9).any():
        at = np.flatnonzero(left > 1e-9)
        share = left[at] / demand[at]
        price = (lengths[at] / capacity) ** power * np.exp(rate * (share - share.max()))
        config = np.zeros(len(lengths), np.int64)
        config[at] = best_configuration(lengths[at], price, np.ceil(left[at]).astype(np.int64), capacity)
        if len(at) == len(lengths) and n < rounds:
            worth = best_configuration(lengths, price, np.full(len(at), capacity), capacity) @ price
            result.bound = max(result.bound, float(price @ demand / worth))
        held = config > 0
        step = (left[held] / config[held]).min()
        if step > 1 and n < rounds:
            step = max(step / 2, 1.0)
        left[held] -= step * config[held]
        key = config.tobytes()
        if key not in chosen:
            chosen[key] = len(result.configs)
            result.configs.append(config)
            result.times.append(0.0)
        result.times[chosen[key]] += step
        n += 1
    return result


Plan = list[tuple[dict[int, int], int]]


def rounded_down(solved: Covering, counts: np.ndarray, least: int) -> tuple[Plan, np.ndarray]:
    """Whole sequences of the program's configurations that fill at least ``least`` of the capacity, and what is left of
    the pieces (by length, as in ``solved.lengths``)."""
    lengths, left = solved.lengths, counts[solved.lengths].astype(np.int64)
    plan: Plan = []
    for k in np.argsort(-np.array(solved.times), kind="stable"):
        config, held = solved.configs[k], solved.configs[k] > 0
        times = min(math.floor(solved.times[k] + 1e-9), int((left[held] // config[held]).min()))
        if times and config @ lengths >= least:
            left = left - config * times
            plan.append((_pieces(lengths, config), times))
    return plan, left


def _pieces(lengths: np.ndarray, config: np.ndarray) -> dict[int, int]:
    return {int(lengths[k]): int(config[k]) for k in np.flatnonzero(config)}


def priced_rest(lengths: np.ndarray, left: np.ndarray, capacity: int, power: float) -> Plan:
    """The pieces that are left, sequence by sequence: each is the most valuable configuration of them, a length's price
    being a power of its share of the capacity."""
    price, plan = (lengths / capacity) ** power, []
    while left.any():
        at = np.flatnonzero(left)
        config = np.zeros(len(lengths), np.int64)
        config[at] = best_configuration(lengths[at], price[at], left[at], capacity)
        held = config > 0
        times = int((left[held] // config[held]).min())
        left = left - config * times
        plan.append((_pieces(lengths, config), times))
    return plan


#: Prices of the pieces that rounding leaves: the lower the power, the more a full sequence counts against long pieces.
REST_POWERS = (1.02, 1.1, POWER)


def sequences(plan: Plan) -> int:
    return sum(times for _, times in plan)


def packing_plan(counts: np.ndarray, capacity: int, rounds: int = 400) -> Plan:
    """Whole-number plan: ``({length: pieces per sequence}, sequences)`` that holds the histogram exactly.

    The program's solution is rounded down to whole sequences, and what that leaves is placed by the pricing step. A
    sequence with room to spare is lost for good, so one rounding keeps the program's full configurations only and
    leaves more to place, another keeps all; each is finished with a few prices, and the fewest sequences win.
    """
    if not counts.any():
        return []
    solved = solve_configurations(counts, capacity, rounds)
    best: Plan | None = None
    for least in (capacity, 0):
        plan, left = rounded_down(solved, counts, least)
        for power in REST_POWERS:
            whole = plan + priced_rest(solved.lengths, left, capacity, power)
            if best is None or sequences(whole) < sequences(best):
                best = whole
            if sequences(best) < solved.bound + 1:  # no plan has fewer
                return best
    return best


class PlanTable:
    """The plan as sorted arrays: a piece's number within its length finds its sequence and offset."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        taken: dict[int, int] = {}
        rows, base = [], 0
        for config, times in plan:
            offset = 0
            for n, k in sorted(config.items(), reverse=True):
                rows.append((n, taken.get(n, 0), k, base, offset))
                taken[n] = taken.get(n, 0) + k * times
                offset += n * k
            base += times
        rows.sort()
        self.length, self.first, self.each, self.base, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.sequences = base

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.empty(len(length), np.int64)
        for n in np.unique(length):  # at most `capacity` values
            a, b = np.searchsorted(self.length, [n, n + 1])
            mine = length == n
            at[mine] = a + np.searchsorted(self.first[a:b], number[mine], side="right") - 1
        inner = number - self.first[at]
        return self.base[at] + inner // self.each[at], self.offset[at] + inner % self.each[at] * length


# --------------------------------------------------------------------------- operator


def pack_pieces(pieces: DataFrame, capacity: int = 1024, rounds: int = 400) -> DataFrame:
    """``pieces`` (a stored table with ``doc_id, piece, start, length, ids_crc32``) with ``sequence_id, offset``."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row["length"]] = row["count"]
    table = PlanTable(packing_plan(counts, capacity, rounds))
    block = max(1024, math.isqrt(int(counts.sum())))
    blocks = [int(c) for c in -(-counts // block)]
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.greatest(F.lit(1), F.element_at(F.array(*map(F.lit, blocks)), (F.col("length") + 1).cast("int"))))
    salted = pieces.withColumn("_block", salt)
    before = salted.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    through = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "_block", F.coalesce(F.sum("_n").over(through), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = salted.withColumn("_inside", F.row_number().over(inside)).join(before, ["length", "_block"]).withColumn("_number", F.col("_before") + F.col("_inside") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_number"))
            sequence, offset = table.place(length, number) if len(length) else (length, number)
            keep = batch.drop_columns(["_number"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(sequence), pa.array(offset)], names=[*keep.schema.names, "sequence_id", "offset"])

    out = numbered.select(*pieces.columns, "_number")
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return out.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, rounds: int = 400, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and its offset there."""
    return pack_pieces(written(token_pieces(docs, tokenizer_path, capacity, end_id, keep_ids, id_col, text_col), "pieces"), capacity, rounds)
