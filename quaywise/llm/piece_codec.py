"""SentencePiece encoding and decoding that keeps every piece's place in the source bytes.

The model file is read once per Python worker. Its compiled character map (a double-array trie plus a
pool of replacement strings) normalises a text by longest prefix, and each normalised byte remembers the
source byte range it came from; an empty map has no rules, so every character stays as it is. The pairs are
then merged unit by unit: no piece of the vocabularies served has a word start inside it, so merging never
crosses one (a unit is a run of word-start marks and the characters after it), and a long unit is cut
wherever two characters stand side by side in no piece. The sizes of the pieces, laid over the alignment,
give each id its range of source bytes.

Null texts count as empty; an empty text has no ids and decodes to an empty text. Texts are encoded whole,
however long, in time that grows with them. Rows are independent of each other, so repeated rows give
repeated results and an empty table an empty one; further columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaywise.llm.common import small_batches, text_or_empty

MARK = "▁"  # stands for a space inside pieces
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format
CACHE_UNITS = 300_000  # units remembered per worker
LONGEST_CACHED = 48  # characters
NEVER = 1 << 30  # rank of a pair that is no piece
MERGED_AT_ONCE = 4096  # units


# --------------------------------------------------------------------------- model file


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) pairs of a protocol-buffer message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            size = varint()
            value, at = buf[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = struct.unpack("<f" if size == 4 else "<d", buf[at : at + size])[0], at + size
        yield key >> 3, value


@dataclass
class PieceModel:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    charsmap: bytes
    add_dummy_prefix: bool
    squeeze_spaces: bool
    byte_fallback: bool
    unknown_surface: str

    @classmethod
    def read(cls, path: str) -> PieceModel:
        pieces, scores, kinds = [], [], []
        norm, train = b"", b""
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    item = dict(_fields(value))
                    pieces.append(item.get(1, b"").decode())
                    scores.append(item.get(2, 0.0))
                    kinds.append(item.get(3, NORMAL))
                elif number == 2:
                    train = value
                elif number == 3:
                    norm = value
        n, t = dict(_fields(norm)), dict(_fields(train))
        if not n.get(5, 1):
            raise ValueError("models that do not escape white space are not supported")
        if t.get(3, 1) != 2:
            raise ValueError("only models merged by pair rank are supported")
        return cls(pieces, scores, kinds, n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1)), bool(t.get(35, 0)), t.get(44, b" \xe2\x81\x87 ").decode())


# --------------------------------------------------------------------------- normalisation


class CharacterMap:
    """The compiled map: longest-prefix replacement rules over UTF-8 bytes."""

    def __init__(self, blob: bytes):
        self.units, self.pool = None, b""
        if blob:
            size = struct.unpack("<I", blob[:4])[0]
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
            self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes taken, replacement) of the longest rule that starts at ``at``."""
        units = self.units
        if units is None:
            return None
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)  # noqa: E731  as the trie format lays it out
        pos, found = offset(units[0]), None
        for i in range(at, len(data)):
            pos ^= data[i]
            if pos >= len(units):
                break
            unit = units[pos]
            if unit & 0x800000FF != data[i]:
                break
            pos ^= offset(unit)
            if unit & 0x100:
                found = (i + 1 - at, units[pos] & 0x7FFFFFFF)
        if found is None:
            return None
        start = found[1]
        return found[0], self.pool[start : self.pool.index(b"\0", start)]


@dataclass
class Normalised:
    text: str  # with word-start marks
    source: np.ndarray | None  # source byte where each normalised byte begins, one more for the end; None: see below
    prefixed: bool  # a mark that no source byte stands behind opens the text


def normalise(model: PieceModel, rules: CharacterMap, text: str) -> Normalised:
    """Longest-prefix normalisation. With no rules and no squeezing the alignment is left implicit:
    every character maps to itself and every mark to one space byte."""
    if not text:
        return Normalised("", None, False)
    if rules.units is None and not model.squeeze_spaces and MARK not in text:
        plain = text.replace(" ", MARK)
        return Normalised(MARK + plain if model.add_dummy_prefix else plain, None, model.add_dummy_prefix)
    data, out, source, at = text.encode(), [], [], 0
    while at < len(data):
        rule = rules.longest(data, at)
        if rule is None:
            size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            rule = size, data[at : at + size]
        out.append((rule[1], at, at + rule[0]))
        at += rule[0]
    chars: list[tuple[str, int, int]] = [(c, a, b) for s, a, b in out for c in s.decode()]
    if model.squeeze_spaces:
        kept: list[tuple[str, int, int]] = []
        for c in chars:
            if c[0] != " " or (kept and kept[-1][0] != " "):
                kept.append(c)
        while kept and kept[-1][0] == " ":
            kept.pop()
        chars = kept
    if not chars:
        return Normalised("", np.array([0]), False)
    text_out = "".join(MARK if c == " " else c for c, _, _ in chars)
    for c, a, b in chars:
        size = 3 if c == " " else len(c.encode())
        source += range(a, b) if b - a == size else [a] * size
    source.append(chars[-1][2])
    if model.add_dummy_prefix:
        return Normalised(MARK + text_out, np.array([chars[0][1]] * 3 + source), True)
    return Normalised(text_out, np.array(source), False)


# --------------------------------------------------------------------------- units


class PieceCodec:
    """Encoder and decoder of one model, with a bounded memory of units seen."""

    def __init__(self, path: str):
        self.model = PieceModel.read(path)
        self.rules = CharacterMap(self.model.charsmap)
        m = self.model
        normal = [i for i, k in enumerate(m.kinds) if k == NORMAL]
        place = {s: n for n, s in enumerate(sorted({m.scores[i] for i in normal}, reverse=True))}
        self.rank = {m.pieces[i]: place[m.scores[i]] for i in normal}  # the best score comes first
        self.id = {m.pieces[i]: i for i in normal}
        if any(MARK in p.lstrip(MARK) for p in self.rank) or any(k in (USER, UNUSED) for k in m.kinds):
            raise ValueError("pieces with inner word starts, user-defined or unused pieces are not supported")
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k == BYTE}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.unknown = next(i for i, k in enumerate(m.kinds) if k == UNKNOWN)
        self.size = np.array([len(p.encode()) if k == NORMAL else 0 for p, k in zip(m.pieces, m.kinds, strict=True)])
        self.neighbours = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}  # characters side by side in some piece
        # ASCII bytes decode alone; a piece whose text hangs on its neighbours has no entry here
        self.surface = [p.replace(MARK, " ") if k == NORMAL else chr(self.id_byte[i]) if self.id_byte.get(i, 255) < 0x80 else None for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True))]
        self.decimal = list(map(str, range(len(m.pieces))))
        self.seen: dict[str, tuple[bytes, bytes | None]] = {}  # bytes, which the collector need not look at
        self._pair_table()

    def merge(self, unit: str) -> list[str]:
        """Pieces of a unit: the best-ranked neighbouring pair merges first, the leftmost among equals."""
        if len(unit) > 32:
            return self._merge_long(unit)
        parts, rank = list(unit), self.rank.get
        pairs = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            i = pairs.index(best)
            parts[i] = piece = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + piece, NEVER)
            if i < len(pairs):
                pairs[i] = rank(piece + parts[i + 1], NEVER)
        return parts

    def _merge_long(self, unit: str) -> list[str]:
        """The same with a heap of pairs, in time that grows nearly with the unit's length."""
        parts: list[str | None] = list(unit)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        rank, heap = self.rank, []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                if both in rank:
                    heapq.heappush(heap, (rank[both], i, len(both), j))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, size, j = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def _unit(self, unit: str) -> tuple[bytes, bytes | None]:
        """Ids of a unit as 32-bit numbers, and where the ids do not tell them the normalised bytes of each."""
        pieces = self.merge(unit)
        ids = list(map(self.id.get, pieces))
        if None not in ids:
            return struct.pack(f"<{len(ids)}i", *ids), None
        ids, sizes = [], []
        for piece in pieces:
            known, raw = self.id.get(piece), piece.encode()
            if known is not None:
                ids.append(known)
                sizes.append(len(raw))
            elif self.model.byte_fallback:
                ids += [self.byte_id[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]  # the character's bytes stay together
            elif ids and ids[-1] == self.unknown:  # neighbouring unknown characters are one
                sizes[-1] += len(raw)
            else:
                ids.append(self.unknown)
                sizes.append(len(raw))
        return struct.pack(f"<{len(ids)}i", *ids), struct.pack(f"<{len(ids)}i", *sizes)

    def _pair_table(self) -> None:
        """Which two symbols (pieces, and characters of pieces) join to which piece, and how early."""
        symbols = list(self.rank) + sorted({c for p in self.rank for c in p} - self.rank.keys())
        number = {p: n for n, p in enumerate(symbols)}
        rows = []
        for whole in self.rank:
            for cut in range(1, len(whole)):
                a, b = number.get(whole[:cut]), number.get(whole[cut:])
                if a is not None and b is not None:
                    rows.append((a << 32 | b, self.rank[whole], number[whole]))
        keys, ranks, joined = np.array(sorted(rows), np.int64).reshape(-1, 3).T
        never = np.array([NEVER])
        self.pair_key, self.pair_rank, self.pair_symbol = np.append(keys, 1 << 62), np.append(ranks, never), np.append(joined, never)
        self.symbol_id = np.array([self.id.get(p, -1) for p in symbols], np.int32)
        self.symbol_of = np.full(0x110000, -2, np.int64)  # by code point; -2: stands in no piece
        for c, n in number.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = n

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol) of the piece that two symbols join to, NEVER where there is none."""
        key = np.where((a >= 0) & (b >= 0), a << 32 | b, -1)
        at = np.searchsorted(self.pair_key, key)
        real = self.pair_key[at] == key
        return np.where(real, self.pair_rank[at], NEVER), np.where(real, self.pair_symbol[at], NEVER)

    def _see(self, wanted: set[str]) -> None:
        """Remember units: those not seen lately merge side by side, one pair of each a round."""
        new = [u for u in wanted if u not in self.seen and len(u) <= LONGEST_CACHED]
        if len(self.seen) + len(new) > CACHE_UNITS:
            self.seen = {u: v for u, v in self.seen.items() if u in wanted}
        new.sort(key=len)
        for at in range(0, len(new), MERGED_AT_ONCE):
            self._learn(new[at : at + MERGED_AT_ONCE])

    def _learn(self, units: list[str]) -> None:
        n, width = len(units), len(units[-1])
        size = np.fromiter(map(len, units), np.int64, n)
        symbols = np.full((n, width + 1), -1, np.int64)
        symbols[np.arange(width + 1) < size[:, None]] = self.symbol_of[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
        ranks, joined = self._pairs(symbols[:, :-1], symbols[:, 1:])
        live, place = np.arange(n), np.arange(width)
        while len(live):
            best = ranks[live].argmin(1)
            going = ranks[live, best] < NEVER
            live, best = live[going], best[going]
            r = np.arange(len(live))
            s, k, j = symbols[live], ranks[live], joined[live]
            s[r, best] = j[r, best]
            source = place + (place > best[:, None])  # what stands behind moves up by one
            s[:, :-1] = np.take_along_axis(s, source, 1)
            s[:, -1] = -1
            source = np.minimum(place + (place >= best[:, None]), width - 1)
            k, j = np.take_along_axis(k, source, 1), np.take_along_axis(j, source, 1)
            k[:, -1] = NEVER
            k[r, best], j[r, best] = self._pairs(s[r, best], s[r, best + 1])
            before = np.maximum(best - 1, 0)
            old, old_j = k[r, before], j[r, before]
            new, new_j = self._pairs(s[r, before], s[r, best])
            k[r, before], j[r, before] = np.where(best > 0, new, old), np.where(best > 0, new_j, old_j)
            symbols[live], ranks[live], joined[live] = s, k, j
        held = symbols[:, :width] != -1
        ids = np.where(symbols >= 0, self.symbol_id[np.maximum(symbols, 0)], -1)[:, :width]
        strange = (held & (ids < 0)).any(1).tolist()
        raw, ends = ids[held].astype("<i4").tobytes(), np.cumsum(4 * held.sum(1)).tolist()
        start = 0
        for unit, end, odd in zip(units, ends, strange, strict=True):
            self.seen[unit] = self._unit(unit) if odd else (raw[start:end], None)
            start = end

    def _remembered(self, unit: str) -> tuple[bytes, bytes | None]:
        """:meth:`_unit` of a unit that was not seen lately; a long one is put together from its parts."""
        if len(unit) > LONGEST_CACHED:
            parts = self.parts(unit)
            if len(parts) == 1:
                return self._unit(unit)
            ids, sizes = self._joined([self.seen.get(p) or self._remembered(p) for p in parts])
            return ids, sizes.astype("<i4").tobytes()
        if len(self.seen) >= CACHE_UNITS:
            self.seen.clear()
        self.seen[unit] = value = self._unit(unit)
        return value

    def _joined(self, found: list[tuple[bytes, bytes | None]]) -> tuple[bytes, np.ndarray]:
        """Ids of units in a row, and the normalised bytes of each."""
        raw = b"".join([f[0] for f in found])
        sizes = self.size[np.frombuffer(raw, "<i4")]
        if any(own for _, own in found):
            at = 0
            for ids, own in found:
                if own is not None:
                    sizes[at : at + len(ids) // 4] = np.frombuffer(own, "<i4")
                at += len(ids) // 4
        return raw, sizes

    def parts(self, unit: str) -> list[str]:
        """A unit cut where merging cannot join what stands on both sides. Unknown characters in a row stay together
        where they become one id."""
        neighbours, fallback = self.neighbours, self.model.byte_fallback
        cuts = [i for i, pair in enumerate(map("".join, zip(unit, unit[1:], strict=False)), 1) if pair not in neighbours and (fallback or pair[0] in self.rank or pair[1] in self.rank)]
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True)]

    @staticmethod
    def units(text: str) -> list[str]:
        """The text cut before every run of marks."""
        parts = text.split(MARK)
        if "" not in parts[1:]:
            return ([parts[0]] if parts[0] else []) + [MARK + p for p in parts[1:]]
        out, run = ([parts[0]] if parts[0] else []), 0
        for p in parts[1:]:
            run += 1
            if p:
                out.append(MARK * run + p if run > 1 else MARK + p)
                run = 0
        if run:
            out.append(MARK * run)
        return out

    def encode(self, text: str) -> Encoded:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[Encoded]:
        norms = [normalise(self.model, self.rules, t) for t in texts]
        units = [self.units(n.text) for n in norms]
        self._see(set().union(*units))
        out = []
        for norm, own in zip(norms, units, strict=True):
            found = list(map(self.seen.get, own))
            if None in found:
                found = [f or self._remembered(u) for f, u in zip(found, own, strict=True)]
            raw, sizes = self._joined(found)
            out.append(Encoded(np.frombuffer(raw, "<i4").tolist(), sizes, norm))
        return out

    def spans(self, e: Encoded) -> tuple[np.ndarray, np.ndarray]:
        """Source byte range of each id. Bytes of one character share that character's range."""
        sizes = e.sizes
        stop = np.cumsum(sizes)
        start = stop - sizes
        inner = sizes == 0  # a byte of a character whose size stands on its last byte
        if inner.any():
            last = np.where(~inner, np.arange(len(sizes)), len(sizes))
            last = np.minimum.accumulate(last[::-1])[::-1]
            start, stop = start[last], stop[last]
        if e.normal.source is not None:
            return e.normal.source[start], e.normal.source[stop]
        raw = np.frombuffer(e.normal.text.encode(), np.uint8)
        # a mark is three bytes where the source has one (none for the dummy prefix)
        first = raw[:-2] == 0xE2 if len(raw) > 2 else np.zeros(0, bool)
        is_mark = np.zeros(len(raw) + 1, np.int64)
        if len(raw) > 2:
            is_mark[1 : len(raw) - 1] = first & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
        place = np.arange(len(raw) + 1) - 2 * np.cumsum(is_mark)
        if e.normal.prefixed:
            place = np.maximum(place - 1, 0)
        return place[start], place[stop]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, marks as spaces, the dummy prefix dropped, byte runs read as UTF-8."""
        plain = list(map(self.surface.__getitem__, ids))
        if None not in plain:
            text = "".join(plain)
            return text[1:] if self.model.add_dummy_prefix and text.startswith(" ") and self.model.kinds[ids[0]] == NORMAL else text
        out, raw, first, m = [], bytearray(), True, self.model

        def flush() -> None:
            at = 0
            while at < len(raw):  # each broken byte becomes one replacement character
                for size in (1, 2, 3, 4):
                    try:
                        out.append(raw[at : at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            raw.clear()

        for i in ids:
            kind = m.kinds[i]
            if kind == BYTE:
                raw.append(self.id_byte[i])
                first = False
                continue
            if raw:
                flush()
            if kind == CONTROL:
                continue
            piece = m.unknown_surface if kind == UNKNOWN else m.pieces[i].replace(MARK, " ")
            if first and kind == NORMAL and m.add_dummy_prefix and piece.startswith(" "):
                piece = piece[1:]
            first = False
            out.append(piece)
        flush()
        return "".join(out)


@dataclass
class Encoded:
    ids: list[int]
    sizes: np.ndarray
    normal: Normalised


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec per worker and model file."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


# --------------------------------------------------------------------------- operators


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, ids array<int>, starts array<int>, ends array<int>`` (source bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in small_batches(batches):
            ids, starts, ends = [], [], []
            for e in c.encode_all(batch.column(1).to_pylist()):
                a, b = c.spans(e)
                ids.append(e.ids)
                starts.append(a)
                ends.append(b)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, kind), pa.array(starts, kind), pa.array(ends, kind)], names=["doc_id", "ids", "starts", "ends"])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, ids array<int>, starts array<int>, ends array<int>")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, text string")


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of ids, decoded text and spans, without sending the ids back to the JVM.

    Columns: ``doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256`` (start and end bytes of every
    id as little-endian 32-bit pairs).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in small_batches(batches):
            n, ids, decoded, spans = [], [], [], []
            for e in c.encode_all(batch.column(1).to_pylist()):
                n.append(len(e.ids))
                ids.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, e.ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(e.ids).encode()).hexdigest())
                spans.append(hashlib.sha256(np.stack(c.spans(e), 1).astype("<i4").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded), pa.array(spans)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
