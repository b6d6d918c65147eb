"""Media columns: payload bytes stored as MPEG transport streams and read back whole.

A payload is cut into access units. Each travels in one packetised elementary packet with a presentation
time, spread over 188-byte transport packets; every ``RANDOM_ACCESS_EVERY``-th unit is marked as a
random-access point with a clock reference. A program table pair opens the stream. Reading parses the
program tables, checks the continuity counters, reassembles the elementary packets and lists the times of
the units and which of them are random-access points. All of it is arithmetic on whole arrays of packets.

Null texts count as empty; an empty text is one block of padding. Equal texts give equal media; texts are stored
whole, however long. Rows are independent, so repeated rows repeat, null ids stay null, further columns of the input
are not looked at and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaywise.llm.common import small_batches, text_or_empty, written

# Fixed values of the format.
PACKET, SYNC, TABLES_PID = 188, 0x47, 0
STUFFING, PRIVATE_STREAM, PRIVATE_DATA = 0xFF, 0xBD, 0x06
HEADER, TIMED_HEADER = 4, 14  # transport header; elementary header with one time stamp
CLOCK_FIELD = 8  # adaptation field with a clock reference

# This writer's choices.
PROGRAM, MAP_PID, DATA_PID = 1, 0x1000, 0x0100
BLOCK, UNIT = 576, 576 * 8
TICKS = 3600  # of the 90 kHz clock between units
RANDOM_ACCESS_EVERY = 4


def _table_crc() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _table_crc()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


def _opening() -> bytes:
    programs = PROGRAM.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big")
    streams = (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    return _table_packet(TABLES_PID, _section(0x00, 1, programs)) + _table_packet(MAP_PID, _section(0x02, PROGRAM, streams))


OPENING = _opening()


def pad(data: bytes, block: int = BLOCK) -> bytes:
    """Bytes 255 up to a positive multiple of the block."""
    short = -len(data) % block if data else block
    return data + b"\xff" * short


def _time_bytes(ticks: np.ndarray) -> np.ndarray:
    t = ticks.astype(np.int64)
    return np.stack([0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, (t >> 14) & 0xFE | 1, (t >> 7) & 0xFF, (t << 1) & 0xFE | 1], 1).astype(np.uint8)


def _units_to_packets(units: np.ndarray, first_unit: int, first_packet: int) -> np.ndarray:
    """Packets ``[unit, packet, 188]`` of equally long access units ``[unit, byte]``."""
    m, size = units.shape
    number = np.arange(first_unit, first_unit + m)
    elementary = np.empty((m, TIMED_HEADER + size), np.uint8)
    elementary[:, :9] = [0, 0, 1, PRIVATE_STREAM, *(size + 8).to_bytes(2, "big"), 0x84, 0x80, 5]
    elementary[:, 9:14] = _time_bytes(number * TICKS)
    elementary[:, TIMED_HEADER:] = units
    opening = PACKET - HEADER - CLOCK_FIELD
    full, tail = divmod(elementary.shape[1] - opening, PACKET - HEADER)
    n = 1 + full + (tail > 0)
    out = np.full((m, n, PACKET), STUFFING, np.uint8)
    out[:, :, 0] = SYNC
    out[:, :, 1] = DATA_PID >> 8
    out[:, 0, 1] |= 0x40
    out[:, :, 2] = DATA_PID & 0xFF
    counter = (first_packet + np.arange(m * n).reshape(m, n)) & 15
    out[:, :, 3] = 0x10 | counter
    out[:, 0, 3] |= 0x20
    clock = number * TICKS
    out[:, 0, 4] = CLOCK_FIELD - 1
    out[:, 0, 5] = np.where(number % RANDOM_ACCESS_EVERY == 0, 0x50, 0x10)
    out[:, 0, 6:12] = np.stack([clock >> 25 & 0xFF, clock >> 17 & 0xFF, clock >> 9 & 0xFF, clock >> 1 & 0xFF, (clock & 1) << 7 | 0x7E, 0 * clock], 1)
    out[:, 0, HEADER + CLOCK_FIELD :] = elementary[:, :opening]
    if full:
        out[:, 1 : 1 + full, HEADER:] = elementary[:, opening : opening + full * (PACKET - HEADER)].reshape(m, full, -1)
    if tail:
        gap = PACKET - HEADER - tail
        out[:, -1, 3] |= 0x20
        out[:, -1, 4] = gap - 1
        if gap > 1:
            out[:, -1, 5] = 0
        out[:, -1, PACKET - tail :] = elementary[:, -tail:]
    return out


def write_stream(payload: bytes) -> bytes:
    """The transport stream of a payload (whole blocks)."""
    data = np.frombuffer(payload, np.uint8)
    whole = len(data) // UNIT
    parts = [OPENING]
    packets = 0
    if whole:
        block = _units_to_packets(data[: whole * UNIT].reshape(whole, UNIT), 0, 0)
        packets = block.shape[0] * block.shape[1]
        parts.append(block.tobytes())
    if len(data) > whole * UNIT:
        parts.append(_units_to_packets(data[None, whole * UNIT :], whole, packets).tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    payload: bytes
    times: np.ndarray  # of the access units, in 90 kHz ticks
    random_access: np.ndarray  # of the access units
    packets: int


def _read_section(packet: np.ndarray, table_id: int) -> bytes:
    raw = packet.tobytes()
    at = HEADER + (1 + raw[4] if raw[3] & 0x20 else 0)
    at += 1 + raw[at]
    size = int.from_bytes(raw[at + 1 : at + 3], "big") & 0xFFF
    section = raw[at : at + 3 + size]
    if section[0] != table_id or section_crc(section):
        raise ValueError("broken program table")
    return section[8:-4]


def read_stream(media: bytes) -> Stream:
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost packet alignment")
    pid = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    programs = _read_section(packets[(pid == TABLES_PID).argmax()], 0x00)
    map_pid = int.from_bytes(programs[2:4], "big") & 0x1FFF
    streams = _read_section(packets[(pid == map_pid).argmax()], 0x02)
    skip = 4 + (int.from_bytes(streams[2:4], "big") & 0xFFF)
    data_pid = int.from_bytes(streams[skip + 1 : skip + 3], "big") & 0x1FFF

    mine = packets[pid == data_pid]
    counter = mine[:, 3] & 15
    breaks = int(((counter[1:] - counter[:-1]) & 15 != 1).sum())
    if breaks:
        raise ValueError(f"{breaks} packets are missing or out of order")
    adapted = mine[:, 3] & 0x20 != 0
    begin = HEADER + np.where(adapted, 1 + mine[:, 4].astype(np.int64), 0)
    filled = np.arange(PACKET) >= begin[:, None]
    elementary = mine[filled]
    opens = mine[:, 1] & 0x40 != 0
    random_access = (adapted & (mine[:, 5] & 0x40 != 0))[opens]
    reach = np.concatenate([[0], np.cumsum(PACKET - begin)])
    start = reach[:-1][opens]
    stop = np.append(start[1:], reach[-1])
    head = elementary[start[:, None] + np.arange(TIMED_HEADER)].astype(np.int64)
    if (head[:, :3] != [0, 0, 1]).any():
        raise ValueError("lost elementary packet start")
    times = (head[:, 9] & 0x0E) << 29 | head[:, 10] << 22 | (head[:, 11] & 0xFE) << 14 | head[:, 12] << 7 | head[:, 13] >> 1
    declared = (head[:, 4] << 8 | head[:, 5]) + 6
    if (declared != stop - start).any():
        raise ValueError("an elementary packet is incomplete")
    body = start + 9 + head[:, 8]
    payload = b"".join([elementary[a:b].tobytes() for a, b in zip(body.tolist(), stop.tolist(), strict=True)])
    return Stream(payload, times, random_access, len(packets))


# --------------------------------------------------------------------------- operators


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: the padded UTF-8 bytes of each text as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            raw = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array([write_stream(pad(b)) for b in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """Digests and features of stored media: the payload as read back, the times of its units and of those that are
    random-access points (in 90 kHz ticks). A stream with a packet missing or out of order is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            cols: list[list] = [[] for _ in range(8)]
            for media in batch.column(2).to_pylist():
                s = read_stream(media)
                points = s.times[s.random_access]
                feature = f"packets={s.packets};units={len(s.times)};last_time={int(s.times[-1])};access_points={len(points)};last_access={int(points[-1])}"
                for c, v in zip(cols, (len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, s.times, points), strict=True):
                    c.append(v)
            ticks = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), ticks, ticks]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "unit_times", "access_times"])

    return stored.mapInArrow(run, f"doc_id {dict(stored.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, unit_times array<long>, access_times array<long>")


def media_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media in the shared folder, read the stored bytes back and describe them."""
    return media_features(written(store_media(docs, id_col, text_col), "media"))
