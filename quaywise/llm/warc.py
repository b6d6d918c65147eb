"""WARC archives: write pages as records, read them back, and merge the archives' capture indexes.

Every record is a gzip member of its own (a very long one several), members are put together to archives that are cut
by bytes, and Spark's own writer commits them to the shared folder, so a lost executor's attempt leaves nothing
behind. Of records with equal payloads, the one with the largest page id is the response and the others are revisit
records that refer to it. Reading parses each archive member by member, checks every payload digest, and leaves a run
of captures sorted by URL key and time, each with its archive, offset and length, by which :func:`read_record` finds
it again.

The runs are merged externally: a level merges at most :data:`FAN_IN` runs to a longer one by a loser tree. It is dealt
out by ranges of (merged run, URL key, time, page, place in the archives), so a task holds one range of the index,
whatever the size of a run, and no key is too common for it; levels are stored in the shared folder. The last level
leaves all captures in global order (``range_no``, then ``range_place``).

Null pages count as empty. A null page id ranks below every other: it revisits a record with an id, and where
no record of the payload has one, each is a response. Repeated page ids at the top of a group are all
responses. A null URL leaves the record without a target. Ids are read as long; pages are stored whole, however long;
further columns of the input are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaywise.llm.common import removed, scratch_path, small_batches, text_or_empty, written

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"

FIRST_CAPTURE = 1_704_067_200  # pages carry no capture time: page_id seconds after this one
ARCHIVE_BYTES = 32 << 20  # an archive ends behind the record that reaches these
MEMBER_BYTES = 8 << 20  # of a record in one gzip member; its size field then ends with a zero byte
FAN_IN = 64  # runs that one loser tree merges
RANGE_ROWS = 250_000  # captures that one task merges, about


def base32_of_hex(hexed: Column) -> Column:
    """Base32 of a hex digest whose length is a multiple of five digits, as DataFrame functions."""
    parts = []
    for at in range(1, 41, 5):
        n = F.conv(F.substring(hexed, at, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substr(F.lit(BASE32), F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*parts)


def record_uuid(page_id: Column) -> Column:
    """A record id that holds the page id; pages without one share an id of their own."""
    h = F.when(page_id.isNull(), F.lit("f" * 32)).otherwise(F.concat(F.lit("0" * 16), F.lower(F.lpad(F.hex(page_id), 16, "0"))))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def page_of_uuid(field: str) -> int | None:
    h = field.strip("<>").rpartition(":")[2].replace("-", "")
    if h == "f" * 32:
        return None
    n = int(h[16:], 16)
    return n - (1 << 64) if n >> 63 else n


def warc_records(pages: DataFrame, revisit_from: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One ``value`` per page: the record's text with the blank lines behind it.

    Which pages revisit which is settled on rows without the html; these meet the pages by a hash of page id, URL and
    digest, so that a page that very many share is not one key.
    """
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    base = base.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long")).withColumn("k", F.xxhash64("page_id", "url", "sha"))
    slim = base.select("page_id", "sha", "size", "k")
    groups = slim.where(F.col("size") >= revisit_from).groupBy("sha", "size").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = slim.join(groups, ["sha", "size"]).where(~F.col("page_id").eqNullSafe(F.col("owner"))).select("k", "sha", "size", "owner").distinct()
    joined = base.join(again, ["k", "sha", "size"], "left")
    revisit = F.col("owner").isNotNull()
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(END))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END * 2))
    moment = F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000)))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    head = F.concat(
        F.lit(VERSION + END),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_uuid(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")),
        line("WARC-Date", F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", record_uuid(F.col("owner"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
    )
    return joined.select(F.concat(head, block, F.lit(END * 2)).alias("value"))


def gzip_members(record: bytes) -> list[bytes]:
    """A record as gzip members, each with a zero byte at its end."""
    return [gzip.compress(record[at : at + MEMBER_BYTES], 6, mtime=0) for at in range(0, len(record), MEMBER_BYTES)]


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of about so many bytes, one row and so one file each; the line end that Spark's writer puts behind a
    row is the zero byte that ends its last member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["archive"])

        for batch in small_batches(batches):
            for record in batch.column(0):
                members = gzip_members(record.as_buffer().to_pybytes())
                held += members
                size += sum(map(len, members))
                if size >= archive_bytes:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    packed = records.select("value").mapInArrow(run, "archive binary").select(F.col("archive").cast("string"))
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def members_of(content: memoryview, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(begin, end, bytes inside) of each gzip member."""
    at = 0
    while at < len(content):
        member, begin, parts = zlib.decompressobj(31), at, []
        while not member.eof:
            if at >= len(content):
                raise ValueError("an archive ends inside a member")
            parts.append(member.decompress(content[at : at + step]))
            at = min(at + step, len(content))
        at -= len(member.unused_data)
        yield begin, at, b"".join(parts)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (lower-case names) and block of a record; None if more bytes belong to it."""
    if not raw.startswith(b"WARC/"):
        raise ValueError(f"no record starts here: {raw[:40]!r}")
    stop = raw.find(b"\r\n\r\n")
    if stop < 0:
        return None
    lines = (line.decode().partition(":") for line in raw[:stop].split(b"\r\n")[1:])
    fields = {name.strip().lower(): value.strip() for name, _, value in lines}
    block = raw[stop + 4 : stop + 4 + int(fields["content-length"])]
    end = stop + 4 + int(fields["content-length"])
    if len(raw) < end + 4:
        return None
    if raw[end:] != b"\r\n\r\n":
        raise ValueError("a record does not end where it should")
    return fields, block


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The record in the bytes that an index row's offset and length name."""
    found = parse_record(b"".join(inside for _, _, inside in members_of(memoryview(raw))))
    if found is None:
        raise ValueError("the bytes end inside a record")
    return found


def parse_archive(content: memoryview) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Header fields, block, offset and length of each record."""
    raw, start = b"", 0
    for begin, end, inside in members_of(content):
        raw, start = (raw + inside, start) if raw else (inside, begin)
        found = parse_record(raw)
        if found:
            yield *found, start, end - start
            raw = b""
    if raw:
        raise ValueError("an archive ends inside a record")


_WWW = re.compile(r"^www\d*\.")


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query; scheme, user, fragment and default port go."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return f"){url}"
    host = ",".join(reversed(_WWW.sub("", host).split(".")))
    shown = f":{port}" if port and port not in (80, 443) else ""
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{host}{shown}){(parts.path or '/').lower()}" + (f"?{query.lower()}" if query else "")


INDEX = "url_key string, capture_time string, page_id long, archive string, offset long, length long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
ORDER = ["url_key", "capture_time", "page_id", "archive", "offset"]
_INDEX_FIELDS = [pa.field(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in INDEX.split(", "))]
_FILE = re.compile(r"part-(\d+)-.*-c(\d+)")


def _captures(name: str, content: memoryview) -> Iterator[tuple]:
    """Index rows of an archive, its payloads checked."""
    for fields, block, offset, length in parse_archive(content):
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)^content-length: *(\d+)", head, re.M)[1])
        digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError("a payload does not match its digest")
        url, refers, own = fields.get("warc-target-uri"), fields.get("warc-refers-to"), page_of_uuid(fields["warc-record-id"])
        yield url_key(url), fields["warc-date"], own, name, offset, length, url, size, digest, kind, page_of_uuid(refers) if refers else None


def capture_runs(archives: DataFrame) -> DataFrame:
    """``task, file`` (which archive of which writing task), ``range_no, range_place`` and the index rows: a sorted run
    of captures for each archive (``binaryFile`` rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["task", "file", "range_no", "range_place", *(f.name for f in _INDEX_FIELDS)]
        for batch in batches:
            for r in range(batch.num_rows):
                name = batch.column(0)[r].as_py().rpartition("/")[2]
                task, file = map(int, _FILE.match(name).groups())
                rows = sorted(_captures(name, memoryview(batch.column(1)[r].as_buffer())), key=_capture_order)
                cols = zip(*rows, strict=True) if rows else [[]] * len(_INDEX_FIELDS)
                places = [pa.array([v] * len(rows), pa.int64()) for v in (task, file)] + [pa.array([0] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*places, *(pa.array(c, f.type) for c, f in zip(cols, _INDEX_FIELDS, strict=True))], names=names)

    return archives.select("path", "content").mapInArrow(run, f"task long, file long, range_no int, range_place long, {INDEX}")


def _capture_order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, the winner moves up."""

    def __init__(self, sources: list[Iterator], key):
        self.sources, self.key = [iter(s) for s in sources], key
        self.k = len(sources)
        self.heads = [next(s, None) for s in self.sources]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(self.k, 1)
        self.winner = self._play(1) if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.k and self.keys[self.winner] is not None:
            at = self.winner
            yield self.heads[at]
            head = next(self.sources[at], None)
            self.heads[at], self.keys[at] = head, None if head is None else self.key(head)
            node = (at + self.k) // 2
            while node:
                if self._beats(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def merge_level(runs: DataFrame, ranges: int) -> DataFrame:
    """Every :data:`FAN_IN` runs (``run, range_no, range_place`` and index rows) as one, numbered anew."""
    grouped = runs.withColumn("group", F.floor(F.col("run") / FAN_IN))
    ranged = grouped.repartitionByRange(ranges, "group", *ORDER).sortWithinPartitions("group", "run", "range_no", "range_place")
    names = ["run", "range_no", "range_place", *(f.name for f in _INDEX_FIELDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, dict[int, list[pa.RecordBatch]]] = {}  # of one range: by group and run
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    g, r = keys[start]
                    pieces.setdefault(g, {}).setdefault(r, []).append(batch.slice(start, i - start))
                    start = i
        rows = lambda parts: (r for b in parts for r in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True))
        number, place = TaskContext.get().partitionId(), 0
        for group, sources in pieces.items():
            tree = iter(LoserTree([rows(parts) for parts in sources.values()], _capture_order))
            while held := [row for _, row in zip(range(4096), tree, strict=False)]:
                places = [pa.array([group] * len(held), pa.int64()), pa.array([number] * len(held), pa.int32()), pa.array(range(place, place + len(held)), pa.int64())]
                place += len(held)
                yield pa.RecordBatch.from_arrays([*places, *(pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _INDEX_FIELDS, strict=True))], names=names)

    source = ranged.select("group", "run", *(f.name for f in _INDEX_FIELDS))
    return source.mapInArrow(run, f"run long, range_no int, range_place long, {INDEX}")


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in global order, merged level by level."""
    shape = runs.agg(F.count("*").alias("n"), F.max("task").alias("task"), F.max("file").alias("file")).first()
    tasks = (shape["task"] or 0) + 1
    ranges = max(1, -(-shape["n"] // range_rows))
    now = runs.withColumn("run", F.col("file") * tasks + F.col("task")).drop("task", "file")
    left = tasks * ((shape["file"] or 0) + 1)
    old = None
    while left > FAN_IN:
        now = written(merge_level(now, ranges), "level")
        if old is not None:
            removed(old)
        old, left = now, -(-left // FAN_IN)
    return merge_level(now, ranges).drop("run")


def archive_round_trip(pages: DataFrame, revisit_from: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives of all pages to the shared folder, read them back, and merge their indexes."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(warc_records(pages, revisit_from, id_col, url_col, html_col), path, archive_bytes)
    archives = spark.read.format("binaryFile").load(path)
    merged = merge_runs(written(capture_runs(archives), "runs"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time", "archive", "offset", "length", "range_no", "range_place")
