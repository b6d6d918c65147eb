"""Corpus operators against brute force and round trips, on small tables with every awkward case."""

import base64
import collections
import gzip
import hashlib
import html
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quaywise.llm import boosting, license_scan, main_text, packing, piece_codec, quality, simhash, substring_dedup, transport_stream, vector_graph, warc

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
# names that the operators use inside, as extra columns of the input
CLASH = {"fp": 1, "d": "x", "t": 2.5, "length": 7, "_words": "w", "starts": 3, "x": None, "held_out": True, "ids": "i", "row": 1, "score": 0.5, "key": "k", "carry": 1}


def documents(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, schema)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items() if k not in df.columns})


@pytest.fixture(scope="module")
def awkward():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé你") for _ in range(r.randint(1, 6)))
    base = [word() for _ in range(400)]
    passage = " ".join(word() for _ in range(45))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (None, " ".join(base[:60])), (7, " ".join(base))]
    rows += [(8, " ".join(base)), (8, " ".join(base)), (9, " ".join([*base[:200], "changed", *base[201:]]))]
    rows += [(n, f"{' '.join(word() for _ in range(r.randint(0, 50)))} {passage}\n{' '.join(word() for _ in range(10))}") for n in range(10, 26)]
    rows += [(30, "loop word " * 60), (31, "MIT License! Apache\tLicense general  public license"), (32, "x" * 70_000), (33, " ".join(word() for _ in range(9000)))]
    rows += [(34, "naïve \x1c\x85 ﻿　 emoji \U0001f600 <s> </s> <|endoftext|> ▁▁ mark"), (35, passage)]
    return rows


def test_piece_codec_matches_library(spark, awkward):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df = documents(spark, awkward)
    got = sorted(piece_codec.piece_digests(df, PIECES).collect(), key=repr)
    want = []
    for i, t in awkward:
        ids = sp.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted((r[:4] for r in map(tuple, got)), key=repr) == sorted(want, key=repr)
    assert piece_codec.piece_digests(df.limit(0), PIECES).count() == 0


def test_piece_spans_cover_the_source(spark, awkward):
    rows = piece_codec.encode_pieces(documents(spark, awkward), PIECES)
    back = {(r["doc_id"], r["text"]) for r in piece_codec.decode_pieces(rows, PIECES).collect()}
    texts = {(i, t or "") for i, t in awkward}
    assert {x for x in texts if "▁" not in x[1]} <= back
    codec = piece_codec.codec(PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for _, t in awkward:
        e = codec.encode(t or "")
        raw = (t or "").encode()
        a, b = codec.spans(e)
        assert len(a) == len(e.ids) and (not len(a) or (a[0] == 0 and b[-1] == len(raw)))
        if "▁" not in (t or ""):
            for k, i in enumerate(e.ids[:200]):
                if not sp.is_byte(i) and k:
                    assert raw[a[k] : b[k]].decode() == sp.id_to_piece(i).replace("▁", " ")


@pytest.mark.parametrize("at_once", [3, 4096])
def test_pieces_merge_as_in_the_library(awkward, at_once, monkeypatch):
    """Units side by side, one by one, from memory, and long ones that are cut or merged by the heap."""
    monkeypatch.setattr(piece_codec, "MERGED_AT_ONCE", at_once)
    monkeypatch.setattr(piece_codec, "CACHE_UNITS", 200)
    r = random.Random(1)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t or "" for _, t in awkward] + ["".join(r.choices(x, k=r.randint(1, 300))) for x in ("abcdefg", "ab ", "你好世界 ", "éü€ߘ😀 ", "▁ x", "the and ing") for _ in range(20)]
    codec = piece_codec.PieceCodec(PIECES)
    for _ in range(2):
        for at in range(0, len(texts), 7):
            for t, e in zip(texts[at : at + 7], codec.encode_all(texts[at : at + 7]), strict=True):
                assert e.ids == sp.encode(t) and e.sizes.sum() == len(e.normal.text.encode())
    for t in texts:
        for unit in codec.units(piece_codec.normalise(codec.model, codec.rules, t).text):
            assert codec.merge(unit[:2000]) == codec._merge_long(unit[:2000])


def test_character_map_longest_prefix():
    """A hand-made trie with the rules a -> A and ab -> xy."""
    units = [0] * 1024
    offset = 256
    units[0] = offset << 10
    at_a = offset ^ ord("a")
    units[at_a] = (512 ^ at_a) << 10 | 0x100 | ord("a")
    node_a = at_a ^ (512 ^ at_a)
    units[node_a] = 1 | 1 << 31
    at_b = node_a ^ ord("b")
    units[at_b] = (768 ^ at_b) << 10 | 0x100 | ord("b")
    units[768] = 3 | 1 << 31
    blob = (len(units) * 4).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + b"\0A\0xy\0"
    rules = piece_codec.CharacterMap(blob)
    assert rules.longest(b"abc", 0) == (2, b"xy") and rules.longest(b"ac", 0) == (1, b"A") and rules.longest(b"ba", 0) is None
    model = piece_codec.PieceModel([], [], [], blob, True, True, True, "")
    n = piece_codec.normalise(model, rules, "  ab  a ")
    assert n.text == "▁xy▁A"
    assert n.source.tolist() == [2, 2, 2, 2, 2, 4, 4, 4, 6, 7]


def test_token_ids_match_tokenizers(awkward):
    slow = Tokenizer.from_file(BPE)
    ids = packing.TokenIds(BPE)
    for _, t in awkward:
        assert np.frombuffer(ids.encode(t or ""), "<u4").tolist() == slow.encode(t or "", add_special_tokens=False).ids


def test_packing(spark, awkward):
    slow = Tokenizer.from_file(BPE)
    df = documents(spark, awkward)
    rows = packing.pack_documents(df, BPE, capacity=128).collect()
    want = collections.Counter()
    for i, t in awkward:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) - (-(-len(ids) // 128) - 1) * 128
        edges = [0, *range(first, len(ids) + 1, 128)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 128) + 2
    assert packing.pack_documents(df.limit(0), BPE).count() == 0


def best_fit(counts, capacity):
    """Sequences that plain best fit needs: the longest piece that fits, until none does."""
    left, n = counts.copy(), 0
    while left.any():
        room = capacity
        while len(fit := np.flatnonzero(left[: room + 1])):
            left[fit[-1]] -= 1
            room -= int(fit[-1])
        n += 1
    return n


def fewest(pieces, capacity):
    """Fewest sequences, by trying every set of pieces with the largest one."""
    if not pieces:
        return 0
    first, rest = pieces[0], pieces[1:]
    best = len(pieces)
    for chosen in range(1 << len(rest)):
        held = [p for k, p in enumerate(rest) if chosen >> k & 1]
        if first + sum(held) <= capacity:
            best = min(best, 1 + fewest(tuple(p for k, p in enumerate(rest) if not chosen >> k & 1), capacity))
            if best * capacity < sum(pieces) + capacity:
                break
    return best


def sequences(counts, capacity):
    plan = packing.packing_plan(counts, capacity)
    got = np.zeros_like(counts)
    for config, times in plan:
        assert sum(n * k for n, k in config.items()) <= capacity and times > 0
        for n, k in config.items():
            got[n] += k * times
    assert (got == counts).all()
    return sum(t for _, t in plan)


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_is_whole_and_tight(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(65, np.int64)
    for n in r.integers(1, 65, size=int(r.integers(1, 3000))):
        counts[n] += 1
    counts[int(r.integers(1, 65))] += 1000 * (seed % 2)
    over_half = counts[33:].sum()
    assert sequences(counts, 64) <= max(-(-int((np.arange(65) * counts).sum()) // 64), over_half) * 1.06 + 2


def test_packing_program_beats_best_fit():
    counts = np.zeros(101, np.int64)
    counts[[51, 27, 26, 23]] = 60, 60, 60, 120
    solved = packing.solve_configurations(counts, 100)
    assert solved.value == pytest.approx(90) and solved.bound == pytest.approx(90)
    assert sequences(counts, 100) == 90 and best_fit(counts, 100) == 110
    for seed in range(4):  # the program comes within a hundredth of its own lower bound, and so does the plan
        counts = np.bincount(np.random.default_rng(seed).integers(20, 60, 2000), minlength=101)
        solved = packing.solve_configurations(counts, 100)
        assert solved.bound <= solved.value <= 1.01 * solved.bound
        assert sequences(counts, 100) <= 1.01 * solved.bound < best_fit(counts, 100)


def test_packing_of_few_pieces_is_as_small_as_can_be():
    r, gap = random.Random(6), 0
    for _ in range(60):
        pieces = tuple(sorted((r.randint(3, 30) for _ in range(r.randint(1, 9))), reverse=True))
        n, least = sequences(np.bincount(pieces, minlength=41), 40), fewest(pieces, 40)
        assert least <= n <= least + 1
        gap += n - least
    assert gap <= 3


@pytest.mark.parametrize("seed", range(20))
def test_pricing_step_finds_the_most_valuable_configuration(seed):
    r = np.random.default_rng(seed)
    lengths = np.sort(r.choice(np.arange(1, 21), size=4, replace=False))
    value, most = r.random(4), r.integers(1, 4, 4)
    got = packing.best_configuration(lengths, value, most, 20)
    every = [c for c in np.ndindex(*(most + 1)) if np.dot(c, lengths) <= 20]
    assert (got <= most).all() and got @ lengths <= 20
    assert got @ value == pytest.approx(max(np.dot(c, value) for c in every))


def brute_repeats(rows, window):
    seen = collections.defaultdict(list)
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    key = lambda i: -(1 << 63) if i is None else i
    for n, (i, w) in enumerate(docs):
        for k in range(len(w) - window + 1):
            seen[tuple(w[k : k + window])].append((key(i), n, k))
    out = []
    for n, (i, w) in enumerate(docs):
        gone = set()
        for k in range(len(w) - window + 1):
            if any(d < key(i) or (m == n and s < k) for d, m, s in seen[tuple(w[k : k + window])]):
                gone.update(range(k, k + window))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(spark, awkward):
    df = documents(spark, awkward)
    got = substring_dedup.remove_repeats(df, window=20)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == brute_repeats(awkward, 20)
    for r in got.collect():
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]
    cut = substring_dedup.without_repeats(df, window=20)
    assert cut.columns == df.columns and cut.count() == df.count()
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_substring_dedup_random(spark):
    r = random.Random(3)
    rows = [(n, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for n in range(40)]
    got = substring_dedup.remove_repeats(documents(spark, rows), window=6, anchor=3, with_text=False)
    assert sorted(map(tuple, got.drop("spans").collect()), key=repr) == brute_repeats(rows, 6)


@pytest.mark.parametrize("hot", [False, True])
def test_blocks_are_judged_across_batches(spark, hot, monkeypatch):
    """Groups that span many Arrow batches, with every anchor or none salted."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(12)]
    piece = [r.choice(words) for _ in range(30)]
    rows = [(n, " ".join([*(r.choice(words) for _ in range(r.randint(0, 9))), *piece[r.randint(0, 6) :], *(r.choice(words) for _ in range(r.randint(0, 9)))])) for n in range(60)]
    if hot:
        monkeypatch.setattr(substring_dedup, "common_anchors", lambda keyed, w, a: np.sort(np.array([x["g"] for x in substring_dedup.anchor_rows(keyed, w, a, np.zeros(0, np.int64)).select("g").distinct().collect()], np.int64)))
    else:
        monkeypatch.setattr(substring_dedup, "common_anchors", lambda keyed, w, a: np.zeros(0, np.int64))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = substring_dedup.remove_repeats(documents(spark, rows), window=8, anchor=3, with_text=False).drop("spans").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows, 8)


def test_kept_anchor_depends_on_the_window_alone():
    h = np.random.default_rng(1).integers(0, 5, 300).astype(np.uint64)
    kept = substring_dedup.kept_anchors(h, 7)
    for s, k in enumerate(kept):
        part = h[s : s + 7].tolist()
        assert k - s == max(i for i, v in enumerate(part) if v == min(part))


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_covering_masks_cover():
    masks = simhash.covering_masks(2)
    for i in range(64):
        for j in range(i, 64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_near_duplicates(spark, awkward):
    df = documents(spark, awkward)
    got = simhash.near_duplicates(df).collect()
    fps = {i: brute_fingerprint(t) for i, t in awkward}
    root = components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    first = collections.defaultdict(list)
    for i, _ in awkward:
        if i is not None:
            first[root[fps[i]]].append(i)
    want = [(i, f"{brute_fingerprint(t):016x}", min(first[root[brute_fingerprint(t)]], default=None)) for i, t in awkward]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_of_dense_clusters(spark):
    r = random.Random(2)
    values = set()
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(25):
            values.add(x)
            for _ in range(r.randint(1, 3)):
                x ^= 1 << r.randrange(64)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"))
    found = {r["u"]: r["root"] for r in simhash.star_components(links).collect()}
    group = lambda v: found.get(v, v)
    nodes = [v for (v,) in signed]
    want = components(nodes, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    for a in nodes:
        for b in nodes:
            assert (group(a) == group(b)) == (want[a] == want[b])


def pages_table(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


def test_warc_round_trip(spark):
    body = "<p>one\r\n\r\nWARC/1.1 é</p>"
    rows = [(1, "http://a.example/x?b=1&a=2", body), (2, "https://www.b.example:443/", body), (3, None, None), (4, "not a url", ""), (None, "http://c.example/", body), (5, "http://a.example/x\r\ny", "only"), (-7, "http://z.example/", "neg"), (9, "http://[bad", "q" * 50_000), (2, "https://www.b.example:443/", body), (None, "http://d.example/", "lonely")]
    df = pages_table(spark, rows)
    got = warc.archive_round_trip(df).collect()
    groups = collections.defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        owner = max((x for x in groups[h or ""] if x is not None), default=None)
        revisit = owner is not None and i != owner
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", owner if revisit else None))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    ordered = [(r["url_key"], r["capture_time"]) for r in sorted(got, key=lambda r: (r["range_no"], r["range_place"]))]
    assert ordered == sorted(ordered)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_records_are_found_by_the_index(spark, monkeypatch):
    """Archives cut by bytes, records over several members, several levels of merging, and every record by its range."""
    from quaywise.llm.common import written

    monkeypatch.setattr(warc, "MEMBER_BYTES", 3000)
    monkeypatch.setattr(warc, "FAN_IN", 2)
    r = random.Random(3)
    rows = [(n, f"http://h{n % 7}.example/{n % 5}", "".join(r.choices("abc <>", k=r.choice([0, 10, 2000, 20_000])))) for n in range(120)] + [(None, "http://h1.example/1", "x")] * 40
    df = pages_table(spark, rows).repartition(3)
    path = warc.scratch_path(spark, "test")
    # members are made in the workers, which know the module's constants only
    warc.write_archives(warc.warc_records(df), path, archive_bytes=30_000)
    runs = written(warc.capture_runs(spark.read.format("binaryFile").load(path)), "runs")
    assert runs.select("task", "file").distinct().count() > 4
    found = sorted(warc.merge_runs(runs, range_rows=50).collect(), key=lambda x: (x["range_no"], x["range_place"]))
    assert len(found) == len(rows) and len({x["range_no"] for x in found}) > 1
    key = lambda x: (x["url_key"], x["capture_time"], x["page_id"] is not None, x["page_id"] or 0, x["archive"], x["offset"])
    assert found == sorted(found, key=key)
    content = {x["path"].rpartition("/")[2]: x["content"] for x in spark.read.format("binaryFile").load(path).collect()}
    assert all(gzip.decompress(c).count(b"WARC/1.1\r\n") for c in content.values())
    for x in found:
        fields, block = warc.read_record(bytes(content[x["archive"]][x["offset"] : x["offset"] + x["length"]]))
        assert warc.page_of_uuid(fields["warc-record-id"]) == x["page_id"] and fields["warc-type"] == x["record_type"]
        assert x["record_type"] == "revisit" or len(block.partition(b"\r\n\r\n")[2]) == x["payload_bytes"]
    assert warc.read_record(b"".join(warc.gzip_members(b"WARC/1.1\r\nContent-Length: 9000\r\n\r\n" + b"y" * 9000 + b"\r\n\r\n")))[1] == b"y" * 9000
    with pytest.raises(ValueError):
        list(warc.parse_archive(memoryview(bytes(next(iter(content.values()))[:-9]))))


def test_small_payloads_are_responses(spark):
    df = pages_table(spark, [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")])
    got = {r["page_id"]: r["record_type"] for r in warc.archive_round_trip(df, revisit_from=4).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted(r.randrange(50) for _ in range(r.randrange(20))) for _ in range(k)]
    assert list(warc.LoserTree([iter(x) for x in runs], lambda v: v)) == sorted(v for x in runs for v in x)


def test_quality_classifier(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    rows, labels = [], []
    for n in range(400):
        good = n % 3 > 0
        words = [word() for _ in range(r.randint(30, 90))]
        rows.append((n, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((n, int(good), 0))
    rows += [(900, None), (901, ""), (902, "x" * 60_000), (None, "some text here"), (3, "repeated id")]
    df = documents(spark, rows)
    truth = spark.createDataFrame(labels + [(950, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(df, truth).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) for x in got)
    for x in got:
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2)
    by = {x["doc_id"]: x for x in got if x["doc_id"] is not None and x["doc_id"] < 400 and x["doc_id"] != 3}
    held = [x for x in by.values() if x["held_out"]]
    assert sum(x["predicted"] == (x["doc_id"] % 3 > 0) for x in held) >= 0.95 * len(held) > 20
    kept = quality.keep_good(df, truth)
    assert kept.columns == df.columns and kept.count() == sum(x["predicted"] for x in got)
    assert quality.quality_scores(df.limit(0), truth).count() == 0
    assert {x["score"] for x in quality.quality_scores(df, truth.limit(0)).collect()} == {0.5}


def test_held_out_labels_do_not_matter(spark):
    rows = [(n, ("good words here " if n % 2 else "BAD!! WORDS## ") * (n % 7 + 1)) for n in range(120)]
    df = documents(spark, rows)
    labels = [(n, n % 2) for n in range(120)]
    flipped = [(n, 1 - q if zlib.crc32(str(n).encode()) % 4 == 2 else q) for n, q in labels]
    scores = [{r["doc_id"]: r["score"] for r in quality.quality_scores(df, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (labels, flipped)]
    assert scores[0] == pytest.approx(scores[1])


def test_nearest_neighbours(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(700, 12)).astype(np.float32)
    v[300:420] = v[300]
    rows = [(n, x.tolist()) for n, x in enumerate(v)]
    rows += [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [1.0, None] + [0.0] * 10), (1004, [float("inf")] * 12), (1050, [1.0, 2.0]), (1051, [2.0, 1.0]), (None, [1.0] * 12), (50, v[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({k: F.lit(x) for k, x in CLASH.items()})
    got = collections.defaultdict(dict)
    for x in vector_graph.nearest_neighbours(df, per_shard=200).collect():
        got[x["query_id"]][x["rank"]] = (x["vec_id"], x["score"])
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 700, 50):
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(700), -np.round(s, 12)))[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        for vec, score in got[q].values():
            assert score == pytest.approx(s[vec], abs=1e-12)
        hits += len({x for x, _ in got[q].values()} & set(best.tolist()))
        total += 5
    assert hits >= 0.9 * total
    assert got[1050] == {1: (1051, pytest.approx(0.8))} and set(got) == {*range(0, 700, 50), 1050}
    assert [x for x, _ in got[300].values()] == [301, 302, 303, 304, 305]
    assert vector_graph.nearest_neighbours(df.limit(0)).count() == 0


def test_graph_of_a_full_shard():
    """Recall on random vectors of 64 dimensions, which have no structure to help, and how much of a shard is scored."""
    r = np.random.default_rng(5)
    v = r.normal(size=(12_000, 64)).astype(np.float32)
    graph = vector_graph.build_graph(v)
    assert graph.layers[0].shape == (12_000, 2 * vector_graph.LINKS) and len(graph.layers[1]) < 1500
    back = vector_graph.Graph.from_bytes(graph.unit, graph.to_bytes())
    asked = graph.unit[::40]
    found, scored = vector_graph.search_graph(back, asked, 6)
    want = np.argsort(-(asked @ graph.unit.T), axis=1)[:, :6]
    recall = np.mean([len(set(f) & set(w)) / 6 for f, w in zip(found[:, :6].tolist(), want.tolist(), strict=True)])
    assert recall >= 0.95 and scored < 0.4 * len(v) * len(asked)
    # at the registered shard size (measured, see the readme) the share is under a sixth


def test_queries_of_many_blocks_meet_one_copy_of_a_shard(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vector_graph, "BLOCKS_TOGETHER", 2)
    v = np.random.default_rng(8).normal(size=(300, 8))
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for x in vector_graph.nearest_neighbours(df, every=3, per_shard=80).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"]))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    assert sorted(got) == list(range(0, 300, 3))
    hits = sum(len({x for _, x in got[q]} & set(np.argsort(-s[q])[:5].tolist())) for q in got)
    assert hits >= 0.98 * 5 * len(got)


def test_media_round_trip(spark, awkward):
    df = documents(spark, awkward)
    got = transport_stream.media_round_trip(df).collect()
    want = []
    for i, t in awkward:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert r["unit_times"] == [3600 * n for n in range(len(r["unit_times"]))] and r["access_times"] == r["unit_times"][::4]
    assert transport_stream.media_round_trip(df.limit(0)).count() == 0


def test_broken_streams_are_noticed():
    media = bytearray(transport_stream.write_stream(transport_stream.pad(b"x" * 20_000)))
    assert transport_stream.read_stream(bytes(media)).random_access.tolist() == [True, False, False, False, True]
    lost = bytes(media[: 5 * 188] + media[6 * 188 :])
    with pytest.raises(ValueError, match="missing or out of order"):
        transport_stream.read_stream(lost)
    media[2 * 188 + 200] = 0
    with pytest.raises(ValueError):
        transport_stream.read_stream(bytes(media[1:]))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def best_blocks(words, templates, threshold):
    """Label and containment of the templates that some block of as many words matches, block by block."""
    found = {}
    for label, text in templates:
        t = text.split()
        best = max((len(set(words[k : k + len(t)]) & set(t)) / len(set(t)) for k in range(len(words))), default=0)
        if best >= threshold:
            found[label] = max(best, found.get(label, 0))
    return found


def test_license_scan(spark, awkward):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software"
    rows = [*awkward, (40, f"intro\n{notice} without\nLicensed under CC BY-NC 4.0."), (41, "mit license mit license\nmit\nlicense"), (42, "ſMIT LICENSEé mit-license"), (43, "general public public license")]
    # characters above ASCII are word characters, those that other tools take for line ends too
    rows += [(50, "a\u2028b mit license x mit license end"), (51, "q\u0085 mit license"), (52, "see mit license\u2028"), (53, "mit license\u0085"), (54, "\u2029 apache license \u2029 mit license\u2029 mit license")]
    rows += [(55, "😀😀 😀 mit license 😀😀😀 a b general public license 😀 c"), (56, "mit license\n"), (57, "licensed under cc " + "x " * 30 + "by nc 4 0"), (58, "by nc licensed 4 0 under cc " * 3)]
    got = {(r["doc_id"], r["n_words"]): r for r in license_scan.scan_licenses(documents(spark, rows)).collect()}
    assert license_scan.scan_licenses(documents(spark, rows)).count() == len(rows)
    for i, t in rows:
        w = WORD.findall(lower(t))
        at = sorted((k, label) for phrase, label in license_scan.PHRASES.items() for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p)
        more = best_blocks(w, license_scan.TEMPLATES, license_scan.THRESHOLD)
        r = got[i, len(w)]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and r["labels"] == ",".join(sorted({x for _, x in at} | set(more)))
        assert r["score"] == pytest.approx(1.0 if at else max(more.values(), default=0.0))
    assert license_scan.scan_licenses(documents(spark, rows).limit(0)).count() == 0


def test_license_templates_from_a_table(spark):
    r = random.Random(9)
    word = lambda: r.choice("abcdefghij")
    templates = [(f"l{k}", " ".join(word() for _ in range(r.randint(1, 9)))) for k in range(12)]
    table = spark.createDataFrame([*templates, ("none", None), ("blank", " . "), (None, "a b")], "label string, text string")
    rows = [(n, " ".join(word() for _ in range(r.randint(0, 40)))) for n in range(80)]
    got = license_scan.scan_licenses(documents(spark, rows), table, threshold=0.7).collect()
    want = {n: best_blocks(t.split(), templates, 0.7) for n, t in rows}
    assert {x["doc_id"]: (x["labels"], round(x["score"], 9)) for x in got} == {n: (",".join(sorted(w)), round(max(w.values(), default=0.0), 9)) for n, w in want.items()}
    many = table.crossJoin(spark.range(license_scan.MOST_TEMPLATES)).select("label", "text")
    with pytest.raises(ValueError):
        license_scan.scan_licenses(documents(spark, rows), many)


def test_wrapped_license_notices(spark):
    import textwrap

    rows = [(n, "\n".join(["code();", *textwrap.wrap(text, 70, initial_indent=" * ", subsequent_indent=" * "), "more();"])) for n, (_, text) in enumerate(license_scan.TEMPLATES)]
    wrapped = [(100 + n, "\n".join(textwrap.wrap(text, 30))) for n, (_, text) in enumerate(license_scan.TEMPLATES)]
    apart = [(200, "redistribution and use in source and binary forms with or without\n" + "other words here\n" * 20 + "modification are permitted provided that the following conditions are met")]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(documents(spark, rows + wrapped + apart)).collect()}
    for n, (label, _) in enumerate(license_scan.TEMPLATES):
        for row in (got[n], got[100 + n]):
            assert label in row["labels"].split(",") and row["score"] == 1.0
    assert got[200]["labels"] == "" and got[200]["score"] == 0.0


def test_main_text(spark):
    article = "<article><h1>A &amp; B</h1><p>First <b>bold</b>\n text, with commas, and more words to read here.</p><p>Second paragraph of the story; it goes on for a while.<p>Third &copy; x"
    page = f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>More</a></li></ul></nav><!-- note --><div class='ad'>Buy now</div>{article}</article><div class=comments><p>Nice!</p></div><footer>All rights reserved</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<nav><a href=/>Home</a></nav>"), (None, "u", page), (5, "u", "<p>" * 3000 + "<" + "\"'" * 500), (1, "u", page)]
    df = pages_table(spark, rows)
    got = main_text.extract_main_text(df).collect()
    text = "A & B First bold text, with commas, and more words to read here. Second paragraph of the story; it goes on for a while. Third © x"
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (1, None)] == [text] * 3
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] in (2, 3, 4)} == {2: "", 3: "", 4: ""}
    assert main_text.extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a ">"', "<!", "<!a ", "<p", "</p", "<", "<a b='>'\"", "<script", "<b>", "<div>x</b>", "<i> </i> ", "<td><div>", "&#9", "<![CDATA[", "<!--", "</x>"])
def test_broken_markup_takes_time_in_proportion(piece):
    """A megabyte of it is read in seconds, where a scan to the end at every piece would take many minutes."""
    import time

    began = time.time()
    for tail in ("", ">", "<p>end</p>"):
        page = main_text.parse("<p>start</p>" + piece * (350_000 // len(piece)) + tail)
        assert page.texts[0] == "start"
    assert time.time() - began < 20


def test_markup_with_quotes():
    texts = lambda source: [t.strip() for t in main_text.parse(source).texts]
    assert texts("<p title='a>b'>one</p><p title=\"x>y\" >two</p>") == ["one", "two"]
    assert texts("<p title='a>one</p><p>two</p>") == ["one", "two"]  # the quote never closes
    assert texts("a < b <p>c<d") == ["a < b", "c<d"]
    assert texts("<p>x<!-- > -->y<![CDATA[z]]><?q?></p><SCRIPT>var a = '</p>';</ScRipt >w") == ["x", "y", "w"]
    assert texts("<p>x<script>never closed") == ["x"] and texts("<p>x<!-- never") == ["x"]
    assert main_text.block_text(main_text.parse("<p>&#" + "9" * 6000 + ";&#000000000000065;</p>"), [True] * 3) == "\ufffdA"


def test_main_text_on_unseen_layouts():
    model = main_text.node_model()
    wrong = 0
    for source in main_text.training_pages(60, seed=123):
        page = main_text.parse(source)
        kept = main_text.decode(page.parent, model.logit(main_text.features(page)))
        for i in range(1, len(kept)):
            assert not kept[i] or kept[page.parent[i]]
        wrong += main_text.block_text(page, kept) != main_text.block_text(page, main_text.labelled(page).tolist())
    assert wrong <= 6


def test_main_text_of_the_table(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet").collect()
    model = main_text.node_model()
    got = main_text.main_text([r["html"] or "" for r in rows], model)
    for r, text in zip(rows, got):
        inner = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        blocks = [re.sub(r"</?b>", "", x) for x in re.split(r"<(?!/?b>)[^>]*>", inner)]
        assert text == " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_boosting_learns():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosting.fit_trees(x, y, trees=30, depth=3)
    assert ((model.logit(x) > 0) == (y > 0)).mean() > 0.95


def test_license_query_matches_its_sql(spark, data):
    import duckdb

    from quaywise.llm import queries

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = db.sql(queries.ORACLES["op10_license_scans"])
    got = queries.QUERIES["op10_license_scans"](spark, data)
    plain = lambda rows, columns: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[columns.index(c)] for c in sorted(columns))) for r in rows), key=repr)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)


def test_discriminant_is_the_plain_one():
    """Log densities by inverse and determinant of the shrunk covariances, from the rows themselves."""
    r = np.random.default_rng(2)
    d = 5
    x = [r.normal(size=(300, d)) @ r.normal(size=(d, d)) + k for k in (0, 1)]
    both = np.concatenate(x)
    moments = quality.Moments(np.array([len(v) for v in x], float), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]))
    model = quality.fit(moments, to_pooled=0.1, to_diagonal=0.02)
    z = [(v - both.mean(0)) / both.std(0) for v in x]
    covs = [np.cov(v.T, bias=True) for v in z]
    pooled = (covs[0] + covs[1]) / 2
    asked = np.clip((both - both.mean(0)) / both.std(0), -8, 8)
    density = []
    for v, c in zip(z, covs):
        c = 0.9 * c + 0.1 * pooled
        c = 0.98 * c + 0.02 * np.diag(np.maximum(np.diagonal(c), 1e-2)) + 1e-3 * np.eye(d)
        e = asked - v.mean(0)
        density.append(-0.5 * np.einsum("ni,ij,nj->n", e, np.linalg.inv(c), e) - 0.5 * np.log(np.linalg.det(c)))
    assert model.difference(both) == pytest.approx(density[1] - density[0], abs=1e-6)
