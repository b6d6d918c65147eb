"""The pipeline against plain recomputation of each stage on its own input."""

import collections
import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def near_copy_roots(rows):
    """For each (id, text) the number of the first row of its group: fingerprints within two bits, or five-word
    shingle sets with a similarity of 0.8."""
    from quaywise.llm.simhash import fingerprint

    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, fps, root = [grams(r[1]) for r in rows], [fingerprint((r[1] or "").encode()) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(rows))]


def test_stages(spark, data):
    from quaywise.llm import quality
    from quaywise.llm.common import written

    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], data), name))
    original, good, single, cut, packed = seen
    for df in (good, single, cut):
        assert df.columns == docs.columns

    labels = spark.read.parquet(f"{data}/labels.parquet")
    scores = quality.quality_scores(original, labels).where("predicted = 1")
    assert {r["doc_id"] for r in scores.collect()} == {r["doc_id"] for r in good.collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert sum(truth[i] == (i in kept) for i in truth) >= 0.95 * len(truth)

    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    assert sorted(r["doc_id"] for r in single.collect()) == [rows[n][0] for n, r in enumerate(near_copy_roots(rows)) if n == r]

    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    left, windows = {}, set()
    for i in sorted(texts):
        w = (texts[i] or "").encode().split()
        gone = set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in windows:
                gone.update(range(k, k + 20))
            windows.add(x)
        left[i] = b" ".join(v for p, v in enumerate(w) if p not in gone)
    got = {r["doc_id"]: r for r in cut.collect()}
    assert set(got) == {i for i, t in left.items() if t}
    for i, r in got.items():
        assert hashlib.sha256(b" ".join(r["text"].encode().split())).digest() == hashlib.sha256(left[i]).digest()
        assert r["n_chars"] == len(r["text"])

    lengths = collections.Counter()
    for r in packed.collect():
        lengths[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in packed.collect()} == set(got) and max(lengths.values()) <= 1024


def test_near_copies_by_similarity(spark):
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(30)]
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.randint(20, 120))] + passage * (rng.random() < 0.5)
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n := n + 1, " ".join(copy), "en", "web", 1))
    rows += [(1, rows[0][1], "en", "web", 1), (2, "its own text under a repeated id", "en", "web", 1), (None, rows[5][1], "en", "web", 1), (None, "a row without id", None, "web", 1)]
    rows += [(900, "", "en", "web", 0), (901, None, "en", "web", 0), (902, " \n", "en", "web", 2), (903, "two words", "en", "web", 9), (904, "Two  words", "en", "web", 9)]
    rows += [rows[0]]

    groups = collections.defaultdict(list)
    for r, root in zip(rows, near_copy_roots(rows), strict=True):
        groups[root].append(r[0])
    want = sorted(min((x for x in g if x is not None), default=-1) for g in groups.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = corpus_pipeline.near_duplicate_filter(spark, docs, "")
    assert len(rows) - len(groups) > 20 and got.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got.collect()) == want
    assert corpus_pipeline.near_duplicate_filter(spark, docs.limit(0), "").count() == 0


def test_no_near_copy_of_the_table_stays(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    left = [r["text"] for r in corpus_pipeline.near_duplicate_filter(spark, docs, data).collect()]
    words = [(t or "").encode().lower().split() for t in left]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    assert 0 < len(left) < docs.count()
    assert not [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]


CLASH = {"_row": "a b", "_kept": True, "_a": 1, "_A_": 2, "row": 3, "text_": "t", "x": None, "score": 0.5, "root": 1, "set_id": 2, "key": 3, "path": "p"}


def test_stages_on_awkward_tables(spark, data):
    """Repeated rows, one id with two texts, nulls, line breaks and clashing names, through every filtering stage."""
    from pyspark.sql import functions as F

    passage = " ".join(f"w{n}" for n in range(30))
    p, q = " ".join(f"p{n}" for n in range(40)), " ".join(f"q{n}" for n in range(40))
    rows = [(3, p), (8, p), (8, q), (8, q), (None, None), (None, p), (20, None), (21, ""), (22, "\n"), (30, f"first line\n\n{passage}\n\nlast  line\n"), (31, f"other\trow\n{passage}\n- one\n- two"), (32, f"{passage}"), (33, f"tail\n{passage}")]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({k: F.lit(v) for k, v in CLASH.items()})

    single = corpus_pipeline.near_duplicate_filter(spark, docs, data)
    assert single.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in single.collect() if r["doc_id"] not in (30, 31, 32, 33)) == [(3, p), (8, q), (20, "")]

    cut = corpus_pipeline.passage_filter(spark, docs.where("doc_id >= 30"), data)
    assert cut.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert got == {30: f"first line\n\n{passage}\n\nlast  line\n", 31: "other\trow\n- one\n- two", 33: "tail\n"}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    left = corpus_pipeline.passage_filter(spark, docs, data).collect()
    assert collections.Counter(r["doc_id"] for r in left if r["text"] is None) == {None: 1, 20: 1}

    good = corpus_pipeline.quality_filter(spark, docs, data)
    assert good.columns == docs.columns and good.count() <= docs.count()
    assert {r["doc_id"] for r in corpus_pipeline.pack(spark, docs, data).collect()} == {i for i, _ in rows}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0


def test_prefixes_of_unnamed_sets_are_not_compared(spark, monkeypatch):
    """Only sets that a pair names reach the comparison of prefixes."""
    from quaywise.llm import shingle_dedup

    seen = []
    real = shingle_dedup.enough_shared
    monkeypatch.setattr(shingle_dedup, "enough_shared", lambda pairs, sets: seen.append(sorted(r["set_id"] for r in sets.collect())) or real(pairs, sets))
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words), (2, words + " end"), (3, "another text with enough words for a shingle or two")], "doc_id long, text string")
    texts = shingle_dedup.keyed_texts(docs, "doc_id", "text")
    rows = shingle_dedup.sketches(texts).cache()
    sets = rows.select("set_id", "a", "b", "size", "lo", "hi", "keys")
    u, v = sorted(r["set_id"] for r in rows.where("doc_id < 3").collect())
    pairs = spark.createDataFrame([(u, v)], "u long, v long")
    assert [tuple(r) for r in shingle_dedup.verified(pairs, sets, texts).collect()] == [(u, v)] and seen == [[u, v]]


def test_marks_rule_out_no_link(spark):
    """Sets around the limit: a pair that links is never ruled out, most of the others are; also for very long sets."""
    import numpy as np

    from quaywise.llm import shingle_dedup

    rng = np.random.default_rng(5)
    held, want = [], set()
    for k, size in enumerate([1, 2, 9, 60, 146, 400, 5000] * 3):
        base = rng.integers(-(2**63), 2**63 - 1, size)
        for near in range(4):
            other = base.copy()
            gone = rng.choice(size, min(size, round(size * 0.04 * near)), replace=False)
            other[gone] = rng.integers(-(2**63), 2**63 - 1, len(gone))
            held.append((10 * k + near, np.unique(other)))
    sets = spark.createDataFrame([(i, len(g), shingle_dedup.mark(g).tolist()) for i, g in held], "set_id long, size int, bits array<long>")
    by_id = dict(held)
    alike = lambda i, j: 5 * min(len(by_id[i]), len(by_id[j])) >= 4 * max(len(by_id[i]), len(by_id[j]))
    pairs = [(i, j) for i in by_id for j in by_id if i < j and alike(i, j)]
    for i, j in pairs:
        both = len(np.intersect1d(by_id[i], by_id[j]))
        if 9 * both >= 4 * (len(by_id[i]) + len(by_id[j])):
            want.add((i, j))
    got = {(r["u"], r["v"]) for r in shingle_dedup.close_pairs(spark.createDataFrame(pairs, "u long, v long"), sets).collect()}
    assert want and want <= got and len(got - want) < len(pairs) // 3


def test_pairs_of_a_large_group_are_not_listed(spark):
    """Texts that share one passage and are far apart: no pair of them goes on from their group."""
    import random

    from quaywise.llm import shingle_dedup

    rng = random.Random(11)
    passage = [f"p{n}" for n in range(60)]
    docs = [(i, " ".join([*passage, *(f"x{rng.randrange(10**9)}" for _ in range(30))])) for i in range(150)]
    docs += [(900 + i, " ".join([*passage, *(f"y{n}" for n in range(30 - i))])) for i in range(3)]
    rows = shingle_dedup.sketches(shingle_dedup.keyed_texts(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text"), sample=1000).cache()
    # every text has twelve shingles of the passage among its keys, as where the sample does not show the passage
    keys = spark.createDataFrame([(k,) for k in range(12)], "key long")
    shared = rows.selectExpr("set_id", "set_id root", "size", "lo", "hi").crossJoin(keys)
    near = {r["set_id"] for r in rows.where("doc_id >= 900").collect()}
    whole = shingle_dedup.pairs_of_large_groups(shared).count()
    got = shingle_dedup.pairs_of_large_groups(shingle_dedup.marked(shared, rows)).collect()
    assert whole > 10_000 and len(got) == 3 and {x for r in got for x in r} == near
