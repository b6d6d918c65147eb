"""Quality rules, packed products and ranked search against brute force and their SQL."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quaywise.llm import common, license_scan, packed_products, packing, presence_search, quality_rules, queries, shingle_dedup
from quaywise.llm.packed_products import Packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Names that the operators use inside, as extra columns of the input.
CLASH = {"_text": "x", "_words": 1, "_lines": 2, "n_words": 3, "kept": "k", "n": 5, "terms": "t", "tfs": 0, "item": 1, "score": 0.5, "rank": 2, "v": 1, "shard": 3, "part": 4, "r": None}


def clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items() if k not in df.columns})


@pytest.fixture(scope="module")
def awkward():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé你") for _ in range(r.randint(1, 4)))
    plain = " ".join(r.choice(["the", "of", "lamp", "house", "green", "and", "stone", "river"]) + str(i % 7) for i in range(90))
    rows = [(1, None), (2, ""), (3, " \n\t\r\x0b\x0c "), (4, "one"), (5, "one two"), (6, "a b c"), (7, "a b c a b c"), (8, "a a a a"), (9, "a b a b a b a")]
    rows += [(10, "x y\nx y\n\nx y\r\n \n#$ %&\n#$ %&"), (11, "\x1c\x85 ﻿ 　   a\x00b"), (12, plain), (12, plain), (None, plain), (13, "loop word again " * 4000)]
    rows += [(14, "w" * 70_000), (15, " ".join(word() for _ in range(20_000)))]
    rows += [(20 + n, " ".join(r.choice("ab c d e f g".split()) for _ in range(r.randint(0, 80)))) for n in range(30)]
    return rows


def counts_of(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = list(zip(w, w[1:], w[2:]))
    often = Counter(windows)
    covered = {i + k for i, g in enumerate(windows) if often[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_count_as_brute_force_does(spark, awkward):
    df = clashing(spark.createDataFrame(awkward, "doc_id long, text string"))
    got = quality_rules.judge(df).collect()
    want = [(i, *counts_of(t)) for i, t in awkward]
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not r["broken_rules"])
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_each_rule_rejects(spark):
    good = " ".join(f"the river{i} of stone{i} and" for i in range(20))
    cases = {
        "": good,
        "mean_word_chars": " ".join(["the"] + [f"{'long' * 8}{i}" for i in range(60)] + ["of", "and"] * 2),
        "symbols_per_word": good + " $ # %" * 8,
        "bare_word_share": " ".join(f"{i} the {i + 100} 7,{i}" for i in range(40)),
        "stop_word_share": " ".join(f"lamp{i} house{i}" for i in range(40)),
        "dup_line_share": good + "\n" + "\n".join(["same line", "other line"] * 4),
        "words_per_line": "\n".join(f"stone{i}" if i % 4 else "the" for i in range(80)),
    }
    df = spark.createDataFrame(list(cases.items()), "doc_id string, text string")
    for r in quality_rules.judge(df).collect():
        assert not r["base_failed"] and r["broken_rules"] == r["doc_id"] and r["kept"] == (not r["doc_id"])
    only = [quality_rules.Rule("n_words", 55, None)]
    assert {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, only).collect()} == {k: len(t.split()) >= 55 for k, t in cases.items()}
    assert all(r["kept"] for r in quality_rules.judge(df, []).collect())
    with pytest.raises(ValueError, match="no measure"):
        quality_rules.judge(df, [quality_rules.Rule("colour", 1, 2)])


def test_rules_are_one_native_projection(spark, data):
    plan = quality_rules.judge(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_rules_keep_labelled_good_documents(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    judged = quality_rules.judge(spark.read.parquet(f"{data}/documents.parquet")).where("not base_failed").join(labels, "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert n[1, True] > 0 and not n.get((1, False)) and n.get((0, True), 0) <= 0.05 * n[0, False]


# --------------------------------------------------------------------------- packed products


@pytest.mark.parametrize(("dim", "low", "high"), [(64, -256, 256), (3, -5, 9), (1, 0, 0), (7, -3_000_000, 100), (4, -(2**29), 2**29), (2, 40, 90)])
def test_packed_products_are_exact(dim, low, high):
    r = np.random.default_rng(1)
    a, c = (r.integers(low, high, (n, dim), endpoint=True).astype(float) for n in (5, 37))
    a[0], c[0], c[1] = low, low, high
    packing = Packing.of(dim, low, high)
    shifted = packing.shifted(c)
    got = packing.scores(packing.shifted(a), shifted, packing.packed(shifted))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in c] for p in a]
    assert got.tolist() == want
    assert packing.fields >= 2


def usable_rows(rows):
    whole = defaultdict(list)
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole[i].append((label, v))
    return {i: min(x) for i, x in whole.items()}


def negatives_of(rows, every=100, k=5):
    used = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in usable_rows(rows).items()}
    out = []
    for a, (label, v) in used.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m == label) for i, (m, w) in used.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:k]:
            band = [(i, -t) for t, i, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, n + 1, i, -s, t) for n, (i, t) in enumerate(band)]
    return out


@pytest.mark.parametrize("per_shard", [8192, 40])
def test_hard_negatives_match_brute_force(spark, per_shard):
    r = random.Random(2)
    vector = lambda: [float(np.float32(r.gauss(0.2, 0.6))) for _ in range(8)]
    rows = [(i, vector(), r.choice([0, 0, 0, 1, 2])) for i in range(400)]
    copy = vector()
    rows += [(i, copy, i % 3) for i in range(400, 640)]  # many equal scores
    rows += [(700, None, 1), (800, [1.0, None], 1), (900, [float("nan")] * 8, 1), (1000, [float("inf")] * 8, 2), (1100, vector(), None), (None, vector(), 1)]
    rows += [(1200, [0.5, 0.5], 1), (1300, [], 0), (1400, copy, 7), (300, vector(), 2), (301, rows[301][1], rows[301][2])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = packed_products.hard_negatives(df, per_shard=per_shard)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == sorted(negatives_of(rows))
    assert packed_products.hard_negatives(df.limit(0)).count() == 0
    assert packed_products.hard_negatives(df.where("vec_id = 1200")).count() == 0


def test_hard_negatives_with_large_components(spark):
    r = random.Random(4)
    rows = [(i, [float(r.randint(-3000, 3000)) for _ in range(3)], i % 2) for i in range(0, 300, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert packed_products.packing_of(packed_products.usable(df, "vec_id", "embedding", "label")).long
    got = packed_products.hard_negatives(df, every=50)
    assert sorted(map(tuple, got.collect())) == sorted(negatives_of(rows, every=50))


# --------------------------------------------------------------------------- ranked search


def ranks_of(docs, items, top=10):
    low = lambda t: TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words = [(i, Counter(low(t)), len(low(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in words), sum(n for *_, n in words)
    df = Counter(t for _, c, _ in words for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(low(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in words:
            m = 10 + (90 * n * n_docs // n_terms if n_terms else 0)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            scored += [(-score, i is None, i or 0, i)] if score > 0 else []
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return out


@pytest.mark.parametrize("block_terms", [200_000, 12])
def test_ranked_search_matches_brute_force(spark, awkward, block_terms):
    r = random.Random(8)
    names = [f"w{k}" for k in range(90)]
    text = lambda n: " ".join(r.choice(names[: r.choice([5, 20, 90])]) for _ in range(n))
    docs = [*awkward, *((100 + n, text(r.randint(0, 60))) for n in range(300)), *((500 + n, "w1 W2, w3") for n in range(40)), (900, "naïve Ünï w1")]
    items = [(n, text(r.randint(1, 40))) for n in range(12)] + [(50, None), (51, ""), (52, " ".join(names)), (53, "absent term"), (54, "w1 w1 W2"), (None, "naïve 你"), (3, "w7 w8"), (55, "loop the")]
    left = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    right = clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = presence_search.ranked_search(left, right, block_terms=block_terms)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == sorted(ranks_of(docs, items), key=repr)


def test_ranked_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", F.lit(None).cast("string")), items)):
        got = presence_search.ranked_search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_groups_below_the_tenth_best_are_not_scored(monkeypatch):
    """The bound ends the search: most documents of a block hold only a frequent word."""
    import pyarrow as pa

    n = 2000
    terms = [[0, 1] if d < 12 else [0] for d in range(n)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array([50] * n), pa.array(terms, pa.list_(pa.int32())), pa.array([[1] * len(t) for t in terms], pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"]
    )
    figures = presence_search.Figures(n, 50 * n, np.array([1, 5000]))
    scored = []
    kept = presence_search.Block.scores
    monkeypatch.setattr(presence_search.Block, "scores", lambda self, docs, wanted: scored.append(len(docs)) or kept(self, docs, wanted))
    block = presence_search.Block(batch, figures)
    best = presence_search.improve([], block, np.array([0, 1]), np.array([True, True]), 10)
    assert [h[2] for h in best] == list(range(10))
    more = presence_search.improve(best, block, np.array([0]), np.array([True, False]), 10)
    assert more == best and sum(scored) <= n + 12


@pytest.mark.parametrize("name", ["op11_quality_rules", "op12_hard_negatives", "op13_ranked_search"])
def test_query_matches_its_sql(spark, data, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    want, got = db.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, data)
    rows = lambda found, columns: sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in found), key=repr)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


# --------------------------------------------------------------------------- earlier operators


def best_containments(words, templates):
    """Label and best share of every template, by a window that slides over the words."""
    out = {}
    for label, text in templates:
        wanted, width = set(text.split()), len(text.split())
        held, most = Counter(), 0
        for n, w in enumerate(words):
            if w in wanted:
                held[w] += 1
            if n >= width and words[n - width] in wanted:
                old = words[n - width]
                held[old] -= 1
                if not held[old]:
                    del held[old]
            most = max(most, len(held))
        if most / len(wanted) >= license_scan.THRESHOLD:
            out[label] = max(out.get(label, 0), most / len(wanted))
    return out


def test_long_texts_of_template_words(spark):
    """A hundred thousand words that all stand in templates: the scan takes time in proportion."""
    import time

    r = random.Random(6)
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()})
    long = [r.choice(vocabulary) for _ in range(100_000)]
    planted = license_scan.TEMPLATES[8][1].split()
    long[70_000 : 70_000 + len(planted)] = planted
    texts = {1: long, 2: long[:5000], 3: planted[: -len(planted) // 3]}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    license_scan.scan_licenses(df.where("doc_id = 3")).collect()  # compiled
    began = time.time()
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(df).collect()}
    took = time.time() - began
    base = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for k, words in texts.items():
        found = best_containments(words, license_scan.TEMPLATES)
        told = set(found) | {label for phrase, label in base.items() if f" {phrase} " in f" {' '.join(words)} "}
        assert got[k]["labels"] == ",".join(sorted(told))
    assert took < 30  # four minutes and more where each seed looked through the whole text


@pytest.mark.parametrize(("seed", "n"), [(1, 400), (2, 3000)])
def test_packing_is_no_worse_than_best_fit(seed, n):
    """Against plain best fit, longest first, and close to the program's own bound."""
    r = np.random.default_rng(seed)
    sizes = np.minimum(1024, np.maximum(1, r.lognormal(5.5, 1.0, n).astype(int)))
    counts = np.bincount(sizes, minlength=1025)
    plan = packing.packing_plan(counts, 1024)
    held = np.zeros(1025, np.int64)
    for config, times in plan:
        assert sum(k * m for k, m in config.items()) <= 1024
        for k, m in config.items():
            held[k] += m * times
    assert (held == counts).all()
    room: list[int] = []
    for size in sorted(sizes.tolist(), reverse=True):
        fits = [k for k, free in enumerate(room) if free >= size]
        if fits:
            room[min(fits, key=room.__getitem__)] -= size
        else:
            room.append(1024 - size)
    assert packing.sequences(plan) <= len(room)
    assert packing.sequences(plan) <= math.ceil(packing.solve_configurations(counts, 1024).bound) + 1


def test_hashed_filter_lets_every_key_through(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("a"))
    bits = common.hashed_bits(keys, "a")
    held = keys.toPandas()["a"].to_numpy()
    assert common.may_hold(bits, held).all()
    others = spark.range(10_000, 60_000).select(F.xxhash64("id").alias("a"))
    assert common.may_hold(bits, others.toPandas()["a"].to_numpy()).mean() < 0.01
    assert others.where(common.may_be_in(bits, F.col("a"))).count() < 500


def test_small_groups_are_compared_whole(spark):
    rows = [(7, s, s, 10, 0, 0) for s in range(5)] + [(8, s, s, 10, 0, 0) for s in range(40)] + [(9, 1, 1, 10, 0, 0), (9, 50, 1, 10, 0, 0), (9, 51, 51, 100, 0, 0)]
    shared = spark.createDataFrame(rows, "key long, set_id long, root long, size int, lo long, hi long")
    pairs = {(r["u"], r["v"]) for r in shingle_dedup.pairs_of_small_groups(shared, 16).collect()}
    assert pairs == {(u, v) for u in range(5) for v in range(u + 1, 5)}


def test_pairs_of_large_groups_leave_no_pair_out(spark):
    """Pairs that only share shingles of large groups, against all pairs; two of one component are not compared."""
    import random

    rng = random.Random(3)
    holds = {u: (rng.choice([20, 22, 24, 40]), set(rng.sample(range(6), rng.randint(1, 6)))) for u in range(1, 91)}
    rows = [(k, u, u // 2, size, 0, 0) for u, (size, keys) in holds.items() for k in keys] + [(99, 1, 0, 20, 0, 0), (99, 5, 2, 20, 0, 0)]
    shared = spark.createDataFrame(rows, "key long, set_id long, root long, size int, lo long, hi long")
    least = lambda m, n: -(-4 * (m + n) // 9) - -(-4 * max(m, n) // 5) + 1
    want = {(u, v) for u, (m, a) in holds.items() for v, (n, b) in holds.items() if u < v and u // 2 != v // 2 and 5 * min(m, n) >= 4 * max(m, n) and len(a & b) >= least(m, n)}
    got = [(r["u"], r["v"]) for r in shingle_dedup.pairs_of_large_groups(shared, 16).collect()]
    assert want and sorted(got) == sorted(want)


def test_sets_in_large_groups_are_joined(spark, monkeypatch):
    """With no group small enough to be compared whole and neighbours switched off, like sets still meet."""
    monkeypatch.setattr(shingle_dedup, "neighbours", lambda shared, *_: shared.selectExpr("set_id u", "set_id v").where("false"))
    monkeypatch.setattr(shingle_dedup, "pairs_of_small_groups", lambda shared: shared.selectExpr("set_id u", "set_id v").where("false"))
    whole = shingle_dedup.pairs_of_large_groups
    monkeypatch.setattr(shingle_dedup, "pairs_of_large_groups", lambda shared: whole(shared, 1))
    words = [f"w{n}" for n in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:290], *(f"x{n}" for n in range(10))])), (3, "some other text of more than five words")], "doc_id long, text string")
    monkeypatch.setattr(shingle_dedup, "fingerprint_groups", lambda rows: rows.selectExpr("set_id u", "set_id v").where("false"))
    assert sorted(r["doc_id"] for r in shingle_dedup.keep_one_of_each(docs).collect()) == [1, 3]
