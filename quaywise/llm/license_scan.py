"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, as many as the template has, wherever lines break in it. It matches a
template when it holds at least ``threshold`` of the template's distinct words. One pass over the texts counts the
phrases and keeps, for texts that hold enough words of some template at all, the places of template words. The rest
works on these places:

* template words are ordered by how often they stand there, rarest first, over the whole corpus;
* prefix: words that a block and a template share include one of the template's first ``size - need + 1``;
* length: around such a word there must be ``need`` different template words;
* position: so many must stand at or behind it in the global order, as it is taken for the first shared one;
* what passes is verified by counting the words of the blocks that hold it.

The filters only spare work, so the join is exact. Everything runs as DataFrame functions.

Null texts count as empty (no words, no labels, score 0). Texts are read whole, however long. Repeated rows repeat,
null ids stay null, an empty table gives an empty result, further columns of the input are not looked at. Templates
are a list or a table ``label, text`` of at most :data:`MOST_TEMPLATES` rows, whatever the corpus; more is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaywise.llm.common import text_or_empty, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels: fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Opening sentences of common licenses and the usual one-line notices.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
MOST_TEMPLATES = 1000
THRESHOLD = 0.8


def spaced_words(text: Column) -> Column:
    """The lower-cased words of a text, each behind one space."""
    plain = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NOT_WORD, " "))
    return F.when(plain == "", F.lit("")).otherwise(F.concat(F.lit(" "), plain))


def spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def phrase_columns(words: Column, phrases: dict[str, str] = PHRASES) -> dict[str, Column]:
    """Counts, first and last place and labels of phrases in a :func:`spaced_words` column.

    Words may hold any character above ASCII, line separators too, hence ``(?s)`` and ``\\z`` in the patterns.
    """
    start = r" (?=(?:" + "|".join(phrases) + r")(?: |\z))"
    may = F.lit(False)
    for word in sorted({p.rpartition(" ")[2] for p in phrases}):
        may = may | words.contains(" " + word)
    count = F.when(may, F.regexp_count(words, F.lit(start))).otherwise(F.lit(0)).cast("long")
    found = may & words.rlike(start)
    before_first = F.regexp_extract(words, f"(?s)^(.*?){start}", 1)
    before_last = F.regexp_extract(words, f"(?s)^(.*){start}", 1)
    ended = F.concat(words, F.lit(" "))
    labels = [F.when(may & ended.contains(f" {p} "), F.lit(label)) for p, label in phrases.items()]
    return {
        "n_words": spaces(words),
        "n_base": count,
        "first_word": F.when(found, spaces(before_first)),
        "last_word": F.when(found, spaces(before_last)),
        "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def least_words(n: int, threshold: float) -> int:
    """How many of ``n`` words reach the threshold."""
    return next(k for k in range(1, n + 1) if k / n >= threshold)


def template_list(templates: list[tuple[str, str]] | DataFrame) -> list[tuple[str, str]]:
    """Templates with lower-cased words, from a list or a table; those without a word go."""
    if isinstance(templates, DataFrame):
        rows = templates.select("label", spaced_words(text_or_empty("text")).alias("text")).limit(MOST_TEMPLATES + 1).collect()
        if len(rows) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        templates = sorted((r["label"], r["text"]) for r in rows if r["label"] is not None)
    return [(label, text) for label, text in templates if text.split()]


def _literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def word_places(words: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """``array<struct<p, w>>``: the places of template words in a :func:`spaced_words` column, null where the text
    holds too few words of every template."""
    sets = [sorted(set(text.split())) for _, text in templates]
    vocabulary = _literal(sorted({w for s in sets for w in s}))

    def placed(all_words: Column) -> Column:
        held = F.array_intersect(vocabulary, all_words)
        # the one-element array binds a value once, where a column would be computed again at each use
        enough = F.exists(F.array(held), lambda h: _any([F.size(F.array_intersect(h, _literal(s))) >= least_words(len(s), threshold) for s in sets]))
        every = F.transform(all_words, lambda w, i: F.struct(i.alias("p"), w.alias("w")))
        return F.when(enough, F.filter(every, lambda x: F.array_contains(vocabulary, x["w"])))

    return F.transform(F.array(F.split(F.ltrim(words), " ")), placed)[0]


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


STRETCH = 64  # places that are seeds of one stretch


def _stretch(c: Column, wide: int) -> Column:
    """The places of stretch ``c`` and ``wide`` more on both sides; ``first`` tells where its own begin."""
    start = F.greatest(F.lit(1), c * STRETCH + 1 - wide)
    return F.struct(F.slice("placed", start, c * STRETCH + STRETCH + wide + 1 - start).alias("places"), (c * STRETCH + 1 - start).alias("first"))


def containment_join(placed: DataFrame, key: str, templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """``key, label, containment`` of every row (``key, placed``) and template with a block that meets the threshold:
    its best block's share of the template's words."""
    # how often each template word stands in the corpus' places: one row per template word
    counted = placed.select(F.explode("placed.w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    often = {r["w"]: r["n"] for r in counted}
    order = {w: i for i, w in enumerate(sorted({w for _, text in templates for w in text.split()}, key=lambda w: (often.get(w, 0), w)))}

    prefixes = []
    for number, (label, text) in enumerate(templates):
        ranked = sorted(set(text.split()), key=order.__getitem__)
        need = least_words(len(ranked), threshold)
        for q, w in enumerate(ranked[: len(ranked) - need + 1]):
            prefixes.append((w, number, label, len(text.split()), len(ranked), need, ranked, ranked[q:]))
    schema = "w string, number int, label string, width int, size int, need int, template array<string>, behind array<string>"
    prefix = placed.sparkSession.createDataFrame(prefixes, schema)

    # stretches of places, each with as many beside it as the widest template needs: places are in order and differ, so
    # those within some words of a seed are within as many entries of it
    wide = max((p[3] for p in prefixes), default=1) - 1
    stretch = F.transform(F.sequence(F.lit(0), F.floor((F.size("placed") - 1) / STRETCH).cast("int")), lambda c: _stretch(c, wide))
    parts = placed.where(F.size("placed") > 0).select(key, F.explode(stretch).alias("x")).select(key, "x.places", "x.first")
    seeds = parts.select(key, "places", "first", F.posexplode("places").alias("i", "seed")).where((F.col("i") >= F.col("first")) & (F.col("i") < F.col("first") + STRETCH))
    met = seeds.select(key, "places", "seed.p", "seed.w").join(F.broadcast(prefix), "w")
    around = F.filter("places", lambda x: (x["p"] > F.col("p") - F.col("width")) & (x["p"] < F.col("p") + F.col("width")) & F.array_contains("template", x["w"]))
    met = met.select(key, "number", "label", "p", "width", "size", "need", "behind", around.alias("near"))
    words = F.array_distinct("near.w")
    met = met.where((F.size(words) >= F.col("need")) & (F.size(F.array_intersect(words, "behind")) >= F.col("need")))

    def words_from(start: Column) -> Column:
        inside = F.filter("near", lambda x: (x["p"] >= start["p"]) & (x["p"] < start["p"] + F.col("width")))
        return F.size(F.array_distinct(F.transform(inside, lambda x: x["w"])))

    starts = F.filter("near", lambda x: (x["p"] <= F.col("p")))
    met = met.select(key, "number", "label", "size", "need", F.array_max(F.transform(starts, words_from)).alias("overlap"))
    best = met.where(F.col("overlap") >= F.col("need")).groupBy(key, "number", "label", "size").agg(F.max("overlap").alias("overlap"))
    return best.select(key, "label", (F.col("overlap") / F.col("size")).alias("containment"))


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] | DataFrame = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: phrase counts and places, base labels, labels with the templates', and a score
    (1 where a base phrase stands, else the best containment that meets the threshold, else 0)."""
    templates = template_list(templates)
    words = docs.select(F.col(f"`{id_col}`").alias("doc_id"), spaced_words(text_or_empty(text_col)).alias("_words"))
    columns = phrase_columns(F.col("_words")) | {"placed": word_places(F.col("_words"), templates, threshold)}
    scanned = written(words.select("doc_id", F.monotonically_increasing_id().alias("_r"), *(c.alias(n) for n, c in columns.items())), "scanned")
    found = containment_join(scanned.where("placed is not null").select("_r", "placed"), "_r", templates, threshold)
    by_row = found.groupBy("_r").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    joined = scanned.drop("placed").join(by_row, "_r", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("_more", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
