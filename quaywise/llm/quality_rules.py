"""Quality rules: a table of thresholds compiled into one projection.

A rule names a measure, a lower and an upper bound; a document passes when every measure lies within its bounds (both
included). :func:`compiled` turns the table into one Boolean column, and everything a rule can ask for is computed in
the same pass over the text: no shuffle, no user function, no second read.

The base counts are exact. Words that stand in repeated windows are found in two steps: where the hashes of a text's
windows all differ, the windows do, and nothing more is done; else the windows themselves are sorted with their places,
equal neighbours are the repeated ones, and the words they cover are counted from place to place. So a text costs its
length (times its logarithm where windows repeat), however long it is.

Null texts count as empty: no words, all counts zero, ``base_failed``. Texts are read whole. Repeated rows repeat, null
ids stay null, further columns of the input are not looked at, an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaywise.llm.common import text_or_empty

#: What parts words: a space and the characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Characters that do not make a word of letters: digits and ASCII punctuation.
NO_LETTERS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: The commonest words of English, German, French and Spanish; they count in lower case or with a capital first letter.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from an or not have which "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es "
    "de la le et les en un du une que pour est dans qui par au sur pas avec il "
    "el y los se las del por con no su para al lo como más"
).split()


def written_forms(words: list[str]) -> list[str]:
    return sorted({*words, *(w.capitalize() for w in words)})


class Rule(NamedTuple):
    """``measure`` has to lie between ``least`` and ``most``; None leaves a side open."""

    measure: str
    least: float | None
    most: float | None


#: The registered thresholds.
RULES = [
    Rule("mean_word_chars", 2.5, 10.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("bare_word_share", None, 0.3),
    Rule("stop_word_share", 0.02, None),
    Rule("dup_line_share", None, 0.4),
    Rule("words_per_line", 2.0, None),
]


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def filled_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: without(line, SPACES) != "")


def repeated_window_words(words: Column) -> Column:
    """How many words of an array column stand in windows of three that are found twice or more."""
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def placed(i: Column) -> Column:
        return F.struct(F.concat(words[i], F.lit(" "), words[i + 1], F.lit(" "), words[i + 2]).alias("g"), i.alias("i"))

    def covered(ordered: Column) -> Column:
        same = lambda x, other: F.coalesce(x["g"] == other["g"], F.lit(False))
        twice = F.filter(ordered, lambda x, k: same(x, F.get(ordered, k - 1)) | same(x, F.get(ordered, k + 1)))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total"))
        return F.aggregate(places, first, step, lambda acc: acc["total"])

    # one-element arrays bind a value once, where a column would be computed again at each use
    exact = F.transform(F.array(F.array_sort(F.transform(starts, placed))), covered)[0]
    repeats = F.exists(F.array(hashes), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((F.size(words) > 3) & repeats, exact).otherwise(F.lit(0)).cast("long")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measure(name: str) -> Column:
    """A measure that rules can name, from the counts of :func:`counted`."""
    n = F.col("n_words")
    known = {
        "n_words": n.cast("double"),
        "mean_word_chars": share(F.col("word_chars"), n),
        "symbols_per_word": share(F.col("n_symbols"), n),
        "bare_word_share": share(n - F.col("n_lettered"), n),
        "stop_word_share": share(F.col("n_stop_words"), n),
        "dup_line_share": share(F.col("n_dup_lines"), F.col("n_lines")),
        "words_per_line": share(n, F.col("n_lines")),
        "repeat_word_share": share(F.col("n_repeat_words"), n),
    }
    if name not in known:
        raise ValueError(f"no measure {name}; there are {', '.join(known)}")
    return known[name]


def passes(rule: Rule) -> Column:
    value = measure(rule.measure)
    low = F.lit(True) if rule.least is None else value >= rule.least
    return low if rule.most is None else low & (value <= rule.most)


def compiled(rules: list[Rule]) -> Column:
    """True where every rule of the table holds."""
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & passes(rule)
    return verdict


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """``doc_id`` and the counts of each text."""
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("_text"))
    parted = texts.select("doc_id", "_text", words_of(F.col("_text")).alias("_words"), filled_lines(F.col("_text")).alias("_lines"))
    words, lines = F.col("_words"), F.col("_lines")
    stop = F.filter(words, lambda w: w.isin(*written_forms(stop_words)))
    lettered = words_of(without(F.col("_text"), NO_LETTERS))
    return parted.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.length(without(F.col("_text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_window_words(words).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(stop).cast("long").alias("n_stop_words"),
        F.size(lettered).cast("long").alias("n_lettered"),
    )


def judge(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``kept`` and the names of the rules it breaks."""
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < 50) | (100 * repeated > 50 * n)
    broken = F.array_compact(F.array(*(F.when(~passes(r), F.lit(r.measure)) for r in rules))) if rules else F.array().cast("array<string>")
    return counted(docs, id_col, text_col).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & compiled(rules)).alias("kept"),
        F.array_join(broken, ",").alias("broken_rules"),
    )
