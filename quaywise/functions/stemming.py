"""English stemming by measured suffix rules (Porter, 1980), applied once to each distinct term."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOWELS = "aeiou"

# Suffixes and what replaces them: fixed values of the published algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def kinds(word: str) -> str:
    """``c`` and ``v`` for each letter, in one pass: a ``y`` behind a consonant is a vowel."""
    out = ""
    for c in word:
        out += "v" if c in VOWELS or (c == "y" and out[-1:] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return kinds(stem).count("vc")


def has_vowel(stem: str) -> bool:
    return "v" in kinds(stem)


def ends_short(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last none of ``w``, ``x``, ``y``."""
    return len(word) > 2 and kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and kinds(word)[-1] == "c"


def longest(word: str, suffixes) -> str | None:
    """The longest of the suffixes that a word ends in."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def without_plural(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def without_verb_ending(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    ending = longest(word, ("ed", "ing"))
    if not ending or not has_vowel(word[: -len(ending)]):
        return word
    stem = word[: -len(ending)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if doubled(stem) and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if measure(stem) == 1 and ends_short(stem) else stem


def replaced(word: str, table: dict[str, str]) -> str:
    """The longest suffix of the table replaced, where the rest has a measure above 0."""
    suffix = longest(word, table)
    if suffix and measure(word[: -len(suffix)]) > 0:
        return word[: -len(suffix)] + table[suffix]
    return word


def without_suffix(word: str) -> str:
    suffix = longest(word, STEP_4)
    if not suffix:
        return word
    rest = word[: -len(suffix)]
    if measure(rest) <= 1 or (suffix == "ion" and not rest.endswith(("s", "t"))):
        return word
    return rest


def tidy(word: str) -> str:
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not ends_short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and any with other characters than a to z, stay."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    word = without_verb_ending(without_plural(word))
    if word.endswith("y") and has_vowel(word[:-1]):
        word = word[:-1] + "i"
    return tidy(without_suffix(replaced(replaced(word, STEP_2), STEP_3)))


def stems(terms: DataFrame, term: str = "term", out: str = "stem") -> DataFrame:
    """Distinct terms with their stems; join them to whatever holds the terms."""
    distinct = terms.select(term).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if w is None else stem(w) for w in batch.column(0).to_pylist()]
            yield batch.append_column(out, pa.array(found, pa.string()))

    return distinct.mapInArrow(run, f"`{term}` string, `{out}` string")
