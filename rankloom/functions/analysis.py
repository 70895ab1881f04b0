"""Analyzers: from text to index terms. ``standard`` lower-cases words; ``english`` also drops stop words and stems."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Words of Latin letters, digits and low lines, with a stop or an apostrophe between two of them; Han characters one by one.
STANDARD_PATTERN = r"[a-z0-9_\x{00df}-\x{024f}]+(?:['.][a-z0-9_\x{00df}-\x{024f}]+)*|[\x{4e00}-\x{9fff}]"

# The stop words of the English analyzer.
ENGLISH_STOP = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


def standard_terms(text: Column) -> Column:
    """Terms in order, empty for null."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({STANDARD_PATTERN})"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def english_terms(text: Column) -> Column:
    """Standard terms without possessive endings and stop words, stemmed."""
    bare = F.transform(standard_terms(text), lambda t: F.regexp_replace(t, "'s$", ""))
    stop = F.array(*[F.lit(w) for w in ENGLISH_STOP])
    return _stems(F.filter(bare, lambda t: ~F.array_contains(stop, t) & (t != "")))


@F.pandas_udf(ArrayType(StringType()))
def _stems(lists: pd.Series) -> pd.Series:
    return pd.Series([[stem(w) for w in words] for words in lists])


# --- Porter's suffix stripping, after the published description of the algorithm.

_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """The word as a string of c and v; y after a consonant is a vowel."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    return len(word) >= 3 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, rules: dict[str, str]) -> str:
    for end in sorted(rules, key=len, reverse=True):
        if word.endswith(end):
            base = word[: -len(end)]
            return base + rules[end] if _measure(base) > 0 else word
    return word


@lru_cache(1 << 18)  # kept from batch to batch by a worker
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    # Plurals.
    for end, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + put
            break
    # Past tense and participles.
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            base = word[: -len(end)]
            if word.endswith(end) and "v" in _shape(base):
                if base.endswith(("at", "bl", "iz")):
                    base += "e"
                elif len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
                    base = base[:-1]
                elif _measure(base) == 1 and _short_end(base):
                    base += "e"
                word = base
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
