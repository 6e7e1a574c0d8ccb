"""English stems of terms, by the public suffix-stripping algorithm of 1980 (steps 1 to 5), on Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# The algorithm's suffixes and what takes their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """The word with ``v`` for vowels and ``c`` for others; a y after a consonant is a vowel."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words that are not plain ASCII letters, or shorter than three, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            rest = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(rest):
                if rest.endswith(("at", "bl", "iz")):
                    rest += "e"
                elif len(rest) > 1 and rest[-1] == rest[-2] and _shape(rest)[-1] == "c" and rest[-1] not in "lsz":
                    rest = rest[:-1]
                elif _measure(rest) == 1 and _short_end(rest):
                    rest += "e"
                word = rest
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for step in (STEP_2, STEP_3):
        if (suffix := _longest(word, step)) and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + step[suffix]
    suffix = _longest(word, (*STEP_4, "ion"))
    if suffix and _measure(rest := word[: -len(suffix)]) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
        word = rest
    if word.endswith("e"):
        n = _measure(word[:-1])
        if n > 1 or n == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@pandas_udf(ArrayType(StringType()))
def _stemmed(lists: pd.Series) -> pd.Series:
    return lists.map(lambda words: None if words is None else [stem(w) for w in words])


def stemmed(words: Column) -> Column:
    """The stems of an array of lower-case words."""
    return _stemmed(words)
