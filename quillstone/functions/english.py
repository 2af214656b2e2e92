"""The English analyzer of full-text search: lower-case runs of letters and digits, stop words dropped, the rest stemmed by Porter's rules (1980)."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stop words: fixed values.
STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
#: Porter's suffixes and what they become, by step: fixed values.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
WORD = re.compile(r"[^\W_]+")


def _shape(word: str) -> str:
    """c and v for consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(word)))


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Words of one or two letters, and those with other than a to z, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    for ending, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):  # plurals
        if word.endswith(ending):
            word = word[: len(word) - len(ending)] + to
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (ending := _longest(word, ("ed", "ing"))) and "v" in _shape(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _doubled(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        if (ending := _longest(word, table)) and _measure(word[: -len(ending)]) > 0:
            word = word[: -len(ending)] + table[ending]
    if ending := _longest(word, STEP_4):
        base = word[: -len(ending)]
        if _measure(base) > 1 and (ending != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def english(text: str | None) -> list[str]:
    return [stem(w) for w in WORD.findall((text or "").lower()) if w not in STOP]


def plain(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


ANALYZERS: dict[str, Callable[[str | None], list[str]]] = {"english": english, "plain": plain}


def analyzed(text: Column, analyzer: str) -> Column:
    """The terms of texts, in order; none for null."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([ANALYZERS[analyzer](t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(text)
