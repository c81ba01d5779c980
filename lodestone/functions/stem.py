"""Porter's stemming algorithm (1980) as an Arrow function over distinct words."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_CONSONANT, _VOWEL = "[^aeiou]", "[aeiouy]"
_C, _V = f"{_CONSONANT}[^aeiouy]*", f"{_VOWEL}[aeiou]*"
_measure = re.compile(f"^(?:{_C})?((?:{_V}{_C})*)(?:{_V})?$")
_vowel = re.compile(f"^(?:{_C})?{_V}")
_double = re.compile(r"([^aeiouylsz])\1$")
_cvc = re.compile(f"^{_C}{_VOWEL}[^aeiouwxy]$")
#: Suffixes of the algorithm's steps 2 to 4. Fixed values.
_TWO = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_THREE = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_FOUR = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _m(stem: str) -> int:
    found = _measure.match(stem)
    return len(re.findall(f"{_V}{_C}", found[1])) if found and found[1] else 0


def _swap(word: str, pairs: list[tuple[str, str]]) -> str:
    for end, new in sorted(pairs, key=lambda p: -len(p[0])):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + new if _m(stem) > 0 else word
    return word


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel.match(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double.search(w):
                    w = w[:-1]
                elif _m(w) == 1 and _cvc.match(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel.match(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _TWO), _THREE)
    for end in sorted(_FOUR, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _m(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_m(w[:-1]) > 1 or _m(w[:-1]) == 1 and not _cvc.match(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")
