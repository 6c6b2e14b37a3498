"""Porter's stemmer, after "An algorithm for suffix stripping" (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The published algorithm's suffixes and what replaces them.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and _shape(cut)[-1] == "c" and cut[-1] not in "lsz":
            w = cut[:-1]
        else:
            w = cut + "e" if _measure(cut) == 1 and _short_end(cut) else cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, _STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(tokens: Column) -> Column:
    """An array of tokens, each stemmed."""

    @F.pandas_udf(ArrayType(StringType()))
    def each(batch: pd.Series) -> pd.Series:
        return batch.map(lambda words: None if words is None else [stem(w) for w in words])

    return each(tokens)
