"""The Porter stemmer as an Arrow UDF, after M. F. Porter, "An algorithm for suffix stripping" (1980)."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Suffix tables of steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)


def _consonant(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiou"  # y too, wherever it stands


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


def _longest(w: str, table) -> str | None:
    return max((s for s in table if w.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """Words of 3 to 64 bytes without their suffixes; whatever is no vowel of a-z counts as a consonant, byte by byte."""
    data = word.encode()
    return _stem(data.decode("latin-1")).encode("latin-1").decode() if 3 <= len(data) <= 64 else word


def _stem(w: str) -> str:
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed") and len(w) > 3:
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem_of(words: pd.Series) -> pd.Series:
    """Stems of words, for a vocabulary: once for each distinct word of a batch."""
    return words.map({w: None if w is None else stem(w) for w in words.unique()})


@F.arrow_udf(StringType())
def stemmed_text(tokens: pa.Array) -> pa.Array:
    """Stems of arrays of tokens, in order, with spaces between: once for each distinct token of a batch."""
    each = tokens.values.dictionary_encode()
    stems = pa.array([None if w is None else stem(w) for w in each.dictionary.to_pylist()], pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(tokens.offsets, stems.take(each.indices)), " ")
