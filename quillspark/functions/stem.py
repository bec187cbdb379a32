"""The English Snowball stemmer, after its published description, as a pandas UDF."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types

_V = "aeiouy"
# Words with a stem of their own, and words left as they are.
_SPECIAL = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEEP = frozenset("sky news howe atlas cosmos bias andes".split())
_KEEP_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    n = len(w)
    lead = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), 0)
    m = re.search(f"[{_V}][^{_V}]", w)
    r1 = lead or (m.end() if m else n)
    m = re.search(f"[{_V}][^{_V}]", w[r1:])
    return r1, r1 + m.end() if m else n


def _short_syllable(w: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$|^[{_V}][^{_V}]$", w))


@lru_cache(100_000)
def stem(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) < 3:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w in _KEEP:
        return w
    w = w.lstrip("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}].", w[:-1]):
        w = w[:-1]
    if w in _KEEP_1A:
        return w.lower()
    m = re.search(r"(eedly|eed)$", w)
    if m:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and re.search(f"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif _short_syllable(w) and r1 >= len(w):
            w += "e"
    w = re.sub(f"(?<=.[^{_V}])[yY]$", "i", w)
    for end in sorted(_STEP2, key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + _STEP2[end]
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[:-3].endswith("l"):
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    for end in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(end):
            if end == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            elif len(w) - len(end) >= r1:
                w = w[: -len(end)] + _STEP3[end]
            break
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] and w[-4] in "st"):
                w = w[: -len(end)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(types.ArrayType(types.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """The stems of an array of words."""
    return pd.Series([None if ws is None else [stem(w) for w in ws] for ws in words], dtype=object)
