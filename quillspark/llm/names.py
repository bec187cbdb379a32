"""Normal forms of names of people, institutions, venues and identifiers as typed."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from urllib.parse import unquote

# Letters without a decomposition.
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th"})
# Titles and suffixes that are no part of a name.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame rev hon phd md msc bsc dphil esq jr sr junior senior".split())
# Words that lead a family name.
PARTICLES = frozenset("van von der den de del della di da dos du la le al el ter ten zu zur af av bin ibn".split())
_MARKS = re.compile(r"[\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")


def fold_text(text: str) -> str:
    """Lower case, without accents; for texts of any length."""
    text = text.lower()
    if text.isascii():
        return text
    return _MARKS.sub("", unicodedata.normalize("NFKD", text.translate(_LETTERS))).translate(_LETTERS)


@lru_cache(50_000)
def fold(text: str) -> str:
    """Lower case, without accents."""
    return fold_text(text)


def plain(text: str) -> str:
    """A folded word whose written-out umlauts are taken back."""
    return text.replace("oe", "o").replace("ae", "a").replace("ue", "u")


_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def _tokens(text: str | None, joined: bool = False) -> list[str]:
    """Words of a name without titles; ``joined`` takes a hyphenated name as one word."""
    if joined:
        text = re.sub(r"(?<=[^\W\d_]{2})-(?=[^\W\d_]{2})", "", text or "")
    return [t.replace("’", "'") for t in _TOKEN.findall(fold(text or "")) if t not in TITLES]


@lru_cache(50_000)
def person(given: str | None, family: str | None) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(given tokens, family tokens) of a name as typed.

    A family field that holds "Family, Given", or both without a comma where the given
    field is empty, is taken apart.  Initials written together count singly.
    """
    given, family = given or "", family or ""
    if "," in family:
        left, _, right = family.partition(",")
        extra = _tokens(right, True)
        if extra and not _tokens(given):
            family, given = left, right
        else:
            family = left
    # two capital letters alone are initials
    bare = re.sub(r"[^\w]", "", given)
    if len(bare) == 2 and bare.isupper() and re.fullmatch(r"[^\W\d_]+", bare):
        givens = [fold(c) for c in bare]
    else:
        givens = _tokens(given, True)
    families = _tokens(family)
    if not givens and len(families) > 1:
        lead = 1
        while lead < len(families) and families[lead - 1] in PARTICLES:
            lead += 1
        if "-" in family:
            head = family.strip().split()[0]
            lead = max(lead, len(_tokens(head)))
        families, givens = families[:lead], _tokens(" ".join(families[lead:]))
    return tuple(givens), tuple(families)


# Words for kinds of institutions and their parts, and small words beside them.
_INSTITUTION_WORDS = frozenset(
    "university universitat universite universidad universidade universita universiteit universitet univ college academy akademie academie school schule ecole escuela faculty fakultat faculte facultad "
    "hochschule polytechnic politecnico institute institut instituto istituto inst department dept abteilung division centre center zentrum centro laboratory laboratoire labor laboratorio lab hospital klinik "
    "hopital technology of the for and in at der die das fur und de la le du des di del della da do".split()
)


@lru_cache(50_000)
def institution(text: str | None) -> str:
    """The words that name an institution, without a leading department."""
    if not text:
        return ""
    if re.match(r"\s*(?:dept|department|faculty|school|institut\w*)\b[^,]*,", text, re.I):
        text = text.partition(",")[2]
    words = [w for w in _TOKEN.findall(fold(text)) if w not in _INSTITUTION_WORDS and not near(w, "university")]
    return "".join(words)


def near(a: str, b: str, least: int = 5) -> bool:
    """Equal but for written-out umlauts, or one edit or swap of neighbours apart where both are long enough."""
    if a == b or plain(a) == plain(b):
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1 or min(la, lb) < least - 1 or max(la, lb) < least:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


@lru_cache(100_000)
def _letters(a: str) -> int:
    """A bit for each letter in a word, by its code."""
    mask = 0
    for c in a:
        mask |= 1 << (ord(c) & 63)
    return mask


@lru_cache(100_000)
def apart(a: str, b: str, most: int = 2) -> int:
    """Edits and swaps of neighbours between two words, ``most`` + 1 if they are more."""
    # an edit changes two bits at most
    if abs(len(a) - len(b)) > most or (_letters(a) ^ _letters(b)).bit_count() > 2 * most:
        return most + 1
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if abs(len(a) - len(b)) > most or not a or not b:
        return min(max(len(a), len(b)), most + 1)
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


ENDINGS = ("ie", "y", "i", "a")


@lru_cache(100_000)
def shortened(a: str, b: str) -> bool:
    """Whether the shorter name is the head (three letters) or the tail (four) of the longer, perhaps with an ending of endearment."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 3 or len(b) - len(a) < 2:
        return False
    if b.startswith(a) or len(a) > 3 and b.endswith(a):
        return True
    for ending in ENDINGS:
        stem = a.removesuffix(ending) if a.endswith(ending) else ""
        if len(stem) > 3 and stem[-1] == stem[-2]:
            stem = stem[:-1]
        if len(stem) > 2 and b.startswith(stem) or len(stem) > 3 and b.endswith(stem):
            return True
    return False


@lru_cache(200_000)
def same_given(a: str, b: str, la: frozenset[str] = frozenset(), lb: frozenset[str] = frozenset()) -> int:
    """2 for one name in full, 1 for an initial or a shortening of the other, 0 for different names; ``la`` and ``lb`` are what a and b are known to be short for."""
    if a == b:
        return 2 if len(a) > 1 else 1
    if len(a) == 1 or len(b) == 1:
        if len(a) > 1:
            a, b, lb = b, a, la
        return int(a == b[0] or any(n[0] == a for n in lb))
    if near(a, b, 4):
        return 2
    if la & lb or any(near(n, b, 4) for n in la) or any(near(n, a, 4) for n in lb):
        return 2
    return int(shortened(a, b))


def doi(text: str | None) -> str:
    text = unquote(text or "").lower()
    m = re.search(r"10\.\d{4,9}/\S+", text)
    return m.group().rstrip(".,;)") if m else ""


_SMALL = frozenset("of the on in for and a an de la der die und et du des".split())


def venue(text: str | None) -> str:
    """The first four letters of each word of a venue's name, as in its short form."""
    text = text or ""
    return " ".join(w[:4] for w in re.findall(r"[^\W\d_]+", fold(text)) if w not in _SMALL)


@lru_cache(20_000)
def title_words(text: str | None) -> tuple[tuple[str, ...], bool]:
    """(words of a title, whether it was cut short)."""
    text = (text or "").strip().strip("[]* ")
    return tuple(re.findall(r"[^\W_]+", fold(text))), text.endswith(("...", "…"))


def core(words: tuple[str, ...]) -> str:
    """The words of a title without small words."""
    return " ".join(w for w in words if w not in _SMALL)
