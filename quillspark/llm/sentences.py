"""Sentence boundaries across languages and scripts.

A text is read by a pushdown automaton in two linear passes.  The first keeps quotation
marks, brackets and list levels on one stack, one blank-line block at a time: a line that
begins a list, or is the next item of a list on the stack, closes the deeper levels and
whatever is left open in them, so that an opener without a closer has no effect beyond its
item.  The second visits end marks, line breaks, list items and, in Thai, blanks outside of
all pairs and decides from the context whether a sentence ends there.
Abbreviations are found by walking a trie backwards from the full stop.

Defined results: a null, empty or blank text has no sentences; every character other
than white space lies in exactly one sentence; offsets are code points from 0, end
exclusive, without white space at either end.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations after which a sentence goes on.
MEDIAL = """
dr mr mrs ms prof st mt messrs hon rev gen col lt capt sgt gov sen rep
fig figs eq eqs sec secs tab tabs no nos app vol vols ch chap pp p ed eds
cf vs v approx ver resp al e.g i.e viz ca c b d est incl dept univ proc
abb nr bd bzw hr hrn fr z.b d.h s vgl sog u.a z.t geb
m mm mme mmes mlle p.ex c.-à-d env art
sr sra srta dña ee pág págs núm p.ej aprox ud uds
рис табл т.е т.д т.п им стр см напр проф акад ул гл разд
डॉ प्रो श्री श्रीमती सं د أ م ص ดร
""".split()

# Abbreviations that may also close a sentence.
FINAL = "etc usw u.s u.k u.s.a e.u uu inc ltd co corp jr bros a.m p.m др пр г гг b.c a.d ph.d p.s".split()

# German words before an ordinal number such as "am 3. Mai".
BEFORE_ORDINAL = frozenset("am die der das dem den des vom zum zur beim im seit bis ab".split())

# Words that do not end a heading.
NOT_LAST = frozenset(
    """a an the of to in on at by for from with and or as is was were that this these those between both before after
    its their our we using although if few earlier how what see no here two each several compared
    der die das den dem des ein eine einer von zu im in am an auf mit und oder für ob laut seit gegenüber zwischen wurde blieb
    le la les un une des de du à au aux en par et ou sur il que nous aucun depuis
    el los las un una de del en y o por para con sin que frente desde queda
    и в во на с со о об от до по за из у к ли не или что""".split()
)

PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "《": "》", "〈": "〉", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“”", "‹": "›", "‚": "‘’"}
CLOSE = frozenset(")]}）］】》〉」』»”“›\"")
FULL = frozenset("。！？｡．")
ENDS = frozenset(".!?…。！？｡।॥؟۔։።")
EVENT = re.compile(r"[.!?…。！？｡．।॥؟۔։።]+|[()\[\]{}（）［］【】《》〈〉「」『』«»“”„‹›\"]|\n\s*|(?<=[฀-๿])[^\S\n]+|[^\S\n]+(?=[฀-๿])")
MARKER = re.compile(r"(?:[^\S\n]?\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\])+|\([^()\n]+?,\s*\d{4}[a-z]?\)|[⁰¹²³⁴-⁹]+")
LEADING_MARKER = re.compile(r"\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]|\([^()\n]+?,\s*\d{4}[a-z]?\)")
WORD = re.compile(r"[^\W\d_]+(?:[.'’-][^\W\d_]+)*$")
MIXED = re.compile(r"[a-zà-ÿ]{1,2}[A-Z]")
ITEM = re.compile(r"([-*•–·])[^\S\n]|(\(?)(\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})([.)])[^\S\n]")
HEADING_WORDS = 8
_DESIGNATOR = re.compile(r"(?:group|type|phase|class|part|case|model|arm|site|batch|plan|team|variant|grade|vitamin|hepatitis) [A-Z]$")
BULLET = re.compile(r"[-*•–·][^\S\n]|\(?(?:\d{1,3}|[a-z])[.)][^\S\n]")


def _trie(words: list[str]) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for char in reversed(word):
            node = node.setdefault(char, {})
        node[""] = word
    return root


_MEDIAL, _FINAL = _trie(MEDIAL), _trie(FINAL)


def _abbreviation(root: dict, text: str, dot: int) -> bool:
    """Whether a word of the trie ends before text[dot]; blanks after inner full stops are skipped."""
    node, at = root, dot - 1
    while at >= 0:
        char = text[at].lower()
        if char.isspace() and text[at - 1] == "." and "." in node:
            at -= 1
            continue
        node = node.get(char)
        if node is None:
            return False
        at -= 1
        if "" in node and (at < 0 or not (text[at].isalnum() or text[at] == "." and at and text[at - 1].isalnum())):
            return True
    return False


_ROMAN = {"i": 1, "v": 5, "x": 10}


def _ordinals(mark: str) -> set[tuple[str, int]]:
    """What a list mark can count as: a number, a letter or a Roman numeral, with its value."""
    if mark.isdigit():
        return {("1", int(mark))}
    low = mark.lower()
    out = {("a", ord(low) - 96)} if len(low) == 1 and low.isascii() else set()
    if set(low) <= set(_ROMAN):
        values = [_ROMAN[c] for c in low]
        out.add(("i", sum(-v if v < max(values[k:]) else v for k, v in enumerate(values))))
    return out


def _pairs(text: str) -> tuple[dict[int, int], list, dict[int, int]]:
    """Start of each pair → its end, all events, and start of each list item → end of its mark."""
    events = [(m.start(), m.end()) for m in EVENT.finditer(text)]
    stack: list[tuple] = []  # ("(", place) of an opener or ("item", indent, what it counts as)
    found: dict[int, int] = {}
    items: dict[int, int] = {}
    open_count: dict[str, int] = {}

    def item(at: int, indent: int) -> None:
        m = ITEM.match(text, at)
        if not m:
            return
        counts = {("-", 0)} if m.group(1) else _ordinals(m.group(3))
        levels = [e for e in stack if e[0] == "item"]
        same = next((e for e in reversed(levels) if e[1] <= indent), None)
        follows = same is not None and same[1] == indent and any((kind, value - 1) in same[2] or (kind, value) in same[2] and kind == "-" for kind, value in counts)
        if not follows and not any(value <= 1 for _, value in counts):
            return
        # deeper levels, and for a next item its own, end with what is open in them
        while any(e[0] == "item" and (e[1] > indent or e[1] == indent) for e in stack):
            e = stack.pop()
            if e[0] != "item":
                open_count[e[0]] -= 1
        stack.append(("item", indent, counts))
        items[at] = m.end()

    item(_skip_blank(text, 0), 0)
    for start, end in events:
        char = text[start]
        if char == "\n":
            if text.count("\n", start, end) > 1:
                stack.clear()
                open_count.clear()
            if end < len(text):
                item(end, end - text.rfind("\n", start, end) - 1)
            continue
        if char == '"':
            closes = open_count.get('"', 0) > 0
        else:
            closes = char in CLOSE and any(open_count.get(o, 0) for o in _OPENERS.get(char, ()))
        if closes:
            wanted = _OPENERS.get(char, '"')
            while stack:
                entry = stack.pop()
                if entry[0] == "item":  # what is open above an item does not close within it
                    stack.append(entry)
                    break
                open_count[entry[0]] -= 1
                if entry[0] in wanted:
                    found[entry[1]] = start
                    break
        elif char in PAIRS or char == '"' and text[start + 1 : start + 2].strip():
            stack.append((char, start))
            open_count[char] = open_count.get(char, 0) + 1
    return found, events, items


_OPENERS: dict[str, str] = {'"': '"'}
for _open, _shut in PAIRS.items():
    for _char in _shut:
        _OPENERS[_char] = _OPENERS.get(_char, "") + _open


def _caseless(char: str) -> bool:
    return char.isalpha() and not (char.isupper() or char.islower() or char.istitle())


def _starts(text: str, at: int) -> bool:
    """Whether text[at:] can begin a sentence after an end mark and a blank."""
    char = text[at]
    if char.isupper() or char.istitle() or char in "¿¡" or _caseless(char):
        return True
    if char in PAIRS or char in "\"'‘":
        k = at + 1
        while k < len(text) and (text[k].isspace() or text[k] in "¿¡\"'"):
            k += 1
        return k < len(text) and (not text[k].islower() or bool(MIXED.match(text, k)))
    return bool(MIXED.match(text, at)) or bool(BULLET.match(text, at)) and not char.islower() and not char.isdigit()


def _heading(text: str, begin: int, stop: int, after: int) -> bool:
    """Whether text[begin:stop], a whole line without an end mark and of ``HEADING_WORDS`` words at most, is a heading before text[after:]."""
    line = text[begin:stop].strip()
    words = line.split()
    if not words or len(words) > HEADING_WORDS or line[-1] in ",;:，、；：-–" or line[-1] in ENDS or not _starts(text, after):
        return False
    if _caseless(text[after]) or _caseless(line[-1]) or not line[-1].isascii() and not (line[-1].islower() or line[-1].isupper()):
        return True
    if words[-1].lower() in NOT_LAST or words[0].lower() in NOT_LAST and len(words) < 3:
        return False
    if line[0].islower():
        return True
    titled = [w for w in words if w.lower() not in NOT_LAST]
    return all(not w[0].islower() for w in titled)


def _skip_blank(text: str, at: int) -> int:
    n = len(text)
    while at < n and text[at].isspace():
        at += 1
    return at


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Offsets of the sentences of a text."""
    if not text or text.isspace():
        return []
    n = len(text)
    pairs, events, items = _pairs(text)
    marks = {end - 2 for end in items.values()}  # the full stops of list marks
    out: list[tuple[int, int]] = []
    begin = _skip_blank(text, 0)
    until = -1  # the end of the outermost pair
    k, last = 0, len(events)

    def cut(at: int) -> None:
        nonlocal begin
        stop = at
        while stop > begin and text[stop - 1].isspace():
            stop -= 1
        if stop > begin:
            out.append((begin, stop))
        begin = _skip_blank(text, at)

    while k < last:
        start, end = events[k]
        k += 1
        if start < until or start < begin:
            continue
        char = text[start]
        if start in pairs:
            until = pairs[start]
            inner = until - 1
            while inner > start and (text[inner].isspace() or text[inner] in CLOSE):
                inner -= 1
            after = until + 1
            while after < n and text[after] in CLOSE and after not in pairs:
                after += 1
            ended = text[inner] in ENDS and not (text[inner] == "." and _abbreviation(_MEDIAL, text, inner))
            if not ended:
                continue
            if (m := MARKER.match(text, after)) and not text[after].isspace():
                after = m.end()
            nxt = _skip_blank(text, after)
            if nxt == n:
                break
            whole = start == begin
            if nxt > after and (text[nxt].isupper() or text[nxt] in "¿¡«\"(" and _starts(text, nxt) or "\n" in text[after:nxt] or whole and _starts(text, nxt) and not _caseless(text[nxt]) or MIXED.match(text, nxt)):
                if not (text[nxt].isupper() and text[inner] == "." and char in "([" and not whole and not text[inner - 1].isalnum()):
                    cut(after)
            continue
        if char in CLOSE or char in PAIRS:
            continue
        if char == "\n":
            if end >= n:
                continue
            if text.count("\n", start, end) > 1 or BULLET.match(text, end) and text[end] in "-*•·" or end in items or text.rfind("\n", begin, start) < 0 and _heading(text, begin, start, end):
                cut(start)
            continue
        if char.isspace():  # a blank beside Thai letters
            left, right = text[start - 1] if start else " ", text[end] if end < n else " "
            if right == " " or LEADING_MARKER.match(text, end) or left == "." and _abbreviation(_MEDIAL, text, start - 1):
                continue
            if right.isalnum() or right in PAIRS or right == '"':
                cut(start)
            continue
        if start in marks:
            continue
        # an end mark outside of all pairs
        after = end
        while after < n and text[after] in CLOSE and after not in pairs:
            after += 1
        if (m := MARKER.match(text, after)) and (text[after : after + 1] in "[(" or _skip_blank(text, m.end()) == n or _starts(text, _skip_blank(text, m.end()))):
            if not (text[after] == "(" and char == "."):
                after = m.end()
        nxt = _skip_blank(text, after)
        if nxt == n:
            break
        spaced = nxt > after or after > end
        mark = text[start:end]
        if mark[0] in "。！？｡．।॥؟۔։።" or mark[-1] in "。！？｡।॥؟۔":
            cut(after)
            continue
        following = text[nxt]
        if "…" in mark and _caseless(following) and nxt == after:
            continue
        if mark[0] in "!?":
            if spaced and _starts(text, nxt) or following.isdigit() and nxt > after or _caseless(following):
                cut(after)
            elif nxt == after and following.isupper():
                cut(after)
            continue
        if not spaced:
            # a missing blank after a full stop, not inside of a number, an address or an abbreviation
            if mark == "." and following.isupper() and start >= 2 and text[nxt + 1 : nxt + 2].islower() or mark == "." and _caseless(following) and start and not text[start - 1].isdigit() and not text[start - 1].isascii():
                token = text[max(begin, text.rfind(" ", begin, start) + 1) : start]
                if "/" in token or "@" in token or "." in token and not token[-1].isdigit() or _abbreviation(_MEDIAL, text, start) or _abbreviation(_FINAL, text, start):
                    continue
                if len(token) >= 2 and (text[start - 1].isalnum() or text[start - 1] in ")]%\"»”"):
                    cut(after)
            continue
        if nxt == after and following.isalnum() and not following.isupper() and not _caseless(following):
            continue
        if mark == "." and k < last and text[end : events[k][0]].strip() == "" and events[k][0] > end and text[events[k][0]] == ".":
            continue  # a spaced ellipsis goes on
        if mark == ".":
            before = text[start - 1] if start else " "
            if before.isalpha() or unicodedata.category(before)[0] == "M":
                if _abbreviation(_MEDIAL, text, start) and not (text[start - 1].isupper() and _single(text, start) and _after_noun(text, start)):
                    continue
                if _single(text, start) and before.isupper():
                    if not _after_noun(text, start):
                        continue
                    if following.isupper() and text[nxt + 1 : nxt + 2] == "." and not _DESIGNATOR.search(text, max(0, start - 20), start):
                        continue
                elif _single(text, start) and text[nxt + 1 : nxt + 2] == ".":
                    continue
                elif _abbreviation(_FINAL, text, start):
                    if not (following.isupper() or following in "¿¡«\"(“" and _starts(text, nxt)):
                        continue
            elif before.isdigit():
                m = re.search(r"(\S+)\s+\d{1,2}$", text[max(begin, start - 40) : start])
                if m and m.group(1).lower() in BEFORE_ORDINAL and following.isupper():
                    continue
        if _starts(text, nxt):
            cut(after)
        elif following.isdigit() and nxt > after and not (start and text[start - 1] == "."):
            if not _abbreviation(_FINAL, text, start):
                cut(after)
    cut(n)
    return out


def _single(text: str, dot: int) -> bool:
    return dot < 2 or not (text[dot - 2].isalnum() or text[dot - 2] in ".'’-")


def _after_noun(text: str, dot: int) -> bool:
    """Whether the letter before the full stop follows a word in small letters, as in "group B."."""
    m = re.search(r"(\S+)\s+$", text[max(0, dot - 40) : dot - 1])
    return bool(m) and m.group(1)[0].islower() and m.group(1)[-1].islower()


_SPAN = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32())]))


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, ends, offsets = [], [], [0]
        for text in batch.column(batch.num_columns - 1).to_pylist():
            for a, b in sentences(text):
                starts.append(a)
                ends.append(b)
            offsets.append(len(starts))
        values = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(_SPAN.value_type))
        spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=_SPAN)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], spans], names=[*batch.schema.names[:-1], "spans"])


def sentence_spans(df: DataFrame, key: str, text: str, order: list[str]) -> DataFrame:
    """One row (key, start_pos, end_pos) per sentence of each distinct key.

    Texts are split where they are scanned; only keys and offsets are shuffled to keep one
    row for each key, the least by ``order`` (ties: the least offsets).  A null key is a key.
    """
    kinds = dict(df.dtypes)
    slim = df.select(F.col(key).alias("k"), F.struct(*[F.col(c) for c in order]).alias("o") if order else F.lit(0).alias("o"), F.col(text).cast("string").alias("t"))
    o_type = dict(slim.dtypes)["o"]
    split = slim.mapInArrow(_split_batches, f"k {kinds[key]}, o {o_type}, spans array<struct<start_pos:int,end_pos:int>>")
    first = split.groupBy("k").agg(F.min(F.struct("o", "spans")).alias("x"))
    return first.select(F.col("k").alias(key), F.explode("x.spans").alias("s")).select(key, "s.start_pos", "s.end_pos")
