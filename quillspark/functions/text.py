"""Text functions as column expressions; only what JVM expressions cannot say is a pandas UDF."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

_SPANS = types.ArrayType(types.StructType([types.StructField("start", types.IntegerType()), types.StructField("end", types.IntegerType())]))
WORD = r"([\p{L}\p{N}_]+)"

# The customary English stop words; the single letters among them are kept apart.
STOPWORDS = tuple(
    """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers
    herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into
    through during before after above below to from up down in out on off over under again further then once here there when where why how all
    any both each few more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll
    m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't
    mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't""".split()
)
INDEX_STOPWORDS = tuple(w for w in STOPWORDS if len(w) > 1)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_stop(word: Column) -> Column:
    """Whether a word is a stop word of the index; the list becomes a hash set."""
    return word.isin(*INDEX_STOPWORDS)


def lemma(word: Column) -> Column:
    """The default lemma: plural endings are taken off."""
    return (
        F.when((F.length(word) < 4) | word.rlike("(ss|us|is)$"), word)
        .when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ss|sh|ch|x)es$"), F.regexp_replace(word, "es$", ""))
        .otherwise(F.regexp_replace(word, "s$", ""))
    )


def words(text: Column) -> Column:
    """Lower-cased words of a text in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def index_words(text: Column) -> Column:
    """Words as they enter the index: stop words as they are, the rest by their lemma."""
    return F.transform(words(text), lambda w: F.when(is_stop(w), w).otherwise(lemma(w)))


def unigrams(tokens: Column) -> Column:
    return F.array_distinct(F.filter(tokens, lambda w: ~is_stop(w)))


def bigrams(tokens: Column) -> Column:
    """Distinct pairs of neighbours, both no stop words."""

    def pairs(t: Column) -> Column:
        def pair(w: Column, i: Column) -> Column:
            return let(F.get(t, i + 1), lambda after: F.when(~is_stop(w) & ~is_stop(after), F.concat_ws(" ", w, after)))

        return F.array_distinct(F.filter(F.transform(t, pair), lambda p: p.isNotNull()))

    return let(tokens, pairs)


def squash(text: Column) -> Column:
    """White space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title_key(text: Column) -> Column:
    """Letters of a title only, without stop words, as a key of equal titles."""
    kept = F.filter(F.split(F.lower(text), r"\s+"), lambda w: ~w.isin(*STOPWORDS))
    return F.concat_ws(" ", F.regexp_extract_all(F.concat_ws(" ", kept), F.lit("([a-z]+)"), F.lit(1)))


def abbreviated(name: Column) -> Column:
    """Initials of all but the last word, then the last word, in lower case."""


    def short(parts: Column) -> Column:
        lead = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda w: F.substring(w, 1, 1))
        return F.when(F.size(parts) > 0, F.concat_ws(" ", lead, F.slice(parts, -1, 1))).otherwise("")

    return let(F.filter(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: w != ""), short)


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return bin(row ^ full).count("1")


def indel_ratio(a: str | None, b: str | None) -> float | None:
    """Similarity of 0 to 100 by insertions and deletions; two empty texts are equal."""
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * _common_subsequence(a, b) / total


@F.pandas_udf(types.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def alike(a: Column, b: Column, least: float = 90.0) -> Column:
    """Whether the ratio is above ``least``; the edit distance, which bounds it, prunes in the JVM first."""
    most = F.floor((1 - least / 100.0) * (F.length(a) + F.length(b))).cast("int")
    return (F.levenshtein(a, b) <= most) & (ratio(a, b) > least)


def _ends(needle: str, text: str, most: int) -> list[int]:
    """Places in a text where a match within an edit distance ends."""
    return [j for j, score in enumerate(_scores(needle, text)) if score <= most]


def _scores(needle: str, text: str) -> Iterator[int]:
    """For each place of a text the least distance of a match that ends there, by bit-parallel columns: a few operations on long integers for each character."""
    m = len(needle)
    full, high = (1 << m) - 1, 1 << m - 1
    at: dict[str, int] = {}
    for i, c in enumerate(needle):
        at[c] = at.get(c, 0) | 1 << i
    plus, minus, score = full, 0, m
    for c in text:
        equal = at.get(c, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | full & ~(across | plus), plus & across
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | full & ~(vertical | up), up & vertical
        yield score


def near_matches(needle: str, text: str, most: int) -> list[tuple[int, int]]:
    """Non-overlapping places of a text within an edit distance of a needle, the best of each overlap.

    Where matches end is found by one bit-parallel pass; their starts by rows of distances
    over the few characters before.
    """
    m = len(needle)
    if not m or not text:
        return []
    hits: list[tuple[int, int, int]] = []
    reach = m + most + 1
    ends = _ends(needle, text, most) if most < m else list(range(len(text)))
    at = 0
    while at < len(ends):
        last = at
        while last + 1 < len(ends) and ends[last + 1] - ends[last] <= reach:
            last += 1
        low = max(0, ends[at] - reach)
        hits += _starts(needle, text, low, ends[last] + 1, most)
        at = last + 1
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(hits, key=lambda h: (h[0], h[2])):
        if all(b <= x or a >= y for x, y in out):
            out.append((a, b))
    return sorted(out)


def _starts(needle: str, text: str, low: int, high: int, most: int) -> list[tuple[int, int, int]]:
    """(distance, start, end) of the matches in text[low:high], by a row of distances and starts."""
    m = len(needle)
    cost, begin = list(range(m + 1)), [low] * (m + 1)
    hits = []
    for j in range(low, high):
        c = text[j]
        last_cost, last_begin = cost, begin
        cost, begin = [0] * (m + 1), [j + 1] + [0] * m
        for i in range(1, m + 1):
            best, at = last_cost[i - 1] + (needle[i - 1] != c), last_begin[i - 1]
            if i == 1:
                at = j
            if last_cost[i] + 1 < best:
                best, at = last_cost[i] + 1, last_begin[i]
            if cost[i - 1] + 1 < best:
                best, at = cost[i - 1] + 1, begin[i - 1]
            cost[i], begin[i] = best, at
        if cost[m] <= most:
            hits.append((cost[m], begin[m], j + 1))
    return hits


@F.pandas_udf(_SPANS)
def find_near(needle: pd.Series, text: pd.Series, most: pd.Series) -> pd.Series:
    """Places of a needle in a text whose repeated white space is passed over; offsets are those of the text as given."""
    out = []
    for n, t, k in zip(needle, text, most):
        if not n or not t:
            out.append([])
            continue
        kept = [i for i, c in enumerate(t) if not (c.isspace() and i + 1 < len(t) and t[i + 1].isspace())]
        flat = "".join(" " if t[i].isspace() else t[i] for i in kept)
        spans = near_matches(" ".join(n.split()), flat, int(k))
        out.append([{"start": kept[a], "end": kept[b - 1] + 1} for a, b in spans if b > a])
    return pd.Series(out)


# Edit distances tried in turn, and the length of the probe tried last.
PASSAGE_EDITS, PROBE = (5, 10, 15), 30


def _first_near(needle: str, text: str) -> tuple[int, int] | None:
    """The first place within the least of ``PASSAGE_EDITS`` that has any; one pass tells which that is."""
    least = min(_scores(needle, text), default=len(needle))
    # a needle no longer than a distance is near everywhere
    level = next((most for most in PASSAGE_EDITS if least <= most or len(needle) <= most), None)
    found = near_matches(needle, text, level) if level is not None else []
    return found[0] if found else None


def passage(needle: str, text: str) -> tuple[int, int] | None:
    """Where a passage stands in a text, by rising edit distance, else by a probe from its middle."""
    needle, text = needle.lower(), text.lower()
    if found := _first_near(needle, text):
        return (found[0], found[1] - 1) if found[0] < found[1] - 1 else None
    if len(needle) <= PROBE:
        return None
    at = (len(needle) - PROBE) // 2
    if found := _first_near(needle[at : at + PROBE], text):
        return found[0] - at, found[1] + len(needle) - at - PROBE
    return None


@F.pandas_udf(_SPANS)
def find_passage(needle: pd.Series, text: pd.Series) -> pd.Series:
    """The place of a passage in a text as an array of at most one span; repeated white space is passed over, what reaches beyond the text is cut."""
    out = []
    for n, t in zip(needle, text):
        if not n or not t:
            out.append([])
            continue
        kept = [i for i, c in enumerate(t) if not (c.isspace() and i + 1 < len(t) and t[i + 1].isspace())]
        place = passage(n, "".join(t[i] for i in kept))
        if place is None:
            out.append([])
            continue
        start = kept[max(place[0], 0)] if place[0] < len(kept) else len(t)
        end = kept[place[1]] + 1 if 0 <= place[1] < len(kept) else len(t)
        out.append([{"start": start, "end": end}] if start < end else [])
    return pd.Series(out)


def highlight(text: Column, keywords: list[str]) -> Column:
    """Spans of keywords in the text after its white space is squashed; neighbouring hits are one span.

    A span runs to the blank after its last word, but not beyond the text.
    """
    wanted = [k.lower() for k in keywords]
    parts = F.split(squash(text), " ")
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, w: Column) -> Column:
        after = acc.at + F.length(w) + 1
        hit = bare(w).isin(*wanted)
        last = F.try_element_at(acc.spans, F.lit(-1))
        joined = F.when(
            F.coalesce(last.end == acc.at, F.lit(False)),
            F.concat(F.slice(acc.spans, 1, F.greatest(F.size(acc.spans) - 1, F.lit(0))), F.array(F.struct(last.start.alias("start"), after.alias("end")))),
        ).otherwise(F.concat(acc.spans, F.array(F.struct(acc.at.alias("start"), after.alias("end")))))
        return F.struct(after.alias("at"), F.when(hit, joined).otherwise(acc.spans).alias("spans"))

    def finish(acc: Column) -> Column:
        # the last word has no blank after it
        return F.transform(acc.spans, lambda s: F.struct(s.start.alias("start"), F.least(s.end, acc.at - 1).alias("end")))

    return F.aggregate(parts, start, step, finish)


def split_sentences(text: Column) -> Column:
    """Pieces between full stops followed by white space, each with its full stop."""


    def ended(pieces: Column) -> Column:
        return F.transform(pieces, lambda s, i: F.when(i < F.size(pieces) - 1, F.concat(s, F.lit("."))).otherwise(s))

    return F.filter(let(F.split(squash(text), r"\.\s"), ended), lambda s: F.trim(s) != "")


def merge_short(sentences: Column, least: int = 10) -> Column:
    """Sentences of fewer than ``least`` words are joined to what follows; the last, if short, to what precedes."""
    count = lambda s: F.size(F.split(s, " "))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(acc: Column, s: Column) -> Column:
        now = F.trim(F.concat_ws(" ", acc.held, s))
        long = count(now) >= least
        return F.struct(F.when(long, F.concat(acc.done, F.array(now))).otherwise(acc.done).alias("done"), F.when(long, F.lit("")).otherwise(now).alias("held"))

    def finish(acc: Column) -> Column:
        last = F.try_element_at(acc.done, F.lit(-1))
        return (
            F.when(acc.held == "", acc.done)
            .when(F.size(acc.done) == 0, F.array(acc.held))
            .otherwise(F.concat(F.slice(acc.done, 1, F.greatest(F.size(acc.done) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, acc.held))))
        )

    return F.aggregate(sentences, start, step, finish)


def url_from_doi(doi: Column, other: Column) -> Column:
    """A resolver's address for a DOI, percent-escaped, else the other address."""
    escaped = doi
    for raw, code in (("%", "%25"), ('"', "%22"), ("#", "%23"), (" ", "%20"), ("?", "%3F"), ("<", "%3C"), (">", "%3E")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(code))
    return F.when(F.trim(F.coalesce(doi, F.lit(""))) != "", F.concat(F.lit("https://doi.org/"), escaped)).otherwise(F.coalesce(other, F.lit("")))


def normal_doi(doi: Column) -> Column:
    """The bare, lower-cased DOI in a text, '' if there is none."""
    decoded = F.replace(F.lower(doi), F.lit("%2f"), F.lit("/"))
    return F.coalesce(F.regexp_replace(F.regexp_extract(decoded, r"(10\.\d{4,9}/\S+)", 1), r"[.,;]+$", ""), F.lit(""))


_ACCENTED = "àáâãäåāăąçćčďđèéêëēęěğìíîïīįıłļľñńňòóôõöøōőŕřśşšťţùúûüūůűųýÿźżž"
_PLAIN = "aaaaaaaaacccddeeeeeeegiiiiiiilllnnnoooooooorrsssttuuuuuuuuyyzzz"


# The usual Latin spelling of Cyrillic and Greek letters.
_CYRILLIC = dict(zip("абвгдеёзийклмнопрстуфыэ", "abvgdeeziiklmnoprstufye")) | {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}
_GREEK = dict(zip("αβγδεζηικλμνξοπρσςτυφωάέήίόύώ", "abgdeziiklmnxoprsstyfoaeiioyo")) | {"θ": "th", "χ": "ch", "ψ": "ps"}


def ascii_text(text: Column) -> Column:
    """Latin letters without their accents, Cyrillic and Greek ones by their usual Latin spelling; other characters beyond ASCII are left out."""
    ligatures = text
    for script in (_CYRILLIC, _GREEK):
        for raw, plain in script.items():
            if len(plain) != 1:
                ligatures = F.replace(F.replace(ligatures, F.lit(raw), F.lit(plain)), F.lit(raw.upper()), F.lit(plain.capitalize()))
        single = {r: p for r, p in script.items() if len(p) == 1}
        ligatures = F.translate(ligatures, "".join(single) + "".join(single).upper(), "".join(single.values()) + "".join(single.values()).upper())
    for raw, plain in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE")):
        ligatures = F.replace(ligatures, F.lit(raw), F.lit(plain))
    return F.regexp_replace(F.translate(ligatures, _ACCENTED + _ACCENTED.replace("ı", "").upper(), _PLAIN + _PLAIN[: _ACCENTED.index("ı")].upper() + _PLAIN[_ACCENTED.index("ı") + 1 :].upper()), r"[^\x00-\x7F]", "")


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def two_digits(value: Column) -> Column:
    """A month's name or number, or a day's number, as two digits; '' for anything else."""
    number = value.try_cast("int")
    named = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.substring(F.lower(F.trim(value)), 1, 3)).cast("int")
    code = F.when(number.isNotNull(), number).otherwise(F.nullif(named, F.lit(0)))
    return F.coalesce(F.when(code.between(1, 31), F.lpad(code.cast("string"), 2, "0")), F.lit(""))


def joined_date(year: Column, month: Column, day: Column) -> Column:
    """What there is of year, month and day, joined by hyphens."""
    return F.concat_ws("-", *[F.nullif(F.trim(p.cast("string")), F.lit("")) for p in (year, month, day)])


def day_month_year(day: Column, month: Column, year: Column) -> Column:
    """day-month-year, 01 for a day or month that is not given."""
    part = lambda p, default: F.coalesce(F.nullif(F.trim(p.cast("string")), F.lit("")), F.lit(default))
    return F.concat_ws("-", part(day, "01"), part(month, "01"), part(year, ""))


def full_year(two: Column, pivot: int = 50) -> Column:
    """The year two digits stand for: below ``pivot`` one of this century."""
    number = two.try_cast("int")
    return F.when(number.between(0, 99), F.when(number < pivot, number + 2000).otherwise(number + 1900))


def is_expansion(between: Column) -> Column:
    """Whether the text between two citation markers makes them a range: one or two characters, dashes and blanks only, one dash at least."""
    return F.coalesce(between.rlike("^[-–— ]{1,2}$") & between.rlike("[-–—]"), F.lit(False))


def without_tokens(text: Column, tokens: tuple[str, ...] = ("<pad>", "</s>", "<s>", "<unk>")) -> Column:
    """Generated text without a model's marks."""
    for token in tokens:
        text = F.replace(text, F.lit(token), F.lit(""))
    return F.trim(text)


def is_inside(start: Column, end: Column, spans: Column) -> Column:
    """Whether a span lies within one of an array of spans."""
    return F.exists(spans, lambda s: (start >= s.start) & (end <= s.end))


def replace_spans(text: Column, spans: Column, before: str = "", after: str = "", between: str = ", ") -> Column:
    """Text whose spans (start, end, new) are replaced, in order of start.

    A span that overlaps one before it is left out.  All but the first replacement get
    ``before`` and ``after`` around them, and one that abuts the last span ``between`` in front.
    """
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        fits = (s.start >= acc.at) & (s.end > 0)
        padded = F.when(acc.n == 0, s.new).otherwise(F.concat(F.when(s.start == acc.at, F.lit(between)).otherwise(""), F.lit(before), s.new, F.lit(after)))
        kept = F.concat(acc.out, F.substring(text, acc.at + 1, s.start - acc.at), padded)
        return F.struct(F.when(fits, kept).otherwise(acc.out).alias("out"), F.when(fits, s.end).otherwise(acc.at).alias("at"), F.when(fits, acc.n + 1).otherwise(acc.n).alias("n"))

    return F.aggregate(F.array_sort(spans), state, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))


def clean_latex(text: Column) -> Column:
    """LaTeX source before it is parsed: optional arguments of citations and bibliography items are taken off, and displayed and inline mathematics are removed after the preamble."""
    text = F.regexp_replace(text, r"\\(?:cite[pt]?|citealp|citeauthor|citeyear)\*?(?:\[[^\]]*\]){1,2}\{([^}]*)\}", r"\\cite{$1}")
    text = F.regexp_replace(text, r"\\bibitem\s*\[[^\]]*\]", r"\\bibitem")
    at = F.position(F.lit(r"\begin{document}"), text)
    head, body = F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0))), F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)
    for pattern in (r"(?s)\\begin\{(equation|align|eqnarray|gather|multline|displaymath|math)(\*?)\}.*?\\end\{\1\2\}", r"(?s)\$\$.*?\$\$", r"(?s)\\\[.*?\\\]", r"(?s)\\\(.*?\\\)", r"(?s)(?<!\\)\$[^$]*(?<!\\)\$"):
        body = F.regexp_replace(body, pattern, "")
    return F.concat(head, body)


def last_by_key(entries: Column) -> Column:
    """A map of an array of (key, value) structs; of equal keys the last counts."""
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later.key == e.key) & e.key.isNotNull())
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e.key, e.value)))


def word_ids(words: Column, vocabulary: dict[str, int], length: int, unknown: int = 0, pad: int = 1, end: int | None = None) -> Column:
    """Ids of the first words, filled up to a length; ``end`` closes them if it is given."""
    known = F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv])
    room = length - (end is not None)
    ids = F.transform(F.slice(words, 1, room), lambda w: F.coalesce(F.try_element_at(known, w), F.lit(unknown)))
    closed = F.concat(ids, F.array(F.lit(end))) if end is not None else ids
    return F.concat(closed, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(closed), F.lit(0))))
