"""The keyword language: a small parser on the driver, compiled to filters on terms.

``<AND>`` binds least, then ``<OR>``, then ``<NOT>``.  A piece may name a field before a
colon, a range of years, a DOI or words; words become their bigrams and the unigrams that no
bigram covers.  Text left of ``<NOT>`` in a piece has no effect, and an unknown field's name
is dropped.  An empty element matches everything.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import INDEX_STOPWORDS
from quillspark.operators.postings import FIELDS

# The pattern of a DOI in free text.
_DOI = re.compile(r"10\.\d{4,9}/[-._;()/:a-z0-9]+", re.I)
_YEAR = re.compile(r"^(?:1[5-9]|20)\d\d$")
_RANGE = re.compile(r"^\s*(\d{4})\s*\.\.\s*(\d{4})\s*$")


@dataclass
class Node:
    """'term', 'and', 'or', 'not' or 'all'; an 'or' with ``fallback`` n uses the parts from n on only if those before match nothing."""

    op: str
    parts: list[Node] = field(default_factory=list)
    term: str = ""
    fallback: int | None = None


ALL = Node("all")
Person = Callable[[str], tuple[str, str] | None]


def lemma(word: str) -> str:
    """The same rule as the index's."""
    if len(word) < 4 or re.search("(ss|us|is)$", word):
        return word
    if word.endswith("ies"):
        return word[:-3] + "y"
    if re.search("(ss|sh|ch|x)es$", word):
        return word[:-2]
    return word[:-1] if word.endswith("s") else word


def rewrite(text: str) -> str:
    r"""The short syntax of users: literal \t for and, | for or, ! for not, _ for a blank (not in field names such as Abstract_parsed)."""
    pieces = [" ".join(re.sub(r"_(?![pP]arsed)", " ", piece).split()) for piece in text.strip().split("\\t")]
    return "<AND>".join(p.replace("|", "<OR>").replace("!", "<NOT>") for p in pieces if p)


def _simplify(op: str, parts: list[Node], fallback: int | None = None) -> Node:
    parts = [p for p in parts if p.op != "all"]
    if not parts:
        return ALL
    if len(parts) == 1 and fallback is None:
        return parts[0]
    return Node(op, parts, fallback=fallback)


def _words(text: str) -> list[str]:
    found = re.findall(r"\w+", text.lower())
    return [w if w in INDEX_STOPWORDS else lemma(w) for w in found]


def _grams(text: str, prefix: str = "") -> Node:
    tokens = _words(text)
    ok = [w not in INDEX_STOPWORDS for w in tokens]
    pairs, covered = [], set()
    for i in range(len(tokens) - 1):
        if ok[i] and ok[i + 1]:
            pairs.append(f"{tokens[i]} {tokens[i + 1]}")
            covered |= {i, i + 1}
    singles = [t for i, t in enumerate(tokens) if ok[i] and i not in covered]
    return _simplify("and", [Node("term", term=prefix + t) for t in dict.fromkeys([*pairs, *singles])])


def _years(low: int, high: int) -> Node:
    return _simplify("or", [Node("term", term=f"publicationdate.year:{y}") for y in range(low, high + 1)])


def _full_name(text: str) -> Node:
    tokens = re.findall(r"\w+", text.lower())
    if not tokens:
        return ALL
    swapped = tokens[-1:] + tokens[:-1]
    return _simplify("or", [Node("term", term="author.fullname:" + " ".join(t)) for t in dict.fromkeys([tuple(tokens), tuple(swapped)])])


_NAME = re.compile(r"[^\W\d_a-z][\w'’-]+(?:\s+[^\W\d_a-z]\.?)*\s+(?:(?:van|von|de|der|den|la|le|al|el|bin)\s+)*[^\W\d_a-z][\w'’-]+")


def looks_like_name(text: str) -> tuple[str, str] | None:
    """(first, last) of a text that is written as a person's name: words in capitals, perhaps with initials between.

    A wrong guess does no harm: a name that no author has counts as its plain words.  A
    recogniser of names can stand in for this rule.
    """
    found = _NAME.fullmatch(text.strip().rstrip(","))
    words = re.findall(r"[\w'’-]+", found.group()) if found else []
    return (words[0], words[-1]) if len(words) > 1 else None


def _person(first: str, last: str) -> Node:
    """A name as typed or reversed, and only if no author has it its plain words."""
    first, last = (" ".join(re.findall(r"\w+", x.lower())) for x in (first, last))
    if first and last:
        names = [Node("term", term=f"author.fullname:{a} {b}") for a, b in ((first, last), (last, first))]
    else:
        names = [Node("term", term=f"author.{field}:{first or last}") for field in ("familyname", "givenname")]
    return Node("or", [*names, _simplify("and", [_grams(x) for x in (first, last) if x])], fallback=2)


def _piece(text: str, person: Person | None) -> Node:
    name, colon, rest = text.partition(":")
    if colon and (lowered := name.strip().lower()) in FIELDS:
        text = rest
        if lowered in ("year", "publicationdate.year"):
            if m := _RANGE.match(rest):
                return _years(int(m[1]), int(m[2]))
            return Node("term", term="publicationdate.year:" + rest.strip())
        if lowered == "doi":
            return Node("term", term="doi:" + rest.strip().lower())
        if lowered == "availablefield":
            return Node("term", term="availablefield:" + rest.strip().lower())
        if lowered == "author.fullname":
            return _full_name(rest)
        if lowered == "author":
            tokens = re.findall(r"[\w'’-]+", rest)
            return _person(tokens[0], tokens[-1] if len(tokens) > 1 else "") if tokens else ALL
        if lowered in ("title", "venue"):
            return _grams(rest, lowered + ":")
        return Node("term", term=f"{lowered}:" + " ".join(re.findall(r"\w+", rest.lower())))
    if m := _DOI.search(text):
        return Node("term", term="doi:" + m.group().lower().rstrip("."))
    if m := _RANGE.match(text):
        return _years(int(m[1]), int(m[2]))
    if colon and re.fullmatch(r"\s*[A-Za-z_.]+\s*", name):
        text = rest
    years = [w for w in re.findall(r"\w+", text) if _YEAR.match(w)]
    if years:
        return _simplify("and", [Node("term", term=f"publicationdate.year:{y}") for y in years])
    if name := (person or looks_like_name)(text):
        return _person(*name)
    return _grams(text)


def parse(text: str, person: Person | None = None) -> Node:
    """The node of a keyword query; ``person`` recognises names in free text (see ``looks_like_name``)."""

    def lowest(text: str, stages: tuple[str, ...]) -> Node:
        if not stages:
            return _piece(text, person) if text.strip() else ALL
        mark, rest = stages[0], stages[1:]
        if mark == "<NOT>":
            if mark not in text:
                return lowest(text, rest)
            inner = lowest(text.rpartition(mark)[2], rest)
            return ALL if inner.op == "all" else Node("not", [inner])
        return _simplify("and" if mark == "<AND>" else "or", [lowest(part, rest) for part in text.split(mark)])

    return lowest(text, ("<AND>", "<OR>", "<NOT>"))


def terms(node: Node) -> set[str]:
    return {node.term} if node.op == "term" else set().union(*(terms(p) for p in node.parts)) if node.parts else set()


def _fallbacks(node: Node) -> list[Node]:
    own = [node] if node.fallback is not None else []
    return own + [n for p in node.parts for n in _fallbacks(p)]


def condition(node: Node, has, usable: dict[int, bool] | None = None) -> Column:
    """The node as a Boolean column; ``has`` gives the column for a term."""
    if node.op == "all":
        return F.lit(True)
    if node.op == "term":
        return has(node.term)
    parts = node.parts
    if node.fallback is not None:
        first = (usable or {}).get(id(node), True)
        parts = parts[: node.fallback] if first else parts[node.fallback :]
    out = condition(parts[0], has, usable)
    if node.op == "not":
        return ~out
    for part in parts[1:]:
        more = condition(part, has, usable)
        out = out & more if node.op == "and" else out | more
    return out


def _settle(node: Node, exists) -> dict[int, bool]:
    """For each fallback, innermost first, whether its first parts match any document."""
    usable: dict[int, bool] = {}
    for n in reversed(_fallbacks(node)):
        usable[id(n)] = exists(Node("or", n.parts[: n.fallback]), usable)
    return usable


def match_rows(df: DataFrame, term_array: str, node: Node) -> DataFrame:
    """Rows whose array of terms satisfies the node: one filter, no shuffle."""
    has = lambda t: F.array_contains(term_array, t)
    usable = _settle(node, lambda n, u: not df.filter(condition(n, has, u)).isEmpty())
    return df.filter(condition(node, has, usable))


def _false_alone(node: Node) -> bool:
    """Whether a document with none of the terms fails the node."""
    if node.op in ("all", "not"):
        return False
    if node.op == "term":
        return True
    check = [_false_alone(p) for p in node.parts]
    return any(check) if node.op == "and" else all(check)


def match_postings(rows: DataFrame, universe: DataFrame, keys: list[str], node: Node) -> DataFrame:
    """Keys of the documents that satisfy the node.

    Only the postings of the node's terms are read; they are aggregated to one row of flags
    per document.  The universe is joined only where a document without any of the terms
    could match, as below a negation.
    """
    needed = sorted(terms(node))
    if not needed:
        return universe.select(*keys).distinct()
    found = rows.filter(F.col("term").isin(needed))
    flags = found.groupBy(*keys).agg(*[F.max(F.col("term") == t).alias(f"t{i}") for i, t in enumerate(needed)])
    column = {t: F.coalesce(F.col(f"t{i}"), F.lit(False)) for i, t in enumerate(needed)}
    usable = _settle(node, lambda n, u: not flags.filter(condition(n, column.__getitem__, u)).isEmpty())
    base = flags if _false_alone(node) else universe.select(*keys).distinct().join(flags, keys, "left")
    return base.filter(condition(node, column.__getitem__, usable)).select(*keys)
