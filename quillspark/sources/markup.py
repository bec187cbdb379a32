"""Papers from XML: journal articles (JATS), parsed PDFs (TEI) and their references.

A document is walked once; inline references become spans whose offsets are those of the
paragraph's text after its white space is squashed.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

_PERSON = "struct<first:string,middle:array<string>,last:string,suffix:string,email:string,affiliations:array<string>,orcid:string>"
_SPAN = "struct<start:int,end:int,text:string,ref_id:string>"
_EQUATION = "struct<start:int,end:int,text:string,latex:string,mathml:string,ref_id:string>"
_PARA = f"struct<section:string,sec_num:string,text:string,cite_spans:array<{_SPAN}>,ref_spans:array<{_SPAN}>,eq_spans:array<{_EQUATION}>>"
_BIB = f"struct<ref_id:string,title:string,authors:array<{_PERSON}>,year:string,venue:string,volume:string,issue:string,pages:string,doi:string,num:string,urls:array<string>,raw_text:string>"
_FLOAT = "struct<ref_id:string,kind:string,text:string,html:string,latex:string,mathml:string,uris:array<string>,num:string,parent:string>"
FIELDS = ["title", "authors", "year", "venue", "ids", "subjects", "abstract", "body_text", "back_matter", "bib_entries", "ref_entries", "funding", "conflicts", "supplements"]
SCHEMA = (
    f"title string, authors array<{_PERSON}>, year string, venue string, ids map<string,string>, subjects array<string>, abstract array<{_PARA}>, body_text array<{_PARA}>, back_matter array<{_PARA}>, "
    f"bib_entries array<{_BIB}>, ref_entries array<{_FLOAT}>, funding array<string>, conflicts array<string>, supplements array<string>"
)


def _bare(root: ET.Element) -> ET.Element:
    """Drops namespaces from all tags and attributes."""
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2]
        e.attrib = {k.rpartition("}")[2]: v for k, v in e.attrib.items()}
    return root


def text_of(e: ET.Element | None) -> str:
    return "" if e is None else " ".join("".join(e.itertext()).split())


class Paragraph:
    """Collects text with squashed white space and the spans in it."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.blank = True
        self.cites: list[dict] = []
        self.refs: list[dict] = []
        self.equations: list[dict] = []

    def add(self, text: str | None) -> None:
        for piece in re.findall(r"\s+|\S+", text or ""):
            if piece.isspace():
                if not self.blank:
                    self.parts.append(" ")
                    self.size += 1
                    self.blank = True
            else:
                self.parts.append(piece)
                self.size += len(piece)
                self.blank = False

    def walk(self, e: ET.Element, kinds) -> None:
        """Adds an element's text; ``kinds`` says for an element whether it cites ('cite'), points ('ref'), is a formula ('math'), is left out ('skip') or is plain ('')."""
        self.add(e.text)
        for child in e:
            kind, target = kinds(child)
            if kind == "math":
                text, latex, mathml = formula(child)
                begin = self.size
                self.add(text)
                if self.size > begin:
                    self.equations.append({**self._span(begin, target), "latex": latex, "mathml": mathml})
            elif kind != "skip":
                begin = self.size
                self.walk(child, kinds)
                if kind and self.size > begin and (span := self._span(begin, target)):
                    (self.cites if kind == "cite" else self.refs).append(span)
            self.add(child.tail)

    def _span(self, begin: int, target: str | None) -> dict | None:
        """The span of the text added since ``begin``, without white space at its ends."""
        text = "".join(self.parts)[begin : self.size]
        lead = len(text) - len(text.lstrip())
        text = text.strip()
        return {"start": begin + lead, "end": begin + lead + len(text), "text": text, "ref_id": target} if text else None

    def done(self, section: str, number: str | None) -> dict | None:
        text = "".join(self.parts).rstrip()
        return {"section": section, "sec_num": number, "text": text, "cite_spans": self.cites, "ref_spans": self.refs, "eq_spans": self.equations} if text else None


def paragraph(e: ET.Element, kinds, section: str, number: str | None = None, before: str = "") -> list[dict]:
    """The element as one paragraph, or nothing if it has no text."""
    p = Paragraph()
    p.add(before)
    p.walk(e, kinds)
    made = p.done(section, number)
    return [made] if made else []


def formula(e: ET.Element) -> tuple[str, str | None, str | None]:
    """(text, LaTeX, MathML) of a formula; the text is its LaTeX source where it has one, without the wrapping of a document."""
    source = next((x for x in e.iter() if x.tag in ("tex-math", "texmath", "latex")), None)
    math = next((x for x in e.iter() if x.tag == "math"), None)
    latex = None
    if source is not None:
        inner = re.search(r"\\begin\{document\}(.*?)\\end\{document\}", "".join(source.itertext()), re.S)
        latex = " ".join((inner.group(1) if inner else "".join(source.itertext())).split())
    mathml = None
    if math is not None:
        held, math.tail = math.tail, None
        mathml, math.tail = ET.tostring(math, encoding="unicode"), held
    elif e.get("type") == "math" or source is None:
        latex = latex or (text_of(e) if e.get("notation", "").lower() == "tex" else None)
    label = text_of(e.find("label"))
    text = latex or text_of(math if math is not None else e)
    return " ".join(filter(None, [text, label if label and label not in text else ""])), latex, mathml


def entry(ref_id: str | None, kind: str, text: str, html: str = "", latex: str | None = None, mathml: str | None = None, uris: list[str] | None = None, num: str | None = None, parent: str | None = None) -> dict:
    return {"ref_id": ref_id, "kind": kind, "text": text, "html": html, "latex": latex, "mathml": mathml, "uris": uris or [], "num": num or None, "parent": parent}


def links(e: ET.Element) -> list[str]:
    """Addresses of the graphics and links below an element."""
    found = [x.get("href") or x.get("url") or x.get("file") for x in e.iter() if x.tag in ("graphic", "media", "ext-link", "uri", "xref", "ptr", "ref")]
    return [u for u in dict.fromkeys(found) if u]


def counted(text: str) -> str | None:
    """The number in a label such as Figure 2a."""
    m = re.search(r"\d+[A-Za-z]?(?:\.\d+)*", text)
    return m.group() if m else None


# The labels of the targets of references, by the beginnings of their ids.
LABELS = {"BIBREF": ("b", "bib", "bibr", "ref", "cr"), "FIGREF": ("fig", "f"), "TABREF": ("tab", "t"), "FORMREF": ("formula", "eq"), "FOOTREF": ("foot", "fn"), "SECREF": ("sec",)}
_LABEL_OF = {prefix: label for label, prefixes in LABELS.items() for prefix in prefixes}


def ref_name(target: str | None) -> str | None:
    """One form of the ids that point to references, figures, tables and formulas."""
    m = re.match(r"#?([a-z]+)[_\-]?0*(\d+)", target or "", re.I)
    label = _LABEL_OF.get(m.group(1).lower()) if m else None
    return f"{label}{m.group(2)}" if label else (target or "").lstrip("#") or None


def _person(first: str, last: str, suffix: str = "", email: str = "", places: list[str] | None = None, orcid: str = "") -> dict:
    names = first.split()
    number = re.search(r"\d{4}-\d{4}-\d{4}-\d{3}[\dX]", orcid)
    return {"first": names[0] if names else "", "middle": names[1:], "last": last, "suffix": suffix, "email": email, "affiliations": places or [], "orcid": number.group() if number else ""}


def merge_people(people: list[dict]) -> list[dict]:
    """Each name once, in order; later addresses and affiliations that are not empty win; nameless entries go."""
    out: dict[tuple, dict] = {}
    for p in people:
        if not (p["first"] or p["last"]):
            continue
        key = (p["first"].lower(), tuple(m.lower() for m in p["middle"]), p["last"].lower())
        held = out.setdefault(key, p)
        held["email"] = p["email"] or held["email"]
        held["affiliations"] = p["affiliations"] or held["affiliations"]
        held["orcid"] = p["orcid"] or held["orcid"]
    return list(out.values())


def table_html(e: ET.Element) -> str:
    """The rows of a table as plain HTML; rows of an unusual length are left out."""
    rows = [[(c.tag == "th", text_of(c)) for c in row if c.tag in ("td", "th", "cell")] for row in e.iter() if row.tag in ("tr", "row")]
    sizes = [len(r) for r in rows if r]
    if not sizes:
        return ""
    usual = max(set(sizes), key=lambda n: (sizes.count(n), n))
    cells = lambda r: "".join(f"<{t}>{v}</{t}>" for t, v in (("th" if h else "td", v) for h, v in r))
    return "<table>" + "".join(f"<tr>{cells(r)}</tr>" for r in rows if len(r) == usual) + "</table>"


# ------------------------------------------------------------------ journal articles


_JATS_APART = ("fig", "fig-group", "table-wrap", "table-wrap-group", "supplementary-material", "ref-list", "fn-group", "fn", "title", "label", "sec-meta")
_JATS_LEAF = ("p", "disp-formula", "def", "verse-line", "attrib", "preformat", "code")


def _jats_kind(e: ET.Element) -> tuple[str, str | None]:
    if e.tag == "xref":
        return ("cite" if e.get("ref-type") == "bibr" else "ref", ref_name(e.get("rid")))
    if e.tag in ("disp-formula", "inline-formula"):
        return ("math", ref_name(e.get("id")))
    return ("skip", None) if e.tag in _JATS_APART else ("", None)


def _jats_paragraphs(e: ET.Element, path: list[str]) -> list[dict]:
    """Paragraphs in reading order; what lies in containers without a meaning of their own is not lost."""
    out = []
    for child in e:
        if child.tag in _JATS_APART or not isinstance(child.tag, str):
            continue
        title = text_of(child.find("title"))
        if child.tag in _JATS_LEAF or child.tag == "list-item" and child.find("list") is None:
            out += paragraph(child if child.tag != "disp-formula" else _wrapped(child), _jats_kind, " :: ".join(path))
        elif child.tag in ("sec", "app", "ack", "notes", "glossary", "bio", "abstract", "trans-abstract") or title:
            out += _jats_paragraphs(child, [*path, title] if title else path)
        elif len(child):
            out += _jats_paragraphs(child, path)
        else:
            out += paragraph(child, _jats_kind, " :: ".join(path))
    return out


def _wrapped(e: ET.Element) -> ET.Element:
    """A formula that stands alone, as the only child of a paragraph."""
    p = ET.Element("p")
    p.append(e)
    return p


def _jats_back(article: ET.Element) -> list[dict]:
    back = article.find("back")
    out = []
    for child in [] if back is None else back:
        name = {"ack": "Acknowledgements", "glossary": "Glossary"}.get(child.tag, "")
        if child.tag == "fn-group":
            for fn in child.iter("fn"):
                out += paragraph(fn, lambda e: _jats_kind(e) if e.tag not in ("title",) else ("", None), text_of(child.find("title")) or "Footnotes")
        elif child.tag != "ref-list":
            title = text_of(child.find("title")) or name
            out += _jats_paragraphs(child, [title] if title else [])
    return out


def _jats_floats(article: ET.Element) -> list[dict]:
    out = []
    for f in article.iter():
        ident, label = ref_name(f.get("id")), text_of(f.find("label"))
        told = " ".join(filter(None, [label, text_of(f.find("caption"))]))
        if f.tag in ("fig", "table-wrap"):
            out.append(entry(ident, "figure" if f.tag == "fig" else "table", told, table_html(f) if f.tag == "table-wrap" else "", uris=links(f), num=counted(label)))
        elif f.tag == "disp-formula" and (ident or label):
            text, latex, mathml = formula(f)
            out.append(entry(ident, "formula", text, "", latex, mathml, num=counted(label)))
        elif f.tag == "fn":
            out.append(entry(ident, "footnote", text_of(f), num=counted(label)))
    return out


def _jats_year(meta: ET.Element) -> str:
    years = {}
    for date in meta.iter("pub-date"):
        years.setdefault(date.get("pub-type") or date.get("date-type") or "", text_of(date.find("year")))
    for date in meta.iter("date"):
        years.setdefault(date.get("date-type") or "", text_of(date.find("year")))
    for kind in ("epub", "accepted", "collection", "ppub", "pub", "received"):
        if years.get(kind):
            return years[kind]
    return next((y for y in years.values() if y), "")


def _jats_people(meta: ET.Element) -> list[dict]:
    places = {a.get("id"): " ".join("".join(x for x in ([a.text] + [t for c in a for t in ((text_of(c) if c.tag not in ("label", "sup") else ""), c.tail)]) if x).split()) for a in meta.iter("aff")}
    people = []
    for c in meta.iter("contrib"):
        if c.get("contrib-type", "author") != "author":
            continue
        orcid = next((text_of(i) for i in c.findall("contrib-id") if i.get("contrib-id-type") == "orcid"), "")
        if c.find("name") is None:
            if text_of(c.find("collab")):
                people.append(_person("", text_of(c.find("collab"))))
            continue
        mine = [places[x.get("rid")] for x in c.findall("xref") if x.get("ref-type") == "aff" and x.get("rid") in places]
        mine += [text_of(a) for a in c.findall("aff")]
        people.append(_person(text_of(c.find("name/given-names")), text_of(c.find("name/surname")), text_of(c.find("name/suffix")), text_of(c.find(".//email")), mine, orcid))
    return merge_people(people)


def _jats_bib(root: ET.Element) -> list[dict]:
    out = []
    for i, ref in enumerate(root.iter("ref")):
        cited = next((ref.find(t) for t in ("mixed-citation", "element-citation", "citation", "nlm-citation") if ref.find(t) is not None), None)
        if cited is None:
            continue
        people = [_person(text_of(n.find("given-names")), text_of(n.find("surname"))) for n in cited.iter("name")]
        ids = {p.get("pub-id-type"): text_of(p) for p in cited.iter("pub-id")}
        out.append({"ref_id": ref_name(ref.get("id")) or f"BIBREF{i}", "title": text_of(cited.find("article-title")) or text_of(cited.find("chapter-title")), "authors": people, "year": text_of(cited.find("year")), "venue": text_of(cited.find("source")), "volume": text_of(cited.find("volume")), "issue": text_of(cited.find("issue")), "pages": "-".join(filter(None, [text_of(cited.find("fpage")), text_of(cited.find("lpage"))])), "doi": ids.get("doi", ""), "num": counted(text_of(ref.find("label"))), "urls": links(cited), "raw_text": text_of(cited)})
    return out


def parse_jats(root: ET.Element) -> dict:
    article = root if root.tag == "article" else root.find(".//article")
    if article is None:
        raise ValueError("no article")
    meta = article.find("front/article-meta")
    meta = meta if meta is not None else ET.Element("article-meta")
    body = article.find("body")
    abstract = [p for a in meta.findall("abstract") for p in _jats_paragraphs(a, [text_of(a.find("title"))] if a.find("title") is not None else [])]
    # an abstract without paragraphs is one
    abstract = abstract or [p for a in meta.findall("abstract") for p in paragraph(a, _jats_kind, "")]
    title = " ".join(filter(None, [text_of(meta.find("title-group/article-title")), text_of(meta.find("title-group/subtitle"))]))
    journal = article.find("front/journal-meta")
    venue = "" if journal is None else text_of(journal.find(".//journal-title")) or text_of(journal.find("journal-id"))
    return {
        "title": title,
        "authors": _jats_people(meta),
        "year": _jats_year(meta),
        "venue": venue,
        "ids": {i.get("pub-id-type", ""): text_of(i) for i in meta.findall("article-id")},
        "subjects": [text_of(s) for s in meta.iter("subject")],
        "abstract": abstract,
        "body_text": _jats_paragraphs(body, []) if body is not None else [],
        "back_matter": _jats_back(article),
        "bib_entries": _jats_bib(article),
        "ref_entries": _jats_floats(article),
        "funding": list(dict.fromkeys(filter(None, [text_of(x) for x in meta.iter() if x.tag in ("funding-statement", "award-id", "funding-source")]))),
        "conflicts": [text_of(f) for f in article.iter("fn") if f.get("fn-type", "").lower() in ("conflict", "coi-statement", "con")],
        "supplements": [" ".join(filter(None, [text_of(x.find("label")), text_of(x.find("caption"))])) or (links(x) or [x.get("href") or ""])[0] for x in article.iter("supplementary-material")],
    }


# ------------------------------------------------------------------ parsed PDFs


def _tei_kind(e: ET.Element) -> tuple[str, str | None]:
    if e.tag == "ref":
        return ("cite" if e.get("type") == "bibr" else "ref", ref_name(e.get("target")))
    if e.tag == "formula":
        return ("math", ref_name(e.get("id")))
    return ("skip", None) if e.tag in ("figure", "note", "head") else ("", None)


def _tei_people(e: ET.Element | None) -> list[dict]:
    people = []
    for a in [] if e is None else e.iter("author"):
        name = a.find("persName")
        if name is None:
            continue
        first = " ".join(text_of(n) for n in name.findall("forename"))
        places = [text_of(x) for x in a.findall("affiliation")]
        orcid = next((text_of(x) for x in a.findall("idno") if x.get("type", "").upper() == "ORCID"), "")
        people.append(_person(first, text_of(name.find("surname")), text_of(name.find("genName")), text_of(a.find("email")), places, orcid))
    return merge_people(people)


def _tei_year(e: ET.Element | None) -> str:
    for date in [] if e is None else e.iter("date"):
        if m := re.match(r"(?:19|20)\d\d", date.get("when", "") or text_of(date)):
            return m.group()
    return ""


def _tei_paragraphs(e: ET.Element, section: str = "", number: str | None = None) -> list[dict]:
    """Paragraphs in reading order under the last heading; notes are paragraphs of their own, after the one they stand in."""
    out = []
    for item in e:
        if item.tag == "head":
            section, number = text_of(item), item.get("n")
        elif item.tag == "div":
            out += _tei_paragraphs(item, section, number)
        elif item.tag == "listBibl" or item.tag == "figure":
            continue
        elif item.tag == "formula":
            out += paragraph(_wrapped(item), _tei_kind, section, number)
        elif item.tag == "note":
            out += paragraph(item, _tei_kind, section, number)
        elif item.tag in ("list", "quote") and item.find("item") is not None:
            for x in item.iter("item"):
                out += paragraph(x, _tei_kind, section, number)
        else:
            out += paragraph(item, _tei_kind, section, number)
            for note in item.iter("note"):
                out += paragraph(note, _tei_kind, section, number)
    return out


def _tei_floats(root: ET.Element) -> list[dict]:
    out = []
    for f in root.iter():
        ident, label = ref_name(f.get("id")), text_of(f.find("label"))
        if f.tag == "figure":
            table = f.get("type") == "table"
            out.append(entry(ident, "table" if table else "figure", text_of(f.find("figDesc")) or text_of(f.find("head")), table_html(f) if table else "", uris=links(f), num=counted(label or text_of(f.find("head")))))
        elif f.tag == "formula" and ident:
            text, latex, mathml = formula(f)
            out.append(entry(ident, "formula", text, "", latex, mathml, num=counted(label)))
        elif f.tag == "note" and f.get("place") in ("foot", "margin"):
            out.append(entry(ident, "footnote", text_of(f), num=f.get("n")))
    return out


def parse_tei(root: ET.Element) -> dict:
    header = root.find("teiHeader/fileDesc")
    header = header if header is not None else ET.Element("fileDesc")
    source = header.find("sourceDesc/biblStruct")
    bib = []
    for i, b in enumerate(root.findall(".//listBibl/biblStruct")):
        title = b.find("analytic/title") if b.find("analytic/title") is not None else b.find("monogr/title")
        scope = {s.get("unit"): text_of(s) or "-".join(filter(None, [s.get("from"), s.get("to")])) for s in b.iter("biblScope")}
        ids = {x.get("type", "").lower(): text_of(x) for x in b.iter("idno")}
        bib.append({"ref_id": ref_name(b.get("id")) or f"BIBREF{i}", "title": text_of(title), "authors": _tei_people(b), "year": _tei_year(b), "venue": text_of(b.find("monogr/title")) if b.find("analytic/title") is not None else "", "volume": scope.get("volume", ""), "issue": scope.get("issue", ""), "pages": scope.get("page", ""), "doi": ids.get("doi", ""), "num": None, "urls": links(b), "raw_text": next((text_of(n) for n in b.iter("note") if n.get("type") == "raw_reference"), "")})
    body, abstract = root.find("text/body"), root.find("teiHeader/profileDesc/abstract")
    back = root.find("text/back")
    return {
        "title": text_of(header.find("titleStmt/title")),
        "authors": _tei_people(source),
        "year": _tei_year(header),
        "venue": text_of(source.find("monogr/title")) if source is not None else "",
        "ids": {x.get("type", "").lower(): text_of(x) for x in header.iter("idno")},
        "subjects": [text_of(t) for t in root.iter("term")],
        "abstract": _tei_paragraphs(abstract) if abstract is not None else [],
        "body_text": _tei_paragraphs(body) if body is not None else [],
        "back_matter": _tei_paragraphs(back) if back is not None else [],
        "bib_entries": bib,
        "ref_entries": _tei_floats(root),
        "funding": list(dict.fromkeys(filter(None, [text_of(x) for x in root.iter("funder")] + [text_of(x) for d in root.iter("div") if d.get("type") == "funding" for x in d.iter("p")]))),
        "conflicts": [text_of(d) for d in root.iter("div") if d.get("type") in ("conflict", "coi")],
        "supplements": [],
    }


# ------------------------------------------------------------------ LaTeX as XML


_TEX_APART = ("figure", "table", "float", "bibliography", "biblio", "maketitle", "titlepage", "abstract", "keywords", "title", "author", "date", "head")


def _tex_kind(e: ET.Element) -> tuple[str, str | None]:
    if e.tag == "cit" or e.tag == "ref" and (e.get("target") or "").startswith(("bid", "cite")):
        return "cite", re.sub(r"^(?:bid|cite)", "BIBREF", (e.get("target") or (e.find("ref").get("target") if e.find("ref") is not None else "")) or "")
    if e.tag == "ref":
        return "ref", re.sub(r"^(?:cid|uid|formula)", "SECREF", e.get("target") or "")
    if e.tag == "formula":
        return "math", re.sub(r"^(?:uid|formula)", "FORMREF", e.get("id") or "") or None
    return ("skip", None) if e.tag in (*_TEX_APART, "note") else ("", None)


def _tex_paragraphs(e: ET.Element, path: list[str]) -> list[dict]:
    """Paragraphs in reading order; items of lists are paragraphs, numbers of ordered lists stand before them, and footnotes follow."""
    out = []
    for child in e:
        if child.tag in _TEX_APART or child.tag in ("bibitem", "note"):
            continue
        section = "::".join(path)
        if re.fullmatch(r"div\d", child.tag) or child.tag == "section":
            title = text_of(child.find("head"))
            out += _tex_paragraphs(child, [*path, title] if title else path)
        elif child.tag == "list":
            for n, item in enumerate(child.findall("item"), 1):
                out += paragraph(item, _tex_kind, section, before=f"{n}. " if child.get("type") == "ordered" else "")
        elif child.tag in ("p", "formula") or not any(x.tag in ("p", "list", "section") or re.fullmatch(r"div\d", x.tag) for x in child.iter()):
            out += paragraph(_wrapped(child) if child.tag == "formula" else child, _tex_kind, section)
        else:
            out += _tex_paragraphs(child, path)
    return out


# What may stand after a family name.
SUFFIXES = frozenset("jr sr ii iii iv v phd md".split())


def split_person(text: str) -> dict:
    """A name as typed, whose last word is the family name unless it is a suffix; "Family, Given" is turned round."""
    left, comma, right = text.partition(",")
    if comma and right.strip().lower().rstrip(".") not in SUFFIXES:
        text = f"{right.strip()} {left.strip()}"
    else:
        text = text.replace(",", " ")
    words, suffix = text.split(), ""
    while len(words) > 1 and words[-1].lower().strip(".") in SUFFIXES:
        suffix = f"{words.pop()} {suffix}".strip()
    return _person(" ".join(words[:-1]), words[-1] if words else "", suffix)


def _tex_people(root: ET.Element) -> list[dict]:
    """Authors of the front matter; several in one element are set apart by "and" or line ends."""
    people = []
    for a in root.iter("author"):
        place = [text_of(x) for x in a.iter() if x.tag in ("affil", "affiliation", "address")]
        email = next((text_of(x) for x in a.iter("email")), "")
        own = "".join(([a.text or ""] + [(text_of(c) if c.tag not in ("affil", "affiliation", "address", "email", "note", "thanks") else "") + (c.tail or "") for c in a]))
        for name in re.split(r"\s+and\s+|\n|;|\\\\and", own):
            if name.strip():
                people.append({**split_person(name), "affiliations": place, "email": email})
    return merge_people(people)


def guess_reference(text: str) -> dict:
    """What a reference's text shows without a parser: year, DOI, addresses, a title in quotation marks, volume and pages."""
    years = re.findall(r"\b(?:19|20)\d\d\b", text)
    title = re.search(r"[“\"‘]{1,2}(.{6,}?)[,.]?[”\"’]{1,2}", text)
    doi = re.search(r"10\.\d{4,9}/\S+[^\s.,;)]", text)
    pages = re.search(r"\b(\d{1,5})\s*[-–]{1,2}\s*(\d{1,5})\b", text)
    volume = re.search(r"\b(?:vol\.?|volume)\s*(\d+)|\b(\d{1,4})\s*\((\d{1,4})\)", text, re.I)
    return {
        "title": title.group(1).strip() if title else "", "authors": [], "year": years[-1] if years else "", "venue": "", "volume": (volume.group(1) or volume.group(2)) if volume else "", "issue": (volume.group(3) or "") if volume else "",
        "pages": f"{pages.group(1)}-{pages.group(2)}" if pages else "", "doi": doi.group() if doi else "", "urls": re.findall(r"https?://[^\s,;]+[^\s,;.)]", text),
    }


def parse_tex(root: ET.Element, reader=guess_reference) -> dict:
    """``reader`` takes a reference's text apart; a service that parses references can stand in for the default."""
    bib = []
    for i, b in enumerate(root.iter("bibitem")):
        text = text_of(b)
        bib.append({**reader(text), "ref_id": re.sub(r"^(?:bid|cite)", "BIBREF", b.get("id") or f"BIBREF{i}"), "num": counted(b.get("label") or ""), "raw_text": text})
    abstract = []
    for e in root.iter("abstract"):
        inner = e.findall("p")
        for x in inner or [e]:
            abstract += paragraph(x, _tex_kind, "Abstract")
    floats = []
    for f in root.iter():
        if f.tag in ("figure", "table"):
            floats.append(entry(f.get("id"), f.tag, text_of(f.find("caption")) or text_of(f.find("head")), table_html(f) if f.tag == "table" else "", uris=links(f), num=f.get("id-text")))
        elif f.tag == "formula" and f.get("id"):
            text, latex, mathml = formula(f)
            floats.append(entry(re.sub(r"^(?:uid|formula)", "FORMREF", f.get("id")), "formula", text, "", latex, mathml, num=f.get("id-text")))
    floats += [entry(f"FOOTREF{i}", "footnote", text_of(n), num=n.get("id-text")) for i, n in enumerate(root.iter("note"))]
    front = root.find(".//maketitle")
    title = text_of(next((x for x in (front.find("title") if front is not None else None, root.find("title"), root.find(".//titlepage/title"), root.find(".//title")) if x is not None), None))
    return {
        "title": title, "authors": _tex_people(root), "year": "", "venue": "", "ids": {}, "subjects": [text_of(k) for k in root.iter("keywords")], "abstract": abstract, "body_text": _tex_paragraphs(root, []), "back_matter": [],
        "bib_entries": bib, "ref_entries": floats, "funding": [], "conflicts": [], "supplements": [],
    }


def parse(content: bytes) -> dict:
    root = _bare(ET.fromstring(content))
    if root.tag == "TEI":
        return parse_tei(root)
    if root.tag in ("article", "pmc-articleset", "articles"):
        return parse_jats(root)
    if root.tag in ("std", "unknown", "latex", "document"):
        return parse_tex(root)
    raise ValueError(f"no reader for <{root.tag}>")
