"""Writing papers as release documents, and reading all layouts of such documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

LAYOUTS = ("current", "2019", "2020")


def layout(columns: list[str]) -> str:
    """Which layout a document of these fields has: its parse under pdf_parse (or latex_parse), under grobid_parse, or at the top."""
    held = set(columns)
    return "current" if {"pdf_parse", "latex_parse"} & held else "2019" if "grobid_parse" in held else "2020"


def _field(df: DataFrame, path: str) -> Column | None:
    kind: types.DataType = df.schema
    for name in path.split("."):
        if not isinstance(kind, types.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return F.col(path)


def _first(df: DataFrame, paths: list[str], default: Column) -> Column:
    found = [c for c in (_field(df, p) for p in paths) if c is not None]
    return F.coalesce(*found, default) if found else default


def by_id(entries: Column) -> Column:
    """An array of entries with ref_id as a map; of equal ids the last counts, nameless ones are left out."""
    kept = F.filter(entries, lambda e, i: e.ref_id.isNotNull() & ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later.ref_id == e.ref_id))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e.ref_id, e)))


def release_json(papers: DataFrame, ident: str, generated_with: str, day: str, parse: str = "pdf_parse") -> DataFrame:
    """(ident, document): each parsed paper as the text of one release document of the current layout."""
    people = F.transform(
        F.coalesce("authors", F.array().cast(papers.schema["authors"].dataType)),
        lambda a: F.struct(
            a.first.alias("first"), a.middle.alias("middle"), a.last.alias("last"), a.suffix.alias("suffix"), F.struct(F.coalesce(F.get(a.affiliations, F.lit(0)), F.lit("")).alias("institution")).alias("affiliation"), a.email.alias("email")
        ),
    )
    whole = lambda ps: F.array_join(F.transform(F.coalesce(ps, F.array().cast(papers.schema["abstract"].dataType)), lambda p: p.text), "\n")
    parsed = F.struct(F.col(ident).cast("string").alias("paper_id"), "abstract", "body_text", "back_matter", by_id(F.col("bib_entries")).alias("bib_entries"), by_id(F.col("ref_entries")).alias("ref_entries"))
    document = F.struct(
        F.col(ident).cast("string").alias("paper_id"),
        F.struct(F.lit(generated_with).alias("generated_with"), F.lit(day).alias("date_generated")).alias("header"),
        "title", people.alias("authors"), "year", "venue", F.col("ids").alias("identifiers"), whole(F.col("abstract")).alias("abstract"), parsed.alias(parse),
    )
    return papers.select(ident, F.to_json(document).alias("document"))


def read_release(documents: DataFrame) -> DataFrame:
    """Documents of any layout, already parsed into columns, in one form: paper_id, title, authors, year, venue, abstract, body_text, back_matter, bib_entries."""
    under = {"current": ["pdf_parse", "latex_parse"], "2019": ["grobid_parse"], "2020": []}[layout(documents.columns)]
    none = F.lit(None)
    inside = lambda name: [*(f"{u}.{name}" for u in under), name]
    head = lambda name: [name, f"metadata.{name}"]
    columns = [_first(documents, head(n), none).alias(n) for n in ("title", "authors", "year", "venue")]
    # the abstract of a parse, an array of paragraphs, is preferred to the plain one
    abstract = next((c for c in (_field(documents, p) for p in [*(f"{u}.abstract" for u in under), "abstract", "metadata.abstract"]) if c is not None), none)
    return documents.select("paper_id", *columns, abstract.alias("abstract"), *[_first(documents, inside(n), none).alias(n) for n in ("body_text", "back_matter", "bib_entries")])


def raw_text(paragraphs: Column) -> Column:
    """The text of paragraphs, one a line."""
    return F.array_join(F.transform(paragraphs, lambda p: p.text), "\n")
