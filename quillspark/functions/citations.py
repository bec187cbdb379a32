"""Citations of papers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _name(a: Column) -> Column:
    """Family, Given - or what there is of both."""
    return F.concat_ws(", ", F.nullif(_blank(a.familyname), F.lit("")), F.nullif(_blank(a.givenname), F.lit("")))


def people(authors: Column) -> Column:
    """Names of the authors that have one."""
    return F.filter(F.transform(F.coalesce(authors, F.array()), _name), lambda n: n != "")


def mla(authors: Column, title: Column, venue: Column, year: Column) -> Column:
    """First three authors, or the first and "et al", then title, venue and year."""
    names = people(authors)
    lead = F.when(F.size(names) > 3, F.concat(F.get(names, F.lit(0)), F.lit(" et al"))).otherwise(F.array_join(names, ", "))
    parts = F.array(lead, F.concat(F.lit('"'), _blank(title), F.lit('"')), _blank(venue), _blank(year))
    return F.concat(F.array_join(F.filter(parts, lambda p: (p != "") & (p != '""')), ". "), F.lit("."))


def bibtex(key: Column, authors: Column, title: Column, venue: Column, year: Column, doi: Column) -> Column:
    fields = [("author", F.array_join(people(authors), " and ")), ("title", _blank(title)), ("journal", _blank(venue)), ("year", _blank(year)), ("doi", _blank(doi))]
    lines = F.array(*[F.when(v != "", F.concat(F.lit(f"  {n} = {{"), v, F.lit("}"))) for n, v in fields])
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), F.array_join(F.array_compact(lines), ",\n"), F.lit("\n}"))


def with_source(entry: Column, collection: Column, ident: Column) -> Column:
    """Puts where the paper is stored into the head of a BibTeX entry."""
    note = F.concat(F.lit("paperIDInfo={collection:"), collection, F.lit(", id_int:"), ident.cast("string"), F.lit("}"))
    head = F.instr(entry, ",")
    return F.when(head > 0, F.concat(F.substring(entry, F.lit(1), head), F.lit(" "), note, F.lit(","), F.substring(entry, head + 1, F.length(entry)))).otherwise(entry)


def card(authors: Column) -> Column:
    """Up to three authors as initial and family name; "et al" for more."""
    names = F.filter(F.transform(F.coalesce(authors, F.array()), lambda a: F.trim(F.concat_ws(" ", F.nullif(F.substring(_blank(a.givenname), 1, 1), F.lit("")), _blank(a.familyname)))), lambda n: n != "")
    return F.when(F.size(names) > 3, F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.lit(" et al"))).otherwise(F.array_join(names, ", "))
