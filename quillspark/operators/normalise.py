"""Raw records of any source as rows of the paper schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import citations
from quillspark.functions import text as T
from quillspark.operators import sections

SENTENCE = "struct<sentence_id:string,sentence_text:string,cite_spans:array<struct<start:string,end:string,text:string,ref_id:string>>>"


def clean(value: Column) -> Column:
    """Text without outer blanks; null for '' and for the word None alone."""
    trimmed = F.trim(value.cast("string"))
    return F.when(~trimmed.isin("", "None"), trimmed)


def people(authors: Column) -> Column:
    """Authors with a name, as family and given name."""
    named = F.transform(
        F.coalesce(authors, F.array()),
        lambda a: F.struct(F.trim(F.concat_ws(" ", clean(a["last"]), clean(a.suffix))).alias("familyname"), F.trim(F.concat_ws(" ", clean(a["first"]), F.array_join(F.coalesce(a.middle, F.array()), " "))).alias("givenname")),
    )
    return F.filter(named, lambda a: (a.familyname != "") | (a.givenname != ""))


def date(year: Column, month: Column | None = None, day: Column | None = None) -> Column:
    """Year, month and day as text; '' for what is no number."""
    whole = lambda c: F.coalesce(F.floor(c.try_cast("double")).cast("string"), F.lit("")) if c is not None else F.lit("")
    return F.struct(whole(year).alias("year"), whole(month).alias("month"), whole(day).alias("day"))


def references(bib: Column) -> Column:
    """Entries of a bibliography map in the order of their numbers, with a text made of their fields."""
    number = lambda k: F.coalesce(F.regexp_extract(k, r"(\d+)$", 1).try_cast("int"), F.lit(1 << 30))
    ordered = F.array_sort(F.transform(F.map_entries(F.coalesce(bib, F.create_map().cast("map<string,struct<title:string,authors:array<struct<first:string,middle:array<string>,last:string,suffix:string,email:string>>,year:string,venue:string,raw_text:string,links:string>>"))), lambda e: F.struct(number(e.key).alias("n"), e.key.alias("key"), e.value.alias("value"))))

    def entry(e: Column) -> Column:
        names = people(e.value.authors)
        made = citations.mla(names, e.value.title, e.value.venue, e.value.year)
        return F.struct(
            e.key.alias("key"), F.coalesce(clean(e.value.title), F.lit("")).alias("title"), names.alias("author"), date(e.value.year).alias("publicationdate"), F.coalesce(clean(e.value.venue), F.lit("")).alias("venue"), F.coalesce(clean(e.value.raw_text), made).alias("referencetext")
        )

    return F.transform(ordered, entry)


def join_parses(metadata: DataFrame, parses: DataFrame) -> DataFrame:
    """Metadata with the first parse of each paper, by file number and place in the file where these are known; blank abstracts are filled from the parsed ones."""
    order = F.struct(*[F.col(c) for c in ("file_number", "position") if c in parses.columns], F.xxhash64(F.to_json(F.struct("body_text"))).alias("_h"))
    one = parses.groupBy("paper_id").agg(F.min_by(F.struct("body_text", "bib_entries", F.col("abstract").alias("parsed_abstract")), order).alias("p"))
    joined = metadata.join(one, "paper_id", "left")
    own = F.nullif(F.trim(F.coalesce("abstract", F.lit(""))), F.lit(""))
    parsed = F.array_join(F.transform(F.coalesce("p.parsed_abstract", F.array()), lambda x: x.text), " ")
    return joined.withColumn("abstract", F.coalesce(own, parsed)).select(*metadata.columns, F.col("p.body_text").alias("body_text"), F.col("p.bib_entries").alias("bib_entries"))


def papers(raw: DataFrame, collection: str) -> DataFrame:
    """The paper schema of joined raw rows; rows without a title and an abstract are no papers."""
    title = F.regexp_replace(F.coalesce(clean(F.col("title")), F.lit("")), r"^\[+|\]+$", "")
    out = raw.select(
        F.lit(collection).alias("collection"),
        "paper_id",
        title.alias("title"),
        F.coalesce(clean(F.col("abstract")), F.lit("")).alias("abstract"),
        people(F.col("authors")).alias("author"),
        F.coalesce(clean(F.col("venue")), clean(F.col("journal")), F.lit("")).alias("venue"),
        F.coalesce(clean(F.col("doi")), F.lit("")).alias("doi"),
        T.url_from_doi(F.col("doi"), F.col("s2_url")).alias("url"),
        date(F.col("year")).alias("publicationdate"),
        references(F.col("bib_entries")).alias("reference"),
        *[F.coalesce(clean(F.col(c)), F.lit("")).alias(n) for c, n in (("pubmed_id", "pmid"), ("pmc_id", "pmcid"), ("arxiv_id", "arxivid"), ("acl_id", "aclid"), ("mag_id", "magid"))],
        F.lit(True).alias("requireindexing"),
        F.unix_timestamp().alias("last_update_unixtime"),
        "body_text",
        F.map_keys(F.coalesce("bib_entries", F.create_map().cast("map<string,string>") if "bib_entries" not in raw.columns else F.col("bib_entries"))).alias("bib_keys"),
    )
    return out.filter((F.col("title") != "") | (F.col("abstract") != ""))


def body(rows: DataFrame, key: str) -> DataFrame:
    """(key, section_id, section_title, paragraph_id, sentence_id, sentence_text, cite_spans) of body_text.

    Sections and numbers follow the paragraphs' order; spans are those that do not overlap, with
    offsets within their sentence and ref_id as the entry's place in the reference list.
    """
    paragraphs = rows.select(key, F.transform("reference", lambda r: r.key).alias("keys"), F.posexplode("body_text").alias("n", "p")).select(key, "keys", "n", F.col("p.section").alias("section"), T.squash(F.coalesce("p.text", F.lit(""))).alias("text"), sections.without_overlap(sections.typed_spans(F.col("p.cite_spans"))).alias("spans"))
    built = sections.build_sections(paragraphs, [key], [F.col("n")], "section")
    split = built.select(key, "keys", "section_id", F.col("section_name").alias("section_title"), "paragraph_id", "text", "spans", F.posexplode(T.split_sentences(F.col("text"))).alias("sentence_id", "sentence_text"))
    # sentences follow one another with one blank between, so their starts are sums of lengths
    by = Window.partitionBy(key, "section_id", "paragraph_id").orderBy("sentence_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = split.withColumn("at", F.coalesce(F.sum(F.length("sentence_text") + 1).over(by), F.lit(0)).cast("int"))
    end = F.col("at") + F.length("sentence_text")
    inside = F.filter("spans", lambda s: (s.start >= F.col("at")) & (s.end <= end))
    shifted = F.transform(inside, lambda s: F.struct((s.start - F.col("at")).cast("string").alias("start"), (s.end - F.col("at")).cast("string").alias("end"), s.text.alias("text"), F.when(F.array_contains("keys", s.ref_id), (F.array_position("keys", s.ref_id) - 1).cast("string")).otherwise("").alias("ref_id")))
    return placed.select(key, "section_id", "section_title", "paragraph_id", "sentence_id", "sentence_text", shifted.alias("cite_spans"))
