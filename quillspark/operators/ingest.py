"""From uploaded files to stored and indexed papers, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import lookup
from quillspark.session import Cut
from quillspark.sources import files as F_
from quillspark.sources.store import Store
from quillspark.streaming import refresh


def papers_of(parsed: DataFrame, collection: str) -> DataFrame:
    """Parsed documents with the columns of stored papers, but for the id; those without a title and an abstract are no papers."""
    text = lambda c: F.coalesce(c, F.lit(""))
    person = lambda a: F.struct(text(a.last).alias("familyname"), F.concat_ws(" ", F.nullif(a.first, F.lit("")), F.array_join(a.middle, " ")).alias("givenname"))
    date = lambda y: F.struct(text(y).alias("year"), F.lit("").alias("month"), F.lit("").alias("day"))
    empty = F.create_map().cast("map<string,string>")
    ids = lambda name: text(F.try_element_at(F.coalesce("ids", empty), F.lit(name)))
    reference = F.transform("bib_entries", lambda b: F.struct(text(b.title).alias("title"), F.transform(b.authors, person).alias("author"), date(b.year).alias("publicationdate"), text(b.venue).alias("venue"), text(b.raw_text).alias("referencetext")))
    out = parsed.filter("error is null").select(
        "file",
        F.lit(collection).alias("collection"),
        text(F.col("title")).alias("title"),
        F.array_join(F.transform("abstract", lambda p: p.text), " ").alias("abstract"),
        F.transform("authors", person).alias("author"),
        text(F.col("venue")).alias("venue"),
        ids("doi").alias("doi"),
        T.url_from_doi(ids("doi"), F.lit("")).alias("url"),
        date(F.col("year")).alias("publicationdate"),
        reference.alias("reference"),
        F.lit(True).alias("requireindexing"),
        F.unix_timestamp().alias("last_update_unixtime"),
    )
    return out.filter("trim(title) <> '' or trim(abstract) <> ''")


def index_files(store: Store, batch: DataFrame, collection: str, pdf: F_.Converter | None = None, latex: F_.Converter | None = None) -> DataFrame:
    """Stores and indexes the papers of a batch of files (pos, uploader, path, content); returns (path, status).

    Each content is taken once, the first of its copies, and not again from an uploader who has
    given it before; papers that a stored one duplicates are left out by the refresh.
    Status is 'indexed', 'known' or the error.
    """
    cut = Cut(batch.sparkSession)
    hashed = cut(batch.withColumn("md5", F.md5("content")))
    seen = store.read("files").select("md5", "uploader") if store.exists("files") else hashed.select("md5", "uploader").limit(0)
    fresh = cut(lookup.new_files(hashed, seen))
    parsed = cut(F_.convert(fresh, pdf, latex))
    found = papers_of(parsed, collection).withColumn("id_int", F.lit(None).cast("long"))
    last = store.largest("papers", "id_int") if store.exists("papers") else 0
    numbered = cut(lookup.append_with_ids(batch.sparkSession.createDataFrame([(last,)], "id_int long").join(found.drop("id_int").limit(0), F.lit(True), "left"), found, "id_int", [F.col("file")]).filter("file is not null"))
    refresh.refresh(store, numbered.drop("file"))
    store.append("files", fresh.select("md5", "uploader"))
    status = hashed.select("path", "md5").join(fresh.select("path", F.lit(True).alias("new")), "path", "left").join(parsed.select(F.col("file").alias("path"), "error"), "path", "left")
    return cut.only(status.select("path", F.when(F.col("new").isNull(), "known").otherwise(F.coalesce("error", F.lit("indexed"))).alias("status")))[0]
