"""The inverted index: terms of papers and documents, postings, counts and bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

FIELDS = ("author", "author.familyname", "author.givenname", "author.fullname", "title", "venue", "doi", "year", "publicationdate.year", "availablefield")


def _prefixed(field: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(field + ":"), v))


def grams(text: Column) -> Column:
    """Unigrams and bigrams of a text as it is indexed."""
    return T.let(T.index_words(F.coalesce(text, F.lit(""))), lambda tokens: F.array_union(T.unigrams(tokens), T.bigrams(tokens)))


def _whole(text: Column) -> Column:
    """A field's words joined by blanks, as one term."""
    return F.concat_ws(" ", T.words(F.coalesce(text, F.lit(""))))


def paper_terms() -> Column:
    """All distinct terms of a row of the paper table: words, fields and present fields."""
    title, abstract = F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))
    family = F.transform(F.coalesce("author", F.array()), lambda a: _whole(a.familyname))
    given = F.transform(F.coalesce("author", F.array()), lambda a: _whole(a.givenname))
    full = F.flatten(F.transform(F.coalesce("author", F.array()), lambda a: F.array(F.concat_ws(" ", T.words(a.givenname), T.words(a.familyname)), F.concat_ws(" ", T.words(a.familyname), T.words(a.givenname)))))
    year = F.coalesce(F.col("publicationdate.year"), F.lit(""))
    present = [
        F.when(F.size(F.coalesce("author", F.array())) > 0, "author"),
        F.when(F.trim(title) != "", "title"),
        F.when(F.trim(abstract) != "", "abstract"),
        F.when(F.trim(F.coalesce("venue", F.lit(""))) != "", "venue"),
        F.when(F.trim(F.coalesce("doi", F.lit(""))) != "", "doi"),
        F.when(F.trim(year) != "", "publicationdate.year"),
        F.when(F.size(F.coalesce("reference", F.array())) > 0, "reference"),
    ]
    single = F.array_compact(F.array(*[F.concat(F.lit("availablefield:"), p) for p in present]))
    parts = [
        grams(F.concat_ws(" . ", title, abstract)),
        _prefixed("title", grams(title)),
        _prefixed("venue", grams(F.col("venue"))),
        _prefixed("author.familyname", family),
        _prefixed("author.givenname", given),
        _prefixed("author.fullname", full),
        F.when(T.normal_doi(F.col("doi")) != "", F.array(F.concat(F.lit("doi:"), T.normal_doi(F.col("doi"))))).otherwise(F.array().cast("array<string>")),
        F.when(F.trim(year) != "", F.array(F.concat(F.lit("publicationdate.year:"), F.trim(year)))).otherwise(F.array().cast("array<string>")),
        single,
    ]
    return F.array_distinct(F.flatten(F.array(*parts)))


def postings(df: DataFrame, keys: list[str], terms: Column) -> DataFrame:
    """(term, keys...) rows, each once per document; terms are made distinct before they are exploded."""
    return df.select(*keys, F.explode(F.array_distinct(terms)).alias("term")).select("term", *keys)


def document_frequency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.count("*").alias("df"))


LIST_BUCKET = 1 << 16


def posting_lists(rows: DataFrame, key: str, bucket: int = LIST_BUCKET) -> DataFrame:
    """(term, bucket, ids): the sorted ids of each term's documents, a list for each range of ids, so that no list grows with the collection."""
    return rows.groupBy("term", F.floor(F.col(key) / bucket).alias("bucket")).agg(F.array_sort(F.collect_set(key)).alias("ids"))


def merge_lists(old: DataFrame, new: DataFrame) -> DataFrame:
    """Posting lists of both sides, united by term and bucket."""
    joined = old.withColumnRenamed("ids", "a").join(new.withColumnRenamed("ids", "b"), ["term", "bucket"], "full")
    empty = F.array().cast(dict(old.dtypes)["ids"])
    return joined.select("term", "bucket", F.array_sort(F.array_union(F.coalesce("a", empty), F.coalesce("b", empty))).alias("ids"))


def bitmaps(rows: DataFrame, key: str) -> DataFrame:
    """(term, bucket, bits): one bitmap per term and bucket of ids."""
    return rows.groupBy("term", F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def cardinality(maps: DataFrame) -> DataFrame:
    """Documents that hold any of the terms: the bitmaps of a bucket are united before they are counted."""
    return maps.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))
