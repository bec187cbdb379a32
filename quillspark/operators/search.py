"""Retrieval: filtered vector search, re-ranking, promotion and title resolution."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import bands, lookup, vectors
from quillspark.session import Cut

PREFETCH, RESULTS = 1000, 100


def search(matching: DataFrame, embeddings: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """The n matching documents nearest each query; matching has id, embeddings id and v, queries query_id and v.

    The matching vectors are written once, so that the filter is not run again for their number.
    """
    return vectors.top_k(Cut(embeddings.sparkSession)(embeddings.join(matching.select("id"), "id", "left_semi")), queries, n)


def per_collection(ranked: DataFrame, collection: str, n: int) -> DataFrame:
    """At most n rows of each collection and query, ranked anew over all."""
    by = Window.partitionBy("query_id", collection).orderBy(F.desc("similarity"), "id")
    kept = ranked.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= n).drop("_r", "rank")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")))


def without_repeats(ranked: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each query and key, in order."""
    by = Window.partitionBy("query_id", key).orderBy(*order)
    return ranked.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def section_rerank(sections: DataFrame) -> DataFrame:
    """(query_id, id, similarity, rank) of documents by their best section, not below 0; sections has query_id, id, similarity."""
    best = sections.groupBy("query_id", "id").agg(F.greatest(F.max("similarity"), F.lit(0.0)).alias("similarity"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")))


def promote(ranked: DataFrame, similarity: str, first: int = 10, least: float = 0.9) -> DataFrame:
    """Of the ``first`` rows by similarity those above ``least`` go to the front; the others keep their order."""
    by_sim = Window.partitionBy("query_id").orderBy(F.desc(similarity), "rank")
    marked = ranked.withColumn("_s", F.row_number().over(by_sim))
    up = (F.col("_s") <= first) & (F.col(similarity) > least)
    order = Window.partitionBy("query_id").orderBy(F.when(up, 0).otherwise(1), F.when(up, F.col("_s")).otherwise(F.col("rank")))
    return marked.withColumn("new_rank", F.row_number().over(order)).drop("_s")


def lexical_score(query: Column, text: Column) -> Column:
    """The default pair score: the share of the query's words that the text holds."""
    asked = T.unigrams(T.index_words(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, T.unigrams(T.index_words(text)))) / F.size(asked)).otherwise(0.0)


def rerank(pairs: DataFrame, n: int, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """(query_id, id, score, rank) of pairs (query_id, query, id, text) by a scorer in Arrow batches, by default the lexical score."""
    score = F.pandas_udf(scorer, "double")("query", "text") if scorer else lexical_score(F.col("query"), F.col("text"))
    return ranked(pairs.select("query_id", "id", score.alias("score")), n)


def ranked(scored: DataFrame, n: int) -> DataFrame:
    """The n best rows (query_id, id, score) of each query with their rank."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def model_query(keywords: str) -> str:
    """Words of a keyword query as models read them: pieces without a field, letters only."""
    import re

    pieces = [p for p in re.split(r"<.*?>", keywords) if ":" not in p]
    return "; ".join(" ".join(re.findall("[A-Za-z]+", p)) for p in pieces if re.search("[A-Za-z]", p))


def resolve_titles(titles: DataFrame, papers: DataFrame, ident: str, title: str, asked: str) -> DataFrame:
    """(asked, ident) of papers whose title has the same letters; a title that many share is joined block by block."""
    left = titles.select(asked, T.title_key(title).alias("_k")).filter("_k <> ''")
    right = papers.select(ident, T.title_key("title").alias("_k")).filter("_k <> ''")
    return lookup.blocked(left, right, ["_k"], asked, ident).select(asked, ident)


BANDS, BAND_ROWS = 20, 2


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _P2
    x = (x ^ x >> np.uint64(29)) * _P3
    return x ^ x >> np.uint64(32)


def _hash_int(i: int) -> np.ndarray:
    """Spark's xxhash64 of an int of 0 or more."""
    x = np.array([42 + 4], np.uint64) + _P5
    return _mixed(_turned(x ^ np.uint64(i) * np.array([1], np.uint64) * _P1, 23) * _P2 + _P3)


def _stirred(x: np.ndarray) -> np.ndarray:
    return _turned(x * _P2, 31) * _P1


def _hash_long(stirred: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs after what gave the seed."""
    return _mixed(_turned(seed + _P5 + np.uint64(8) ^ stirred, 27) * _P1 + _P4)


def _bands(triples: pa.Array) -> pa.Array:
    """The bands of lists of triples as ``title_bands`` defines them."""
    sizes = np.asarray(triples.value_lengths(), np.int64)
    values = np.asarray(triples.flatten()).view(np.uint64)
    rows, ends = np.flatnonzero(sizes), np.cumsum(sizes)
    out = np.empty((len(rows), BANDS), np.int64)
    for s in range(0, len(rows), 500):
        of = rows[s : s + 500]
        first = ends[of] - sizes[of]
        stirred = _stirred(values[first[0] : ends[of[-1]]])
        for b in range(BANDS):
            band = _hash_int(b)
            for k in range(b * BAND_ROWS, (b + 1) * BAND_ROWS):
                least = np.minimum.reduceat(_hash_long(stirred, _hash_int(k)).view(np.int64), first - first[0])
                band = _hash_long(_stirred(least.view(np.uint64)), band)
            out[s : s + 500, b] = band.view(np.int64)
    at = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out.ravel()))


def _triples(title: Column) -> Column:
    """Hashes of the letter triples of a title."""
    flat = T.squash(F.lower(title))
    of = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.xxhash64(F.substr(t, i, F.lit(3)))))
    return F.when(flat != "", T.let(flat, of)).otherwise(F.array().cast("array<bigint>"))


def title_bands(title: Column) -> Column:
    """Hashes of bands of minwise letter triples.

    Titles whose ratio is above 90 share half of their triples at least, as a rule, and then
    meet in one of 20 bands of two rows with a probability of 0.997.
    """

    def bands(t: Column) -> Column:
        least = lambda k: F.array_min(F.transform(t, lambda h: F.xxhash64(F.lit(k), h)))
        return F.array(*[F.xxhash64(F.lit(b), *[least(b * BAND_ROWS + r) for r in range(BAND_ROWS)]) for b in range(BANDS)])

    return T.let(_triples(title), lambda t: F.when(F.size(t) > 0, bands(t)).otherwise(F.array().cast("array<bigint>")))


def add_title_bands(df: DataFrame, title: Column, name: str) -> DataFrame:
    """A table with the ``title_bands`` of a title as its last column, reckoned in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _bands(batch.columns[-1])], names=batch.schema.names)

    keyed = df.withColumn(name, _triples(title))
    return keyed.mapInArrow(run, keyed.schema)


title_bands.add = add_title_bands


def search_titles(titles: DataFrame, papers: DataFrame, asked: str, ident: str, least: float = 90.0) -> DataFrame:
    """(asked, ident, found_by) for every asked title: papers of the same letters, else the likeliest paper if it is alike.

    ``titles`` has asked, title and family (of an author, or null); ``papers`` ident, title
    and families.  A title without an equal one meets the papers of a common band (see
    ``title_bands``), whatever the words it is made of; of those that name the family, if one
    is given, and whose ratio is above ``least``, the one that shares most bands is the answer.
    """
    same = resolve_titles(titles, papers, ident, "title", asked).withColumn("found_by", F.lit("title"))
    open_ = titles.join(same.select(asked).distinct(), asked, "left_anti")
    text = F.coalesce("title", F.lit(""))
    met = bands.alike(open_, papers, asked, ident, text, text, title_bands, least).drop("ratio")
    full = met.join(open_.select(asked, F.lower("family").alias("_f")), asked).join(papers.select(ident, F.transform("families", lambda f: F.lower(f)).alias("_fs")), ident)
    named = F.col("_f").isNull() | (F.trim("_f") == "") | F.array_contains("_fs", F.col("_f"))
    good = full.filter(named)
    best = Window.partitionBy(asked).orderBy(F.desc("shared"), ident)
    first = good.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    return same.select(asked, ident, "found_by").unionByName(first.select(asked, ident, F.lit("search").alias("found_by")))
