"""The whole document search as one plan: what is asked, prefetching, re-ranking, statistics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import models, search, vectors
from quillspark.session import Cut


def plain_keywords(keywords: Column) -> Column:
    """A keyword query without its operators."""
    return F.regexp_replace(F.coalesce(keywords, F.lit("")), "<(?:AND|OR|NOT)>", " ")


def section_texts(sections: Column, title: Column | None = None) -> Column:
    """One text for each parsed section, its sentences joined by blanks, after the title if it is given."""
    sentence = lambda p: F.transform(F.coalesce(p.paragraph_text, F.array()), lambda s: F.coalesce(s.sentence_text, F.lit("")))
    texts = F.transform(F.coalesce(sections, F.array()), lambda s: F.concat_ws(" ", F.flatten(F.transform(F.coalesce(s.section_text, F.array()), sentence))))
    return F.concat(F.array(F.coalesce(title, F.lit(""))), texts) if title is not None else texts


def body_or_abstract(body: Column, abstract: Column) -> Column:
    """The sections of the body, or of the abstract where there is no body."""
    return F.when(F.size(F.coalesce(body, F.array())) > 0, body).otherwise(abstract)


def sources(asked: DataFrame, papers: DataFrame) -> DataFrame:
    """(query_id, source): the text of a query, else the content of the paper it names, else its keywords.

    ``asked`` has query_id, text, collection, id_int and keywords; ``papers`` collection,
    id_int and content.
    """
    given = F.trim(F.coalesce("text", F.lit("")))
    named = asked.filter(given == "").select("query_id", "collection", "id_int").join(papers.select("collection", "id_int", "content"), ["collection", "id_int"])
    content = named.groupBy("query_id").agg(F.min("content").alias("content"))
    joined = asked.join(content, "query_id", "left")
    return joined.select("query_id", F.when(given != "", given).when(F.trim(F.coalesce("content", F.lit(""))) != "", F.col("content")).otherwise(plain_keywords(F.col("keywords"))).alias("source"))


def strategy(matching: int, total: int, share: float = 0.01, least: int = 10_000) -> str:
    """'exact' for few matching documents, else 'index', whose hits are filtered afterwards."""
    return "exact" if matching < max(share * total, least) else "index"


def rerank_globally(candidates: DataFrame, asked: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(query_id, id, similarity, rank) of the n candidates whose whole text is nearest the query; a query without a vector keeps its order."""
    joined = candidates.select("query_id", "id", F.col("rank").alias("_before")).join(asked.select("query_id", F.col("v").alias("_q")), "query_id", "left").join(texts.select("id", F.col("v").alias("_d")), "id", "left")
    near = F.when(F.col("_q").isNotNull() & F.col("_d").isNotNull(), F.round(vectors.dot(F.col("_q"), F.col("_d")), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "_before", "id")
    return joined.select("query_id", "id", near.alias("similarity"), "_before").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("_before")


def document_search(
    asked: DataFrame,
    papers: DataFrame,
    matching: DataFrame,
    embeddings: DataFrame,
    keywords: str = "",
    n: int = search.RESULTS,
    prefetch: int = search.PREFETCH,
    embedder: models.Embedder | None = None,
    scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None,
    index: vectors.InvertedFile | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results, statistics) of every query.

    ``asked`` has query_id, text, collection, id_int and keywords (see ``sources``);
    ``papers`` id, collection, id_int, title, abstract and content; ``matching`` the id of the
    papers that satisfy the keywords; ``embeddings`` id and v.  The ``prefetch`` nearest papers
    of each collection are gathered once each, ranked again by the similarity of their whole
    texts, and the first n of them by pairs of query and paper.
    """
    cut = Cut(asked.sparkSession)
    wanted = cut(sources(asked, papers))
    words = F.concat_ws(" ", "source", plain_keywords(F.lit(keywords)))
    queries = cut(models.embed(wanted.filter("trim(source) <> ''").select("query_id", words.alias("t")), "query_id", "t", embedder))
    live = cut(matching.select("id").distinct())
    n_matching = live.count()
    if index is not None and strategy(n_matching, index.total) == "index":
        near = index.search(queries, prefetch).join(live, "id", "left_semi").join(papers.select("id", "collection"), "id")
    else:
        rows = cut(embeddings.join(live, "id", "left_semi").join(papers.select("id", "collection"), "id").select("id", "v", "collection"))
        near = vectors.top_k(rows, queries, prefetch, "collection")
    first = cut(search.without_repeats(near, F.col("id"), [F.col("rank"), F.col("collection")]))
    held = papers.join(first.select("id").distinct(), "id", "left_semi")
    texts = cut(models.embed(held.select("id", F.concat_ws(" ", "title", "content").alias("t")), "id", "t", embedder))
    best = cut(rerank_globally(first, queries, texts, n))
    pairs = best.select("query_id", "id").join(wanted, "query_id").join(held.select("id", models.paper_text(F.col("title"), F.col("abstract")).alias("text")), "id")
    results = search.rerank(pairs.withColumn("query", models.pair_text(plain_keywords(F.lit(keywords)), F.col("source"))), n, scorer)
    stats = asked.select("query_id", F.lit(n_matching).cast("long").alias("matching_documents"))
    return cut.only(results, stats)
