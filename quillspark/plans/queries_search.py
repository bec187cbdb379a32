"""Queries on the inverted index, the keyword language and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import federation, index, keywords, models, pipeline, postings, search, vectors
from quillspark.session import table

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.INDEX_STOPWORDS) + "]"
_LEMMA = "CASE WHEN list_contains(stop, w) OR length(w) < 4 OR regexp_matches(w, '(ss|us|is)$') THEN w WHEN regexp_matches(w, 'ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(ss|sh|ch|x)es$') THEN regexp_replace(w, 'es$', '') ELSE regexp_replace(w, 's$', '') END"
_TOKENS = f"""
WITH stop AS (SELECT {_STOP} AS stop),
     token AS (SELECT id_int, collection, stop, list_transform(regexp_extract_all(lower(concat_ws(' . ', coalesce(title, ''), coalesce(abstract, ''))), '[\\p{{L}}\\p{{N}}_]+'), lambda w: {_LEMMA}) AS t,
                      list_transform(regexp_extract_all(lower(coalesce(title, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: {_LEMMA}) AS tt FROM paper, stop),
     term AS (SELECT id_int, collection, list_filter(list_distinct(t), lambda w: NOT list_contains(stop, w)) AS uni,
                     list_distinct(list_filter(list_transform(range(1, len(t)), lambda i: CASE WHEN NOT list_contains(stop, t[i]) AND NOT list_contains(stop, t[i + 1]) THEN t[i] || ' ' || t[i + 1] END), lambda x: x IS NOT NULL)) AS bi,
                     list_distinct(list_filter(list_transform(range(1, len(tt)), lambda i: CASE WHEN NOT list_contains(stop, tt[i]) AND NOT list_contains(stop, tt[i + 1]) THEN tt[i] || ' ' || tt[i + 1] END), lambda x: x IS NOT NULL)) AS tbi
              FROM token)
"""


def _text() -> F.Column:
    return F.concat_ws(" . ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))


def _paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "paper")


PAPER_KEYS, DOCUMENT_KEYS = ["id_int", "collection"], ["id"]


def _index(spark: SparkSession, sf_dir: str) -> index.StoredIndex:
    """The stored index of the papers."""
    return index.of_table(spark, f"{sf_dir}/paper.parquet", PAPER_KEYS, postings.paper_terms())


def _document_index(spark: SparkSession, sf_dir: str) -> index.StoredIndex:
    """The stored index of the words of the documents."""
    return index.of_table(spark, f"{sf_dir}/documents.parquet", DOCUMENT_KEYS, T.unigrams(T.index_words(F.coalesce("text", F.lit("")))), [F.col("doc_id").alias("id"), F.col("text")])


def postings_df_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.document_frequency(_index(spark, sf_dir).words(1)).orderBy(F.desc("df"), "term").limit(100)


def bigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.document_frequency(_index(spark, sf_dir).words(2))


def posting_lists_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of the two kinds of collections, united; shown by their length and ends."""
    rows = _index(spark, sf_dir).words(1)
    old = postings.posting_lists(rows.filter("collection = 'S2ORC'"), "id_int")
    new = postings.posting_lists(rows.filter("collection is null or collection <> 'S2ORC'"), "id_int")
    lists = postings.merge_lists(old, new).groupBy("term")
    return lists.agg(F.sum(F.size("ids")).cast("int").alias("n"), F.min(F.get("ids", F.lit(0))).alias("first_id"), F.max(F.element_at("ids", -1)).alias("last_id"))


def bitmap_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _index(spark, sf_dir).postings().filter(F.col("term").isin("cell", "memory", "court"))
    return postings.cardinality(postings.bitmaps(rows, "id_int"))


def available_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.document_frequency(_index(spark, sf_dir).postings().filter(F.col("term").startswith("availablefield:")))


def _keyword(text: str, scan: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        if scan:
            return keywords.match_rows(_paper(spark, sf_dir).select("id_int", postings.paper_terms().alias("terms")), "terms", keywords.parse(text)).select("id_int")
        return _index(spark, sf_dir).match(text).select("id_int")

    return query


def kw_doi_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers found by a DOI written into free text: that of the first paper that has one."""
    first = _paper(spark, sf_dir).select("id_int", T.normal_doi(F.coalesce("doi", F.lit(""))).alias("d")).filter("d <> ''").orderBy("id_int").first()
    return _index(spark, sf_dir).match(f"see https://doi.org/{first['d']} for this" if first else "10.0000/none").select("id_int")


def kw_name_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers found by an author's name in free text, typed family name first: that of the first author with two plain names."""
    plain = F.filter("author", lambda a: a.givenname.rlike("^[A-Z][a-z]+$") & a.familyname.rlike("^[A-Z][a-z]+$"))
    first = _paper(spark, sf_dir).select("id_int", F.try_element_at(plain, F.lit(1)).alias("a")).filter("a is not null").orderBy("id_int").first()
    return _index(spark, sf_dir).match(f"{first['a']['familyname']} {first['a']['givenname']}" if first else "Nobody Known").select("id_int")


def match_count_by_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).match("cell<OR>memory").groupBy("collection").agg(F.count("*").alias("matches"))


def _embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return rows, rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "v")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = _embeddings(spark, sf_dir)
    return vectors.top_k(rows, asked, 10)


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors among those of the documents that hold a word."""
    rows, asked = _embeddings(spark, sf_dir)
    return search.search(_document_index(spark, sf_dir).match("cell<AND><NOT>memory"), rows, asked, 10)


def vector_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of each label for every query."""
    rows, asked = _embeddings(spark, sf_dir)
    return vectors.top_k(rows, asked, 3, "label")


def quantised_int8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _embeddings(spark, sf_dir)
    scale = vectors.scale_of(rows, "v").first()["scale"]
    coded = rows.select("id", vectors.quantise(F.col("v"), F.lit(scale), 8).alias("v"))
    return vectors.top_k(coded, coded.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "v"), 10)


def quantised_int4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _embeddings(spark, sf_dir)
    scale = vectors.scale_of(rows, "v").first()["scale"]
    coded = rows.select("id", vectors.quantise(F.col("v"), F.lit(scale), 4).alias("v"))
    return vectors.top_k(coded, coded.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "v"), 10)


def hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows with most equal signs for every query, by the packed bits of the signs."""
    rows, asked = _embeddings(spark, sf_dir)
    return vectors.hamming_top_k(rows.select("id", "v"), asked, 10)


def hamming_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors per packed word of signs and number of set bits."""
    rows, _ = _embeddings(spark, sf_dir)
    words = rows.select(F.posexplode(vectors.sign_words(F.col("v"))).alias("word", "bits"))
    return words.groupBy("word", F.bit_count("bits").alias("ones")).agg(F.count("*").alias("vectors"))


def ann_ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = _embeddings(spark, sf_dir)
    return vectors.InvertedFile(rows.select("id", "v")).search(asked, 10)


def ann_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the exact ten nearest that the inverted file finds."""
    rows, asked = _embeddings(spark, sf_dir)
    file = vectors.InvertedFile(rows.select("id", "v"))
    exact, found = vectors.top_k(rows, asked, 10), file.search(asked, 10)
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg((F.sum("hit") / F.count("*")).alias("recall"), F.count("*").alias("pairs"))


def ann_ivf_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the inverted file finds nine tenths of the exact ten nearest."""
    return ann_ivf_recall(spark, sf_dir).select((F.col("recall") >= 0.9).alias("enough"), "pairs")


def section_max_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels ranked for every query by the best of their vectors, as papers are by their sections."""
    rows, asked = _embeddings(spark, sf_dir)
    sections = vectors.top_k(rows, asked, 1, "label").select("query_id", F.col("label").alias("id"), "similarity")
    return search.section_rerank(sections)


def rank_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in order of id, those very like the query in front."""
    rows, asked = _embeddings(spark, sf_dir)
    near = vectors.top_k(rows, asked, 100).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
    return search.promote(near, "similarity", 10, 0.3).select("query_id", "id", "new_rank")


def search_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword filter, vector order, at most five of a language, equal texts once, ranked."""
    rows, asked = _embeddings(spark, sf_dir)
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    matching = _document_index(spark, sf_dir).match(keywords.rewrite("sample|procedure"))
    near = search.search(matching, rows.select("id", "v"), asked, search.PREFETCH)
    full = near.join(documents, "id")
    unique = search.without_repeats(full, F.col("hash"), [F.desc("similarity"), F.col("id")])
    return search.per_collection(unique, "lang", 5).select("query_id", "id", "similarity", "rank")


def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search with the content of every twentieth paper as the query, among papers that hold a word."""
    paper = _paper(spark, sf_dir).filter("id_int is not null")
    papers = paper.select(F.col("id_int").alias("id"), "collection", "id_int", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"), F.concat_ws(" ", "title", "abstract").alias("content"))
    asked = paper.filter("id_int % 20 = 0").select(F.col("id_int").alias("query_id"), F.lit("").alias("text"), "collection", "id_int", F.lit("cell<OR>memory").alias("keywords"))
    embeddings = models.embed(papers, "id", "content")
    matching = _index(spark, sf_dir).match("cell<OR>memory").select(F.col("id_int").alias("id"))
    return pipeline.document_search(asked, papers, matching, embeddings, "cell<OR>memory", 10, 50)[0].select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def sentence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sentences of each abstract that hold most of the title's words."""
    parts = T.split_sentences(F.coalesce("abstract", F.lit("")))
    rows = _paper(spark, sf_dir).select("id_int", F.coalesce("title", F.lit("")).alias("title"), F.posexplode(parts).alias("pos", "s"))
    scored = rows.select("id_int", "pos", F.round(search.lexical_score(F.col("title"), F.col("s")), 6).alias("score"))
    by = Window.partitionBy("id_int").orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(by)).filter("rank <= 3")


def query_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked by text, by a stored paper, by one that is not stored, and by keywords only."""
    paper = _paper(spark, sf_dir)
    text = F.when(F.col("id_int") % 3 == 0, F.concat(F.lit(" about "), F.col("id_int").cast("string"))).otherwise(" ")
    wanted = F.when(F.col("id_int") % 3 == 1, F.col("id_int")).otherwise(-F.col("id_int"))
    asked = paper.select(F.col("id_int").alias("query_id"), text.alias("text"), "collection", wanted.alias("id_int"), F.lit("gene<AND><NOT>cell<OR>leaf").alias("keywords"))
    return pipeline.sources(asked, paper.select("collection", "id_int", F.coalesce("title", F.lit("")).alias("content")))


def prefetch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two filters, gathered with repeats, and how many rows and papers there are."""
    at = _index(spark, sf_dir)
    both = federation.gather({"first": at.match("cell"), "second": at.match("cell<OR>sample")})
    return both.groupBy("service").agg(F.count("*").alias("rows"), F.countDistinct("id_int").alias("papers"))


def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page, of two, of the nearest vectors of every query."""
    return federation.page(vector_topk(spark, sf_dir), 2)


def private_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers shown for a list of ids, and for no list."""
    paper = _paper(spark, sf_dir).select("id_int")
    asked = paper.filter("id_int % 20 = 0")
    some, none = federation.guarded(paper, "id_int", asked), federation.guarded(paper, "id_int", None)
    return some.agg(F.count("*").alias("with_ids")).crossJoin(none.agg(F.count("*").alias("without_ids")))


_KEYWORDS = {
    "kw_and": ("cell<AND>sample", "list_contains(uni, 'cell') AND list_contains(uni, 'sample')"),
    "kw_or": ("memory<OR>court", "list_contains(uni, 'memory') OR list_contains(uni, 'court')"),
    "kw_not": ("<NOT>cell", "NOT list_contains(uni, 'cell')"),
    "kw_and_not": ("cell<AND><NOT>memory<OR>court", "list_contains(uni, 'cell') AND (NOT list_contains(uni, 'memory') OR list_contains(uni, 'court'))"),
    "kw_phrase": ("gene expression", "list_contains(bi, 'gene expression')"),
    "kw_field_title": ("Title:memory leak", "list_contains(tbi, 'memory leak')"),
    "kw_fallback_or": ("Author:Gene Expression", "list_contains(uni, 'gene') AND list_contains(uni, 'expression')"),
    "kw_name_unknown": ("Gene Expression<OR>court", "list_contains(uni, 'gene') AND list_contains(uni, 'expression') OR list_contains(uni, 'court')"),
    "kw_short_syntax": (keywords.rewrite(r"gene_expression\tcell|memory\tx!court"), "list_contains(bi, 'gene expression') AND (list_contains(uni, 'cell') OR list_contains(uni, 'memory')) AND NOT list_contains(uni, 'court')"),
}
_SIM = "round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6)"


def _top(rows: str, sim: str, k: int, extra: str = "") -> str:
    return f"SELECT query_id, id, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {sim} AS similarity FROM embeddings q, {rows} e WHERE q.vec_id % 20 = 0 {extra})) WHERE rank <= {k}"


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"
_HELD = f"list_transform({_WORDS}, lambda w: {_LEMMA})".replace("list_contains(stop, w)", f"list_contains({_STOP}, w)")

QUERIES = {
    "postings_df_top_terms": postings_df_top_terms,
    "bigram_postings": bigram_postings,
    "posting_lists_merged": posting_lists_merged,
    "bitmap_cardinality": bitmap_cardinality,
    "available_field_counts": available_field_counts,
    "match_count_by_collection": match_count_by_collection,
    "kw_year_range": _keyword("Year:2005..2010"),
    "kw_doi": _keyword("AvailableField:DOI<AND><NOT>AvailableField:Venue"),
    "kw_author": _keyword("Author.FamilyName:Hulare"),
    "kw_doi_text": kw_doi_text,
    "kw_name_text": kw_name_text,
    "kw_scan": _keyword("cell<AND>sample", scan=True),
    **{name: _keyword(text) for name, (text, _) in _KEYWORDS.items()},
    "vector_topk": vector_topk,
    "vector_topk_filtered": vector_topk_filtered,
    "vector_topk_per_label": vector_topk_per_label,
    "quantised_int8_topk": quantised_int8_topk,
    "quantised_int4_topk": quantised_int4_topk,
    "document_search": document_search,
    "query_sources": query_sources,
    "sentence_topk": sentence_topk,
    "prefetch_union": prefetch_union,
    "result_page": result_page,
    "private_guard": private_guard,
    "hamming_topk": hamming_topk,
    "hamming_words": hamming_words,
    "ann_ivf_topk": ann_ivf_topk,
    "ann_ivf_recall": ann_ivf_recall,
    "ann_ivf_enough": ann_ivf_enough,
    "section_max_rerank": section_max_rerank,
    "rank_promotion": rank_promotion,
    "search_pipeline": search_pipeline,
}

SQL = {
    "postings_df_top_terms": _TOKENS + "SELECT term, count(*) AS df FROM (SELECT unnest(uni) AS term FROM term) GROUP BY term ORDER BY df DESC, term LIMIT 100",
    "bigram_postings": _TOKENS + "SELECT term, count(*) AS df FROM (SELECT unnest(bi) AS term FROM term) GROUP BY term",
    "posting_lists_merged": _TOKENS + "SELECT term, CAST(count(DISTINCT id_int) AS INT) AS n, min(id_int) AS first_id, max(id_int) AS last_id FROM (SELECT id_int, unnest(uni) AS term FROM term) GROUP BY term",
    "bitmap_cardinality": _TOKENS + "SELECT count(*) AS documents FROM term WHERE list_contains(uni, 'cell') OR list_contains(uni, 'memory') OR list_contains(uni, 'court')",
    "available_field_counts": """SELECT 'availablefield:' || f AS term, count(*) AS df FROM (
        SELECT unnest([CASE WHEN len(author) > 0 THEN 'author' END, CASE WHEN trim(title) <> '' THEN 'title' END, CASE WHEN trim(abstract) <> '' THEN 'abstract' END, CASE WHEN trim(venue) <> '' THEN 'venue' END,
                       CASE WHEN trim(doi) <> '' THEN 'doi' END, CASE WHEN trim(publicationdate.year) <> '' THEN 'publicationdate.year' END, CASE WHEN len(reference) > 0 THEN 'reference' END]) AS f FROM paper) WHERE f IS NOT NULL GROUP BY f""",
    "match_count_by_collection": _TOKENS + "SELECT collection, count(*) AS matches FROM term WHERE list_contains(uni, 'cell') OR list_contains(uni, 'memory') GROUP BY collection",
    "kw_year_range": "SELECT id_int FROM paper WHERE trim(publicationdate.year) IN ('2005', '2006', '2007', '2008', '2009', '2010')",
    "kw_doi": "SELECT id_int FROM paper WHERE trim(doi) <> '' AND NOT coalesce(trim(venue) <> '', false)",
    "kw_author": "SELECT id_int FROM paper WHERE len(list_filter(author, lambda a: array_to_string(regexp_extract_all(lower(a.familyname), '[\\p{L}\\p{N}_]+'), ' ') = 'hulare')) > 0",
    "kw_scan": _TOKENS + "SELECT id_int FROM term WHERE list_contains(uni, 'cell') AND list_contains(uni, 'sample')",
    **{name: _TOKENS + f"SELECT id_int FROM term WHERE {where}" for name, (_, where) in _KEYWORDS.items()},
    "vector_topk": _top("embeddings", _SIM, 10),
    "vector_topk_filtered": _top(f"(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE list_contains({_HELD}, 'cell') AND NOT list_contains({_HELD}, 'memory')))", _SIM, 10),
    "vector_topk_per_label": f"SELECT query_id, id, similarity, label, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY similarity DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, {_SIM} AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)) WHERE rank <= 3",
    "quantised_int8_topk": "WITH s AS (SELECT stddev_pop(abs(x)) * 4 AS scale FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)), coded AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(-128, least(127, round_even(CAST(x AS DOUBLE) / scale * 128, 0)))) AS embedding FROM embeddings, s) "
    + _top("coded", "round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6)", 10).replace("FROM embeddings q", "FROM coded q"),
    "quantised_int4_topk": "WITH s AS (SELECT stddev_pop(abs(x)) * 4 AS scale FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)), coded AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(-8, least(7, round_even(CAST(x AS DOUBLE) / scale * 8, 0)))) AS embedding FROM embeddings, s) "
    + _top("coded", "round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6)", 10).replace("FROM embeddings q", "FROM coded q"),
    "hamming_topk": "SELECT query_id, id, CAST((similarity + 64) / 2 AS INT) AS equal_signs, rank FROM (WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END) AS embedding FROM embeddings) " + _top("s", _SIM, 10).replace("FROM embeddings q", "FROM s q") + ")",
    "hamming_words": "SELECT CAST(word AS INT) AS word, CAST(len(list_filter(part, lambda x: x > 0)) AS INT) AS ones, count(*) AS vectors FROM (SELECT unnest([0, 1]) AS word, unnest([embedding[1:63], embedding[64:]]) AS part FROM embeddings) GROUP BY 1, 2",
    "ann_ivf_enough": "SELECT true AS enough, count(*) * 10 AS pairs FROM embeddings WHERE vec_id % 20 = 0",
    "query_sources": """SELECT id_int AS query_id, CASE WHEN id_int % 3 = 0 THEN 'about ' || id_int WHEN id_int % 3 = 1 AND trim(coalesce(title, '')) <> '' THEN title ELSE 'gene  cell leaf' END AS source FROM paper""",
    "sentence_topk": f"""WITH p AS (SELECT id_int, coalesce(title, '') AS title, regexp_split_to_array(trim(regexp_replace(coalesce(abstract, ''), '\\s+', ' ', 'g'), ' '), '\\.\\s') AS p FROM paper),
        s AS (SELECT id_int, title, list_filter(list_transform(p, lambda x, i: CASE WHEN i < len(p) THEN x || '.' ELSE x END), lambda x: trim(x, ' ') <> '') AS s FROM p),
        w AS (SELECT id_int, CAST(i - 1 AS INT) AS pos, list_distinct(list_filter({_HELD.replace("text", "title")}, lambda x: NOT list_contains({_STOP}, x))) AS q, list_distinct(list_filter({_HELD.replace("text", "s[i]")}, lambda x: NOT list_contains({_STOP}, x))) AS t FROM s, unnest(generate_series(1, len(s))) AS u(i)),
        r AS (SELECT id_int, pos, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, t)) / len(q), 6) ELSE 0.0 END AS score FROM w)
        SELECT id_int, pos, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id_int ORDER BY score DESC, pos) AS rank FROM r) WHERE rank <= 3""",
    "prefetch_union": _TOKENS + "SELECT 'first' AS service, count(*) AS rows, count(*) AS papers FROM term WHERE list_contains(uni, 'cell') UNION ALL SELECT 'second', count(*), count(*) FROM term WHERE list_contains(uni, 'cell') OR list_contains(uni, 'sample')",
    "result_page": "SELECT * FROM (" + _top("embeddings", _SIM, 10) + ") WHERE rank IN (5, 6)",
    "private_guard": "SELECT count(*) AS with_ids, 0 AS without_ids FROM paper WHERE id_int % 20 = 0",
    "kw_name_text": """WITH p AS (SELECT id_int, list_filter(author, lambda a: regexp_full_match(a.givenname, '[A-Z][a-z]+') AND regexp_full_match(a.familyname, '[A-Z][a-z]+')) AS named, author FROM paper),
        w AS (SELECT lower(named[1].givenname) AS g, lower(named[1].familyname) AS f FROM p WHERE len(named) > 0 ORDER BY id_int LIMIT 1)
        SELECT id_int FROM (SELECT id_int, unnest(author) AS a FROM paper), w WHERE regexp_replace(lower(concat_ws(' ', a.givenname, a.familyname)), '[^\\p{L}\\p{N}_]+', ' ', 'g') IN (g || ' ' || f, f || ' ' || g) GROUP BY id_int""",
    "kw_doi_text": "WITH d AS (SELECT id_int, lower(regexp_replace(regexp_extract(replace(lower(doi), '%2f', '/'), '10\\.[0-9]{4,9}/[^\\s]+'), '[.,;]+$', '')) AS d FROM paper WHERE doi IS NOT NULL) SELECT id_int FROM d WHERE d <> '' AND d = (SELECT d FROM d WHERE d <> '' ORDER BY id_int LIMIT 1)",
    "section_max_rerank": f"SELECT query_id, id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INT) AS rank FROM (SELECT q.vec_id AS query_id, e.label AS id, greatest(max({_SIM}), 0.0) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 GROUP BY 1, 2)",
    "rank_promotion": "SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN up THEN 0 ELSE 1 END, CASE WHEN up THEN s ELSE r END) AS INT) AS new_rank FROM (SELECT *, s <= 10 AND similarity > 0.3 AS up FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, r) AS s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS r FROM (" + _top("embeddings", _SIM, 100) + "))))",
    "search_pipeline": f"""WITH matching AS (SELECT doc_id, coalesce(lang, '') AS lang, md5(coalesce(text, '')) AS hash FROM documents WHERE list_contains({_HELD}, 'sample') OR list_contains({_HELD}, 'procedure')),
        near AS ({_top("(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM matching))", _SIM, 1000)}),
        uniq AS (SELECT * FROM (SELECT n.*, m.lang, row_number() OVER (PARTITION BY query_id, hash ORDER BY similarity DESC, id) AS u FROM near n JOIN matching m ON m.doc_id = n.id) WHERE u = 1),
        quota AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY similarity DESC, id) AS c FROM uniq) WHERE c <= 5)
        SELECT query_id, id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INT) AS rank FROM quota""",
}
