"""Round trips through sources and sinks, normalisation and streams, checked against the tables they start from."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import registry
from quillspark.functions import text as T
from quillspark.operators import models, normalise, reading, search, sections, vectors
from quillspark.session import delete, shared_dir, table
from quillspark.sources import files, lines, releases
from quillspark.sources.store import Store
from quillspark.streaming import refresh


def _folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder, cleared when the interpreter ends."""
    path = f"{shared_dir(spark)}/quillspark-trip-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def _raw_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta records as the lines of a dump."""
    text = lambda c: F.col(c).cast("string").alias(c)
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    people = F.transform("authors", lambda a: F.struct(a["first"].alias("first"), a.middle.alias("middle"), a["last"].alias("last"), a.suffix.alias("suffix"), F.lit(None).cast("string").alias("email")))
    return table(spark, sf_dir, "meta_record").select(F.col("meta_id").cast("string").alias("paper_id"), "title", people.alias("authors"), "abstract", text("year"), "venue", "journal", "doi", *none("s2_url", "pubmed_id", "pmc_id", "arxiv_id", "acl_id", "mag_id"))


def dump_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as lines of JSON and read again with their ids taken from the beginnings of the lines."""
    path = _folder(spark)
    _raw_metadata(spark, sf_dir).write.json(path)
    read = lines.read_metadata(spark, path).select("paper_id", "title", "year")
    heads = lines.read_lines(spark, path).groupBy("id").agg(F.count("*").alias("n_lines"))
    return read.join(heads, read.paper_id == heads.id).select(F.col("paper_id").cast("long").alias("meta_id"), "title", "year", "n_lines")


def normalised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records in the paper schema: cleaned texts, authors with a name, whole years, the resolver's address."""
    none = F.lit(None).cast(f"map<string,{lines.BIB}>")
    rows = _raw_metadata(spark, sf_dir).withColumns({"body_text": F.lit(None).cast(f"array<{lines.PARA}>"), "bib_entries": none})
    out = normalise.papers(rows, "dump")
    return out.select(F.col("paper_id").cast("long").alias("meta_id"), "title", "venue", F.col("publicationdate.year").alias("year"), F.size("author").alias("authors"), "url")


def tree_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers written as one document each, named by their number in the archive, and the date that the name tells."""
    path = _folder(spark)
    named = table(spark, sf_dir, "paper").filter(F.col("arxivid").rlike(r"^\d{4}\.\d+$")).groupBy("arxivid").agg(F.min("id_int").alias("id_int"))
    body = F.to_json(F.struct(F.col("id_int").cast("string").alias("paper_id")))

    def write(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = os.path.join(path.removeprefix("file://"), name[:2])
                os.makedirs(folder, exist_ok=True)
                with open(os.path.join(folder, f"{name}.json"), "w") as out:
                    out.write(text)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    named.select("arxivid", body.alias("t")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    tree = lines.read_tree(spark, path, "paper_id string")
    return tree.select(F.col("paper_id").cast("long").alias("id_int"), "file_year", "file_month")


def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest version of each name."""
    number = F.col("id_int") % 50
    names = table(spark, sf_dir, "paper").select(F.concat(F.lit("2101."), number.cast("string"), F.lit("v"), F.col("id_int").cast("string"), F.lit(".pdf")).alias("name"))
    return lines.latest_versions(names).select("name")


def _xml(c: Column) -> Column:
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def article_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers written as journal articles and read again."""
    text = lambda c: _xml(F.coalesce(c, F.lit("")))
    tag = lambda name, c, attrs="": F.concat(F.lit(f"<{name}{attrs}>"), c, F.lit(f"</{name}>"))
    name = lambda a: tag("contrib", tag("name", F.concat(tag("surname", text(a.familyname)), tag("given-names", text(a.givenname)))), " contrib-type='author'")
    people = F.array_join(F.transform(F.coalesce("author", F.array()), name), "")
    refs = F.array_join(F.transform(F.coalesce("reference", F.array()), lambda r, i: F.concat(F.lit("<ref id='B"), i.cast("string"), F.lit("'><mixed-citation>"), tag("article-title", text(r.title)), F.lit("</mixed-citation></ref>"))), "")
    meta = F.concat(F.lit("<article-meta><title-group>"), tag("article-title", text(F.col("title"))), F.lit("</title-group>"), tag("contrib-group", people), tag("pub-date", tag("year", text(F.col("publicationdate.year"))), " pub-type='epub'"), tag("abstract", tag("p", text(F.col("abstract")))), F.lit("</article-meta>"))
    whole = F.concat(F.lit("<article><front>"), meta, F.lit("</front><back><ref-list>"), refs, F.lit("</ref-list></back></article>"))
    made = table(spark, sf_dir, "paper").select(F.col("id_int").cast("string").alias("member"), F.encode(whole, "UTF-8").alias("content"))
    read = files.parse_documents(made)
    return read.select(F.col("file").cast("long").alias("id_int"), "error", "title", "year", F.coalesce(F.get("abstract", F.lit(0))["text"], F.lit("")).alias("abstract"), F.size("bib_entries").alias("refs"), F.coalesce(F.get("bib_entries", F.lit(0))["title"], F.lit("")).alias("first_ref"))


def release_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of papers written as release documents and read again."""
    para = F.struct(F.coalesce("section_title", F.lit("")).alias("section"), F.lit(None).cast("string").alias("sec_num"), F.coalesce("text", F.lit("")).alias("text"))
    rows = table(spark, sf_dir, "paragraph").filter("id_int is not null").groupBy("id_int").agg(F.array_sort(F.collect_list(F.struct("paragraph_no", "para_id", "ingested_at", para.alias("p")))).alias("ps"))
    empty = F.array()
    kinds = "array<struct<section:string,sec_num:string,text:string>>"
    papers = rows.select(
        "id_int", F.lit("").alias("title"), empty.cast("array<struct<first:string,middle:array<string>,last:string,suffix:string,email:string,affiliations:array<string>>>").alias("authors"), F.lit("").alias("year"), F.lit("").alias("venue"), F.create_map().cast("map<string,string>").alias("ids"),
        empty.cast(kinds).alias("abstract"), F.transform("ps", lambda x: x.p).alias("body_text"), empty.cast(kinds).alias("back_matter"), empty.cast("array<struct<ref_id:string,title:string>>").alias("bib_entries"), empty.cast("array<struct<ref_id:string,text:string>>").alias("ref_entries"),
    )
    path = _folder(spark)
    releases.release_json(papers, "id_int", "quillspark", "2026-01-01").select("document").write.text(path)
    schema = f"paper_id string, title string, pdf_parse struct<body_text:{kinds}>"
    read = releases.read_release(spark.read.schema(schema).json(path))
    return read.select(F.col("paper_id").cast("long").alias("id_int"), F.size("body_text").alias("paragraphs"), F.md5(releases.raw_text(F.col("body_text"))).alias("hash"))


def shard_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored in shards, sharded anew, one shard set aside and taken back, some rows replaced: what the table then holds."""
    store = Store(spark, _folder(spark))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    store.shard("v", rows, "id", 4)
    store.shard("v", store.read("v"), "id", 3)
    folder = store.parts("v")[0].folder
    store.detach("v", folder)
    store.attach("v", folder)
    store.upsert("v", rows.filter("id % 10 = 0").withColumn("label", F.lit(-1)), ["id"])
    store.append_new("v", rows, ["id"])
    return store.view("v", "quillspark_vectors").groupBy("label").agg(F.count("*").alias("vectors"), F.sum("id").alias("ids"))


def refreshed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the tables after two runs of the same refresh: papers stored twice, DOIs and titles that two papers share, papers without vectors, postings of papers that are not stored; one row."""
    store = Store(spark, _folder(spark))
    paper = table(spark, sf_dir, "paper").filter("id_int is not null and collection is not null")
    refresh.refresh(store, paper)
    refresh.refresh(store, paper)
    papers, key = store.read("papers"), refresh.KEY
    twice = papers.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("twice"))
    shared = store.read("dedup_keys").groupBy("key_type", "key").agg(F.count_distinct(*key).alias("n")).filter("n > 1").agg(F.count("*").alias("shared"))
    bare = papers.filter(F.coalesce("requireindexing", F.lit(True))).join(store.read("vectors"), key, "left_anti").agg(F.count("*").alias("bare"))
    loose = store.read("postings").join(papers, key, "left_anti").agg(F.count("*").alias("loose"))
    return twice.crossJoin(shared).crossJoin(bare).crossJoin(loose)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of the events as a stream, of the days that the newest event closes."""
    out, checkpoint = _folder(spark), _folder(spark)
    events = table(spark, sf_dir, "events")
    live = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    refresh.run_once(refresh.windowed_counts(live, "0 seconds", "1 day"), out, checkpoint)
    return spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def paper_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of papers' paragraphs, nested and taken apart again, with their numbers."""
    first = table(spark, sf_dir, "paragraph").filter("text is not null and id_int is not null").groupBy("para_id").agg(F.min_by(F.struct("collection", "id_int", "paragraph_no", "text"), "ingested_at").alias("p")).select("para_id", "p.*")
    sentence = F.transform(T.split_sentences(F.col("text")), lambda s: F.struct(s.alias("sentence_text")))
    paras = first.groupBy("collection", "id_int").agg(F.array_sort(F.collect_list(F.struct("paragraph_no", "para_id", sentence.alias("paragraph_text")))).alias("ps"))
    parsed = F.array(F.struct(F.transform("ps", lambda p: F.struct(p.paragraph_text.alias("paragraph_text"))).alias("section_text")))
    return reading.sentences(paras.select(F.struct("collection", "id_int").alias("k"), parsed.alias("parsed")), "k", "parsed").select("k.id_int", "paragraph_id", "sentence_id", F.md5("sentence_text").alias("hash"))


def two_digit_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "paper").select("id_int", T.two_digits(F.col("publicationdate.month")).alias("month"), T.two_digits(F.lit("March")).alias("named"))


def marker_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers in citation markers, what a range from each to the next but two stands for, and whether paragraphs cite in brackets."""
    spans = table(spark, sf_dir, "paragraph").groupBy("para_id").agg(F.min_by(F.struct("text", "cite_spans"), "ingested_at").alias("p")).select("para_id", F.coalesce("p.text", F.lit("")).alias("text"), F.explode("p.cite_spans").alias("s"))
    number = reading.marker_number(F.col("s.text"))
    return spans.select("para_id", number.alias("number"), F.size(sections.expand_ranges(number, number + 3)).alias("stands_for"), reading.bracket_style(F.col("text"), 2).alias("in_brackets")).filter("number is not null").groupBy("para_id", "in_brackets").agg(F.count("*").alias("markers"), F.sum("number").alias("numbers"), F.sum("stands_for").alias("stands_for"))


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of vectors, and of the same vectors normalised."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    return rows.select("vec_id", F.round(vectors.norm(F.col("v")), 4).alias("length"), F.round(vectors.norm(vectors.normalise(F.col("v"))), 6).alias("unit"))


def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as models read them: keyword queries by their words, papers by title and abstract, pairs by keywords and context."""
    asked = search.model_query("gene expression<AND>Title:cell<OR><NOT>memory2 leak")
    paper = table(spark, sf_dir, "paper")
    return paper.select("id_int", F.lit(asked).alias("query"), F.md5(models.paper_text(F.col("title"), F.col("abstract"))).alias("paper"), models.pair_text(F.lit("k"), F.lit("c")).alias("pair"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered functions in SQL text, a table function among them."""
    registry.register(spark)
    venues = table(spark, sf_dir, "venue_list")
    return spark.sql("SELECT venue_id, pos, sentence, round(indel_ratio(name, name), 1) AS same FROM {v}, LATERAL split_sentences(concat(name, '. Second one.'))", v=venues)


QUERIES = {f.__name__: f for f in (
    dump_round_trip, normalised_records, tree_round_trip, newest_files, article_round_trip, release_round_trip, shard_round_trip, refreshed_store, stream_windows, paper_sentences,
    two_digit_months, marker_numbers, unit_vectors, model_texts, sql_functions,
)}

_NEWEST = "SELECT para_id, arg_min({'text': text, 'cite_spans': cite_spans, 'collection': collection, 'id_int': id_int, 'paragraph_no': paragraph_no}, ingested_at) AS p FROM paragraph"
_SQUASHED = "trim(regexp_replace({}, '\\s+', ' ', 'g'), ' ')"
_CLEAN = "CASE WHEN trim({0}) NOT IN ('', 'None') THEN trim({0}) END"

SQL = {
    "dump_round_trip": "SELECT meta_id, title, CAST(year AS VARCHAR) AS year, 1 AS n_lines FROM meta_record",
    "normalised_records": f"""SELECT meta_id, regexp_replace(coalesce({_CLEAN.format("title")}, ''), '^\\[+|\\]+$', '', 'g') AS title, coalesce({_CLEAN.format("venue")}, {_CLEAN.format("journal")}, '') AS venue, coalesce(CAST(year AS VARCHAR), '') AS year,
        CAST(len(list_filter(coalesce(authors, []), lambda a: trim(concat_ws(' ', nullif(nullif(trim(a.last), ''), 'None'), nullif(nullif(trim(a.suffix), ''), 'None'))) <> '' OR trim(concat_ws(' ', nullif(nullif(trim(a.first), ''), 'None'), array_to_string(coalesce(a.middle, []), ' '))) <> '')) AS INT) AS authors,
        CASE WHEN trim(coalesce(doi, '')) <> '' THEN 'https://doi.org/' || replace(replace(replace(replace(replace(replace(replace(doi, '%', '%25'), '"', '%22'), '#', '%23'), ' ', '%20'), '?', '%3F'), '<', '%3C'), '>', '%3E') ELSE '' END AS url
        FROM meta_record WHERE {_CLEAN.format("title")} IS NOT NULL OR {_CLEAN.format("abstract")} IS NOT NULL""",
    "tree_round_trip": "SELECT min(id_int) AS id_int, CAST(CASE WHEN CAST(arxivid[1:2] AS INT) < 50 THEN 2000 ELSE 1900 END + CAST(arxivid[1:2] AS INT) AS INT) AS file_year, arxivid[3:4] AS file_month FROM paper WHERE regexp_full_match(arxivid, '[0-9]{4}\\.[0-9]+') GROUP BY arxivid",
    "newest_files": "SELECT '2101.' || (id_int % 50) || 'v' || max(id_int) || '.pdf' AS name FROM paper GROUP BY id_int % 50",
    "article_round_trip": f"""SELECT id_int, CAST(NULL AS VARCHAR) AS error, {_SQUASHED.format("coalesce(title, '')")} AS title, {_SQUASHED.format("coalesce(publicationdate.year, '')")} AS year, {_SQUASHED.format("coalesce(abstract, '')")} AS abstract,
        CAST(coalesce(len(reference), 0) AS INT) AS refs, {_SQUASHED.format("coalesce(reference[1].title, '')")} AS first_ref FROM paper""",
    "release_round_trip": "SELECT id_int, CAST(count(*) AS INT) AS paragraphs, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY paragraph_no, para_id, ingested_at)) AS hash FROM paragraph WHERE id_int IS NOT NULL GROUP BY id_int",
    "shard_round_trip": "SELECT CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS label, count(*) AS vectors, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings GROUP BY 1",
    "refreshed_store": "SELECT 0 AS twice, 0 AS shared, 0 AS bare, 0 AS loose",
    "stream_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) GROUP BY 1, 2",
    "paper_sentences": f"""WITH first AS (SELECT para_id, p.collection AS collection, p.id_int AS id_int, p.paragraph_no AS paragraph_no, p.text AS text FROM ({_NEWEST} WHERE text IS NOT NULL AND id_int IS NOT NULL GROUP BY para_id)),
        n AS (SELECT id_int, row_number() OVER (PARTITION BY collection, id_int ORDER BY paragraph_no, para_id) - 1 AS paragraph_id, regexp_split_to_array({_SQUASHED.format("text")}, '\\.\\s') AS p FROM first),
        s AS (SELECT id_int, paragraph_id, list_filter(list_transform(p, lambda x, i: CASE WHEN i < len(p) THEN x || '.' ELSE x END), lambda x: trim(x, ' ') <> '') AS s FROM n)
        SELECT id_int, CAST(paragraph_id AS INT) AS paragraph_id, CAST(i - 1 AS INT) AS sentence_id, md5(s[i]) AS hash FROM s, unnest(generate_series(1, len(s))) AS t(i)""",
    "two_digit_months": "SELECT id_int, CASE WHEN try_cast(publicationdate.month AS INT) BETWEEN 1 AND 31 THEN lpad(CAST(try_cast(publicationdate.month AS INT) AS VARCHAR), 2, '0') ELSE '' END AS month, '03' AS named FROM paper",
    "marker_numbers": f"""WITH first AS ({_NEWEST} GROUP BY para_id), spans AS (SELECT para_id, coalesce(p.text, '') AS text, unnest(p.cite_spans) AS c FROM first),
        m AS (SELECT para_id, len(regexp_extract_all(text, '\\[[0-9]+(\\s*[,;–-]\\s*[0-9]+)*\\s*\\]')) > 2 AS in_brackets, try_cast(regexp_extract(c.text, '^\\s*[\\[(]?([0-9]+)[\\])]?\\s*$', 1) AS INT) AS number FROM spans)
        SELECT para_id, in_brackets, count(*) AS markers, CAST(sum(number) AS BIGINT) AS numbers, count(*) * 4 AS stands_for FROM m WHERE number IS NOT NULL GROUP BY para_id, in_brackets""",
    "unit_vectors": "SELECT vec_id, round(3 * sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS length, 1.0 AS unit FROM embeddings",
    "model_texts": "SELECT id_int, 'gene expression; memory leak' AS query, md5('title: ' || coalesce(title, '') || ' abstract: ' || coalesce(abstract, '')) AS paper, 'keywords: k text before citation: c' AS pair FROM paper",
    "sql_functions": "SELECT venue_id, unnest([0, 1]) AS pos, unnest([name || '.', 'Second one.']) AS sentence, 100.0 AS same FROM venue_list",
}
