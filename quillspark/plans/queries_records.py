"""Queries on records: lookups, mutations, duplicates, sections, text functions and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import citations
from quillspark.functions import text as T
from quillspark.operators import bands, federation, lookup, projection, search, sections, summary
from quillspark.session import table

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS) + "]"


def _key_sql(text: str) -> str:
    return f"array_to_string(regexp_extract_all(array_to_string(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: NOT list_contains({_STOP}, w)), ' '), '[a-z]+'), ' ')"


def _squash_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'), ' ')"


def _paper(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "paper")


def projection_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projection.project(_paper(spark, sf_dir), {"Title": 1, "Author.FamilyName": 1, "PublicationDate.Year": 1, "Missing.Path": 1}, ("id_int",))
    return rows.select("id_int", "title", F.array_join(F.col("author.familyname"), ";").alias("families"), F.col("publicationdate.year").alias("year"))


def json_props_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(value).alias("sum_k"), F.count(value).alias("n_k"))


def multi_get_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited papers in the order of the citing lists, with placeholders for those not stored."""
    paper = _paper(spark, sf_dir)
    asked = paper.select(F.col("id_int").alias("citing"), F.posexplode("reference").alias("pos", "r")).filter("trim(r.paperid.id_value) <> ''")
    asked = asked.select("citing", "pos", F.col("r.paperid.collection").alias("collection"), F.trim("r.paperid.id_value").try_cast("long").alias("id_int"))
    stored = paper.select("collection", "id_int", "title", F.col("publicationdate.month").alias("month"))
    rows = lookup.multi_get(stored, asked.withColumn("pos", F.struct("citing", "pos")), ["collection", "id_int"], {"title": F.lit("(missing)")})
    return rows.select(F.col("pos.citing").alias("citing"), F.col("pos.pos").alias("pos"), F.concat_ws("_", "collection", "id_int").alias("_id"), "title", lookup.month_index(F.coalesce("month", F.lit(""))).alias("month"), "found")


def _paragraphs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "paragraph").dropDuplicates(["para_id"])


def left_join_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    paragraph = table(spark, sf_dir, "paragraph").select("collection", "id_int", "para_id", "paragraph_no", "section_title")
    return lookup.first_match(_paper(spark, sf_dir).select("collection", "id_int"), paragraph, ["collection", "id_int"], [F.col("paragraph_no"), F.col("para_id")])


def abstract_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank abstracts are filled with the paper's paragraphs."""
    paper = _paper(spark, sf_dir).select("collection", "id_int", "abstract")
    blank = F.trim(F.coalesce("abstract", F.lit(""))) == ""
    # only paragraphs of papers that need them are read further
    body = _paragraphs(spark, sf_dir).filter("text is not null").join(paper.filter(blank).select("collection", "id_int"), ["collection", "id_int"], "left_semi")
    body = body.groupBy("collection", "id_int").agg(F.array_sort(F.collect_list(F.struct("paragraph_no", "para_id", "text"))).alias("ps"))
    parts = F.transform(F.coalesce("ps", F.array()), lambda p: p.text)
    return paper.join(body, ["collection", "id_int"], "left").select("id_int", F.md5(lookup.fill_blank(F.col("abstract"), parts)).alias("hash"))


def anti_join_new_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _paper(spark, sf_dir).select(T.title_key(F.coalesce("title", F.lit(""))).alias("k"))
    return lookup.new_records(table(spark, sf_dir, "meta_record").select("meta_id", T.title_key(F.coalesce("title", F.lit(""))).alias("k")), known, "k").select("meta_id")


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _paper(spark, sf_dir).select("id_int", "title", F.lit("paper").alias("origin"))
    new = table(spark, sf_dir, "meta_record").select(F.col("meta_id").alias("id_int"), "title", F.lit("meta").alias("origin"))
    return lookup.upsert(old, new, ["id_int"])


def append_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _paper(spark, sf_dir).select("id_int", "title")
    new = table(spark, sf_dir, "meta_record").select("meta_id", "title")
    grown = lookup.append_with_ids(old.withColumn("meta_id", F.lit(None).cast("long")), new.withColumn("id_int", F.lit(None).cast("long")).select("id_int", "title", "meta_id"), "id_int", [F.col("meta_id")])
    return grown.select("id_int", "title")


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paper(spark, sf_dir).groupBy("collection").agg(F.count("*").alias("n"), F.coalesce(F.max("id_int"), F.lit(0)).alias("max_id"))


def _first_author(array: str, given: str, family: str) -> F.Column:
    first = F.try_element_at(F.col(array), F.lit(1))
    return F.concat_ws(" ", first[given], first[family])


def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.duplicate_keys(_paper(spark, sf_dir), ["id_int"], "doi", "title", _first_author("author", "givenname", "familyname"))
    return rows.select("id_int", "key_type", "key")


def dup_key_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = lookup.duplicate_keys(_paper(spark, sf_dir), ["id_int"], "doi", "title", _first_author("author", "givenname", "familyname"))
    asked = lookup.duplicate_keys(table(spark, sf_dir, "meta_record"), ["meta_id"], "doi", "title", _first_author("authors", "first", "last"))
    return lookup.cascade_match(asked, known, "meta_id", "id_int")


def dup_cascade_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches that the cascade decides by the DOI, and how many asked records it decides otherwise."""
    hits = dup_key_cascade(spark, sf_dir)
    return hits.filter("key_type = 'doi'").select("meta_id", "id_int")


def dup_cascade_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the cascade: records with matches of two kinds, and matches by title although the DOI has some; one row."""
    hits = dup_key_cascade(spark, sf_dir)
    kinds = hits.groupBy("meta_id").agg(F.count_distinct("key_type").alias("n")).agg(F.count_if(F.col("n") > 1).alias("two_kinds"))
    doi = hits.filter("key_type = 'doi'").select("meta_id").distinct()
    late = hits.filter("key_type <> 'doi'").join(doi, "meta_id", "left_semi").agg(F.count("*").alias("late"))
    return kinds.crossJoin(late)


def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("text is not null").groupBy(F.md5("text").alias("hash"))
    return rows.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paper of each title and first author."""
    key = F.concat_ws("|", T.title_key(F.coalesce("title", F.lit(""))), T.abbreviated(_first_author("author", "givenname", "familyname")))
    return _paper(spark, sf_dir).groupBy(key.alias("k")).agg(F.min("id_int").alias("id_int")).select("id_int")


def version_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "paper_store").groupBy("collection", "id_int")
    return rows.agg(F.max_by("parser_tag", "last_update_unixtime").alias("parser_tag"), F.max("last_update_unixtime").alias("last_update_unixtime"))


def title_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "meta_record").select("meta_id", F.coalesce("title", F.lit("")).alias("asked_title"))
    return search.resolve_titles(asked, _paper(spark, sf_dir).select("id_int", F.coalesce("title", F.lit("")).alias("title")), "id_int", "asked_title", "meta_id")


def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers for the titles of meta records, by equal letters or by search and verification."""
    meta = table(spark, sf_dir, "meta_record").select("meta_id", "title", F.try_element_at("authors", F.lit(1))["last"].alias("family"))
    paper = _paper(spark, sf_dir).select("id_int", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("author.familyname", F.array()).alias("families"))
    return search.search_titles(meta.withColumn("title", F.coalesce("title", F.lit(""))), paper, "meta_id", "id_int")


def new_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored contents by their hash, once each, that no other parser gave before."""
    rows = table(spark, sf_dir, "paper_store").select(F.md5(F.coalesce("parsed_content", F.lit(""))).alias("md5"), F.col("parser_tag").alias("uploader"), F.struct("last_update_unixtime", "id_int").alias("pos"), "id_int")
    return lookup.new_files(rows, rows.filter("uploader = ''")).select("md5", "uploader", "id_int")


def ascii_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "author_name").select("name_id", T.ascii_text(F.coalesce("familyname", F.lit(""))).alias("plain"))


def sections_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paragraphs(spark, sf_dir).select("collection", "id_int", "para_id", "paragraph_no", "section_title")
    built = sections.build_sections(rows, ["collection", "id_int"], [F.col("paragraph_no"), F.col("para_id")], "section_title")
    return built.select("para_id", "section_name", "section_id", "paragraph_id")


def _spans() -> F.Column:
    return sections.typed_spans(F.col("cite_spans"))


def span_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paragraphs(spark, sf_dir).filter("text is not null").select("para_id", F.posexplode(sections.fill_gaps(F.col("text"), _spans())).alias("pos", "r"))
    return rows.select("para_id", "pos", "r.kind", "r.start", "r.end")


def span_non_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paragraphs(spark, sf_dir).select("para_id", F.explode(sections.without_overlap(_spans())).alias("s"))
    return rows.select("para_id", "s.start", "s.end", "s.text")


def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation markers with the entry of the reference list they stand for."""
    spans = _paragraphs(spark, sf_dir).select("collection", "id_int", "para_id", F.explode("cite_spans").alias("s")).select("collection", "id_int", "para_id", F.col("s.ref_id").try_cast("int").alias("pos"))
    refs = _paper(spark, sf_dir).select("collection", "id_int", F.posexplode("reference").alias("pos", "r")).select("collection", "id_int", "pos", F.col("r.title").alias("cited_title"))
    return spans.join(refs, ["collection", "id_int", "pos"]).groupBy("id_int", "pos", "cited_title").agg(F.count("*").alias("mentions"), F.countDistinct("para_id").alias("paragraphs"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = T.split_sentences(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", pieces.alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("hash"))


def sentence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = T.merge_short(T.split_sentences(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(merged).alias("pos", "sentence"))


_HIGHLIGHT = ["gene", "expression", "memory", "leak", "court"]


def highlight_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paper(spark, sf_dir).select("id_int", F.explode(T.highlight(F.coalesce("title", F.lit("")), _HIGHLIGHT)).alias("s"))
    return rows.select("id_int", "s.start", "s.end")


def near_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the title of its paper stands in the whole text of a document, by rising distances and then a probe."""
    documents = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "id_int", "text")
    joined = documents.join(_paper(spark, sf_dir).select("id_int", F.col("title").alias("needle")), "id_int")
    return joined.select("doc_id", "id_int", F.explode(T.find_passage("needle", "text")).alias("s")).select("doc_id", "id_int", "s.start", "s.end")


def _titled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(meta_id, a) and (id_int, b, text): the records whose titles meet in a band of letter triples."""
    meta = table(spark, sf_dir, "meta_record").select("meta_id", F.coalesce("title", F.lit("")).alias("a"))
    return meta, _paper(spark, sf_dir).select("id_int", F.coalesce("title", F.lit("")).alias("b"), F.concat_ws(" ", "title", "abstract").alias("text"))


def fuzzy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title ratios of records found alike by their letters."""
    met = bands.alike(*_titled(spark, sf_dir), "meta_id", "id_int", F.col("a"), F.col("b"), search.title_bands, 80.0)
    return met.select("meta_id", "id_int", F.round("ratio", 6).alias("ratio"), (F.col("ratio") > 90.0).alias("alike"))


def summary_top_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.split_sentences(F.col("text")).alias("sentences"))
    return summary.summarise(rows, "doc_id", "sentences")


def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers whose title is alike that of a meta record, ranked by the words they share with it."""
    met = bands.most_words(*_titled(spark, sf_dir), "meta_id", "id_int", F.col("a"), F.col("b"), F.col("text"), search.title_bands, 5)
    return search.ranked(met.select(F.col("meta_id").alias("query_id"), F.col("id_int").alias("id"), "score"), 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def dup_keys_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate keys by file hash and by stemmed words."""
    rows = _paper(spark, sf_dir).withColumn("md5", F.md5(F.coalesce("abstract", F.lit(""))))
    return lookup.duplicate_keys(rows, ["id_int"], "doi", "title", _first_author("author", "givenname", "familyname"), "md5", True).select("id_int", "key_type", "key")


_COLLECTIONS = ["S2ORC", "PMCOA", "arXiv", "upload"]


def dup_by_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta records checked against one collection after the other: the hits of the first that has any."""
    known = lookup.duplicate_keys(_paper(spark, sf_dir).filter("collection is not null"), ["id_int", "collection"], "doi", "title", _first_author("author", "givenname", "familyname"), None, True)
    asked = lookup.duplicate_keys(table(spark, sf_dir, "meta_record"), ["meta_id"], "doi", "title", _first_author("authors", "first", "last"), None, True)
    return lookup.cascade_by_collection(asked, known, "meta_id", "id_int", _COLLECTIONS)


def federated_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hit of each meta record's DOI in the first collection that has it, the least paper of it."""
    doi = lambda df, *more: df.select(*more, T.normal_doi(F.coalesce("doi", F.lit(""))).alias("d")).filter("d <> ''")
    asked, known = doi(table(spark, sf_dir, "meta_record"), "meta_id"), doi(_paper(spark, sf_dir), "collection", "id_int")
    hits = federation.gather({c: known.filter(F.col("collection") == c) for c in _COLLECTIONS})
    met = lookup.blocked(asked, hits, ["d"], "meta_id", "id_int")
    return federation.keep_first(met, ["meta_id"], [F.col("service_order"), F.col("id_int")]).select("meta_id", "service", "id_int")


def federated_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited papers by number from the first collection that holds it."""
    paper = _paper(spark, sf_dir)
    wanted = paper.select(F.explode("reference").alias("r")).select(F.expr("try_cast(trim(r.paperid.id_value) as bigint)").alias("id_int")).filter("id_int is not null").distinct()
    parts = {c: paper.filter(F.col("collection") == c).select("id_int", "title") for c in _COLLECTIONS}
    return federation.first_present(wanted, parts, ["id_int"], ["title"])


def live_shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of the collections that are not paused."""
    live = federation.live_shards(_COLLECTIONS, ["arXiv", "upload"])
    return _paper(spark, sf_dir).filter(F.col("collection").isin(*live)).groupBy("collection").agg(F.count("*").alias("n"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of a venue, and a row of nulls for a venue that is not there."""
    rows = table(spark, sf_dir, "venue_list").select("venue_id", "name")
    there, absent = (federation.point(rows, "venue_id", v, [F.col("name")]) for v in (7, -7))
    return there.select("venue_id", "name").unionByName(absent.select("venue_id", "name"))


def cited_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers each paper cites, once each and sorted."""
    ids = F.array_compact(F.transform(F.coalesce("reference", F.array()), lambda r: F.nullif(F.trim(r.paperid.id_value), F.lit(""))))
    return _paper(spark, sf_dir).select("id_int", F.array_join(federation.unique_sorted(ids), ",").alias("cited"))


def paper_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in both written forms, and the year that its last two digits stand for."""
    d = F.col("publicationdate")
    return _paper(spark, sf_dir).select("id_int", T.joined_date(d.year, d.month, d.day).alias("joined"), T.day_month_year(d.day, d.month, d.year).alias("written"), T.full_year(F.substring(F.trim(d.year), -2, 2)).alias("year"))


def marker_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring citation markers and whether the text between them makes them a range."""
    rows = _paragraphs(spark, sf_dir).filter("text is not null").select("para_id", "text", sections.without_overlap(_spans()).alias("s")).filter("size(s) > 1")
    pairs = rows.select("para_id", "text", F.posexplode(F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("a"), F.slice("s", 2, F.size("s") - 1).alias("b"))).alias("pos", "p"))
    between = F.substr("text", F.col("p.a.end") + 1, F.col("p.b.start") - F.col("p.a.end"))
    return pairs.select("para_id", "pos", T.is_expansion(between).alias("is_range"))


def last_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each reference a paragraph cites the text of its last marker."""
    entries = F.transform(F.filter(F.coalesce("cite_spans", F.array()), lambda s: F.coalesce(s.ref_id, F.lit("")) != ""), lambda s: F.struct(s.ref_id.alias("key"), F.coalesce(s.text, F.lit("")).alias("value")))
    return _paragraphs(spark, sf_dir).select("para_id", F.explode(T.last_by_key(entries)).alias("ref_id", "marker"))


def common_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The venue most papers of a collection are in."""
    counted = _paper(spark, sf_dir).filter("trim(venue) <> ''").groupBy("collection", "venue").agg(F.count("*").alias("n"))
    return counted.groupBy("collection").agg(F.max(F.struct("n", "venue")).alias("m")).select("collection", "m.venue", "m.n")


def markers_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with their citation markers written as the references they stand for."""
    new = F.transform(sections.without_overlap(_spans()), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.concat(F.lit("<"), s.ref_id, F.lit(">")).alias("new")))
    rows = _paragraphs(spark, sf_dir).filter("text is not null").select("para_id", "text", new.alias("s"))
    return rows.select("para_id", F.length(T.replace_spans(F.col("text"), F.col("s"))).alias("length"), F.size("s").alias("markers"))


def _cite(spark, sf_dir, value: F.Column) -> DataFrame:
    return _paper(spark, sf_dir).select("id_int", value.alias("citation"))


def cite_mla(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cite(spark, sf_dir, citations.mla(F.col("author"), F.col("title"), F.col("venue"), F.col("publicationdate.year")))


def cite_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = citations.bibtex(F.concat_ws("_", "collection", "id_int"), F.col("author"), F.col("title"), F.col("venue"), F.col("publicationdate.year"), F.col("doi"))
    return _cite(spark, sf_dir, citations.with_source(entry, F.col("collection"), F.col("id_int")))


def cite_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cite(spark, sf_dir, citations.card(F.col("author")))


def reference_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference lists as text: the stored text, else one made from the entry's fields."""
    refs = _paper(spark, sf_dir).select("id_int", F.posexplode("reference").alias("pos", "r"))
    made = citations.mla(F.col("r.author"), F.col("r.title"), F.col("r.venue"), F.col("r.publicationdate.year"))
    return refs.select("id_int", "pos", F.coalesce(F.nullif(F.trim("r.referencetext"), F.lit("")), made).alias("text"))


def author_abbrev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "author_name").select("name_id", T.abbreviated(F.concat_ws(" ", "givenname", "familyname")).alias("short"))


def md5_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5"), F.md5(F.regexp_replace(coded, r"\s", "")).alias("base64_md5"))


def doi_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paper(spark, sf_dir).select("id_int", T.url_from_doi(F.col("doi"), F.col("url")).alias("address"), T.normal_doi(F.coalesce("doi", F.lit(""))).alias("doi"))


def affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of each affiliation, those without one kept."""
    rows = table(spark, sf_dir, "author_name").select(F.coalesce(F.nullif(F.trim("affiliation"), F.lit("")), F.lit("(none)")).alias("affiliation"), "name_id")
    return rows.groupBy("affiliation").agg(F.count("*").alias("names"), F.min("name_id").alias("first_name_id"))


def venue_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers per venue by id, else by the name written in either form."""
    venues = table(spark, sf_dir, "venue_list")
    names = venues.select("venue_id", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("short_name")))).alias("n")).groupBy("n").agg(F.min("venue_id").alias("by_name"))
    paper = _paper(spark, sf_dir).select("id_int", "venue_id", F.lower(F.trim("venue")).alias("n"))
    joined = paper.join(names, "n", "left")
    return joined.groupBy(F.coalesce("venue_id", "by_name").alias("venue")).agg(F.count("*").alias("papers"))


_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY para_id ORDER BY ingested_at) AS rn FROM paragraph) WHERE rn = 1"
_DOI = "coalesce(regexp_replace(regexp_extract(replace(lower(coalesce(doi, '')), '%2f', '/'), '(10\\.\\d{4,9}/\\S+)', 1), '[.,;]+$', ''), '')"
_PEOPLE = "list_filter(list_transform(coalesce(author, []), lambda a: concat_ws(', ', nullif(trim(coalesce(a.familyname, '')), ''), nullif(trim(coalesce(a.givenname, '')), ''))), lambda n: n <> '')"
_ABBREV = "CASE WHEN len(p) > 0 THEN array_to_string(list_transform(p, lambda w, i: CASE WHEN i < len(p) THEN w[1] ELSE w END), ' ') ELSE '' END"


def _parts(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(trim({text})), '\\s+'), lambda w: w <> '')"


_MLA = "array_to_string(list_filter([CASE WHEN len(names) > 3 THEN names[1] || ' et al' ELSE array_to_string(names, ', ') END, '\"' || trim(coalesce(title, '')) || '\"', trim(coalesce(venue, '')), trim(coalesce(year, ''))], lambda p: p <> '' AND p <> '\"\"'), '. ') || '.'"
_FIRST_AUTHOR = "concat_ws(' ', author[1].givenname, author[1].familyname)"

_SPANS_SQL = f"""first AS ({_FIRST}), raw AS (SELECT para_id, text, unnest(coalesce(cite_spans, [])) AS s FROM first),
        typed AS (SELECT para_id, text, try_cast(s.start AS INT) AS a, try_cast(s."end" AS INT) AS b, coalesce(s.text, '') AS t, coalesce(s.ref_id, '') AS r FROM raw WHERE try_cast(s.start AS INT) < try_cast(s."end" AS INT)),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY para_id ORDER BY a, b, t, r) AS i FROM typed),
        walk AS (SELECT para_id, 0 AS i, -1 AS at, false AS kept FROM (SELECT DISTINCT para_id FROM numbered)
                 UNION ALL SELECT n.para_id, CAST(n.i AS INT), CASE WHEN n.a >= w.at THEN n.b ELSE w.at END, n.a >= w.at FROM walk w JOIN numbered n ON n.para_id = w.para_id AND n.i = w.i + 1),
        kept AS (SELECT n.*, row_number() OVER (PARTITION BY n.para_id ORDER BY n.i) AS k, coalesce(lag(n.b) OVER (PARTITION BY n.para_id ORDER BY n.i), 0) AS before FROM numbered n JOIN walk w ON w.para_id = n.para_id AND w.i = n.i AND w.kept)"""
QUERIES = {f.__name__: f for f in (
    projection_nested, json_props_projection, multi_get_ordered, left_join_first_match, abstract_fill, anti_join_new_docs, upsert_merge, append_with_ids, row_counts,
    dup_keys, dup_key_cascade, dup_cascade_doi, dup_cascade_faults, exact_dup_groups, dedup_first, version_dedup, title_resolve, title_search, new_versions, ascii_names, sections_islands, span_gap_fill, span_non_overlap, citation_edges,
    sentence_split, sentence_merge, highlight_spans, near_match, fuzzy_titles, summary_top_sentences, lexical_rerank, cite_mla, cite_bibtex, cite_card, reference_texts,
    author_abbrev, md5_base64, doi_urls, affiliations, venue_join,
    dup_keys_stemmed, dup_by_collection, federated_doi, federated_get, live_shard_counts, point_lookup, cited_numbers, paper_dates, marker_ranges, last_markers, common_venue, markers_replaced,
)}

SQL = {
    "projection_nested": "SELECT id_int, title, array_to_string(list_transform(author, lambda a: a.familyname), ';') AS families, publicationdate.year AS year FROM paper",
    "json_props_projection": "SELECT event_type, CAST(sum(k) AS BIGINT) AS sum_k, count(k) AS n_k FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY event_type",
    "multi_get_ordered": """WITH asked AS (SELECT id_int AS citing, i - 1 AS pos, reference[i].paperid.collection AS collection, try_cast(trim(reference[i].paperid.id_value) AS BIGINT) AS id_int FROM paper, unnest(generate_series(1, len(reference))) AS t(i) WHERE trim(reference[i].paperid.id_value) <> ''),
        got AS (SELECT a.*, p.title, p.publicationdate.month AS month, p.id_int IS NOT NULL AS found FROM asked a LEFT JOIN paper p ON p.collection = a.collection AND p.id_int = a.id_int)
        SELECT citing, CAST(pos AS INT) AS pos, concat_ws('_', collection, CAST(id_int AS VARCHAR)) AS _id, CASE WHEN found THEN title ELSE '(missing)' END AS title, CASE WHEN try_cast(coalesce(month, '') AS DOUBLE) IS NULL THEN '' ELSE CAST(greatest(CAST(floor(try_cast(month AS DOUBLE)) AS INT) - 1, 0) AS VARCHAR) END AS month, found FROM got""",
    "left_join_first_match": "SELECT p.collection, p.id_int, g.para_id, g.paragraph_no, g.section_title FROM paper p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection, id_int ORDER BY paragraph_no, para_id) AS rn FROM paragraph) WHERE rn = 1) g ON g.collection = p.collection AND g.id_int = p.id_int",
    "abstract_fill": f"WITH first AS ({_FIRST}), body AS (SELECT collection, id_int, string_agg(text, ' ' ORDER BY paragraph_no, para_id) AS body FROM first WHERE text IS NOT NULL GROUP BY ALL) SELECT p.id_int, md5(coalesce(nullif(trim(abstract), ''), body, '')) AS hash FROM paper p LEFT JOIN body b ON b.collection = p.collection AND b.id_int = p.id_int",
    "anti_join_new_docs": f"SELECT meta_id FROM meta_record WHERE {_key_sql("coalesce(title, '')")} NOT IN (SELECT {_key_sql("coalesce(title, '')")} FROM paper)",
    "upsert_merge": "SELECT id_int, title, 'paper' AS origin FROM paper WHERE id_int NOT IN (SELECT meta_id FROM meta_record) UNION ALL SELECT meta_id, title, 'meta' FROM meta_record",
    "append_with_ids": "SELECT id_int, title FROM paper UNION ALL SELECT (SELECT max(id_int) FROM paper) + row_number() OVER (ORDER BY meta_id), title FROM meta_record",
    "row_counts": "SELECT collection, count(*) AS n, coalesce(max(id_int), 0) AS max_id FROM paper GROUP BY collection",
    "dup_keys": f"""WITH base AS (SELECT id_int, {_DOI} AS d, {_key_sql("coalesce(title, '')")} AS k FROM paper), parts AS (SELECT *, list_filter(string_split(k, ' '), lambda w: w <> '') AS p FROM base)
        SELECT DISTINCT id_int, key_type, key FROM (SELECT id_int, 'doi' AS key_type, d AS key FROM parts UNION ALL SELECT id_int, 'title', k FROM parts UNION ALL
        SELECT id_int, 'head_tail', 'h ' || array_to_string(p[1:5], ' ') FROM parts WHERE len(p) >= 5 UNION ALL SELECT id_int, 'head_tail', 't ' || array_to_string(p[len(p)-4:len(p)], ' ') FROM parts WHERE len(p) >= 5) WHERE key <> ''""",
    "dup_cascade_doi": f"WITH a AS (SELECT meta_id, {_DOI} AS d FROM meta_record), b AS (SELECT id_int, {_DOI} AS d FROM paper) SELECT meta_id, id_int FROM a JOIN b USING (d) WHERE d <> ''",
    "dup_cascade_faults": "SELECT 0 AS two_kinds, 0 AS late",
    "exact_dup_groups": "SELECT md5(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "dedup_first": f"SELECT min(id_int) AS id_int FROM (SELECT id_int, k || '|' || {_ABBREV} AS key FROM (SELECT id_int, {_key_sql("coalesce(title, '')")} AS k, {_parts(_FIRST_AUTHOR)} AS p FROM paper)) GROUP BY key",
    "version_dedup": "SELECT collection, id_int, arg_max(parser_tag, last_update_unixtime) AS parser_tag, max(last_update_unixtime) AS last_update_unixtime FROM paper_store GROUP BY collection, id_int",
    "title_resolve": f"WITH a AS (SELECT meta_id, {_key_sql("coalesce(title, '')")} AS k FROM meta_record), b AS (SELECT id_int, {_key_sql("coalesce(title, '')")} AS k FROM paper) SELECT meta_id, id_int FROM a JOIN b USING (k) WHERE k <> ''",
    "new_versions": "WITH r AS (SELECT md5(coalesce(parsed_content, '')) AS md5, parser_tag AS uploader, last_update_unixtime, id_int FROM paper_store), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY last_update_unixtime, id_int) AS rn FROM r) WHERE rn = 1) SELECT md5, uploader, id_int FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.uploader = '' AND r.md5 = f.md5 AND r.uploader = f.uploader)",
    "sections_islands": f"""WITH first AS ({_FIRST}), named AS (SELECT collection, id_int, para_id, paragraph_no, coalesce(last_value(nullif(trim(section_title), '') IGNORE NULLS) OVER (PARTITION BY collection, id_int ORDER BY paragraph_no, para_id ROWS UNBOUNDED PRECEDING), '') AS section_name FROM first),
        started AS (SELECT *, CASE WHEN lag(section_name) OVER (PARTITION BY collection, id_int ORDER BY paragraph_no, para_id) <> section_name THEN 1 ELSE 0 END AS new FROM named),
        ids AS (SELECT *, CAST(sum(new) OVER (PARTITION BY collection, id_int ORDER BY paragraph_no, para_id ROWS UNBOUNDED PRECEDING) AS INT) AS section_id FROM started)
        SELECT para_id, section_name, section_id, CAST(row_number() OVER (PARTITION BY collection, id_int, section_id ORDER BY paragraph_no, para_id) - 1 AS INT) AS paragraph_id FROM ids""",
    "citation_edges": f"""WITH first AS ({_FIRST}), span AS (SELECT collection, id_int, para_id, try_cast(s.ref_id AS INT) AS pos FROM (SELECT collection, id_int, para_id, unnest(cite_spans) AS s FROM first)),
        ref AS (SELECT collection, id_int, i - 1 AS pos, reference[i].title AS cited_title FROM paper, unnest(generate_series(1, len(reference))) AS t(i))
        SELECT s.id_int, CAST(s.pos AS INT) AS pos, cited_title, count(*) AS mentions, count(DISTINCT para_id) AS paragraphs FROM span s JOIN ref r ON r.collection = s.collection AND r.id_int = s.id_int AND r.pos = s.pos GROUP BY ALL""",
    "sentence_split": f"""WITH p AS (SELECT doc_id, regexp_split_to_array({_squash_sql("coalesce(text, '')")}, '\\.\\s') AS p FROM documents), s AS (SELECT doc_id, list_filter(list_transform(p, lambda x, i: CASE WHEN i < len(p) THEN x || '.' ELSE x END), lambda x: trim(x, ' ') <> '') AS s FROM p)
        SELECT doc_id, CAST(len(s) AS INT) AS n, md5(array_to_string(s, '|')) AS hash FROM s""",
    "highlight_spans": f"""WITH w AS (SELECT id_int, string_split({_squash_sql("coalesce(title, '')")}, ' ') AS ws FROM paper), x AS (SELECT id_int, i, ws[i] AS w, len(ws) AS n FROM w, unnest(generate_series(1, len(ws))) AS t(i)),
        pos AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY id_int ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, regexp_replace(lower(w), '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g') IN ({", ".join(repr(k) for k in _HIGHLIGHT)}) AS hit FROM x),
        run AS (SELECT *, i - row_number() OVER (PARTITION BY id_int ORDER BY i) AS g FROM pos WHERE hit)
        SELECT id_int, CAST(min(s) AS INT) AS start, CAST(max(CASE WHEN i = n THEN s + length(w) ELSE s + length(w) + 1 END) AS INT) AS "end" FROM run GROUP BY id_int, g""",
    "cite_mla": f"SELECT id_int, {_MLA} AS citation FROM (SELECT id_int, title, venue, publicationdate.year AS year, {_PEOPLE} AS names FROM paper)",
    "cite_bibtex": f"""SELECT id_int, '@article{{' || collection || '_' || id_int || ', paperIDInfo={{collection:' || collection || ', id_int:' || id_int || '}},' || chr(10) || array_to_string(list_filter(
        [CASE WHEN len(names) > 0 THEN '  author = {{' || array_to_string(names, ' and ') || '}}' END, CASE WHEN trim(title) <> '' THEN '  title = {{' || trim(title) || '}}' END, CASE WHEN trim(venue) <> '' THEN '  journal = {{' || trim(venue) || '}}' END,
         CASE WHEN trim(year) <> '' THEN '  year = {{' || trim(year) || '}}' END, CASE WHEN trim(doi) <> '' THEN '  doi = {{' || trim(doi) || '}}' END], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' AS citation
        FROM (SELECT id_int, collection, title, venue, doi, publicationdate.year AS year, {_PEOPLE} AS names FROM paper)""",
    "cite_card": """SELECT id_int, CASE WHEN len(n) > 3 THEN array_to_string(n[1:3], ', ') || ' et al' ELSE array_to_string(n, ', ') END AS citation FROM (SELECT id_int, list_filter(list_transform(coalesce(author, []), lambda a: trim(concat_ws(' ', nullif(trim(coalesce(a.givenname, ''))[1], ''), trim(coalesce(a.familyname, ''))))), lambda x: x <> '') AS n FROM paper)""",
    "reference_texts": f"""WITH ref AS (SELECT id_int, i - 1 AS pos, reference[i].referencetext AS stored, reference[i].title AS title, reference[i].venue AS venue, reference[i].publicationdate.year AS year, reference[i].author AS author FROM paper, unnest(generate_series(1, len(reference))) AS t(i))
        SELECT id_int, CAST(pos AS INT) AS pos, coalesce(nullif(trim(stored), ''), {_MLA}) AS text FROM (SELECT *, {_PEOPLE} AS names FROM ref)""",
    "author_abbrev": f"SELECT name_id, {_ABBREV} AS short FROM (SELECT name_id, {_parts("concat_ws(' ', givenname, familyname)")} AS p FROM author_name)",
    "md5_base64": "SELECT doc_id, md5(coalesce(text, '')) AS md5, md5(to_base64(encode(coalesce(text, '')))) AS base64_md5 FROM documents",
    "doi_urls": f"""SELECT id_int, CASE WHEN trim(coalesce(doi, '')) <> '' THEN 'https://doi.org/' || replace(replace(replace(replace(replace(replace(replace(doi, '%', '%25'), '"', '%22'), '#', '%23'), ' ', '%20'), '?', '%3F'), '<', '%3C'), '>', '%3E') ELSE coalesce(url, '') END AS address, {_DOI} AS doi FROM paper""",
    "affiliations": "SELECT coalesce(nullif(trim(affiliation), ''), '(none)') AS affiliation, count(*) AS names, min(name_id) AS first_name_id FROM author_name GROUP BY 1",
    "venue_join": "WITH n AS (SELECT n, min(venue_id) AS by_name FROM (SELECT venue_id, lower(name) AS n FROM venue_list UNION SELECT venue_id, lower(short_name) FROM venue_list) GROUP BY n) SELECT coalesce(p.venue_id, n.by_name) AS venue, count(*) AS papers FROM paper p LEFT JOIN n ON n.n = lower(trim(p.venue)) GROUP BY 1",
    "span_non_overlap": f"""WITH RECURSIVE {_SPANS_SQL} SELECT para_id, a AS start, b AS "end", t AS text FROM kept""",
    "span_gap_fill": f"""WITH RECURSIVE {_SPANS_SQL},
        run AS (SELECT para_id, 'default' AS kind, before AS start, a AS "end" FROM kept WHERE a > before UNION ALL SELECT para_id, 'citation_marker', a, b FROM kept
                UNION ALL SELECT f.para_id, 'default', coalesce(m.b, 0), length(f.text) FROM first f LEFT JOIN (SELECT para_id, max(b) AS b FROM kept GROUP BY para_id) m ON m.para_id = f.para_id WHERE f.text IS NOT NULL AND coalesce(m.b, 0) < length(f.text))
        SELECT para_id, CAST(row_number() OVER (PARTITION BY para_id ORDER BY start, "end") - 1 AS INT) AS pos, kind, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end" FROM run WHERE para_id IN (SELECT para_id FROM first WHERE text IS NOT NULL)""",
    "marker_ranges": f"""WITH RECURSIVE {_SPANS_SQL}, b AS (SELECT *, substring(text, before + 1, a - before) AS gap FROM kept WHERE text IS NOT NULL AND k > 1)
        SELECT para_id, CAST(k - 2 AS INT) AS pos, regexp_full_match(gap, '[-–— ]{{1,2}}') AND regexp_matches(gap, '[-–—]') AS is_range FROM b""",
    "markers_replaced": f"""WITH RECURSIVE {_SPANS_SQL}, d AS (SELECT para_id, count(*) AS n, sum(length(r) + 2 - (b - a) + CASE WHEN k > 1 AND a = before THEN 2 ELSE 0 END) AS grown FROM kept GROUP BY para_id)
        SELECT f.para_id, CAST(length(text) + coalesce(grown, 0) AS INT) AS length, CAST(coalesce(n, 0) AS INT) AS markers FROM first f LEFT JOIN d USING (para_id) WHERE text IS NOT NULL""",
    "last_markers": f"""WITH first AS ({_FIRST}), s AS (SELECT para_id, i, cite_spans[i].ref_id AS ref_id, coalesce(cite_spans[i].text, '') AS marker FROM first, unnest(generate_series(1, len(cite_spans))) AS t(i))
        SELECT para_id, ref_id, arg_max(marker, i) AS marker FROM s WHERE coalesce(ref_id, '') <> '' GROUP BY para_id, ref_id""",
    "federated_doi": f"""WITH a AS (SELECT meta_id, {_DOI} AS d FROM meta_record), b AS (SELECT collection, id_int, {_DOI} AS d, list_position(['S2ORC', 'PMCOA', 'arXiv', 'upload'], collection) AS o FROM paper)
        SELECT meta_id, collection AS service, id_int FROM (SELECT meta_id, collection, id_int, row_number() OVER (PARTITION BY meta_id ORDER BY o, id_int) AS rn FROM a JOIN b USING (d) WHERE d <> '' AND o IS NOT NULL) WHERE rn = 1""",
    "federated_get": """WITH w AS (SELECT DISTINCT try_cast(trim(r.paperid.id_value) AS BIGINT) AS id_int FROM (SELECT unnest(reference) AS r FROM paper))
        SELECT w.id_int, p.collection AS service, p.title FROM w LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_int ORDER BY list_position(['S2ORC', 'PMCOA', 'arXiv', 'upload'], collection)) AS rn FROM paper WHERE collection IN ('S2ORC', 'PMCOA', 'arXiv', 'upload')) WHERE rn = 1) p ON p.id_int = w.id_int WHERE w.id_int IS NOT NULL""",
    "live_shard_counts": "SELECT collection, count(*) AS n FROM paper WHERE collection IN ('S2ORC', 'PMCOA') GROUP BY collection",
    "point_lookup": "SELECT venue_id, name FROM venue_list WHERE venue_id = 7 UNION ALL SELECT NULL, NULL",
    "cited_numbers": "SELECT id_int, array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(reference, []), lambda r: trim(r.paperid.id_value)), lambda x: x <> ''))), ',') AS cited FROM paper",
    "paper_dates": """WITH d AS (SELECT id_int, nullif(trim(publicationdate.year), '') AS y, nullif(trim(publicationdate.month), '') AS m, nullif(trim(publicationdate.day), '') AS d FROM paper)
        SELECT id_int, concat_ws('-', y, m, d) AS joined, coalesce(d, '01') || '-' || coalesce(m, '01') || '-' || coalesce(y, '') AS written,
               CASE WHEN try_cast(right(y, 2) AS INT) BETWEEN 0 AND 49 THEN try_cast(right(y, 2) AS INT) + 2000 WHEN try_cast(right(y, 2) AS INT) BETWEEN 50 AND 99 THEN try_cast(right(y, 2) AS INT) + 1900 END AS year FROM d""",
    "common_venue": "SELECT collection, venue, n FROM (SELECT collection, venue, count(*) AS n, row_number() OVER (PARTITION BY collection ORDER BY count(*) DESC, venue DESC) AS rn FROM paper WHERE trim(venue) <> '' GROUP BY collection, venue) WHERE rn = 1",
    "ascii_names": r"""SELECT name_id, regexp_replace(translate(strip_accents(replace(replace(replace(replace(replace(coalesce(familyname, ''), 'ß', 'ss'), 'æ', 'ae'), 'Æ', 'AE'), 'œ', 'oe'), 'Œ', 'OE')), 'łŁøØđĐı', 'lLoOdDi'), '[^\x00-\x7F]', '', 'g') AS plain FROM author_name""",
    "sentence_merge": f"""WITH RECURSIVE p AS (SELECT doc_id, regexp_split_to_array({_squash_sql("coalesce(text, '')")}, '\\.\\s') AS p FROM documents),
        s AS (SELECT doc_id, list_filter(list_transform(p, lambda x, i: CASE WHEN i < len(p) THEN x || '.' ELSE x END), lambda x: trim(x, ' ') <> '') AS s FROM p),
        walk AS (SELECT doc_id, 0 AS i, s, CAST([] AS VARCHAR[]) AS done, '' AS held FROM s
                 UNION ALL SELECT doc_id, i + 1, s, CASE WHEN len(string_split(now, ' ')) >= 10 THEN list_append(done, now) ELSE done END, CASE WHEN len(string_split(now, ' ')) >= 10 THEN '' ELSE now END
                 FROM (SELECT doc_id, i, s, done, trim(concat_ws(' ', held, s[i + 1]), ' ') AS now FROM walk WHERE i < len(s))),
        closed AS (SELECT doc_id, CASE WHEN held = '' THEN done WHEN len(done) = 0 THEN [held] ELSE list_append(done[1:len(done) - 1], done[len(done)] || ' ' || held) END AS done FROM walk WHERE i = len(s))
        SELECT doc_id, CAST(unnest(range(len(done))) AS INT) AS pos, unnest(done) AS sentence FROM closed""",
}
