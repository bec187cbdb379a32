"""Queries on pairs of records: near-duplicates, linkage and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import linkage, people, setjoin
from quillspark.session import table

NEAR_DUPLICATE = 0.7


def _paper_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    paper = table(spark, sf_dir, "paper").filter(F.length(F.trim("abstract")) > 0)
    return paper.select(F.col("id_int").cast("long").alias("id"), setjoin.word_set("title", "abstract").alias("set"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = setjoin.similar_sets(_paper_sets(spark, sf_dir), NEAR_DUPLICATE)
    return setjoin.expand(members, links).select(F.col("a").alias("id_int_a"), F.col("b").alias("id_int_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per paper: the class of equal word sets it belongs to and the links of that class."""
    members, links = setjoin.similar_sets(_paper_sets(spark, sf_dir), NEAR_DUPLICATE)
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
    count = ends.groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(count, "rep", "left").select(F.col("id").alias("id_int"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked pairs with their confidence."""
    paper = table(spark, sf_dir, "paper").select(
        F.col("id_int").cast("long").alias("id"),
        "title",
        F.transform("author", lambda a: F.struct(a.givenname.alias("given"), a.familyname.alias("family"))).alias("people"),
        F.col("publicationdate.year").alias("year"),
        "venue",
        "doi",
        "abstract",
    )
    meta = table(spark, sf_dir, "meta_record").select(
        F.col("meta_id").cast("long").alias("id"),
        "title",
        F.transform("authors", lambda a: F.struct(F.concat_ws(" ", a.first, a.middle).alias("given"), a.last.alias("family"))).alias("people"),
        "year",
        F.coalesce(F.nullif(F.trim("venue"), F.lit("")), "journal").alias("venue"),
        "doi",
        "abstract",
    )
    links = linkage.link(paper, meta)
    return links.select(F.col("id_l").alias("id_int"), F.col("id_r").alias("meta_id"), "confidence")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_links(spark, sf_dir).select("id_int", "meta_id")


def p6_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per spelling: the person it stands for."""
    rows = table(spark, sf_dir, "author_name").select(F.col("name_id").cast("long").alias("id"), F.col("givenname").alias("given"), F.col("familyname").alias("family"), F.col("affiliation").alias("place"))
    return people.resolve(rows).select(F.col("id").alias("name_id"), F.col("person").alias("person_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = p6_persons(spark, sf_dir).select(F.col("name_id").alias("id"), F.col("person_id").alias("person"))
    return people.pairs(resolved).select(F.col("a").alias("name_id_a"), F.col("b").alias("name_id_b"))


def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the links: confidences out of range, repeated pairs and pairs of unknown records; one row."""
    links = p3_links(spark, sf_dir)
    odd = links.agg(F.count_if(~F.col("confidence").between(0.5, 1.0)).alias("out_of_range"), (F.count("*") - F.count_distinct("id_int", "meta_id")).alias("repeated"))
    known = links.join(table(spark, sf_dir, "paper").select("id_int"), "id_int", "left_anti").agg(F.count("*").alias("unknown"))
    return odd.crossJoin(known)


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the persons: rows, distinct names, and persons that are not named by their least spelling; one row."""
    rows = p6_persons(spark, sf_dir)
    least = rows.groupBy("person_id").agg((F.min("name_id") != F.col("person_id")).alias("odd")).agg(F.count_if("odd").alias("misnamed"))
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("name_id").alias("names")).crossJoin(least)


QUERIES = {"p3_checks": p3_checks, "p6_checks": p6_checks, "p6_found": p6_found, "p6_persons": p6_persons, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_links": p3_links}
_SETS = """WITH sets AS (SELECT id_int, list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[\\p{L}\\p{N}]+'))) AS s FROM paper WHERE length(trim(abstract)) > 0),
        class AS (SELECT min(id_int) AS rep, s FROM sets GROUP BY s),
        word AS (SELECT rep, unnest(s) AS w FROM class),
        common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM word a JOIN word b ON a.w = b.w AND a.rep < b.rep GROUP BY 1, 2),
        link AS (SELECT a, b FROM common JOIN class x ON x.rep = a JOIN class y ON y.rep = b WHERE n >= 0.7 * (len(x.s) + len(y.s) - n) - 1e-9),
        degree AS (SELECT rep, count(*) AS links FROM (SELECT a AS rep FROM link UNION ALL SELECT b FROM link) GROUP BY rep)"""

SQL: dict[str, str] = {
    "p2_classes": _SETS + " SELECT id_int, c.rep AS class_id, coalesce(links, 0) AS links FROM sets JOIN class c USING (s) LEFT JOIN degree d ON d.rep = c.rep",
    "p3_checks": "SELECT 0 AS out_of_range, 0 AS repeated, 0 AS unknown",
    "p6_checks": "SELECT count(*) AS rows, count(DISTINCT name_id) AS names, 0 AS misnamed FROM author_name",
    "p2_found": """WITH sets AS (SELECT id_int, list_distinct(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[\\p{L}\\p{N}]+')) AS s FROM paper WHERE length(trim(abstract)) > 0),
        word AS (SELECT id_int, unnest(s) AS w FROM sets),
        common AS (SELECT a.id_int AS id_int_a, b.id_int AS id_int_b, count(*) AS n FROM word a JOIN word b ON a.w = b.w AND a.id_int < b.id_int GROUP BY 1, 2)
        SELECT id_int_a, id_int_b FROM common JOIN sets x ON x.id_int = id_int_a JOIN sets y ON y.id_int = id_int_b WHERE n >= 0.7 * (len(x.s) + len(y.s) - n) - 1e-9""",
}
