"""Queries on running text: sentences and token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import sentences, tokens
from quillspark.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, sf_dir, "paragraph"), "para_id", "text", ["ingested_at"])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p1_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the sentences: letters of all distinct paragraphs and those within sentences, overlaps, and sentences with white space at an end; one row."""
    texts = table(spark, sf_dir, "paragraph").filter("text is not null").groupBy("para_id").agg(F.min_by("text", "ingested_at").alias("text"))
    letters = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}]", "")).cast("long")
    spans = p1_found(spark, sf_dir).join(texts, "para_id").select("para_id", "start_pos", "end_pos", F.substr("text", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")).alias("s"))
    before = F.lag("end_pos").over(Window.partitionBy("para_id").orderBy("start_pos"))
    inside = spans.withColumn("over", F.coalesce(F.col("start_pos") < before, F.lit(False))).agg(F.sum(letters(F.col("s"))).alias("letters"), F.count_if("over").alias("overlaps"), F.count_if(F.col("s").rlike(r"^[ \t\n]|[ \t\n]$")).alias("loose_ends"))
    return inside


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, rows without ids, and ids out of the vocabulary's range; one row."""
    ids = p7_ids(spark, sf_dir).select(F.size("ids").alias("n"), F.coalesce(F.array_min("ids"), F.lit(0)).alias("low"))
    return ids.agg(F.count("*").alias("rows"), F.count_if(F.col("n") == 0).alias("empty"), F.count_if(F.col("low") < 0).alias("negative"))


QUERIES = {"p1_found": p1_found, "p7_ids": p7_ids, "p1_checks": p1_checks, "p7_checks": p7_checks}
SQL: dict[str, str] = {
    "p1_checks": "SELECT CAST(sum(length(regexp_replace(text, '[^\\p{L}]', '', 'g'))) AS BIGINT) AS letters, 0 AS overlaps, 0 AS loose_ends FROM (SELECT para_id, arg_min(text, ingested_at) AS text FROM paragraph WHERE text IS NOT NULL GROUP BY para_id)",
    "p7_checks": "SELECT count(*) AS rows, count(*) FILTER (WHERE coalesce(text, '') = '') AS empty, 0 AS negative FROM documents",
}
