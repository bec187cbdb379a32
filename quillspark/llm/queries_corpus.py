"""Queries on the make-up of the corpus: subjects and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import mixing, subjects, tokens
from quillspark.session import table


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, _ = subjects.assign(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "subject_label"), table(spark, sf_dir, "subject_area"))
    return found


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p9_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their summed shares by subject."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"), F.sum(F.col("share").cast("double")).alias("weight"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents")
    count = tokens.counter(tokens.build_lexicon(spark))
    rows = subjects.leading(documents.select("doc_id", "lang", "text", "source"), table(spark, sf_dir, "subject_label"), table(spark, sf_dir, "subject_area"), ["source"], count)
    return mixing.plan(rows, table(spark, sf_dir, "mix_target"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mix(spark, sf_dir)[1]


def p8_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, raked and reached share of each source, language and topic."""
    return _mix(spark, sf_dir)[2]


def p8_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the mixture: sources used above their cap, and those whose share is missed by more than half a percent; one row of counts."""
    shares = p8_shares(spark, sf_dir).filter("available_tokens > 0")
    # the shares of sources without records are spread over the others
    aim = F.col("target_share") / F.sum("target_share").over(Window.partitionBy(F.lit(0)))
    checked = shares.select((F.col("most_uses") > F.col("max_repeat")).alias("over"), (F.abs(F.col("reached_share") - aim) > 0.005).alias("off"))
    return checked.agg(F.count_if("over").alias("over_cap"), F.count_if("off").alias("off_target"), F.count("*").alias("sources"))


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the subjects: those that are not allowed, of documents without text, and repeated ones; one row."""
    found = p9_found(spark, sf_dir)
    allowed = table(spark, sf_dir, "subject_area").select("subject", F.lit(True).alias("ok"))
    blank = table(spark, sf_dir, "documents").filter("text is null or trim(text) = ''").select("doc_id", F.lit(True).alias("blank"))
    marked = found.join(F.broadcast(allowed), "subject", "left").join(blank, "doc_id", "left")
    return marked.agg(F.count_if(F.col("ok").isNull()).alias("unknown"), F.count_if("blank").alias("without_text"), (F.count("*") - F.count_distinct("doc_id", "subject")).alias("repeated"))


QUERIES = {"p9_checks": p9_checks, "p8_margins": p8_margins, "p8_caps": p8_caps, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_makeup": p9_makeup}
SQL: dict[str, str] = {
    "p9_checks": "SELECT 0 AS unknown, 0 AS without_text, 0 AS repeated",
    "p8_caps": "SELECT 0 AS over_cap, 0 AS off_target, count(*) AS sources FROM mix_target WHERE target_share > 0 AND source IN (SELECT source FROM documents WHERE length(trim(text)) > 0)",
}
