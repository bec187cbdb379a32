"""Sections, numbering and spans of a document's paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build_sections(df: DataFrame, document: list[str], order: list[Column], title: str) -> DataFrame:
    """Adds section_name, section_id and paragraph_id, all from 0 within the document.

    A section begins where a title that is not blank differs from the last one; a blank title
    inherits it.
    """
    by = Window.partitionBy(*document).orderBy(*order)
    named = df.withColumn("section_name", F.coalesce(F.last(F.nullif(F.trim(title), F.lit("")), True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))
    starts = named.withColumn("_new", (F.coalesce(F.lag("section_name").over(by) != F.col("section_name"), F.lit(False))).cast("int"))
    ids = starts.withColumn("section_id", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")
    return ids.withColumn("paragraph_id", (F.row_number().over(Window.partitionBy(*document, "section_id").orderBy(*order)) - 1).cast("int"))


def without_overlap(spans: Column) -> Column:
    """Spans in order of start of which none begins before the end of the last one kept."""
    kind = "array<struct<start:int,end:int,text:string,ref_id:string>>"
    ordered = F.array_sort(spans)
    empty = F.struct(F.lit(-1).alias("end"), F.array().cast(kind).alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        fits = s.start >= acc.end
        return F.struct(F.when(fits, s.end).otherwise(acc.end).alias("end"), F.when(fits, F.concat(acc.kept, F.array(s))).otherwise(acc.kept).alias("kept"))

    return F.aggregate(ordered, empty, step, lambda acc: acc.kept)


def typed_spans(spans: Column) -> Column:
    """Spans whose offsets are text, with whole numbers; those without usable offsets are dropped."""
    cast = F.transform(
        F.coalesce(spans, F.array()),
        lambda s: F.struct(s.start.try_cast("int").alias("start"), s.end.try_cast("int").alias("end"), F.coalesce(s.text, F.lit("")).alias("text"), F.coalesce(s.ref_id, F.lit("")).alias("ref_id")),
    )
    return F.filter(cast, lambda s: s.start.isNotNull() & s.end.isNotNull() & (s.start < s.end))


def fill_gaps(text: Column, spans: Column) -> Column:
    """The whole text as runs: those of the spans, typed 'citation_marker', and 'default' ones between."""
    run = lambda kind, s, e: F.struct(F.lit(kind).alias("kind"), s.cast("int").alias("start"), e.cast("int").alias("end"))
    kind = "array<struct<kind:string,start:int,end:int>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("runs"))

    def step(acc: Column, s: Column) -> Column:
        before = F.when(s.start > acc.at, F.array(run("default", acc.at, s.start))).otherwise(F.array().cast(kind))
        return F.struct(s.end.alias("at"), F.concat(acc.runs, before, F.array(run("citation_marker", s.start, s.end))).alias("runs"))

    def finish(acc: Column) -> Column:
        return F.when(acc.at < F.length(text), F.concat(acc.runs, F.array(run("default", acc.at, F.length(text))))).otherwise(acc.runs)

    return F.aggregate(without_overlap(spans), empty, step, finish)


def islands(df: DataFrame, group: list[str], order: str, flag: Column) -> DataFrame:
    """Runs of neighbouring rows where the flag holds: (group..., first, last, rows)."""
    by = Window.partitionBy(*group).orderBy(order)
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    numbered = marked.withColumn("_all", F.row_number().over(by)).filter("_f").withColumn("_run", F.col("_all") - F.row_number().over(by))
    return numbered.groupBy(*group, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows")).drop("_run")


def expand_ranges(first: Column, last: Column, most: int = 20) -> Column:
    """The numbers a citation range such as [1]-[4] stands for; just its ends where it is empty or too long."""
    gap = last - first
    return F.when((gap > 1) & (gap < most), F.sequence(first, last)).otherwise(F.array_distinct(F.array(first, last)))
