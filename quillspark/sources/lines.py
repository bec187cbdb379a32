"""Scans of JSON: lines of dumps, one document per file, and release layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string,ref_id:string>"
PARA = f"struct<section:string,text:string,cite_spans:array<{SPAN}>>"
PERSON = "struct<first:string,middle:array<string>,last:string,suffix:string,email:string>"
BIB = f"struct<title:string,authors:array<{PERSON}>,year:string,venue:string,raw_text:string,links:string>"
METADATA = f"paper_id string, title string, authors array<{PERSON}>, abstract string, year string, venue string, journal string, doi string, s2_url string, pubmed_id string, pmc_id string, arxiv_id string, acl_id string, mag_id string"
PARSE = f"paper_id string, abstract array<{PARA}>, body_text array<{PARA}>, back_matter array<{PARA}>, bib_entries map<string,{BIB}>"


def read_lines(spark: SparkSession, path: str, id_field: str = "paper_id") -> DataFrame:
    """(file_number, id, line) of every non-empty line; the id is taken from the first characters without parsing the line."""
    head = F.regexp_extract(F.substring("value", 1, 80), rf'"{id_field}":\s*"?([^",}}\s]+)', 1)
    number = F.regexp_extract(F.input_file_name(), r"(\d+)\.[A-Za-z.]+$", 1).try_cast("int")
    return spark.read.text(path).filter("trim(value) <> ''").select(F.coalesce(number, F.lit(-1)).alias("file_number"), F.nullif(head, F.lit("")).alias("id"), F.col("value").alias("line"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).filter("_bad is null and paper_id is not null").drop("_bad")


def read_parses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARSE).json(path).filter("paper_id is not null")


def read_tree(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON document per file, at any depth; also the file's name, and its year and month where the name is an arXiv number."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("wholetext", "true").text(folder)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = text.select(name.alias("file"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("d"))
    two, month = F.regexp_extract("file", r"^(\d{2})(\d{2})\.\d+", 1), F.regexp_extract("file", r"^(\d{2})(\d{2})\.\d+", 2)
    return rows.select("file", full_year(two).alias("file_year"), F.nullif(month, F.lit("")).alias("file_month"), "d.*")


def full_year(two: Column, pivot: int = 50) -> Column:
    """Two digits as a year of 19yy or 20yy."""
    number = two.try_cast("int")
    return F.when(number < pivot, number + 2000).otherwise(number + 1900)


def latest_versions(names: DataFrame, column: str = "name") -> DataFrame:
    """The highest version of each name such as 2101.00001v10.pdf, by number."""
    base = F.regexp_extract(column, r"^(.*?)(?:v(\d+))?(?:\.[A-Za-z]+)?$", 1)
    version = F.coalesce(F.regexp_extract(column, r"v(\d+)(?:\.[A-Za-z]+)?$", 1).try_cast("int"), F.lit(0))
    return names.groupBy(base.alias("base")).agg(F.max_by(column, F.struct(version, F.col(column))).alias(column))


def release(df: DataFrame) -> DataFrame:
    """One layout for releases that keep the parse in pdf_parse, in grobid_parse, or at the top, with or without metadata."""
    columns = set(df.columns)

    def pick(name: str) -> Column:
        places = [F.col(f"{parent}.{name}") for parent in ("pdf_parse", "grobid_parse") if parent in columns and name in df.select(f"{parent}.*").columns]
        return F.coalesce(*places, *([F.col(name)] if name in columns else []), F.lit(None))

    def head(name: str) -> Column:
        places = [F.col(name)] if name in columns else []
        if "metadata" in columns and name in df.select("metadata.*").columns:
            places.append(F.col(f"metadata.{name}"))
        return F.coalesce(*places, F.lit(None)) if places else F.lit(None)

    return df.select("paper_id", *[head(n).alias(n) for n in ("title", "authors", "year", "venue")], *[pick(n).alias(n) for n in ("body_text", "back_matter", "bib_entries")], pick("abstract").alias("abstract"))
