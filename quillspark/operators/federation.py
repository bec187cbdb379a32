"""Several collections behind one answer: what services would be asked one by one is one plan here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gather(parts: dict[str, DataFrame], name: str = "service") -> DataFrame:
    """All rows of all parts, repeated ones too, with the name and the order of their part."""
    marked = [df.withColumns({name: F.lit(part), f"{name}_order": F.lit(i)}) for i, (part, df) in enumerate(parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def first_present(wanted: DataFrame, parts: dict[str, DataFrame], on: list[str], value: list[str]) -> DataFrame:
    """Every wanted row with the values of the first part, in order, that has its key; nulls if none has."""
    rows = gather(parts).select(*on, F.struct("service_order", "service", *value).alias("_v"))
    first = rows.groupBy(*on).agg(F.min_by("_v", F.col("_v.service_order")).alias("_v"))
    return wanted.join(first, on, "left").select(*wanted.columns, *[F.col(f"_v.{v}").alias(v) for v in ("service", *value)])


def keep_first(hits: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first hit of each key."""
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def live_shards(shards: list[str], paused: list[str]) -> list[str]:
    """Shards that are not paused, in their order."""
    return [s for s in shards if s not in set(paused)]


def unique_sorted(values: Column) -> Column:
    """Each value once, in ascending order."""
    return F.array_sort(F.array_distinct(values))


def point(df: DataFrame, field: str, value, order: list[Column]) -> DataFrame:
    """The first row whose field has a value; one row of nulls if none has."""
    found = df.filter(F.col(field) == F.lit(value)).orderBy(*order).limit(1)
    return df.sparkSession.range(1).select().join(found, F.lit(True), "left")


def guarded(df: DataFrame, ident: str, allowed: DataFrame | None) -> DataFrame:
    """Only rows that were asked for by id; without a list of ids nothing is shown."""
    return df.limit(0) if allowed is None else df.join(allowed.select(ident).distinct(), ident, "left_semi")


PAGE = 2


def page(ranked: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """Rows of a page, from 0, of ranked rows with ranks from 1."""
    return ranked.filter(F.col("rank").between(number * size + 1, (number + 1) * size))
