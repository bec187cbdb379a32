"""Tables of databases as sources: any with a JDBC driver, and SQLite files."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table read in ranges of a numeric key; filters and columns go to the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    for option, value in options.items():
        reader = reader.option(option, value)
    return reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def read_sqlite(spark: SparkSession, path: str, name: str, key: str, schema: str, low: int | None = None, high: int | None = None, step: int = 100_000) -> DataFrame:
    """Rows of a SQLite table whose key lies in [low, high), read by ranges of ``step`` keys in parallel.

    The file must be where all executors see it; without bounds those of the table are taken.
    """
    quoted = lambda c: '"' + c.replace('"', '""') + '"'
    if low is None or high is None:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as held:
            least, most = held.execute(f"SELECT min({quoted(key)}), max({quoted(key)}) FROM {quoted(name)}").fetchone()
        low, high = (least or 0) if low is None else low, (most or -1) + 1 if high is None else high
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    text = f"SELECT {', '.join(quoted(c) for c in kind.names)} FROM {quoted(name)} WHERE {quoted(key)} >= ? AND {quoted(key)} < ? ORDER BY {quoted(key)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        try:
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    rows = held.execute(text, (start, min(start + step, high)))
                    while some := rows.fetchmany(5_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), arrow)], schema=arrow)
        finally:
            held.close()

    ranges = spark.range(low, max(low, high), step, max(1, min(200, -(-(high - low) // step)))).select(F.col("id").alias("start"))
    return ranges.mapInArrow(run, schema)
