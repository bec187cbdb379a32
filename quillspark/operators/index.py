"""Inverted indexes that are written once and read by term.

Postings lie sorted by term in files of disjoint ranges of terms, so that a query's terms
reach the scan as a filter that skips all other files and row groups.  A frequent term
spreads over several files, as the ranges are of (term, document).
"""

from __future__ import annotations

import atexit
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import keywords, postings
from quillspark.session import delete, shared_dir
from quillspark.sources.store import Conflict, Store

LAYOUT = 1  # counted up when terms change, so that indexes of older code are not read


class StoredIndex:
    """Postings (term, keys...) and the keys of all documents under one store."""

    def __init__(self, store: Store, name: str, keys: list[str]):
        self.store, self.name, self.keys = store, name, keys

    @property
    def documents_name(self) -> str:
        return f"{self.name}_documents"

    def exists(self) -> bool:
        return self.store.exists(self.name) and self.store.exists(self.documents_name)

    def build(self, df: DataFrame, terms: Column, files: int | None = None) -> StoredIndex:
        rows = postings.postings(df, self.keys, terms)
        files = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.store.write(self.documents_name, df.select(*self.keys).distinct())
        self.store.write(self.name, rows.repartitionByRange(files, "term", *self.keys).sortWithinPartitions("term", *self.keys))
        return self

    def add(self, df: DataFrame, terms: Column) -> None:
        """Documents that are new or have changed; only their postings are written."""
        self.store.upsert(self.documents_name, df.select(*self.keys).distinct(), self.keys)
        self.store.upsert(self.name, postings.postings(df, self.keys, terms).sortWithinPartitions("term", *self.keys), self.keys)

    def postings(self) -> DataFrame:
        return self.store.read(self.name)

    def documents(self) -> DataFrame:
        return self.store.read(self.documents_name)

    def words(self, grams: int) -> DataFrame:
        """Postings of the words of texts (1) or of pairs of neighbours (2), without those of fields."""
        blanks = F.length("term") - F.length(F.replace("term", F.lit(" ")))
        return self.postings().filter(~F.col("term").contains(":") & (blanks == grams - 1))

    def match(self, query: str | keywords.Node) -> DataFrame:
        """Keys of the documents that satisfy a keyword query."""
        node = keywords.parse(query) if isinstance(query, str) else query
        return keywords.match_postings(self.postings(), self.documents(), self.keys, node)


def _stamp(spark: SparkSession, path: str) -> str:
    """Tells one content of a table's files from another by their names, lengths and times."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listStatus(at)
    seen = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    return hashlib.sha1(repr((LAYOUT, seen)).encode()).hexdigest()[:20]


_OWN: set[str] = set()


def of_table(spark: SparkSession, path: str, keys: list[str], terms: Column, select: list[Column] | None = None, kind: str = "") -> StoredIndex:
    """The index of a table of parquet files, built on first use in the shared folder and kept while the session lives."""
    root = f"{shared_dir(spark)}/quillspark-index-{_stamp(spark, path)}{kind}"
    index = StoredIndex(Store(spark, root), "postings", keys)
    if not index.exists():
        if root not in _OWN:
            _OWN.add(root)
            atexit.register(delete, spark, root)
        df = spark.read.parquet(path)
        try:
            index.build(df.select(*select) if select else df, terms)
        except Conflict:  # another session has built it meanwhile
            pass
    return index
