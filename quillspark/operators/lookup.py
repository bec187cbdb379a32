"""Lookups, joins and store mutations on tables of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.stem import stems
from quillspark.session import Cut


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """Left join to the first right row of each key.

    The right side is reduced by an aggregate, which combines before the shuffle.
    """
    rest = [c for c in right.columns if c not in on]
    names = [f"_o{i}" for i in range(len(order))]
    key = F.struct(*[c.alias(n) for c, n in zip(order, names)])
    one = right.groupBy(*on).agg(F.min_by(F.struct(*rest), key).alias("_r"))
    return left.join(one, on, "left").select(*left.columns, *[F.col("_r")[c].alias(c) for c in rest])


def fill_blank(value: Column, parts: Column) -> Column:
    """The value, or where it is null or blank the parts joined by blanks."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.array_join(parts, " "))


def multi_get(papers: DataFrame, wanted: DataFrame, on: list[str], default: dict[str, Column]) -> DataFrame:
    """Requested rows in order, with repeats; ``wanted`` has pos and the key; a missing row gets the defaults."""
    rest = [c for c in papers.columns if c not in on]
    found = wanted.join(papers.withColumn("_found", F.lit(True)), on, "left")
    return found.select("pos", *on, *[F.when(F.col("_found"), F.col(c)).otherwise(default.get(c, F.lit(None))).alias(c) for c in rest], F.coalesce("_found", F.lit(False)).alias("found"))


def month_index(month: Column) -> Column:
    """Months from 0 as text; '' for what is no month."""
    number = month.try_cast("double")
    return F.when(number.isNull(), "").otherwise(F.greatest(F.floor(number).cast("int") - 1, F.lit(0)).cast("string"))


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Old rows not in new, and all of new."""
    return old.join(new.select(*on), on, "left_anti").unionByName(new)


def append_with_ids(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """New rows get the ids that follow the largest one, in order.

    Ranks come from range-sorted partitions and their offsets, not from one global window.
    """
    spark = old.sparkSession
    most = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("most")).first()["most"]
    within = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    # written once: the bounds of the ranges are sampled, and a second evaluation could draw others
    ranged = Cut(spark)(new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", within))
    offsets, total = [], 0
    for r in sorted(ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()):
        offsets.append((r["_p"], total))
        total += r["n"]
    starts = spark.createDataFrame(offsets or [(0, 0)], "_p int, _start long")
    placed = ranged.join(F.broadcast(starts), "_p")
    return old.unionByName(placed.select((F.lit(most) + F.col("_start") + F.col("_i") + 1).alias(key), *[c for c in new.columns if c != key]))


def new_records(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not known; each new key once per row given."""
    return incoming.join(known.select(key).distinct(), key, "left_anti")


def new_files(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Files of a batch (pos, uploader, md5, ...) once per content, the first of each, without those the uploader has given before."""
    rest = [c for c in batch.columns if c != "md5"]
    first = batch.groupBy("md5").agg(F.min_by(F.struct(*rest), "pos").alias("_r")).select("md5", "_r.*")
    return first.join(known.select("md5", "uploader").distinct(), ["md5", "uploader"], "left_anti")


# ------------------------------------------------------------------ duplicate keys

# The order in which keys are tried, and how many words make the head and the tail of a title.
KEY_ORDER = ("md5", "doi", "title", "head_tail")
HEAD_TAIL = 5


def stemmed_key(text: Column) -> Column:
    """The words of ``title_key`` by their stems."""
    return F.array_join(stems(F.filter(F.split(T.title_key(text), " "), lambda w: w != "")), " ")


def duplicate_keys(df: DataFrame, ident: list[str], doi: str, title: str, author: Column, md5: str | None = None, stemmed: bool = False) -> DataFrame:
    """(ident..., key_type, key, title_key, author_key): one row for each key a record can be found by.

    ``stemmed`` takes the words of titles and authors by their stems; ``md5`` names the
    column of the hash of a file, if there is one.
    """
    key_of = stemmed_key if stemmed else T.title_key
    author = F.coalesce(author, F.lit(""))
    known = F.lower(F.trim(F.coalesce(F.col(md5), F.lit("")))) if md5 else F.lit("")
    base = df.select(*ident, known.alias("_m"), T.normal_doi(F.coalesce(F.col(doi), F.lit(""))).alias("_d"), key_of(F.coalesce(F.col(title), F.lit(""))).alias("title_key"), T.abbreviated(stemmed_key(author) if stemmed else author).alias("author_key"))
    parts = F.filter(F.split("title_key", " "), lambda w: w != "")
    head = F.concat_ws(" ", F.slice(parts, 1, HEAD_TAIL))
    tail = F.concat_ws(" ", F.slice(parts, F.greatest(F.size(parts) - HEAD_TAIL + 1, F.lit(1)), HEAD_TAIL))
    one = lambda kind, value: F.struct(F.lit(kind).alias("key_type"), value.alias("key"))
    keys = F.array(
        one("md5", F.col("_m")),
        one("doi", F.col("_d")),
        one("title", F.col("title_key")),
        one("head_tail", F.when(F.size(parts) >= HEAD_TAIL, F.concat(F.lit("h "), head)).otherwise("")),
        one("head_tail", F.when(F.size(parts) >= HEAD_TAIL, F.concat(F.lit("t "), tail)).otherwise("")),
    )
    return base.select(*ident, "title_key", "author_key", F.explode(F.array_distinct(F.filter(keys, lambda k: k.key != ""))).alias("k")).select(*ident, "k.key_type", "k.key", "title_key", "author_key")


BLOCK = 2_000


def blocked(a: DataFrame, b: DataFrame, on: list[str], asked_id: str, known_id: str) -> DataFrame:
    """The join of both sides; rows of a key that many share meet block by block, so that no task holds them all."""
    size = a.groupBy(*on).agg(F.count("*").alias("_na")).join(b.groupBy(*on).agg(F.count("*").alias("_nb")), on)
    hot = size.filter((F.col("_na") > BLOCK) | (F.col("_nb") > BLOCK)).select(*on, F.ceil(F.col("_na") / BLOCK).cast("long").alias("_pa"), F.ceil(F.col("_nb") / BLOCK).cast("long").alias("_pb"))
    of = lambda column: F.coalesce(column, F.lit(1).cast("long"))
    every = lambda column: F.explode(F.sequence(F.lit(0).cast("long"), of(column) - 1))
    left = a.join(hot, on, "left").withColumn("_ba", F.pmod(F.xxhash64(asked_id), of("_pa"))).withColumn("_bb", every("_pb")).drop("_pa", "_pb")
    right = b.join(hot, on, "left").withColumn("_bb", F.pmod(F.xxhash64(known_id), of("_pb"))).withColumn("_ba", every("_pa")).drop("_pa", "_pb")
    return left.join(right, [*on, "_ba", "_bb"]).drop("_ba", "_bb")


def cascade_by_collection(asked: DataFrame, known: DataFrame, asked_id: str, known_id: str, collections: list[str], least: float = 90.0) -> DataFrame:
    """(asked_id, collection, known_id, key_type): the cascade in each collection by itself, and of its hits those of the first collection that has any."""
    hits = [cascade_match(asked, known.filter(F.col("collection") == c), asked_id, known_id, least).withColumns({"collection": F.lit(c), "_o": F.lit(i)}) for i, c in enumerate(collections)]
    every = reduce(DataFrame.unionByName, hits)
    first = every.withColumn("_first", F.min("_o").over(Window.partitionBy(asked_id))).filter("_o = _first")
    return first.select(asked_id, "collection", known_id, "key_type")


def cascade_match(asked: DataFrame, known: DataFrame, asked_id: str, known_id: str, least: float = 90.0) -> DataFrame:
    """The matches of each asked record by the first kind of key that finds any: file hash, DOI, whole title, then head or tail of the title.

    Matches by title or its parts are verified by the ratio of titles and, where both name
    one, of first authors.
    """
    a = asked.select(F.col(asked_id), "key_type", "key", F.col("title_key").alias("ta"), F.col("author_key").alias("aa"))
    b = known.select(F.col(known_id), "key_type", "key", F.col("title_key").alias("tb"), F.col("author_key").alias("ab"))
    pairs = blocked(a, b, ["key_type", "key"], asked_id, known_id)
    # equal pairs met by several keys are verified once
    rank = F.array_position(F.array(*[F.lit(k) for k in KEY_ORDER]), F.col("key_type"))
    once = pairs.groupBy(asked_id, known_id, "ta", "tb", "aa", "ab").agg(F.min(rank).alias("rank"))
    by_author = (F.col("aa") == "") | (F.col("ab") == "") | T.alike(F.col("aa"), F.col("ab"), least)
    good = once.filter((F.col("rank") <= 2) | (T.alike(F.col("ta"), F.col("tb"), least) & by_author))
    best = Window.partitionBy(asked_id)
    kind = F.element_at(F.array(*[F.lit(k) for k in KEY_ORDER]), F.col("best").cast("int"))
    return good.withColumn("best", F.min("rank").over(best)).filter(F.col("rank") == F.col("best")).select(asked_id, known_id, kind.alias("key_type"))
