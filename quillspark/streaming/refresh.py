"""Keeping the derived tables up to date, in one batch or from a stream of files.

A batch writes its own rows only: papers, duplicate keys, postings and vectors are stored in
parts, of which a later one replaces the rows of the papers it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators import lookup, models, postings
from quillspark.session import Cut
from quillspark.sources.store import Store

KEY = ["collection", "id_int"]
TABLES = ("papers", "dedup_keys", "postings", "vectors")


def repeats(keys: DataFrame, cut: Cut) -> DataFrame:
    """KEY of the papers of a batch that repeat another one of it by a key.

    Papers go in order: one stays if no paper that stays comes before it under a common key.
    """
    paper = F.struct(*KEY).alias("p")
    pairs = keys.select(paper, "key_type", "key").distinct()
    shared = pairs.groupBy("key_type", "key").agg(F.count("*").alias("n")).filter("n > 1")
    open_, lost = cut(pairs.join(shared.drop("n"), ["key_type", "key"], "left_semi")), []
    while not open_.isEmpty():
        least = open_.groupBy("key_type", "key").agg(F.min("p").alias("first"))
        led = cut(open_.join(least, ["key_type", "key"]))
        stay = led.groupBy("p").agg(F.bool_and(F.col("p") == F.col("first")).alias("stays")).filter("stays").select("p")
        gone = cut(led.join(stay.withColumnRenamed("p", "first"), "first", "left_semi").filter(F.col("p") != F.col("first")).select("p").distinct())
        lost.append(gone)
        open_ = cut(open_.join(stay.unionByName(gone), "p", "left_anti"))
    none = pairs.select("p").limit(0)
    return reduce(DataFrame.unionByName, lost, none).select("p.*")


def refresh(store: Store, papers: DataFrame, embedder: models.Embedder | None = None) -> None:
    """Adds papers that no stored one, and no earlier one of the batch, duplicates by DOI or title, with their keys, postings and vectors.

    Papers stored before are replaced; a batch that is run again changes nothing.
    """
    cut = Cut(papers.sparkSession)
    papers = cut(papers.dropDuplicates(KEY))
    keys = cut(lookup.duplicate_keys(papers, KEY, "doi", "title", F.lit("")).filter("key_type in ('doi', 'title')"))
    if store.exists("dedup_keys"):
        stored = store.read("dedup_keys")
        known = keys.join(stored.select("key_type", "key").distinct(), ["key_type", "key"], "left_semi").select(*KEY).distinct()
        same = stored.select(*KEY).distinct()
        papers = papers.join(known.join(same, KEY, "left_anti"), KEY, "left_anti")
        keys = keys.join(papers.select(*KEY), KEY, "left_semi")
    papers = cut(papers.join(repeats(keys, cut), KEY, "left_anti"))
    indexed = papers.filter(F.coalesce("requireindexing", F.lit(True)))
    text = indexed.select(F.struct(*KEY).alias("p"), F.concat_ws(" ", "title", "abstract").alias("t"))
    changed = {
        "papers": papers,
        "dedup_keys": keys.join(papers.select(*KEY), KEY, "left_semi"),
        "postings": postings.postings(indexed, KEY, postings.paper_terms()),
        "vectors": models.embed(text, "p", "t", embedder).select("p.*", "v"),
    }
    for name, df in changed.items():
        store.upsert(name, df, KEY)
        store.vacuum(name)
    cut.drop()


def stream(spark: SparkSession, folder: str, schema, store: Store, checkpoint: str, files_per_batch: int = 16) -> StreamingQuery:
    """The same over files as they arrive; a batch that is run again changes nothing."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return source.writeStream.foreachBatch(lambda batch, _: refresh(store, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; rows later than ``late`` behind the newest are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user that end after a gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(stream_df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now into parquet files."""
    query = stream_df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def running_totals(events: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """(user_id, n, total, done) of each user from a stream of events, kept as state between batches.

    A user's totals come out after every batch with events of theirs, and once more, with
    ``done``, when none has come for ``idle`` of event time; then the state is dropped.
    """
    minutes = {"seconds": 1 / 60, "minutes": 1, "hours": 60, "days": 1440}
    number, unit = idle.split()
    wait = int(float(number) * minutes[unit if unit.endswith("s") else unit + "s"] * 60_000)

    def step(key, frames, state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "done": [True]})
            return
        for frame in frames:
            n, total = n + len(frame), total + float(frame["value"].fillna(0).sum())
            last = max(last, int(frame["ts"].max().timestamp() * 1000))
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "done": [False]})

    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", idle)
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double, done boolean", "n long, total double, last long", "append", GroupStateTimeout.EventTimeTimeout)
