"""Vector search: exact top-k in blocks, quantised and bit forms, and an inverted-file index."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 50_000
BLOCK_QUERIES = 2_000


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """v / (|v| + 1e-12)"""
    length = norm(v) + F.lit(1e-12)
    return F.transform(v, lambda x: x.cast("double") / length)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def _best(k: int, group: bool = False):
    """The k best rows of a block, or of each group in it, for each query of a block; ties by the row's id."""

    def nearest(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, wanted: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        ids, rows = ids[by_id], rows[by_id]
        for begin in range(0, len(queries), 256):
            sim = np.round(wanted[begin : begin + 256] @ rows.T, 6)
            take = min(k, len(ids))
            kth = -np.partition(-sim, take - 1, axis=1)[:, take - 1 : take]
            q, r = np.nonzero(sim >= kth)
            s = sim[q, r]
            # of the ties at the end only the least ids are kept
            order = np.lexsort((ids[r], -s, q))
            q, r, s = q[order], r[order], s[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            keep = place < take
            yield queries[begin + q[keep]], ids[r[keep]], s[keep]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, rows = np.asarray(left["id"], np.int64), _matrix(left["v"])
        queries, wanted = np.asarray(right["query_id"], np.int64), _matrix(right["v"])
        out, kinds = [], []
        if len(ids) and len(queries):
            names = left["g"].combine_chunks().dictionary_encode(null_encoding="encode") if group else None
            parts = [(names.dictionary[c].as_py(), np.nonzero(np.asarray(names.indices) == c)[0]) for c in range(len(names.dictionary))] if group else [(None, slice(None))]
            for kind, part in parts:
                for found in nearest(ids[part], rows[part], queries, wanted):
                    out.append(found)
                    kinds += [kind] * len(found[0])
        q, i, s = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        table = {"query_id": q, "id": i, "similarity": s}
        if group:
            table["g"] = pa.array(kinds, left["g"].type)
        return pa.table(table)

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """(query_id, id, similarity, rank) of the k rows nearest each query by inner product, rounded to 6 digits; with ``group`` the k rows of each group, with its column.

    Rows (id, v) and queries (query_id, v) are cut into blocks by hash; each pair of blocks is
    one task of matrix products that keeps k rows a query (and group), and only those are merged.
    """
    n, q = rows.count(), queries.count()
    rb, qb = max(1, n // BLOCK_ROWS), max(1, q // BLOCK_QUERIES)
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    extra = [F.col(group).alias("g")] if group else []
    left = rows.select(F.col("id").alias("id"), F.col("v").alias("v"), *extra, F.pmod(F.xxhash64("id"), F.lit(rb)).cast("int").alias("rb"), spread(qb).alias("qb"))
    right = queries.select(F.col("query_id").alias("query_id"), F.col("v").alias("v"), F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int").alias("qb"), spread(rb).alias("rb"))
    schema = "query_id long, id long, similarity double" + (f", g {dict(rows.dtypes)[group]}" if group else "")
    near = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(_best(k, group is not None), schema)
    order = Window.partitionBy("query_id", *(["g"] if group else [])).orderBy(F.desc("similarity"), "id")
    best = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.withColumnRenamed("g", group) if group else best


def quantise(v: Column, scale: float | Column, bits: int) -> Column:
    """Whole numbers of ``bits`` bits: v / scale in units of the largest code, cut at the bounds."""
    low, high = -(1 << bits - 1), (1 << bits - 1) - 1
    return F.transform(v, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), F.rint(x.cast("double") / scale * (high + 1)))).cast("int"))


def scale_of(df: DataFrame, v: str) -> DataFrame:
    """Four standard deviations of the absolute values of all components."""
    return df.select(F.explode(v).alias("x")).agg((F.stddev_pop(F.abs(F.col("x").cast("double"))) * 4).alias("scale"))


def sign_words(v: Column, width: int = 63) -> Column:
    """Bits of the signs, packed into longs of ``width`` bits."""
    bit = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1) + F.when(x > 0, 1).otherwise(0).cast("long"))
    starts = F.sequence(F.lit(1), F.size(v), F.lit(width))
    return F.transform(starts, lambda s: bit(F.slice(v, s, F.lit(width))))


def hamming_similarity(a: Column, b: Column, dimension: int) -> Column:
    """The number of equal signs."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.lit(dimension) - apart


def hamming_top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, equal_signs, rank) of the k rows with most signs equal to a query's, by exclusive or and bit count of packed words, in blocks."""
    n, q = rows.count(), queries.count()
    rb, qb = max(1, n // BLOCK_ROWS), max(1, q // BLOCK_QUERIES)
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    packed = lambda df, key, own, m, other, o: df.select(key, F.size("v").alias("d"), sign_words(F.col("v")).alias("w"), F.pmod(F.xxhash64(key), F.lit(m)).cast("int").alias(own), spread(o).alias(other))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "equal_signs": []}
        if left.num_rows and right.num_rows:
            order = np.argsort(np.asarray(left["id"]), kind="stable")
            ids = np.asarray(left["id"])[order]
            words = np.asarray(left["w"].combine_chunks().flatten()).reshape(len(ids), -1)[order]
            asked = np.asarray(right["w"].combine_chunks().flatten()).reshape(right.num_rows, -1)
            width = int(left["d"][0].as_py())
            for query, one in zip(right["query_id"].to_pylist(), asked):
                same = width - np.bitwise_count(words ^ one).sum(1, dtype=np.int64)
                best = np.argsort(-same, kind="stable")[:k]
                out["query_id"] += [query] * len(best)
                out["id"] += ids[best].tolist()
                out["equal_signs"] += same[best].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "equal_signs": pa.array(out["equal_signs"], pa.int32())})

    left, right = packed(rows, "id", "rb", rb, "qb", qb), packed(queries, "query_id", "qb", qb, "rb", rb)
    near = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(nearest, "query_id long, id long, equal_signs int")
    order = Window.partitionBy("query_id").orderBy(F.desc("equal_signs"), "id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class InvertedFile:
    """Rows in the cells of their nearest centroid, each with a short code; a search reads codes first.

    The number of cells grows with the root of the number of rows, and a cell of many rows is
    split over several tasks, so that no task grows with the collection.  A search visits the
    cells nearest the query, orders their rows by the product of the query with codes of
    ``BITS`` bits a component, and takes the full vectors of the best of them only, ``reread``
    for each row asked for.  The centroids are fitted on a bounded sample (``SAMPLE`` rows);
    every row is indexed.
    """

    SAMPLE, BITS = 50_000, 4
    CELL_ROWS = 50_000

    def __init__(self, rows: DataFrame, cells: int | None = None, seed: int = 11, rounds: int = 10):
        self.total = total = rows.count()
        part = rows.select("v") if total <= self.SAMPLE else rows.select("v").sample(False, self.SAMPLE / total, seed)
        data = np.array([r.v for r in part.limit(self.SAMPLE + self.SAMPLE // 10).collect()], np.float64)
        rng = np.random.default_rng(seed)
        cells = max(1, min(cells or math.isqrt(total), len(data) // 20 or 1))
        centre = data[rng.choice(len(data), cells, replace=False)] if len(data) else np.zeros((1, 1))
        for _ in range(rounds if len(data) else 0):
            owner = (data @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
            sums = np.zeros_like(centre)
            np.add.at(sums, owner, data)
            count = np.bincount(owner, minlength=cells)
            centre[count > 0] = sums[count > 0] / count[count > 0, None]
        self.centre = centre
        self.scale = float(np.abs(data).std() * 4) if len(data) else 1.0
        placed = rows.withColumn("cell", self._cells(1)("v")[0])
        # as many rows as there are cells, so they may go to every worker
        parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / self.CELL_ROWS).cast("int").alias("parts"))
        self.parts = parts
        self.rows = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        self.codes = self.rows.select("id", "cell", "part", quantise(F.col("v"), self.scale, self.BITS).cast("array<tinyint>").alias("v"))

    def _cells(self, probes: int):
        centre = self.centre

        @F.pandas_udf("array<int>")
        def nearest(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            data = np.stack(v.to_numpy()).astype(np.float64)
            score = data @ centre.T - 0.5 * (centre**2).sum(1)
            return pd.Series(list(np.argsort(-score, axis=1)[:, :probes].astype(np.int32)))

        return nearest

    def search(self, queries: DataFrame, k: int, probes: int | None = None, reread: int = 10) -> DataFrame:
        """(query_id, id, similarity, rank); ``probes`` cells are visited, all by default."""
        probes = min(probes or len(self.centre), len(self.centre))
        asked = queries.withColumn("cell", F.explode(self._cells(probes)("v"))).join(F.broadcast(self.parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        by = ["cell", "part"]
        near = self.codes.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_best(k * reread), "query_id long, id long, similarity double")
        first = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        kept = near.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k * reread).select("query_id", "id")
        full = kept.join(self.rows.select("id", "v"), "id").join(queries.select("query_id", F.col("v").alias("q")), "query_id")
        scored = full.select("query_id", "id", F.round(dot(F.col("q"), F.col("v")), 6).alias("similarity"))
        return scored.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
