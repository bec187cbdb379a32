"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import Cut

MOST_ROUNDS = 200


def _print(edges: DataFrame) -> tuple:
    """What tells two edge lists apart: their number and the sums of two hashes, from one scan."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.hash("a", "b").cast("long"))).first()
    return tuple(row)


def components(edges: DataFrame, cut: Cut) -> DataFrame:
    """(id, root) of every end of the edges (a, b): the least id of its component.

    Alternates large-star and small-star steps, whose work per round is linear in the
    edges and whose rounds grow with the logarithm of the longest path.  A hub's edges are
    never gathered in one row: each step needs the least neighbour only, which is
    aggregated before the shuffle and joined back.  Should the edges still change after
    ``MOST_ROUNDS`` rounds, an error is raised.
    """
    current = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = _print(current)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            break
        # large star: every larger neighbour of a node is linked to its least neighbour
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of a node, and the node, are linked to the least of them
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        nxt = cut(small.filter("a <> b").distinct())
        now = _print(nxt)
        cut.release(current, large)
        current, before, seen = nxt, seen, now
        if now == before:
            break
    else:
        raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
    rooted = current.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root")
    return rooted.unionByName(rooted.select(F.col("root").alias("id"), "root").distinct())
