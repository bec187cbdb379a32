"""References to records that do not exist.

``direct`` resolves pointers against their targets and names those without one:
'missing', 'deleted' if the target was once removed, or 'late' if it arrived after the
pointer.  ``cascade`` then walks the foreign-key graph: the children of an orphan are
orphans by inheritance, and so are theirs, until a round finds no new one.  Every round
is a semi-join of the edges with the last round's orphans only.

Records are named by (link, key_id, pos); pos is -1 for a whole row, else an ordinal in it.

Defined results: a pointer with a null part names no target; repeated pointers are one
orphan; a record that is an orphan itself is not reported as inherited; cycles end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import Cut

KEY = ["link", "key_id", "pos"]


def earliest(df: DataFrame, key: str, arrived: str, columns: list[Column]) -> DataFrame:
    """One row of each key: the earliest, nulls last; ties by the values of the columns."""
    values = F.struct(F.col(arrived).isNull().alias("_n"), F.col(arrived).alias("_t"), *columns)
    first = df.select(F.col(key).alias("_k"), values.alias("v")).groupBy("_k").agg(F.min("v").alias("v"))
    return first.select(F.col("_k").alias(key), F.col("v._t").alias(arrived), *[F.col("v")[c].alias(c) for c in first.select("v.*").columns if c not in ("_n", "_t")])


def resolve(pointers: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Pointers with what is known of their target: ``there``, when it arrived, ``size``, its number of entries, and ``known``.

    ``targets`` has ``on``, arrived and, if pointers go to entries of it, size.
    """
    size = F.max("size") if "size" in targets.columns else F.lit(None).cast("int")
    known = targets.groupBy(*on).agg(F.min("arrived").alias("there"), size.alias("size"), F.lit(True).alias("known"))
    return pointers.join(known, on, "left")


def unresolved(resolved: DataFrame, removed: DataFrame, on: list[str], late: bool = True) -> DataFrame:
    """(link, arrived, key_id, pos, reason) of resolved pointers to whole records that have no target, or one that came later."""
    gone = removed.select(*on).distinct().withColumn("gone", F.lit(True))
    suspect = resolved.filter(F.col("known").isNull() | (F.lit(late) & (F.col("there") > F.col("arrived"))))
    reason = F.when(F.col("known"), "late").when(F.col("gone"), "deleted").otherwise("missing")
    return suspect.join(gone, on, "left").select("link", "arrived", "key_id", "pos", reason.alias("reason"))


def valid_entry(entry: Column, size: Column) -> Column:
    """Whether a text names an entry of a list, by digits from 0."""
    return entry.rlike("^[0-9]+$") & F.coalesce(entry.try_cast("int") < size, F.lit(False))


def outside(resolved: DataFrame) -> DataFrame:
    """(link, arrived, key_id, pos, reason) of resolved pointers to an ``entry`` of a known record that it does not have; without an entry there is no pointer."""
    named = resolved.filter(F.col("known") & (F.col("entry") != ""))
    return named.filter(~valid_entry(F.col("entry"), F.coalesce("size", F.lit(0)))).select("link", "arrived", "key_id", "pos", F.lit("missing").alias("reason"))


def direct(pointers: DataFrame, targets: DataFrame, removed: DataFrame, on: list[str], late: bool = True) -> DataFrame:
    """(link, arrived, key_id, pos, reason) of pointers without a target.

    ``pointers`` has link, key_id, pos, arrived and the columns ``on``; ``targets`` has
    ``on`` and arrived; ``removed`` has ``on``.
    """
    return unresolved(resolve(pointers, targets, on), removed, on, late)


MOST_ROUNDS = 10_000


def cascade(direct_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """All orphans with their origin, 'direct' or 'inherited', and depth.

    ``edges`` has link, key_id, pos and arrived of the child and parent_link, parent_key,
    parent_pos.  An inherited orphan has the least reason of its parents.  A round joins the
    edges with the orphans of the last round only, and drops those found before by one
    anti-join with all of them.
    """
    cut = Cut(direct_rows.sparkSession)
    frontier = cut(direct_rows.withColumns({"origin": F.lit("direct"), "depth": F.lit(0)}))
    edges, found = cut(edges), [frontier]
    for depth in range(1, MOST_ROUNDS + 1):
        parents = frontier.select(F.col("link").alias("parent_link"), F.col("key_id").alias("parent_key"), F.col("pos").alias("parent_pos"), "reason")
        reached = edges.join(parents, ["parent_link", "parent_key", "parent_pos"]).groupBy(*KEY).agg(F.min("arrived").alias("arrived"), F.min("reason").alias("reason"))
        known = reduce(DataFrame.unionByName, [f.select(*KEY) for f in found])
        new = reached.join(known, KEY, "left_anti").select("link", "arrived", "key_id", "pos", "reason", F.lit("inherited").alias("origin"), F.lit(depth).alias("depth"))
        frontier = cut(new)
        if frontier.isEmpty():
            cut.release(edges, frontier)
            return reduce(DataFrame.unionByName, found)
        found.append(frontier)
    raise RuntimeError(f"orphans still spread after {MOST_ROUNDS} rounds")
