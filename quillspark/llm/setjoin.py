"""Set similarity self-join by chosen paths.

Every distinct set gets a sketch of minwise tokens.  A tree sends a set along paths: at
each node two sketch positions, fixed by the node, are chosen and the set moves on to one
child for each, named by its minwise token there.  Two sets of similarity s share a
given branch with probability s, so a pair at the threshold 0.7 has 1.4 common children
per common node and meets in any depth of one tree with probability above 0.81, while
dissimilar sets part quickly.  Nodes small enough are compared exhaustively by sketch
bits; larger ones branch again; independent trees are repeated to the target recall.
Candidates are verified on the whole sets, so the result holds no false pair.

Sets that are equal are one class and are joined once through their representative.
Defined results: rows with a null or empty set have no class; repeated rows are members
of one class; a null key is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import Cut

POSITIONS = 128
NODE_LIMIT = 1_500
MAX_EXTRA_DEPTH = 8
U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + _M1
        x = (x ^ (x >> U(30))) * _M2
        x = (x ^ (x >> U(27))) * _M3
        return x ^ (x >> U(31))


def sketches(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minwise hashes of ragged sets of 64-bit values, one row per (non-empty) set."""
    out = np.empty((len(offsets) - 1, POSITIONS), np.uint32)
    for i in range(POSITIONS):
        h = mix(values ^ U((i + 1) * 0x2545F4914F6CDD1D & (2**64 - 1)))
        out[:, i] = (np.minimum.reduceat(h, offsets[:-1]) >> U(32)).astype(np.uint32)
    return out


def bits(sketch: np.ndarray) -> np.ndarray:
    """Two words of one bit per sketch position."""
    packed = np.packbits((sketch & 1).astype(np.uint8), axis=1)
    return np.ascontiguousarray(packed).view(np.uint64)


def children(path: np.ndarray, row: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both children of each (path, row)."""
    a, b = mix(path), mix(path ^ U(0x5851F42D4C957F2D))
    first = (a % U(POSITIONS)).astype(np.int64)
    second = (first + 1 + (b % U(POSITIONS - 1)).astype(np.int64)) % POSITIONS
    paths = [mix(mix(path ^ (p.astype(np.uint64) << U(50))) ^ sketch[row, p].astype(np.uint64)) for p in (first, second)]
    return np.concatenate(paths), np.concatenate([row, row])


def agreement_floor(threshold: float, sigmas: float = 3.5) -> int:
    """Least number of equal sketch bits that a pair at the threshold shows, up to ``sigmas``."""
    p = (1 + threshold) / 2
    return int(POSITIONS * p - sigmas * math.sqrt(POSITIONS * p * (1 - p)))


_SKETCHED = "id long, size int, b0 long, b1 long, sketch binary"


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sets = batch.column(1)
        offsets = np.asarray(sets.offsets, np.int64)
        values = np.asarray(sets.values).astype(np.int64).view(np.uint64)
        values = values[offsets[0] : offsets[-1]]
        sketch = sketches(values, offsets - offsets[0])
        word = bits(sketch).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets).astype(np.int32)), pa.array(word[:, 0]), pa.array(word[:, 1]), pa.array([r.tobytes() for r in sketch], pa.binary())],
            names=["id", "size", "b0", "b1", "sketch"],
        )


_NODE = "path long, id long, size int, b0 long, b1 long"


def _rooted(trees: int, depth: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint32).reshape(n, POSITIONS)
            for tree in range(trees):
                root = int(mix(np.array([seed * 1000 + tree], np.uint64))[0])
                path, row = np.full(n, root, np.uint64), np.arange(n)
                for _ in range(depth):
                    path, row = children(path, row, sketch)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), *[batch.column(i).take(take) for i in range(4)]], names=["path", "id", "size", "b0", "b1"])

    return run


def _branched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sketch = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint32).reshape(n, POSITIONS)
        path, row = children(np.asarray(batch.column(0)).view(np.uint64), np.arange(n), sketch)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), *[batch.column(i).take(take) for i in range(1, 5)]], names=["path", "id", "size", "b0", "b1"])


def _compare(threshold: float):
    """Compares the rows of each node, which lie together in a partition; side 0 meets sides 0 and 1, side 1 only side 0, side 2 any."""
    floor = agreement_floor(threshold)

    def node(ids, size, b0, b1, side) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        order = np.argsort(size, kind="stable")
        ids, size, b0, b1, side = ids[order], size[order], b0[order], b1[order], side[order]
        for begin in range(0, len(ids), 512):
            end = min(begin + 512, len(ids))
            reach = int(np.searchsorted(size, size[end - 1] / threshold + 1e-9, "right"))
            apart = np.bitwise_count(b0[begin:end, None] ^ b0[None, begin:reach]) + np.bitwise_count(b1[begin:end, None] ^ b1[None, begin:reach])
            i, j = np.nonzero(apart <= POSITIONS - floor)
            keep = i < j
            i, j = i[keep] + begin, j[keep] + begin
            keep = (size[i] >= threshold * size[j] - 1e-9) & ((side[i] != side[j]) | (side[i] == 2)) & (ids[i] != ids[j])
            left.append(ids[i[keep]])
            right.append(ids[j[keep]])
        a, b = np.concatenate(left), np.concatenate(right)
        return np.minimum(a, b), np.maximum(a, b)

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        path = table["path"].to_numpy()
        extra = table["block"].to_numpy()
        cols = [table["id"].to_numpy(), table["size"].to_numpy(), table["b0"].to_numpy().view(np.uint64), table["b1"].to_numpy().view(np.uint64), table["side"].to_numpy()]
        change = np.concatenate([[0], np.nonzero((np.diff(path) != 0) | (np.diff(extra) != 0))[0] + 1, [len(path)]])
        lefts, rights = [], []
        for s, e in zip(change[:-1].tolist(), change[1:].tolist()):
            if e - s > 1:
                a, b = node(*[c[s:e] for c in cols])
                if len(a):
                    lefts.append(a)
                    rights.append(b)
        if lefts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lefts)), pa.array(np.concatenate(rights))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            path = table["path"].to_numpy()
            blocks = table["block"].to_numpy()
            # the last node may go on in the next batch
            cut = len(path) - 1
            while cut > 0 and path[cut - 1] == path[-1] and blocks[cut - 1] == blocks[-1]:
                cut -= 1
            if cut:
                yield from emit(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from emit(pa.Table.from_batches(held))

    return run


def _pairs_of_nodes(nodes: DataFrame, threshold: float, parts: int) -> DataFrame:
    return nodes.repartition(parts, "path", "block").sortWithinPartitions("path", "block").mapInArrow(_compare(threshold), "a long, b long")


def candidates(sets: DataFrame, threshold: float, trees: int = 5, seed: int = 1, cut: Cut | None = None) -> DataFrame:
    """Candidate pairs (a < b) of (id long, set array<long>)."""
    spark = sets.sparkSession
    cut = cut or Cut(spark)
    sketched = cut(sets.mapInArrow(_sketch_batches, _SKETCHED))
    n = sketched.count()
    depth = max(1, round(math.log(max(1, n / NODE_LIMIT)) / math.log(6)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 20_000)
    frontier = sketched.select("id", "size", "b0", "b1", "sketch").mapInArrow(_rooted(trees, depth, seed), _NODE)
    found = []
    for extra in range(MAX_EXTRA_DEPTH + 1):
        frontier = cut(frontier)
        sizes = frontier.groupBy("path").agg(F.count("*").alias("n"))
        large = cut(sizes.filter(F.col("n") > NODE_LIMIT))
        if large.isEmpty():
            found.append(_pairs_of_nodes(frontier.withColumns({"block": F.lit(0).cast("long"), "side": F.lit(2)}), threshold, parts))
            break
        small = frontier.join(large, "path", "left_anti")
        found.append(_pairs_of_nodes(small.withColumns({"block": F.lit(0).cast("long"), "side": F.lit(2)}), threshold, parts))
        rest = frontier.join(large, "path")
        if extra < MAX_EXTRA_DEPTH:
            frontier = rest.join(sketched.select("id", "sketch"), "id").select("path", "id", "size", "b0", "b1", "sketch").mapInArrow(_branched, _NODE)
            continue
        # nodes that stay large hold sets alike throughout: compare them in blocks
        blocks = F.ceil(F.col("n") / NODE_LIMIT).cast("long")
        own = F.pmod(F.xxhash64("id"), F.col("blocks"))
        split = rest.withColumn("blocks", blocks).withColumn("own", own)
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        found.append(_pairs_of_nodes(split.select("path", "id", "size", "b0", "b1", (low * F.col("blocks") + high).alias("block"), side.alias("side")), threshold, parts))
    pairs = found[0]
    for other in found[1:]:
        pairs = pairs.unionByName(other)
    return pairs.distinct()


def similar_sets(rows: DataFrame, threshold: float, trees: int = 5, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets and links between them.

    ``rows`` has (id long, set array<long>), the set's elements distinct and sorted.
    Returns members (id, rep) and links (a, b, similarity) between representatives, a < b.
    """
    cut = Cut(rows.sparkSession)
    full = rows.filter(F.col("id").isNotNull() & (F.size("set") > 0))
    keyed = cut(full.select("id", "set", F.xxhash64("set").alias("h1"), F.hash("set").alias("h2")))
    # rows of a class are never gathered: the class has its least id, and each row finds it by the hashes
    classes = cut(keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("set").alias("set")))
    members = cut(keyed.select("id", "h1", "h2").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep"))
    sets = classes.select(F.col("rep").alias("id"), "set")
    pairs = candidates(sets, threshold, trees, seed, cut)
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    similarity = F.col("both") / (F.size("sa") + F.size("sb") - F.col("both"))
    links = joined.withColumn("similarity", similarity).filter(F.col("both") >= F.lit(threshold) * (F.size("sa") + F.size("sb") - F.col("both")) - F.lit(1e-9)).select("a", "b", "similarity")
    return cut.only(members, cut(links))


def word_set(*texts: str) -> F.Column:
    """Sorted hashes of the distinct lower-cased words (runs of letters or digits) of the columns together."""
    whole = F.lower(F.concat_ws(" ", *[F.col(t) for t in texts]))
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(whole, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.xxhash64(w))))


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (a < b) of rows in one class or in linked classes."""
    left = members.select(F.col("id").alias("x"), F.col("rep").alias("a"))
    right = members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    within = left.join(right, F.col("a") == F.col("b")).filter(F.col("x") < F.col("y"))
    across = links.join(left, "a").join(right, "b")
    both = within.select("x", "y").unionByName(across.select("x", "y"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
