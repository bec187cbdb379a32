"""Mixing sources to target weights by iterative proportional fitting.

Token sizes are summed into cells of source, language and topic.  The driver rakes the
cells' weights to the three marginals in turn: the sources to their target shares of the
total, languages and topics to the shares they have in the corpus, so that shifting the
sources does not shift them.  A weight is the expected number of uses of a document of the
cell and stays within the source's cap; the source marginal is raked last, so it holds.
The total is the largest one for which every source that has records can reach its share,
unless one is given.

A document is used floor(weight) times and once more with the remaining probability, by a
hash of its id.  The cut-off of that last use is shifted for each source, by a histogram of
hashes, until the source's sampled tokens meet its target, so that sizes of single
documents do not disturb the shares.

Bounds: cells and histograms depend on the numbers of target sources, languages and topics
only; of languages and of topics beyond the 200 largest the rest are raked as one.

Defined results: sources without a target, null sources and documents without tokens are not
used; the share of a target source without records is spread over the others; a repeated
doc_id is used as one document; no document is used more often than its source's cap.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import Cut

BINS = 4096
CATEGORIES = 200


def rake(sizes: np.ndarray, source: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]], goal: np.ndarray, cap: np.ndarray, rounds: int = 200, close: float = 1e-9) -> tuple[np.ndarray, bool]:
    """Weights of cells, and whether they stay as they are within the rounds.

    ``sizes`` are the cells' tokens, ``source`` their source index; ``others`` are pairs of the
    cells' category index and the categories' target tokens; ``goal`` are the sources' target
    tokens and ``cap`` their largest weights.
    """
    most = cap[source]
    weight = np.minimum(goal[source] / np.maximum(np.bincount(source, sizes, len(goal))[source], 1e-12), most)

    def fit(weight: np.ndarray, index: np.ndarray, target: np.ndarray) -> np.ndarray:
        # capped cells cannot grow, so what they lack is sought in the free ones
        for _ in range(50):
            total = np.bincount(index, weight * sizes, len(target))
            ratio = target / np.maximum(total, 1e-12)
            free = (weight < most) | (ratio[index] < 1)
            fixed = np.bincount(index, np.where(free, 0, weight * sizes), len(target))
            loose = np.bincount(index, np.where(free, weight * sizes, 0), len(target))
            factor = np.clip((target - fixed) / np.maximum(loose, 1e-12), 0, 1e6)
            new = np.where(free, np.minimum(weight * factor[index], most), weight)
            if np.abs(new - weight).max(initial=0) < 1e-12:
                break
            weight = new
        return weight

    for _ in range(rounds):
        before = weight
        for index, target in others:
            weight = fit(weight, index, target)
        weight = fit(weight, source, goal)
        if np.abs(weight - before).max(initial=0) < close:
            return weight, True
    return weight, False


def largest_total(sizes: np.ndarray, share: np.ndarray, cap: np.ndarray) -> float:
    """The largest total at which no source needs more than its capped tokens."""
    return float((sizes * cap / share).min()) if len(sizes) else 0.0


def plan(documents: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sample, report, margins) for documents (doc_id, source, language, topic, tokens) and targets (source, target_share, max_repeat).

    The sample has doc_id, source, language, topic, tokens and copies, for copies above 0; the
    report one row for each target source; margins, for each source, language and topic,
    the share aimed at, that of the raked weights and that of the sample, and whether the
    weights converged.  Where caps keep a margin from its target, the raked share tells.
    """
    spark = documents.sparkSession
    cut = Cut(spark)
    wanted = targets.filter("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeat").alias("cap"))
    wish = sorted(wanted.collect(), key=lambda r: r.source)
    names = [r.source for r in wish]
    one = documents.filter(F.col("source").isin(names) & (F.col("tokens") > 0)).groupBy("doc_id").agg(F.max(F.struct("tokens", "source", "language", "topic")).alias("x"))
    base = cut(one.select("doc_id", "x.source", F.coalesce("x.language", F.lit("")).alias("language"), F.coalesce("x.topic", F.lit("")).alias("topic"), "x.tokens"))
    # so that the number of cells is bounded, categories beyond the largest ones are raked as one
    for column in ("language", "topic"):
        large = base.groupBy(column).agg(F.sum("tokens").alias("t")).orderBy(F.desc("t"), column).limit(CATEGORIES + 1).collect()
        if len(large) > CATEGORIES:
            base = base.withColumn(column, F.when(F.col(column).isin(*[r[column] for r in large[:CATEGORIES]]), F.col(column)).otherwise("(other)"))
    cells = base.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens")).orderBy("source", "language", "topic").collect()
    have = {n: 0.0 for n in names}
    for c in cells:
        have[c.source] += c.tokens
    live = [r for r in wish if have[r.source] > 0 and (r.cap or 0) > 0]
    if not live:
        none = base.withColumn("copies", F.lit(0)).limit(0)
        return none, _report(spark, none, wish, have), spark.createDataFrame([], MARGINS)
    place = {r.source: i for i, r in enumerate(live)}
    share = np.array([r.share for r in live], float)
    share /= share.sum()
    cap = np.array([r.cap for r in live], float)
    sizes_by = np.array([have[r.source] for r in live])
    total = total or largest_total(sizes_by, share, cap)
    used = [c for c in cells if c.source in place]
    sizes = np.array([c.tokens for c in used], float)
    source = np.array([place[c.source] for c in used])
    others = []
    for column in ("language", "topic"):
        kinds = {k: i for i, k in enumerate(sorted({c[column] for c in used}))}
        index = np.array([kinds[c[column]] for c in used])
        others.append((index, np.bincount(index, sizes, len(kinds)) / sizes.sum() * total))
    weight, converged = rake(sizes, source, others, share * total, cap)
    table = spark.createDataFrame([(c.source, c.language, c.topic, float(w), float(cap[s])) for c, w, s in zip(used, weight, source)], "source string, language string, topic string, weight double, cap double")
    chance = (F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    whole = F.floor(F.col("weight") + 1e-9)
    drawn = base.join(F.broadcast(table), ["source", "language", "topic"]).withColumn("whole", whole)
    drawn = drawn.withColumn("rank", chance - (F.col("weight") - F.col("whole"))).withColumn("room", F.col("whole") + 1 <= F.col("cap"))
    # ranks run from -1 to 1; a document with room is used once more if its rank is below the source's cut-off
    binned = drawn.filter("room").groupBy("source", F.floor((F.col("rank") + 1) * (BINS / 2)).cast("int").alias("bin")).agg(F.sum("tokens").alias("tokens"))
    sure = {r.source: r.tokens for r in drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("whole")).alias("tokens")).collect()}
    bins: dict[str, np.ndarray] = {r.source: np.zeros(BINS + 1) for r in live}
    for r in binned.collect():
        bins[r.source][min(max(r.bin, 0), BINS)] += r.tokens
    cuts = []
    for r in live:
        need = share[place[r.source]] * total - sure.get(r.source, 0)
        below = np.concatenate([[0.0], np.cumsum(bins[r.source])])
        cuts.append((r.source, int(np.abs(below - need).argmin())))
    edge = spark.createDataFrame(cuts, "source string, edge int")
    taken = drawn.join(F.broadcast(edge), "source")
    more = F.col("room") & (F.floor((F.col("rank") + 1) * (BINS / 2)).cast("int") < F.col("edge"))
    sample = taken.withColumn("copies", (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int")).filter("copies > 0").select("doc_id", "source", "language", "topic", "tokens", "copies")
    goals = [("source", r.source, float(share[place[r.source]])) for r in live]
    for column in ("language", "topic"):
        kinds: dict[str, float] = {}
        for c, n in zip(used, sizes):
            kinds[c[column]] = kinds.get(c[column], 0.0) + n / sizes.sum()
        goals += [(column, k, v) for k, v in sorted(kinds.items())]
    raked: dict[tuple[str, str], float] = {}
    for c, w, n in zip(used, weight, sizes):
        for column in ("source", "language", "topic"):
            raked[column, c[column]] = raked.get((column, c[column]), 0.0) + w * n
    whole = max(float((weight * sizes).sum()), 1e-12)
    aims = spark.createDataFrame([(m, k, float(v), float(raked.get((m, k), 0.0) / whole), converged) for m, k, v in goals], MARGINS.rsplit(", ", 1)[0])
    return sample, _report(spark, sample, wish, have), _margins(sample, aims)


MARGINS = "margin string, category string, target_share double, raked_share double, converged boolean, reached_share double"


def _margins(sample: DataFrame, aims: DataFrame) -> DataFrame:
    """The sample's share of each category beside its aims; categories are bounded, so the window over a margin is small."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("margin"), F.col(c).alias("category")) for c in ("source", "language", "topic")])).alias("m")
    used = sample.select(each, (F.col("tokens") * F.col("copies")).alias("t")).groupBy("m.margin", "m.category").agg(F.sum("t").alias("t"))
    reached = F.coalesce(F.col("t") / F.sum("t").over(Window.partitionBy("margin")), F.lit(0.0))
    return aims.join(used, ["margin", "category"], "left").select("margin", "category", "target_share", "raked_share", "converged", reached.alias("reached_share"))


def _report(spark, sample: DataFrame, wish: list, have: dict[str, float]) -> DataFrame:
    goals = spark.createDataFrame([(r.source, float(r.share), int(r.cap or 0), int(have[r.source])) for r in wish], "source string, target_share double, max_repeat int, available_tokens long")
    reached = sample.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("uses"), F.max("copies").alias("most_uses"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    # one row a target source, so the window over all of them is small
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "uses", "most_uses", "tokens")]
    joined = goals.join(reached, "source", "left")
    return joined.select("source", "target_share", "max_repeat", "available_tokens", *zero, F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("reached_share"))
