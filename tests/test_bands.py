import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import bands, lookup, search


def titles(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("cell", "memory", "court", "léaf", "gene") for b in ("", "s", "ing")]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n)).title()
    known = [(i, make(rng.randint(1, 14))) for i in range(60)] + [(100, ""), (101, make(70)), (102, "x")]
    asked = [(1000 + i, t[: rng.randint(0, 3)] + t[rng.randint(0, 5) :]) for i, t in known]
    return spark.createDataFrame(asked, "q long, a string"), spark.createDataFrame(known, "i long, b string")


def met(asked, known):
    """The pairs as a join of all bands gives them."""
    kl, kr = asked.select("q", F.explode(search.title_bands(F.col("a"))).alias("k")), known.select("i", F.explode(search.title_bands(F.col("b"))).alias("k"))
    return lookup.blocked(kl, kr, ["k"], "q", "i").groupBy("q", "i").agg(F.count("*").alias("shared")).join(asked, "q").join(known, "i")


def test_alike_titles_are_those_of_the_joined_bands(spark, monkeypatch):
    asked, known = titles(spark)
    want = {(r.q, r.i, r.shared, round(r.ratio, 9)) for r in met(asked, known).withColumn("ratio", T.ratio(F.lower("a"), F.lower("b"))).filter("ratio > 80").collect()}
    assert want
    for pairs, most, size in ((10**9, 10**9, 10**9), (400, 20, 20_000)):
        monkeypatch.setattr(bands, "TASK_PAIRS", pairs)
        monkeypatch.setattr(bands, "BLOCK_ROWS", most)
        monkeypatch.setattr(bands, "SLICE_BYTES", size)
        got = [(r.q, r.i, r.shared, round(r.ratio, 9)) for r in bands.alike(asked, known, "q", "i", F.col("a"), F.col("b"), search.title_bands, 80.0).collect()]
        assert set(got) == want and len(got) == len(want)


def test_best_titles_by_words_are_those_of_the_joined_bands(spark):
    asked, known = titles(spark)
    want = {tuple(r) for r in search.rerank(met(asked, known).select(F.col("q").alias("query_id"), F.col("a").alias("query"), F.col("i").alias("id"), F.col("b").alias("text")), 3).collect()}
    scored = bands.most_words(asked, known, "q", "i", F.col("a"), F.col("b"), F.col("b"), search.title_bands, 3)
    assert {tuple(r) for r in search.ranked(scored.select(F.col("q").alias("query_id"), F.col("i").alias("id"), "score"), 3).collect()} == want
    # no pair but those wanted leaves the blocks: three of each asked title and block at most
    assert scored.count() < met(asked, known).count()


def test_each_pair_of_blocks_has_its_own_task(spark):
    for n in (1, 7, 24):
        places = bands._places(spark, n)
        rows = spark.createDataFrame([(z,) for z in places], "_z long").repartition(n, "_z").select(F.spark_partition_id().alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


def test_bands_in_batches_are_those_of_the_column(spark):
    odd = spark.createDataFrame([("",), ("  ",), ("x",), ("aßc É é",), ("日本語の題名",), ("long " * 300,), (None,), ("Of memory and court",)], "a string")
    assert search.add_title_bands(odd, F.col("a"), "b").collect() == odd.withColumn("b", search.title_bands(F.col("a"))).collect()


def test_few_titles_are_compared_letter_by_letter():
    rng = random.Random(7)
    words = ["of", "the", "outcome", "memory", "court", "léaf", "gene", "deadlock", "ααβγ"]
    known = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    known[:4] = [t + "zz" * 140 for t in known[:4]]
    side = bands._Titles(known)
    rows, wrong, left = np.arange(len(known)), [], 0
    for title in known[:60] + ["", "ω", "outcome of deadlock"]:
        codes = side.asked(title)
        near, need, frequent = side.near(title, codes, rows, 80.0)
        keep = near[side.likely([codes], np.zeros(len(near), np.int64), near, need, frequent)] if len(near) else near
        ratio = side.ratio([title], [codes], np.zeros(len(keep), np.int64), keep)
        want = {i: 200.0 * T._common_subsequence(title, t) / (len(t) + len(title)) if t or title else 100.0 for i, t in enumerate(known)}
        wrong += [i for i, x in want.items() if (x > 80.0) != (i in keep[ratio > 80.0].tolist())]
        assert all(want[i] == x for i, x in zip(keep.tolist(), ratio.tolist()))
        left += len(keep)
    # hardly more than those wanted are compared in full
    assert not wrong and left < 0.2 * 63 * len(known)
