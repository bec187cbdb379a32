import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import vectors
from quillspark.plans import registry


def table(spark, data, key="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], f"{key} long, v array<double>")


def test_top_k_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 20)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(2)
    data = np.round(rng.normal(size=(90, 5)), 1)
    data[10] = data[11] = data[12]
    sim = np.round(data[:10] @ data.T, 6)
    got = {}
    for r in vectors.top_k(table(spark, data), table(spark, data[:10], "query_id"), 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    for q in range(10):
        want = sorted(range(90), key=lambda i: (-sim[q, i], i))[:4]
        assert [i for _, i in sorted(got[q])] == want


def test_groups_empty_and_short(spark):
    rows = table(spark, np.eye(4)).withColumn("label", F.when(F.col("id") < 3, "a").otherwise(None))
    got = vectors.top_k(rows, table(spark, np.eye(4)[:1], "query_id"), 2, "label").collect()
    assert {(r.label, r.rank, r.id) for r in got} == {("a", 1, 0), ("a", 2, 1), (None, 1, 3)}
    assert vectors.top_k(rows.limit(0), table(spark, np.eye(4)[:1], "query_id"), 2).count() == 0


def test_forms_of_vectors(spark):
    df = spark.createDataFrame([([3.0, -4.0],)], "v array<double>")
    r = df.select(vectors.normalise(F.col("v")).alias("n"), vectors.dot(F.col("v"), F.col("v")).alias("d"), vectors.quantise(F.col("v"), 4.0, 4).alias("q"), vectors.hamming_similarity(vectors.sign_words(F.col("v")), vectors.sign_words(F.col("v")), 2).alias("h")).first()
    assert np.allclose(r.n, [0.6, -0.8]) and r.d == 25.0 and r.q == [6, -8] and r.h == 2


def test_inverted_file_recall(spark):
    assert registry.queries()["ann_ivf_recall"](spark, "/root/testdata/sf0.01").first().recall >= 0.9
