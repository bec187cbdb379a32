import json

from pyspark.sql import functions as F

from quillspark.operators import nested, orphans


def nodes(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    schema = nested.infer(df, "t")
    out = df.select("id", F.explode(nested.node_lists(schema, nested.document("t"), frozenset(["s"]))).alias("n")).collect()
    return schema, {(r.id, r.n.level, r.n.path) for r in out}


def test_drifting_shapes(spark):
    deep = {"a": [{"x": 1, "s": ["bare", None, {"c": {"z": 1}}]}, None, {"s": "alone"}]}
    as_object = {"a": {"s": [{"c": [{"z": 2}]}]}}
    as_text = {"a": json.dumps([{"s": ["t"]}]), "extra": {"a": 1}}
    schema, got = nodes(spark, json.dumps(deep), json.dumps(as_object), json.dumps(as_text), None, "", "{broken", "[1]", '{"a": []} x', "null")
    assert got == {
        (0, "a", "0"), (0, "a", "2"), (0, "a/s", "0.0"), (0, "a/s", "0.2"), (0, "a/s/c", "0.2.0"), (0, "a/s", "2.0"),
        (1, "a", "0"), (1, "a/s", "0.0"), (1, "a/s/c", "0.0.0"),
        (2, "a", "0"), (2, "a/s", "0.0"), (2, "extra", "0"),
    }
    assert set(schema.children) == {"a", "extra"} and schema.children["a"].columns["x"] == {"int"}


def test_child_tables_link_to_parents(spark):
    df = spark.createDataFrame([(7, json.dumps({"a": [{"id": "clash", "s": [{"c": 1}, "bare"]}]}))], "id int, t string")
    schema = nested.infer(df, "t")
    top = nested.child_table(df, "id", "t", schema, ["a"]).collect()
    low = nested.child_table(df, "id", "t", schema, ["a", "s"], frozenset(["s"])).collect()
    assert top[0].node_key == "7/a/0" and top[0].a_id == "clash" and top[0].parent_key is None
    assert {(r.node_key, r.parent_key, r.ordinal) for r in low} == {("7/a/0.0", "7/a/0", 0), ("7/a/0.1", "7/a/0", 1)}


def test_empty_table(spark):
    assert nodes(spark)[1] == set()


def test_newest_row_wins(spark):
    df = spark.createDataFrame([(1, 5, "old"), (1, 9, None), (2, None, "x")], "id int, v int, t string")
    got = {r.id: r.v for r in nested.newest(df, "id", "v", "t", F.col("t")).collect()}
    assert got == {1: None, 2: "x"}


def test_direct_orphans_and_cascade(spark):
    pointers = spark.createDataFrame([("r", 1, -1, 10, "A"), ("r", 2, -1, 10, "B"), ("r", 3, -1, 10, "C"), ("r", 4, -1, 10, None), ("r", 1, -1, 10, "A")], "link string, key_id long, pos int, arrived int, k string")
    targets = spark.createDataFrame([("A", 20), ("C", 5)], "k string, arrived int")
    removed = spark.createDataFrame([("B",), ("B",)], "k string")
    direct = orphans.direct(pointers, targets, removed, ["k"]).distinct()
    assert {(r.key_id, r.reason) for r in direct.collect()} == {(1, "late"), (2, "deleted"), (4, "missing")}
    edges = spark.createDataFrame(
        [("s", 10, 0, 11, "r", 1, -1), ("s", 11, 0, 11, "s", 10, 0), ("s", 10, 0, 11, "s", 11, 0), ("s", 12, 0, 11, "r", 3, -1), ("r", 2, -1, 10, "s", 10, 0)],
        "link string, key_id long, pos int, arrived int, parent_link string, parent_key long, parent_pos int",
    )
    got = {(r.link, r.key_id): (r.origin, r.depth, r.reason) for r in orphans.cascade(direct, edges).collect()}
    assert got[("s", 10)] == ("inherited", 1, "late") and got[("s", 11)] == ("inherited", 2, "late")
    assert ("s", 12) not in got and got[("r", 2)][0] == "direct"


def test_no_pointers(spark):
    empty = spark.createDataFrame([], "link string, key_id long, pos int, arrived int, k string")
    targets = spark.createDataFrame([], "k string, arrived int")
    assert orphans.direct(empty, targets, targets.select("k"), ["k"]).count() == 0


def test_orphans_are_inherited_over_several_levels(spark):
    direct = spark.createDataFrame([("a", None, 1, -1, "deleted"), ("b", None, 30, -1, "missing")], "link string, arrived timestamp_ntz, key_id long, pos int, reason string")
    chain = [("b", 10, "a", 1), ("c", 20, "b", 10), ("d", 40, "c", 20), ("a", 1, "d", 40), ("b", 30, "a", 1), ("e", 50, "x", 9), ("c", 20, "b", 10)]
    edges = spark.createDataFrame([(link, key, -1, None, parent, pkey, -1) for link, key, parent, pkey in chain], "link string, key_id long, pos int, arrived timestamp_ntz, parent_link string, parent_key long, parent_pos int")
    got = {(r.link, r.key_id): (r.origin, r.depth, r.reason) for r in orphans.cascade(direct, edges).collect()}
    assert got == {("a", 1): ("direct", 0, "deleted"), ("b", 30): ("direct", 0, "missing"), ("b", 10): ("inherited", 1, "deleted"), ("c", 20): ("inherited", 2, "deleted"), ("d", 40): ("inherited", 3, "deleted")}


def test_deep_documents_keep_all_levels(spark):
    value = {"x": "leaf"}
    for _ in range(30):
        value = {"k": [value]}
    schema = nested.infer(spark.createDataFrame([(json.dumps(value),)], "t string"), "t")
    depth = 0
    while "k" in schema.children:
        schema, depth = schema.children["k"], depth + 1
    assert depth == 30 and "x" in schema.columns
