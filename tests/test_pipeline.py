import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import federation, lookup, models, pipeline, search, vectors


def test_query_source_order(spark):
    asked = spark.createDataFrame([(1, " some text ", "c", 7, "k"), (2, "", "c", 7, "k"), (3, None, "c", 99, "a<AND><NOT>b<OR>c"), (4, "", None, None, None)], "query_id long, text string, collection string, id_int long, keywords string")
    held = spark.createDataFrame([("c", 7, "its content"), ("c", 8, " ")], "collection string, id_int long, content string")
    got = {r.query_id: r.source for r in pipeline.sources(asked, held).collect()}
    assert got == {1: "some text", 2: "its content", 3: "a  b c", 4: ""}


def test_document_search_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(80)]
    rows = [(i, "ab"[i % 2], i, texts[i], texts[i][:20], texts[i]) for i in range(80)]
    papers = spark.createDataFrame(rows, "id long, collection string, id_int long, title string, abstract string, content string")
    asked = spark.createDataFrame([(1, texts[5], None, None, ""), (2, "", "b", 7, "")], "query_id long, text string, collection string, id_int long, keywords string")
    matching = papers.filter("id % 3 <> 0").select("id")
    model = models.HashedWords(32)
    embeddings = models.embed(papers, "id", "content", model)
    results, stats = pipeline.document_search(asked, papers, matching, embeddings, "w1", 5, 10, model)
    got = {}
    for r in results.orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    vec = model(texts)
    whole = model([f"{t} {t}" for t in texts])
    for query, source in ((1, texts[5]), (2, texts[7])):
        q = model([f"{source} w1"])[0]
        live = [i for i in range(80) if i % 3]
        first = [i for c in "ab" for i in sorted((i for i in live if "ab"[i % 2] == c), key=lambda i: (-round(float(vec[i] @ q), 6), i))[:10]]
        best = sorted(first, key=lambda i: -round(float(whole[i] @ q), 6))[:5]
        assert set(got[query]) == set(best)
    assert {(r.query_id, r.matching_documents) for r in stats.collect()} == {(1, 53), (2, 53)}
    assert pipeline.strategy(50, 10_000) == "exact" and pipeline.strategy(20_000, 1_000_000) == "index" and pipeline.strategy(15_000, 10_000_000) == "exact"


def test_inverted_file_splits_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors.InvertedFile, "CELL_ROWS", 7)
    rng = np.random.default_rng(4)
    data = rng.normal(size=(150, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<double>")
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "v")
    file = vectors.InvertedFile(rows)
    found = {(r.query_id, r.id) for r in file.search(asked, 5).collect()}
    exact = {(r.query_id, r.id) for r in vectors.top_k(rows, asked, 5).collect()}
    assert len(found & exact) / len(exact) >= 0.9 and file.rows.select("cell", "part").distinct().count() > file.parts.count()
    sets = vectors.InvertedFile(rows.limit(0)).search(asked, 5)
    assert sets.count() == 0


def test_hamming_words_against_numpy(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(60, 70))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<double>")
    got = {(r.query_id, r.id): r.equal_signs for r in vectors.hamming_top_k(rows, rows.filter("id < 3").select(F.col("id").alias("query_id"), "v"), 60).collect()}
    signs = data > 0
    assert got == {(q, i): int((signs[q] == signs[i]).sum()) for q in range(3) for i in range(60)}


def test_federation(spark):
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    a, b = spark.createDataFrame([(1, "a1")], "id int, t string"), spark.createDataFrame([(1, "b1"), (2, "b2")], "id int, t string")
    got = {r.id: (r.service, r.t) for r in federation.first_present(wanted, {"a": a, "b": b}, ["id"], ["t"]).collect()}
    assert got == {1: ("a", "a1"), 2: ("b", "b2"), 3: (None, None)}
    assert federation.gather({"a": a, "b": b}).count() == 3 and federation.live_shards(["x", "y", "z"], ["y"]) == ["x", "z"]
    assert federation.guarded(a, "id", None).count() == 0 and federation.guarded(a, "id", wanted).count() == 1
    assert federation.point(b, "id", 9, [F.col("t")]).first().t is None


def test_titles_of_common_words_are_found(spark):
    base = "the cell and the sample of the memory of the court"
    rows = [(i, base + f" number {i:04d} for the reader", ["Doe"]) for i in range(300)] + [(900, base + " with one special ending", ["Roe"])]
    papers = spark.createDataFrame(rows, "id_int long, title string, families array<string>")
    asked = spark.createDataFrame([("q", base + " with one specal ending", None), ("r", "", None), ("s", None, "x")], "q string, title string, family string")
    got = [(r.q, r.id_int, r.found_by) for r in search.search_titles(asked, papers, "q", "id_int").collect()]
    assert got == [("q", 900, "search")]


def test_hot_keys_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BLOCK", 5)
    a = spark.createDataFrame([(i, "hot" if i < 17 else f"k{i}") for i in range(20)], "x long, k string")
    b = spark.createDataFrame([(i, "hot" if i < 23 else f"k{i - 6}") for i in range(26)], "y long, k string")
    want = {(r.x, r.y) for r in a.join(b, "k").collect()}
    got = [(r.x, r.y) for r in lookup.blocked(a, b, ["k"], "x", "y").select("x", "y").collect()]
    assert set(got) == want and len(got) == len(want)


def test_cascade_with_files_and_stems(spark):
    schema = "id long, collection string, md5 string, doi string, title string, who string"
    known = spark.createDataFrame([(1, "a", "ff", None, "Studies of running cells", "Jo Doe"), (2, "b", None, None, "Study of the running cell", "Jo Doe"), (3, "b", "ee", "10.5555/q", "Other title altogether", "")], schema)
    keys = lambda df: lookup.duplicate_keys(df, ["id", "collection"], "doi", "title", F.col("who"), "md5", True)
    asked = spark.createDataFrame([(7, "x", "FF ", None, "Nothing alike", ""), (8, "x", None, None, "The studies of a running cell", "Jo Doe"), (9, "x", None, "doi:10.5555/Q", "Studies of running cells", "Jo Doe")], schema)
    k, a = keys(known).withColumnRenamed("id", "known"), keys(asked).drop("collection").withColumnRenamed("id", "asked")
    got = {(r.asked, r.known, r.key_type) for r in lookup.cascade_match(a, k, "asked", "known").collect()}
    assert got == {(7, 1, "md5"), (8, 1, "title"), (8, 2, "title"), (9, 3, "doi")}
    by = {(r.asked, r.collection, r.known) for r in lookup.cascade_by_collection(a, k, "asked", "known", ["b", "a"]).collect()}
    assert by == {(7, "a", 1), (8, "b", 2), (9, "b", 3)}


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_small_text_functions(spark):
    lit = F.lit
    assert one(spark, T.joined_date(lit("2001"), lit(" "), lit("5")), T.day_month_year(lit(None).cast("string"), lit("7"), lit("1999")), T.full_year(lit("49")), T.full_year(lit("50")), T.full_year(lit("x"))) == ("2001-5", "01-7-1999", 2049, 1950, None)
    assert one(spark, T.is_expansion(lit("-")), T.is_expansion(lit(" –")), T.is_expansion(lit("  ")), T.is_expansion(lit("-a")), T.is_expansion(lit(None).cast("string"))) == (True, True, False, False, False)
    assert one(spark, T.without_tokens(lit("<pad> It works.</s>"))) == ("It works.",)
    assert one(spark, T.ascii_text(lit("Łódź Щука Чехов Αθήνα ß 中")))[0].strip() == "Lodz Shchuka Chekhov Athina ss"
    spans = F.array(*[F.struct(lit(a).alias("start"), lit(b).alias("end"), lit(n).alias("new")) for a, b, n in ((6, 8, "B"), (2, 4, "A"), (3, 5, "lost"), (4, 6, "C"))])
    assert one(spark, T.replace_spans(lit("ab[]<>()yz"), spans, "{", "}", "; "), T.is_inside(lit(2), lit(4), spans), T.is_inside(lit(1), lit(4), spans)) == ("abA; {C}; {B}yz", True, False)
    source = r"\\newcommand{$x$} \\begin{document} a $x_1$ b \\citep[see][p. 3]{Key} \\bibitem[Doe(2001)]{k} \\begin{align*} q \\end{align*} $$z$$ cost \\$5 \\[ y \\] end".replace("\\\\", "\\")
    got = one(spark, T.clean_latex(lit(source)))[0]
    assert "{$x$}" in got and "x_1" not in got and r"\cite{Key}" in got and r"\bibitem{k}" in got and " q " not in got and "z" not in got.split("document}")[1] and " y " not in got and r"\$5" in got and got.endswith("end")
    entries = F.array(*[F.struct(lit(k).alias("key"), lit(v).alias("value")) for k, v in (("a", "1"), ("b", "2"), ("a", "3"))])
    assert one(spark, T.last_by_key(entries))[0] == {"a": "3", "b": "2"}
    assert one(spark, T.word_ids(F.array(lit("x"), lit("q"), lit("y")), {"x": 5, "y": 6}, 5, 0, 1, 2), T.word_ids(F.array(lit("x"), lit("y"), lit("x")), {"x": 5, "y": 6}, 2)) == ([5, 0, 6, 2, 1], [5, 6])


def test_passages():
    assert T.passage("the quick brown fox jumps", "we saw that the quikc brown fox jumps over it") == (11, 37 - 1) or T.passage("the quick brown fox jumps", "we saw that the quikc brown fox jumps over it")[0] in (11, 12)
    assert T.passage("completely different words here and there", "nothing of this kind") is None
    needle = "x" * 40 + "the middle of this passage is found here" + "y" * 40
    at = T.passage(needle, "zzzz" * 20 + "the middle of this passage is found here" + "qqqq" * 20)
    assert at is not None and at[0] < 80 < at[1]


def test_near_matches_against_the_full_table():
    rng = np.random.default_rng(7)
    for _ in range(300):
        needle = "".join(rng.choice(list("abc"), rng.integers(1, 9)))
        text = "".join(rng.choice(list("abc"), rng.integers(0, 60)))
        most = int(rng.integers(0, 4))
        ends = T._ends(needle, text, most) if most < len(needle) else list(range(len(text)))
        assert ends == [b - 1 for _, _, b in T._starts(needle, text, 0, len(text), most)]


def test_sections_of_a_paper(spark):
    kind = "array<struct<section_text:array<struct<paragraph_text:array<struct<sentence_text:string>>>>>>"
    df = spark.createDataFrame([(1, [([([("A.",), (None,)],), ([("B.",)],)],), (None,)], []), (2, None, [([([("C.",)],)],)])], f"id int, a {kind}, b {kind}")
    got = {r.id: (r.t, r.n) for r in df.select("id", pipeline.section_texts(F.col("a"), F.lit("T")).alias("t"), F.size(pipeline.body_or_abstract(F.col("b"), F.col("a"))).alias("n")).collect()}
    assert got == {1: (["T", "A.  B.", ""], 2), 2: (["T"], 1)}
    scored = search.rerank(spark.createDataFrame([(1, "q", 1, "x"), (1, "q", 2, "xx")], "query_id int, query string, id int, text string"), 1, lambda q, t: t.str.len().astype("float64"))
    assert [r.id for r in scored.collect()] == [2] and isinstance(pd.Series([1]), pd.Series)


def test_search_through_the_index_filters_its_hits(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, 10)) for _ in range(60)]
    papers = spark.createDataFrame([(i, "a", i, texts[i], "", texts[i]) for i in range(60)], "id long, collection string, id_int long, title string, abstract string, content string")
    asked = spark.createDataFrame([(1, texts[4], None, None, "")], "query_id long, text string, collection string, id_int long, keywords string")
    model = models.HashedWords(16)
    embeddings = models.embed(papers, "id", "content", model)
    monkeypatch.setattr(pipeline, "strategy", lambda n, total: "index")
    results, _ = pipeline.document_search(asked, papers, papers.filter("id % 2 = 0").select("id"), embeddings, "", 5, 20, model, index=vectors.InvertedFile(embeddings))
    found = [r.id for r in results.orderBy("rank").collect()]
    assert found and found[0] == 4 and all(i % 2 == 0 for i in found)
