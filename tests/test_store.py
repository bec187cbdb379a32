import pytest
from pyspark.sql import functions as F

from quillspark.operators import index, keywords, postings
from quillspark.sources.store import Conflict, Store
from quillspark.streaming import refresh

PAPER = "id_int long, collection string, title string, abstract string, author array<struct<familyname:string,givenname:string>>, venue string, doi string, publicationdate struct<year:string,month:string,day:string>, reference array<struct<title:string>>, requireindexing boolean"


def papers(spark, rows):
    return spark.createDataFrame([(i, "c", title, abstract, [("Doe", "Jo")], "V", doi, ("2001", "1", "2"), [], True) for i, title, abstract, doi in rows], PAPER)


def test_versions_are_parts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = lambda *xs: spark.createDataFrame([(k, v) for k, v in xs], "k int, v string")
    got = lambda **kw: sorted((r.k, r.v) for r in store.read("t", **kw).collect())
    assert not store.exists("t") and store.count("t") == 0
    with pytest.raises(ValueError):
        store.read("t")
    assert store.write("t", rows((1, "a"), (2, "b"))) == 1
    assert store.append("t", rows((3, "c"))) == 2 and got() == [(1, "a"), (2, "b"), (3, "c")]
    assert store.upsert("t", rows((2, "B"), (4, "d")), ["k"]) == 3 and got() == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert store.append_new("t", rows((1, "x"), (5, "e"), (5, "e")), ["k"]) == 4 and got() == [(1, "a"), (2, "B"), (3, "c"), (4, "d"), (5, "e")]
    # rows added after a replacement are not replaced by it
    store.append("t", rows((2, "again")))
    assert (2, "again") in got() and (2, "B") in got() and got(version=2) == [(1, "a"), (2, "b"), (3, "c")]
    assert got(without=("k", [2])) == [(1, "a"), (3, "c"), (4, "d"), (5, "e")]
    folder = store.parts("t")[0].folder
    store.detach("t", folder)
    assert (1, "a") not in got()
    store.attach("t", folder)
    assert (1, "a") in got()
    before = got()
    store.compact("t")
    assert got() == before and len(store.parts("t")) == 1
    store.vacuum("t", 1)
    assert got() == before and len(store._list(f"{store.root}/t/data")) == 1


def test_a_reader_keeps_its_version_and_writers_do_not_overwrite(spark, tmp_path):
    store, other = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    store.write("t", spark.range(5))
    held = store.read("t")
    version = store.version("t")
    part = other._add("t", spark.range(100, 103))
    # a draft or a part without a version is not seen
    assert store.count("t") == 5 and store.version("t") == version
    store.append("t", spark.range(10, 12))
    assert held.count() == 5 and store.count("t") == 7
    with pytest.raises(Conflict):
        other._publish("t", version, [part])
    assert store.count("t") == 7


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    letters = lambda i: "q" + "".join("abcdefghij"[int(c)] for c in str(i))
    many = [(i, f"Title {letters(i)} of word", "some abstract text " * 20 + str(i), f"10.5555/{i}") for i in range(600)]
    refresh.refresh(store, papers(spark, many))
    first = {name: store.size(name) for name in refresh.TABLES}
    refresh.refresh(store, papers(spark, [(9001, "Wholly new title", "fresh text", "10.5555/new")]))
    assert store.count("papers") == 601
    for name in refresh.TABLES:
        assert store.size(name) - first[name] < max(first[name] / 5, 8_000), name


def test_repeats_within_a_batch_and_of_stored_papers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    # 2 repeats 1 by DOI, 3 repeats 2 by title and therefore stays, 4 has neither key
    rows = [(1, "First title here", "a", "10.5555/x"), (2, "Second title here", "b", "10.5555/X"), (3, "Second title here", "c", None), (4, "", "d", None)]
    refresh.refresh(store, papers(spark, rows))
    ids = lambda name="papers": sorted({r.id_int for r in store.read(name).select("id_int").collect()})
    assert ids() == [1, 3, 4] == ids("vectors")
    refresh.refresh(store, papers(spark, [(5, "Another title", "e", "10.5555/x"), (1, "First title changed", "new words", "10.5555/x")]))
    assert ids() == [1, 3, 4]
    assert store.read("papers").filter("id_int = 1").first().title == "First title changed"
    terms = {r.term for r in store.read("postings").filter("id_int = 1").collect()}
    assert "changed" in terms and "here" not in terms


def test_stored_index_matches_scan_and_pushes_terms(spark, tmp_path):
    paper = spark.read.parquet("/root/testdata/sf0.001/paper.parquet")
    at = index.StoredIndex(Store(spark, f"file://{tmp_path}/i"), "postings", ["id_int"]).build(paper, postings.paper_terms(), 3)
    for text in ("cell<AND>sample", "memory<OR>court", "<NOT>cell", "Title:memory leak", "gene expression<AND><NOT>cell", "Year:2005..2010", ""):
        scan = keywords.match_rows(paper.select("id_int", postings.paper_terms().alias("t")), "t", keywords.parse(text))
        assert {r.id_int for r in at.match(text).collect()} == {r.id_int for r in scan.collect()}, text
    plan = at.match("cell<AND>sample")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan.replace("IsNotNull(term), ", "") or "In(term, [cell,sample])" in plan
    more = paper.limit(3).withColumn("id_int", F.col("id_int") + 10_000).withColumn("title", F.lit("zyzzyva cell"))
    at.add(more, postings.paper_terms())
    assert at.match("zyzzyva").count() == 3 and at.documents().count() == paper.select("id_int").distinct().count() + 3
