import io
import sqlite3
import tarfile

from pyspark.sql import functions as F

from quillspark.functions import registry
from quillspark.operators import ingest
from quillspark.sources import databases, files
from quillspark.sources.store import Store
from quillspark.streaming import refresh

XML = "<article><front><article-meta><article-id pub-id-type='doi'>10.5555/{n}</article-id><title-group><article-title>{title}</article-title></title-group><abstract><p>About {title}.</p></abstract></article-meta></front></article>"


def test_sqlite_in_ranges(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "my table" (id INTEGER, t TEXT, x REAL)')
        db.executemany('INSERT INTO "my table" VALUES (?, ?, ?)', [(i, f"t{i}" if i % 3 else None, i / 2) for i in range(5, 105)])
    got = databases.read_sqlite(spark, path, "my table", "id", "id long, t string, x double", step=30)
    assert sorted((r.id, r.t, r.x) for r in got.collect()) == [(i, f"t{i}" if i % 3 else None, i / 2) for i in range(5, 105)]
    assert [r.id for r in databases.read_sqlite(spark, path, "my table", "id", "id long", 10, 13, 2).orderBy("id").collect()] == [10, 11, 12]
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE empty (id INTEGER)")
    assert databases.read_sqlite(spark, path, "empty", "id", "id long").count() == 0


def test_latex_is_flattened():
    sources = {"p/main.tex": rb"\documentclass{a} % x" + b"\n" + rb"\input{sec/one} 5\% \include{two}\bibliography{refs}", "p/sec/one.tex": rb"ONE \input{main}", "p/two.tex": b"TWO % hidden", "p/main.bbl": rb"\begin{thebibliography}B", "p/fig.png": b"\x89"}
    text = files.flatten_latex(sources)
    assert "ONE" in text and "TWO" in text and "hidden" not in text and r"5\%" in text and "thebibliography" in text and text.count("documentclass") == 1
    assert files.flatten_latex({"a.tex": b"no class"}) is None


def test_uploads_by_kind(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        data = rb"\documentclass{a} body"
        info = tarfile.TarInfo("m.tex")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    rows = [("a.nxml", XML.format(n=1, title="One").encode()), ("b.pdf", b"%PDF"), ("c.tar.gz", tar.getvalue()), ("d.docx", b"x"), ("e.xml", b"<broken")]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.file: (r.title, r.error) for r in files.convert(df, lambda c: XML.format(n=2, title="Two").encode(), lambda c: b"<std><title>Three</title><p>" + c[-4:] + b"</p></std>").collect()}
    assert got["a.nxml"] == ("One", None) and got["b.pdf"] == ("Two", None) and got["c.tar.gz"] == ("Three", None)
    assert "unknown kind" in got["d.docx"][1] and got["e.xml"][0] is None and got["e.xml"][1]
    assert "no converter" in {r.file: r.error for r in files.convert(df).collect()}["b.pdf"]


def test_batch_of_files_is_indexed_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    kind = "pos int, uploader string, path string, content binary"
    one, two = XML.format(n=1, title="First matter").encode(), XML.format(n=2, title="Second matter").encode()
    status = lambda rows: {r.path: r.status for r in ingest.index_files(store, spark.createDataFrame(rows, kind), "upload").collect()}
    assert status([(0, "u", "a.xml", one), (1, "u", "copy.xml", one), (2, "u", "b.xml", two), (3, "u", "x.bin", b"?")]) == {"a.xml": "indexed", "copy.xml": "known", "b.xml": "indexed", "x.bin": "ValueError: unknown kind of file"}
    assert sorted((r.id_int, r.title) for r in store.read("papers").collect()) == [(1, "First matter"), (2, "Second matter")]
    again = XML.format(n=1, title="First matter renamed").encode()
    assert status([(0, "u", "a.xml", one), (1, "v", "c.xml", XML.format(n=3, title="Third matter").encode()), (2, "v", "d.xml", again)])["a.xml"] == "known"
    assert sorted(r.title for r in store.read("papers").collect()) == ["First matter", "Second matter", "Third matter"]
    assert store.read("postings").filter("term = 'third'").count() == 1


def test_shards_and_views(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.write("v", spark.range(100))
    store.shard("v", store.read("v"), "id", 4)
    parts = store.parts("v")
    assert len(parts) == 4 and store.count("v") == 100
    store.shard("v", store.read("v"), "id", 3)
    store.detach("v", store.parts("v")[0].folder)
    assert 0 < store.count("v") < 100
    store.view("v", "vv")
    before = spark.sql("SELECT count(*) AS n FROM vv").first().n
    store.append("v", spark.range(1000, 1005))
    store.view("v", "vv")
    assert spark.sql("SELECT count(*) AS n FROM vv").first().n == before + 5
    store.write_sorted("w", spark.range(50).select((F.col("id") % 7).alias("k"), "id"), ["k", "id"], 3)
    assert store.count("w") == 50


def test_running_totals_keep_state(spark, tmp_path):
    schema = "user_id long, ts timestamp, value double"
    day = "2024-01-01 "
    batches = [[(1, day + "00:00:00", 1.0), (2, day + "00:01:00", 5.0)], [(1, day + "00:10:00", 2.0)], [(3, day + "09:00:00", 1.0)], [(3, day + "09:10:00", 1.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "user_id long, ts string, value double").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = refresh.running_totals(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        refresh.run_once(live, str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = [(r.user_id, r.n, r.total, r.done) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert (1, 2, 3.0, False) in rows and (1, 2, 3.0, True) in rows and (2, 1, 5.0, True) in rows and (3, 2, 2.0, False) in rows and not any(r[0] == 3 and r[3] for r in rows)


def test_functions_for_sql(spark):
    assert set(registry.register(spark)) >= {"indel_ratio", "split_sentences"}
    assert spark.sql("SELECT round(indel_ratio('abcd', 'abce'), 1) AS r, stems(array('running', 'cells')) AS s").first() == (75.0, ["run", "cell"])
    got = spark.sql("SELECT pos, sentence FROM split_sentences('One here.  Two there. ')").collect()
    assert [(r.pos, r.sentence) for r in got] == [(0, "One here."), (1, "Two there.")] or [(r.pos, r.sentence) for r in got] == [(0, "One here."), (1, "Two there")]
