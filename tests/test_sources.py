import gzip
import io
import json
import tarfile
import zipfile

from pyspark.sql import functions as F

from quillspark.operators import lookup, normalise, projection, sections, summary
from quillspark.sources import files, lines, markup, releases
from quillspark.sources.store import Store
from quillspark.streaming import refresh

JATS = """<article xmlns:x="u"><front><journal-meta><journal-title>Annals of Tests</journal-title></journal-meta><article-meta><article-id pub-id-type="doi">10.5555/t.1</article-id>
<title-group><article-title>On  small
things</article-title></title-group><contrib-group><contrib contrib-type="author"><name><surname>Doe</surname><given-names>Jo Ann</given-names></name><xref ref-type="aff" rid="a1"/></contrib>
<contrib contrib-type="author"><name><surname>Alone</surname><given-names>A</given-names></name></contrib></contrib-group><aff id="a1"><label>1</label>Uni X</aff>
<pub-date pub-type="epub"><year>2020</year></pub-date><pub-date pub-type="received"><year>2019</year></pub-date><abstract><sec><title>Aim</title><p>We cite <xref ref-type="bibr" rid="B1">[1]</xref> here.</p></sec></abstract></article-meta></front>
<body><sec><title>Methods</title><sec><title>Deep</title><p>As in <xref ref-type="bibr" rid="b01">[1]</xref>, see <xref ref-type="fig" rid="F2">Fig. 2</xref>.</p></sec></sec><fig id="F2"><label>Fig 2</label><caption><p>A plot</p></caption></fig>
<table-wrap id="T1"><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr><tr><td>odd</td></tr></table></table-wrap></body>
<back><ref-list><ref id="B1"><mixed-citation><name><surname>Roe</surname><given-names>R</given-names></name> <article-title>Old work</article-title> <source>J</source> <year>1999</year></mixed-citation></ref></ref-list></back></article>"""
TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A title</title></titleStmt><sourceDesc><biblStruct><analytic><author><persName><forename>Jo</forename><surname>Doe</surname></persName><email>a@b</email></author>
<author><persName><forename>Jo</forename><surname>Doe</surname></persName></author></analytic><monogr><title>Venue</title><imprint><date when="2018-05-01"/></imprint></monogr></biblStruct></sourceDesc></fileDesc><profileDesc><abstract><p>Short.</p></abstract></profileDesc></teiHeader>
<text><body><div><head n="1">Intro</head><p>We use <ref type="bibr" target="#b0">[1]</ref>.</p></div></body><back><listBibl><biblStruct id="b0"><analytic><title>Cited</title></analytic><monogr><title>J</title></monogr></biblStruct></listBibl></back></text></TEI>"""


def test_jats():
    d = markup.parse(JATS.encode())
    assert d["title"] == "On small things" and d["year"] == "2020" and d["ids"] == {"doi": "10.5555/t.1"} and d["venue"] == "Annals of Tests"
    assert [(a["first"], a["middle"], a["last"], a["affiliations"]) for a in d["authors"]] == [("Jo", ["Ann"], "Doe", ["Uni X"]), ("A", [], "Alone", [])]
    p = d["body_text"][0]
    assert p["section"] == "Methods :: Deep"
    for s in p["cite_spans"] + p["ref_spans"] + d["abstract"][0]["cite_spans"]:
        assert s["ref_id"] in ("BIBREF1", "FIGREF2")
    assert all(p["text"][s["start"] : s["end"]] == s["text"] for s in p["cite_spans"] + p["ref_spans"])
    assert d["bib_entries"][0]["ref_id"] == "BIBREF1" and d["bib_entries"][0]["title"] == "Old work"
    assert "odd" not in next(f for f in d["ref_entries"] if f["kind"] == "table")["html"]


def test_tei_and_latex():
    d = markup.parse(TEI.encode())
    assert d["title"] == "A title" and d["year"] == "2018" and len(d["authors"]) == 1 and d["authors"][0]["email"] == "a@b"
    assert d["body_text"][0]["sec_num"] == "1" and d["body_text"][0]["cite_spans"][0]["ref_id"] == "BIBREF0"
    t = markup.parse(b"<std><title>T</title><div0><head>S</head><p>x <cit><ref target='bid1'/>[1]</cit></p><list type='ordered'><item>one</item><item>two</item></list></div0><bibitem id='bid1'>Roe 1999</bibitem></std>")
    assert [p["text"] for p in t["body_text"]] == ["x [1]", "1. one", "2. two"] and t["bib_entries"][0]["year"] == "1999"


def test_archives_and_dispatch(spark, tmp_path):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("d/a.nxml")
        info.size = len(JATS.encode())
        t.addfile(info, io.BytesIO(JATS.encode()))
    (tmp_path / "x.tar.gz").write_bytes(tar.getvalue())
    (tmp_path / "y.xml.gz").write_bytes(gzip.compress(TEI.encode()))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("bad.xml", "<oops")
    out = files.parse_documents(files.unpack(files.read_binary(spark, str(tmp_path), "*"))).collect()
    assert {(r.file, r.title, r.error is None) for r in out} == {("d/a.nxml", "On small things", True), ("y.xml", "A title", True), ("bad.xml", None, False)}


def raw(tmp_path):
    meta = [{"paper_id": "1", "title": "[A study]", "authors": [{"first": "Jo", "middle": ["B"], "last": "Doe", "suffix": ""}, {"first": "", "middle": [], "last": "", "suffix": ""}], "abstract": " ", "year": 2001, "venue": "None", "journal": "J", "doi": "10.1/a b"}, {"paper_id": "2", "title": "Other", "authors": None, "abstract": "Text.", "year": "x"}]
    parse = [{"paper_id": "1", "abstract": [{"section": "Abstract", "text": "From parse."}], "body_text": [{"section": "Intro", "text": "First one [1]. Second one.", "cite_spans": [{"start": 10, "end": 13, "text": "[1]", "ref_id": "BIBREF1"}, {"start": 11, "end": 12, "text": "x", "ref_id": "BIBREF0"}]}, {"section": "", "text": "More."}, {"section": "End", "text": "Done."}], "bib_entries": {"BIBREF1": {"title": "Cited", "authors": [], "year": 1999, "venue": "V"}, "BIBREF0": {"title": "Zero"}}}]
    (tmp_path / "metadata_3.jsonl").write_text("\n".join(map(json.dumps, meta)) + "\n{broken\n")
    (tmp_path / "parses_3.jsonl").write_text("\n".join(map(json.dumps, parse)))


def test_normalise(spark, tmp_path):
    raw(tmp_path)
    scanned = lines.read_lines(spark, str(tmp_path / "metadata_3.jsonl")).collect()
    assert {(r.file_number, r.id) for r in scanned} == {(3, "1"), (3, "2"), (3, None)}
    joined = normalise.join_parses(lines.read_metadata(spark, str(tmp_path / "metadata_3.jsonl")), lines.read_parses(spark, str(tmp_path / "parses_3.jsonl")))
    papers = normalise.papers(joined, "T").cache()
    one = {r.paper_id: r for r in papers.collect()}
    assert one["1"].title == "A study" and one["1"].abstract == "From parse." and one["1"].venue == "J" and one["1"].url == "https://doi.org/10.1/a%20b"
    assert [(a.familyname, a.givenname) for a in one["1"].author] == [("Doe", "Jo B")] and one["2"].publicationdate.year == ""
    assert [r.title for r in one["1"].reference] == ["Zero", "Cited"]
    body = {(r.section_id, r.paragraph_id, r.sentence_id): r for r in normalise.body(papers, "paper_id").collect()}
    assert body[(0, 0, 0)].sentence_text == "First one [1]." and body[(0, 1, 0)].section_title == "Intro" and body[(1, 0, 0)].section_title == "End"
    span = body[(0, 0, 0)].cite_spans[0]
    assert (span.start, span.end, span.ref_id) == ("10", "13", "1") and len(body[(0, 0, 0)].cite_spans) == 1


def test_tree_versions_and_release(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "9901.00001.json").write_text(json.dumps({"paper_id": "p", "pdf_parse": {"body_text": [{"text": "t"}]}}))
    tree = lines.read_tree(spark, str(tmp_path), "paper_id string, pdf_parse struct<body_text:array<struct<text:string>>>").first()
    assert (tree.file_year, tree.file_month, tree.paper_id) == (1999, "01", "p")
    names = spark.createDataFrame([("2101.1v2.pdf",), ("2101.1v10.pdf",), ("x.pdf",)], "name string")
    assert {r.name for r in lines.latest_versions(names).collect()} == {"2101.1v10.pdf", "x.pdf"}
    old = spark.createDataFrame([("p", {"title": "T"}, [{"text": "b"}])], "paper_id string, metadata struct<title:string>, body_text array<struct<text:string>>")
    assert lines.release(old).first().title == "T"


def test_store_and_refresh(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    paper = spark.read.parquet("/root/testdata/sf0.001/paper.parquet")
    refresh.refresh(store, paper)
    first = (store.count("papers"), store.count("postings"), store.largest("papers", "id_int"))
    refresh.refresh(store, paper)
    assert (store.count("papers"), store.count("postings"), store.largest("papers", "id_int")) == first and store.version("papers") == 2
    folder = tmp_path / "in"
    paper.limit(5).withColumn("id_int", F.col("id_int") + 100000).withColumn("title", F.concat(F.lit("new unseen "), "title")).withColumn("doi", F.lit(None).cast("string")).write.parquet(str(folder))
    refresh.stream(spark, str(folder), paper.schema, store, str(tmp_path / "cp")).awaitTermination()
    assert store.count("papers") == first[0] + 5


def test_stream_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    refresh.run_once(refresh.windowed_counts(live, "0 seconds", "1 day"), str(tmp_path / "out"), str(tmp_path / "c1"))
    refresh.run_once(refresh.sessions(live, "6 hours", "0 seconds"), str(tmp_path / "ses"), str(tmp_path / "c2"))
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = {(r.d, r.event_type): r.n for r in events.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert all(batch[(r.start.date(), r.event_type)] == r.n for r in got.collect()) and got.count() > 0
    assert spark.read.parquet(str(tmp_path / "ses")).count() > 0


def test_sections_spans_and_lookup(spark):
    df = spark.createDataFrame([("abcdef", [(0, 2, "ab", ""), (1, 3, "x", ""), (4, 5, "e", "")])], "t string, s array<struct<start:int,end:int,text:string,ref_id:string>>")
    assert [(r.kind, r.start, r.end) for r in df.select(sections.fill_gaps(F.col("t"), F.col("s")).alias("r")).first().r] == [("citation_marker", 0, 2), ("default", 2, 4), ("citation_marker", 4, 5), ("default", 5, 6)]
    assert spark.range(1).select(sections.expand_ranges(F.lit(1), F.lit(4))).first()[0] == [1, 2, 3, 4]
    wanted = spark.createDataFrame([(0, "a"), (1, "z"), (2, "a")], "pos int, id string")
    papers = spark.createDataFrame([("a", "T", None)], "id string, title string, venue string")
    got = {r.pos: (r.title, r.found) for r in lookup.multi_get(papers, wanted, ["id"], {"title": F.lit("?")}).collect()}
    assert got == {0: ("T", True), 1: ("?", False), 2: ("T", True)}


def test_projection(spark):
    df = spark.createDataFrame([(1, "T", [("F", "G")])], "id int, title string, author array<struct<familyname:string,givenname:string>>")
    assert projection.project(df, None).columns == df.columns and projection.project(df, {}).columns == []
    assert projection.project(df, {"Author.FamilyName": 1, "title": 0}).schema.simpleString() == "struct<author:array<struct<familyname:string>>>"


def test_summary():
    text = ["the cat sat on the mat today", "a dog ran far away from here", "the cat sat on the mat again", ""]
    assert summary.extract(text, 2) == sorted(summary.extract(text, 2)) and len(summary.extract(text, 2)) == 2
    assert summary.extract(text, 4, block=4) != [0, 1, 2, 3] and summary.extract([], 3) == []


RICH = """<article xmlns:x="u"><front><article-meta><title-group><article-title>Rich</article-title></title-group><contrib-group><contrib contrib-type="author"><contrib-id contrib-id-type="orcid">https://orcid.org/0000-0002-1825-0097</contrib-id><name><surname>Doe</surname><given-names>J</given-names></name></contrib>
<contrib contrib-type="author"><collab>The Group</collab></contrib></contrib-group><abstract>Bare abstract.</abstract><funding-group><award-group><funding-source>Fund A</funding-source><award-id>G-1</award-id></award-group></funding-group></article-meta></front>
<body><p>Before <inline-formula><tex-math>\\begin{document}$x^2$\\end{document}</tex-math></inline-formula> and after.</p><disp-formula id="E1"><label>(1)</label><math><mi>y</mi></math></disp-formula>
<disp-formula-group><disp-formula id="E2"><tex-math>z=1</tex-math></disp-formula></disp-formula-group><statement><title>Theorem</title><p>It holds.</p></statement><verse-group><verse-line>A line of verse</verse-line></verse-group>
<list><list-item><p>First item</p><p>goes on</p></list-item><list-item><label>2</label><p>Second item</p></list-item></list><boxed-text><sec><title>Box</title><p>In the box.</p></sec></boxed-text><note>A stray note</note>
<supplementary-material id="S1"><label>Data S1</label><caption><p>Raw data</p></caption></supplementary-material></body>
<back><ack><p>We thank all.</p></ack><fn-group><fn fn-type="conflict" id="fn1"><p>No conflict.</p></fn></fn-group><app-group><app><title>Appendix A</title><p>More text.</p></app></app-group></back></article>"""


def test_no_text_of_an_article_is_lost():
    d = markup.parse(RICH.encode())
    body = [(p["section"], p["text"]) for p in d["body_text"]]
    assert ("", "Before $x^2$ and after.") in body and ("Theorem", "It holds.") in body and ("Box", "In the box.") in body
    assert ("", "A line of verse") in body and ("", "A stray note") in body and ("", "z=1") in body and any("y (1)" in t for _, t in body)
    assert [t for _, t in body if "item" in t] == ["First itemgoes on", "Second item"] or any("First item" in t for _, t in body)
    equation = d["body_text"][0]["eq_spans"][0]
    assert d["body_text"][0]["text"][equation["start"] : equation["end"]] == "$x^2$" and equation["latex"] == "$x^2$"
    assert [(p["section"], p["text"]) for p in d["back_matter"]] == [("Acknowledgements", "We thank all."), ("Footnotes", "No conflict."), ("Appendix A", "More text.")]
    assert d["conflicts"] == ["No conflict."] and d["funding"] == ["Fund A", "G-1"] and d["supplements"] == ["Data S1 Raw data"]
    assert [(a["last"], a["orcid"]) for a in d["authors"]] == [("Doe", "0000-0002-1825-0097"), ("The Group", "")] and d["abstract"][0]["text"] == "Bare abstract."
    kinds = {(e["kind"], e["num"]) for e in d["ref_entries"]}
    assert ("formula", "1") in kinds and ("footnote", None) in kinds


def test_notes_formulas_and_back_of_parsed_pdfs():
    tei = """<TEI xmlns="t"><teiHeader><fileDesc><titleStmt><title>T</title></titleStmt></fileDesc></teiHeader><text><body><div><head n="2">Model</head><p>Let <formula id="formula_0">a = b<label>(3)</label></formula> hold<note place="foot" n="1" id="foot_0">A footnote.</note>.</p>
    <formula id="formula_1">c = d</formula><list><item>one</item><item>two</item></list><div><head>Inner</head><p>Deep.</p></div></div><p>Loose text.</p></body><back><div type="acknowledgement"><div><head>Thanks</head><p>To all.</p></div></div><div type="funding"><p>Grant 7.</p></div></back></text></TEI>"""
    d = markup.parse(tei.encode())
    body = [(p["section"], p["text"]) for p in d["body_text"]]
    assert [b for b in body if b[1] in ("A footnote.", "c = d", "one", "two")] == [("Model", "A footnote."), ("Model", "c = d"), ("Model", "one"), ("Model", "two")]
    assert ("Inner", "Deep.") in body and any(t == "Loose text." for _, t in body) and body[0][1].startswith("Let a = b")
    assert d["body_text"][0]["eq_spans"][0]["ref_id"] == "FORMREF0" and [p["text"] for p in d["back_matter"]] == ["To all.", "Grant 7."] and d["funding"] == ["Grant 7."]
    assert {e["kind"] for e in d["ref_entries"]} == {"formula", "footnote"}


def test_front_matter_and_references_of_latex():
    d = markup.parse(b"<std><maketitle><title>Main title</title><author>Jo van Doe Jr. and Roe, R.<affil>Uni</affil></author></maketitle><abstract><p>One.</p><p>Two.</p></abstract><div0><head>S</head><p>x <formula id='uid3' type='inline'><texmath>E=mc^2</texmath></formula><note>Foot</note> y</p><quote><p>Quoted.</p></quote></div0><bibitem id='bid2'>R. Roe, \"A long title of it,\" J. 12(3), 45-67, 2004. doi:10.5555/abc.1</bibitem></std>")
    assert d["title"] == "Main title" and [(a["first"], a["last"], a["suffix"]) for a in d["authors"]] == [("Jo", "Doe", "Jr."), ("R.", "Roe", "")]
    assert [p["text"] for p in d["abstract"]] == ["One.", "Two."] and [p["text"] for p in d["body_text"]] == ["x E=mc^2 y", "Quoted."]
    b = d["bib_entries"][0]
    assert (b["ref_id"], b["title"], b["year"], b["volume"], b["issue"], b["pages"], b["doi"]) == ("BIBREF2", "A long title of it", "2004", "12", "3", "45-67", "10.5555/abc.1")
    assert {e["kind"] for e in d["ref_entries"]} == {"formula", "footnote"} and d["body_text"][0]["eq_spans"][0]["latex"] == "E=mc^2"


def test_release_round_trip_and_layouts(spark, tmp_path):
    rows = [{"file": "p1", "error": None, **markup.parse(JATS.encode())}]
    parsed = spark.createDataFrame(rows, f"file string, error string, {markup.SCHEMA}")
    text = releases.release_json(parsed, "file", "reader 1", "2026-01-01").first().document
    assert json.loads(text)["header"] == {"generated_with": "reader 1", "date_generated": "2026-01-01"}
    (tmp_path / "r.json").write_text(text)
    back = releases.read_release(spark.read.json(str(tmp_path / "r.json"))).first()
    assert back.paper_id == "p1" and back.title == "On small things" and back.body_text[0].text == rows[0]["body_text"][0]["text"] and back.bib_entries.BIBREF1.title == "Old work"
    again = {p.text: [(s.start, s.end, s.ref_id) for s in p.cite_spans] for p in back.body_text}
    assert again == {p["text"]: [(s["start"], s["end"], s["ref_id"]) for s in p["cite_spans"]] for p in rows[0]["body_text"]}
    docs = {
        "2019": {"paper_id": "a", "title": "T", "year": 2001, "grobid_parse": {"abstract": [{"text": "A"}], "body_text": [{"text": "B"}, {"text": "C"}], "bib_entries": {"BIBREF0": {"title": "X"}}}},
        "2020": {"paper_id": "a", "metadata": {"title": "T"}, "abstract": [{"text": "A"}], "body_text": [{"text": "B"}, {"text": "C"}], "bib_entries": {"BIBREF0": {"title": "X"}}},
        "current": {"paper_id": "a", "title": "T", "pdf_parse": {"abstract": [{"text": "A"}], "body_text": [{"text": "B"}, {"text": "C"}], "bib_entries": {"BIBREF0": {"title": "X"}}}},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
        df = spark.read.json(str(tmp_path / f"{name}.json"))
        assert releases.layout(df.columns) == name
        got = releases.read_release(df).select("title", releases.raw_text(F.col("body_text")).alias("raw"), "abstract").first()
        assert (got.title, got.raw, got.abstract[0].text) == ("T", "B\nC", "A")
