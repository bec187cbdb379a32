from pyspark.sql import functions as F

from quillspark.operators import normalise, reading, summary

BODY = "array<struct<section_text:array<struct<paragraph_text:array<struct<sentence_text:string,cite_spans:array<struct<start:string,end:string,text:string,ref_id:string>>>>>>>>"


def papers(spark):
    s = lambda text, *spans: (text, [(str(a), str(b), t, r) for a, b, t, r in spans])
    body = [([([s("Cats sleep in the warm house all day."), s("As shown [1] cats sleep.", (9, 12, "[1]", "0"))],)],), ([([s("Dogs run far away from the house.")],), ([s("The cats sleep in the house.")],)],)]
    return spark.createDataFrame([(1, "T", [("Doe", "Jo")], body), (2, "U", [], [])], f"id int, title string, author array<struct<familyname:string,givenname:string>>, body {BODY}")


def test_highlights_name_their_places(spark):
    got = [tuple(r) for r in reading.highlights(papers(spark), "id", "body", 2).orderBy("section_id", "paragraph_id", "sentence_id").collect()]
    assert len(got) == 2 and all(r[0] == 1 for r in got)
    held = {(0, 0, 0): "Cats sleep in the warm house all day.", (0, 0, 1): "As shown [1] cats sleep.", (1, 0, 0): "Dogs run far away from the house.", (1, 1, 0): "The cats sleep in the house."}
    assert all(held[r[1:4]] == r[4] for r in got)
    card = {r.id: (r.citation, r.title, bool(r.summary)) for r in reading.result_card(papers(spark), "id", "body", 1).collect()}
    assert card == {1: ("J Doe", "T", True), 2: ("", "U", False)}


def test_marked_paper(spark):
    wanted = spark.createDataFrame([(1, 0, "The cats sleep in the house"), (1, 1, "Nothing like it at all here"), (2, 0, "x")], "id int, ref int, ref_text string")
    rows, matches = reading.marked_paper(papers(spark), "id", "body", wanted)
    assert [tuple(r) for r in matches.collect()] == [(1, 0, 1, 1, 0)]
    marked = {(r.section_id, r.paragraph_id, r.sentence_id): (r.ref, [(x.kind, x.start, x.end) for x in r.runs]) for r in rows.collect()}
    assert marked[1, 1, 0][0] == 0 and marked[0, 0, 0][0] is None
    assert marked[0, 0, 1][1] == [("default", 0, 9), ("citation_marker", 9, 12), ("default", 12, 24)]


def test_choice_of_sentences():
    text = ["alpha beta gamma delta", "alpha beta gamma delta again", "other words stand here", "and more of them"]
    first = summary.extract(text, 2)
    assert len(first) == 2 and not {0, 1} <= set(first)  # the second repeats the first
    assert summary.extract(text, 4, stop=lambda chosen: float(len(chosen))) == summary.extract(text, 1)
    assert summary.above(text, lambda s: [0.1, 0.5, 0.4, 0.39]) == [1, 2] and summary.above([], lambda s: []) == []
    assert summary.extract(["", " ", "..."], 2) == [0, 1] and summary.centrality(["", "word word"])[0] == 0.0
    many = [f"sentence number{i} of topic{i % 7} with words{i % 11}" for i in range(3000)]
    assert len(summary.extract(many, 7)) == 7


def test_first_parse_by_place(spark):
    para = "array<struct<section:string,text:string>>"
    parses = spark.createDataFrame([("p", [("s", "later")], {}, [], 2, 0), ("p", [("s", "first")], {}, [], 1, 5)], f"paper_id string, body_text {para}, bib_entries map<string,string>, abstract {para}, file_number int, position long")
    got = normalise.join_parses(spark.createDataFrame([("p", None)], "paper_id string, abstract string"), parses).select(F.get("body_text", F.lit(0))["text"].alias("t")).first()
    assert got.t == "first"
