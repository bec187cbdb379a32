import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import keywords as K
from quillspark.operators import postings


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12))
@settings(max_examples=200, deadline=None)
def test_ratio_is_the_subsequence_ratio(a, b):
    want = 100.0 if not a + b else 200.0 * lcs(a, b) / len(a + b)
    assert T.indel_ratio(a, b) == pytest.approx(want)


def test_ratio_of_nulls_and_empty():
    assert T.indel_ratio(None, "a") is None
    assert T.indel_ratio("", "") == 100.0


def test_near_matches():
    assert T.near_matches("abc", "xxabcxxabdxx", 0) == [(2, 5)]
    assert T.near_matches("abcdef", "xxabcxefxx", 1) == [(2, 8)]
    assert T.near_matches("", "abc", 1) == []
    rng = random.Random(5)
    for _ in range(50):
        text = "".join(rng.choice("ab") for _ in range(30))
        at = rng.randrange(20)
        assert any(s <= at < e or s == at for s, e in T.near_matches(text[at : at + 8], text, 0))


def rows(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")


def test_highlight(spark):
    df = rows(spark, "Deep  memory leak found", "", None, "leak")
    got = {r.id: [(s.start, s.end) for s in r.s or []] for r in df.select("id", T.highlight(F.col("t"), ["memory", "leak"]).alias("s")).collect()}
    assert got == {0: [(5, 17)], 1: [], 2: [], 3: [(0, 4)]}


def test_sentences_split_and_merge(spark):
    df = rows(spark, "One two. Three four. " + "w " * 12 + "end.", "Short.", "", None)
    split = {r.id: r.s for r in df.select("id", T.split_sentences(F.col("t")).alias("s")).collect()}
    assert split[0][:2] == ["One two.", "Three four."] and split[1] == ["Short."] and split[2] == []
    merged = {r.id: r.s for r in df.select("id", T.merge_short(T.split_sentences(F.col("t"))).alias("s")).collect()}
    assert len(merged[0]) == 1 and merged[1] == ["Short."]


def test_names_and_dois(spark):
    df = rows(spark, "John Ronald Doe", "", None)
    assert [r[0] for r in df.select(T.abbreviated(F.coalesce("t", F.lit("")))).collect()] == ["j r doe", "", ""]
    df = rows(spark, "doi:10.1234/AB.c.", "https://x/10.1234%2Fabc", "none")
    assert [r[0] for r in df.select(T.normal_doi(F.col("t"))).collect()] == ["10.1234/ab.c", "10.1234/abc", ""]


def shape(node):
    if node.op == "all":
        return "all"
    if node.op == "term":
        return node.term
    return (node.op, *map(shape, node.parts))


GOLDEN = {
    "": "all",
    "deep neural networks": ("and", "deep neural", "neural network"),
    "state of the art": ("and", "state", "art"),
    "Title:deep learning": "title:deep learning",
    "Venue:nature": "venue:nature",
    "Year:2018..2020": ("or", "publicationdate.year:2018", "publicationdate.year:2019", "publicationdate.year:2020"),
    "2020..2018": "all",
    "covid 2020": "publicationdate.year:2020",
    "see 10.1101/2020.01.01": "doi:10.1101/2020.01.01",
    "DOI:10.1/ABC": "doi:10.1/abc",
    "Author.FamilyName:Doe": "author.familyname:doe",
    "Author.FullName:John Doe": ("or", "author.fullname:john doe", "author.fullname:doe john"),
    "Author:John Doe": ("or", "author.fullname:john doe", "author.fullname:doe john", ("and", "john", "doe")),
    "John Doe": ("or", "author.fullname:john doe", "author.fullname:doe john", ("and", "john", "doe")),
    "Author:Doe": ("or", "author.familyname:doe", "author.givenname:doe", "doe"),
    "AvailableField:DOI": "availablefield:doi",
    "foo:bar": "bar",
    "cats<NOT>dogs": ("not", "dog"),
    "cats<AND><NOT>dogs": ("and", "cat", ("not", "dog")),
    "cats<OR>dogs<AND>birds": ("and", ("or", "cat", "dog"), "bird"),
}


@pytest.mark.parametrize("text", GOLDEN)
def test_keyword_trees(text):
    assert shape(K.parse(text)) == GOLDEN[text]


def test_rewrite():
    assert K.rewrite(r"a_b\tc|d\t!e") == "a b<AND>c<OR>d<AND><NOT>e"
    # as the search service has it, what is left of ! in a piece has no effect
    assert K.rewrite("a!b") == "a<NOT>b" and K.parse(K.rewrite("a!b")) == K.parse("<NOT>b")
    assert K.rewrite("Abstract_Parsed:x_y") == "Abstract_Parsed:x y" and K.rewrite("Abstract_parsed") == "Abstract_parsed" and K.rewrite(r"\t \ta") == "a" and K.rewrite("") == ""


def test_matching_both_ways_equals_sets(spark):
    rng = random.Random(3)
    vocabulary = ["cat", "dog", "bird", "fish"]
    docs = [(i, [w for w in vocabulary if rng.random() < 0.4]) for i in range(40)]
    df = spark.createDataFrame(docs, "id int, terms array<string>").cache()
    posted = postings.postings(df, ["id"], F.col("terms"))
    for text in ("cat", "<NOT>cat", "cat<AND><NOT>dog", "cat<OR><NOT>dog", "cat<OR>dog<AND>bird", ""):
        node = K.parse(text)

        def holds(n, terms):
            if n.op == "all":
                return True
            if n.op == "term":
                return n.term in terms
            got = [holds(p, terms) for p in n.parts]
            return not got[0] if n.op == "not" else all(got) if n.op == "and" else any(got)

        want = {i for i, t in docs if holds(node, t)}
        assert {r.id for r in K.match_rows(df, "terms", node).collect()} == want
        assert {r.id for r in K.match_postings(posted, df, ["id"], node).collect()} == want


def test_fallback_is_used_only_without_matches(spark):
    df = spark.createDataFrame([(1, ["author.fullname:john doe"]), (2, ["john", "doe", "john doe"])], "id int, terms array<string>")
    assert [r.id for r in K.match_rows(df, "terms", K.parse("Author:John Doe")).collect()] == [1]
    assert [r.id for r in K.match_rows(df.filter("id = 2"), "terms", K.parse("Author:John Doe")).collect()] == [2]


def test_plain_letters_and_two_digits(spark):
    df = rows(spark, "Łódź Straße Ærø ÉÈ ñ 中", "", None)
    assert [r[0] for r in df.orderBy("id").select(T.ascii_text(F.col("t"))).collect()] == ["Lodz Strasse AEro EE n ", "", None]
    df = rows(spark, "March", "7", "12", "0", "xx", None)
    assert [r[0] for r in df.orderBy("id").select(T.two_digits(F.col("t"))).collect()] == ["03", "07", "12", "", "", ""]


def test_title_search_falls_back(spark):
    from quillspark.operators import search

    titles = spark.createDataFrame([(1, "Deep cells: a study", None), (2, "Quantum memroy leaks in practice", "Doe"), (3, "Quantum memory leaks in practise", "Roe"), (4, "", None)], "q int, title string, family string")
    papers = spark.createDataFrame([(10, "deep CELLS a study", []), (20, "Quantum memory leaks in practice", ["Doe"])], "id int, title string, families array<string>")
    assert {(r.q, r.id, r.found_by) for r in search.search_titles(titles, papers, "q", "id").collect()} == {(1, 10, "title"), (2, 20, "search")}


def test_names_in_free_text():
    assert K.looks_like_name("Jo van Doe") == ("Jo", "Doe") and K.looks_like_name("Émile A. Roe") == ("Émile", "Roe") and K.looks_like_name("gene expression") is None and K.looks_like_name("Memory") is None
    assert K.parse("some one", person=lambda t: ("some", "one")).fallback == 2
