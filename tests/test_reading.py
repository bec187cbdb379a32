import numpy as np
from pyspark.sql import functions as F

from quillspark.functions.stem import stem, stems
from quillspark.operators import models, reading


def test_stems(spark):
    known = {"consistency": "consist", "running": "run", "relational": "relat", "happiness": "happi", "generously": "generous", "hopping": "hop", "flies": "fli", "skies": "sky", "cries": "cri", "ties": "tie", "gas": "gas", "caresses": "caress", "agreed": "agre", "hoped": "hope", "adjustment": "adjust", "conditional": "condit", "rationalize": "ration", "": "", "be": "be"}
    assert {w: stem(w) for w in known} == known
    df = spark.createDataFrame([(1, ["running", "cats"]), (2, None)], "id int, w array<string>")
    assert [r[0] for r in df.orderBy("id").select(stems("w")).collect()] == [["run", "cat"], None]


def test_mark_takes_the_last_near_sentence(spark):
    found = spark.createDataFrame([(1, 0, "the cell grew quickly in all of the samples taken"), (1, 1, "the cell grew quickly in all of the samples taken!"), (2, 0, "the cell grew quickly in all of the samples taken")], "k int, sentence_id int, sentence_text string")
    wanted = spark.createDataFrame([(1, 7, "the cell grew quickly in all of the samples taken"), (1, 8, "nothing like it")], "k int, ref int, ref_text string")
    assert [(r.k, r.ref, r.sentence_id) for r in reading.mark(found, wanted, "k", ["sentence_id"]).collect()] == [(1, 7, 1)]


def test_placeholders_and_markers(spark):
    df = spark.createDataFrame([("see TOK1 and TOK2.", [("TOK2", "Fig. 2"), ("TOK1", "[1]"), ("TOK9", "x")], "[12]")], "t string, k array<struct<token:string,surface:string>>, m string")
    r = df.select(reading.fill_placeholders(F.col("t"), F.col("k")).alias("f"), reading.marker_number(F.col("m")).alias("n"), reading.bracket_style(F.lit("[1] [2] [3] [4,5] [6] [7]")).alias("b")).first()
    assert r.f.text == "see [1] and Fig. 2." and all(r.f.text[s.start : s.end] == s.text for s in r.f.spans) and len(r.f.spans) == 2
    assert r.n == 12 and r.b


def test_sentences_are_numbered(spark):
    df = spark.createDataFrame([(1, [([([("a",), ("b",)],)],)])], "k int, p array<struct<section_text:array<struct<paragraph_text:array<struct<sentence_text:string>>>>>>")
    assert [(r.section_id, r.paragraph_id, r.sentence_id, r.sentence_text) for r in reading.sentences(df, "k", "p").collect()] == [(0, 0, 0, "a"), (0, 0, 1, "b")]


def test_default_models(spark):
    v = models.HashedWords(32)(["a b c", "", "a b c"])
    assert np.allclose(v[0], v[2]) and np.isclose(np.linalg.norm(v[0]), 1) and not v[1].any()
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string")
    assert models.embed(df, "id", "t").count() == 2
    assert models.rouge_n("a b c", "a b d", 2) == 0.5 and models.rouge_n("", "a") == 0.0
    p = spark.createDataFrame([([("Doe", "Jo"), ("Roe", "A")], "T", "1999")], "a array<struct<familyname:string,givenname:string>>, t string, y string")
    assert p.select(models.citing_sentence(F.col("a"), F.col("t"), F.col("y"))).first()[0] == "Doe et al. (1999) studied T."
