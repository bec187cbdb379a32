import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.sentences import sentence_spans, sentences

CASES = [
    ["Dr. Who met J. K. Lee in St. Ives.", "It was 5 p.m.", "The end."],
    ["We measured 3.5 units vs. 4.1 (see Fig. 2).", "As in App. B. we saw it."],
    ['He said: "It works. Really."', "She left."],
    ['"Is it stable?" asked one reviewer.', "Yes."],
    ["They called it \"a threshold. A narrow one\" in the interview.", "Next one."],
    ["(The whole sentence is in brackets.)", "The next is not."],
    ["A result followed.[12]", "Another came [3].", "Last."],
    ["Das gilt z. B. am 3. Mai 1990 für alle.", "Die 2. Auflage fehlt."],
    ["作者问道：“太阳能电池是否稳定？”但没有得到答复。", "结果出人意料！"],
    ["著者は「安定している。」と述べた。", "次の文である。"],
    ["क्या यह स्थिर है?", "डॉ. Cotumar ने कहा।", "अंत।"],
    ["การวัดใช้เวลา784วัน", "เราศึกษาการกลายพันธุ์จากตัวอย่าง490ชุด"],
    ["Only group B.", "It remains unclear."],
    ["It vanished...", "Then it came back."],
    ["An odd . . . or rather even case was seen.", "Done."],
]


@pytest.mark.parametrize("want", CASES)
def test_known_boundaries(want):
    glue = "" if ord(want[0][0]) in range(0x3040, 0xA000) else " "
    text = glue.join(want)
    assert [text[a:b] for a, b in sentences(text)] == want


def test_headings_and_breaks():
    text = "Related Work\n\nWe used\na long line. Results\nfollow here.\n"
    assert [text[a:b] for a, b in sentences(text)] == ["Related Work", "We used\na long line.", "Results\nfollow here."]
    assert [("Methods\nThe way.")[a:b] for a, b in sentences("Methods\nThe way.")] == ["Methods", "The way."]


def test_missing_blank_and_addresses():
    text = "It ended here.The next began. See files.example/A.v2.txt now. Then doi 10.5/A.7.2 is fine."
    assert [text[a:b] for a, b in sentences(text)] == ["It ended here.", "The next began.", "See files.example/A.v2.txt now.", "Then doi 10.5/A.7.2 is fine."]


@given(st.text(st.sampled_from("aB1 .!?\"()[]«»“”。？\n\t,ก"), max_size=60))
@settings(max_examples=400, deadline=None)
def test_every_character_lies_in_one_sentence(text):
    spans = sentences(text)
    assert "".join("".join(text[a:b] for a, b in spans).split()) == "".join(text.split())
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(spans[i][1] <= spans[i + 1][0] for i in range(len(spans) - 1))


def test_degenerate_texts():
    for text in (None, "", "  \n "):
        assert sentences(text) == []
    long = "(" * 50_000 + "A b. " * 20_000
    assert sentences(long)[0][0] == 0
    random.seed(1)
    assert sentences("." * 10_000) == [(0, 10_000)]


def test_earliest_row_of_a_repeated_key(spark):
    df = spark.createDataFrame([(1, "Late one. Two.", 5, "x"), (1, "Early.", 3, "y"), (2, None, 1, "z"), (2, None, 1, "z"), (None, "No key.", 1, "w")], "id long, t string, o int, spans string")
    got = {(r.id, r.start_pos, r.end_pos) for r in sentence_spans(df, "id", "t", ["o"]).collect()}
    assert got == {(1, 0, 6), (None, 0, 7)}
    assert sentence_spans(df.limit(0), "id", "t", ["o"]).count() == 0


def pieces(text):
    return [text[a:b] for a, b in sentences(text)]


def test_list_levels_are_on_the_stack():
    assert pieces("Steps:\n1. First thing (see\n2. Second thing) here") == ["Steps:", "1. First thing (see", "2. Second thing) here"]
    assert pieces("- outer “one\n  1. inner one\n  2. inner two\n- outer” two") == ["- outer “one", "1. inner one", "2. inner two", "- outer” two"]
    assert pieces("a) alpha\nb) beta. Next one\nc) gamma") == ["a) alpha", "b) beta.", "Next one", "c) gamma"]
    assert pieces("i. alpha\nii. beta\niii. gamma\niv. delta") == ["i. alpha", "ii. beta", "iii. gamma", "iv. delta"]
    # a number at the start of a wrapped line is no item of a list
    assert pieces("The mean of the sample was about\n3. The rest was less") == ["The mean of the sample was about\n3.", "The rest was less"]
    assert pieces("1. One\n1. One again\n\n7. Not a list") [:2] == ["1. One", "1. One again"]


def test_long_texts_take_linear_time():
    import time

    start = time.time()
    sentences("x" * 300_000 + ".B" * 20_000 + "\n" + "word " * 100_000 + "line\n" * 20_000)
    assert time.time() - start < 20


def test_recall_of_planted_boundaries():
    """Sentences with abbreviations, decimals, quotations and lists, joined in blocks: nearly all boundaries are found and no others."""
    import random

    rng = random.Random(9)
    kinds = ["Dr. Abel met Prof. Bain at 3.5 km depth.", "The rate fell to 0.25 (cf. Fig. 2).", "“It rose. Then it fell,” she said.", "He asked: why not?", "It was shown [3, 4].", "Values (e.g. 1.2 vs. 3.4) differ.", "本研究は成功した。", "结果很好。", "यह सही है।", "Et al. is used by Smith et al. in text."]
    found = right = wanted = 0
    for _ in range(300):
        parts = [rng.choice(kinds) for _ in range(rng.randint(1, 6))]
        text, want, at = "", set(), 0
        for p in parts:
            text += p + " "
            want.add((at, at + len(p)))
            at = len(text)
        got = set(sentences(text))
        found, right, wanted = found + len(got), right + len(got & want), wanted + len(want)
    assert right / wanted > 0.97 and right / found > 0.97
