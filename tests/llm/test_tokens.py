import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import tokens as K

RANKS = K.load_ranks(K.DEFAULT_RANKS)


def plain_merge(word: bytes) -> list[int]:
    parts = [bytes([b]) for b in word]
    while True:
        ranks = [(RANKS.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)]
        if not ranks or min(ranks)[0] == 1 << 30:
            return [RANKS[p] for p in parts]
        i = min(ranks)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@given(st.text(max_size=12))
@settings(max_examples=300, deadline=None)
def test_merge_is_the_plain_merge(text):
    if text:
        assert K.merge(RANKS, text.encode()) == plain_merge(text.encode())


@given(st.dictionaries(st.text("abcé ", min_size=1, max_size=6), st.lists(st.integers(0, 9), min_size=1, max_size=3), max_size=30), st.lists(st.text("abcé ", max_size=7), max_size=20))
@settings(max_examples=100, deadline=None)
def test_transducer_holds_exactly_its_words(tmp_path_factory, words, asked):
    path = tmp_path_factory.mktemp("lex") / "l.bin"
    path.write_bytes(K.compile_lexicon(words))
    lexicon = K.Lexicon(str(path))
    asked = [*asked, *words]
    raw = [w.encode() for w in asked]
    size = np.array([len(r) for r in raw], np.int64)
    found = lexicon.find(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size) if raw else []
    for word, at in zip(asked, found):
        assert (at >= 0) == (word in words)
        if at >= 0:
            assert list(lexicon.ids[lexicon.start[at] : lexicon.start[at + 1]]) == words[word]


def test_suffixes_are_shared():
    words = {a + "ending": [1] for a in "abcdefgh"}
    assert len(K.compile_lexicon(words)) < len(K.compile_lexicon({a + "endin" + b: [1] for a, b in zip("abcdefgh", "ijklmnop")}))


def test_encoding_equals_the_library(spark):
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    random.seed(2)
    texts = [None, "", " ", "<|endoftext|>", "It's 2²Ⅷ½ ok \x1c\x1d a_b__c", "数据结构化", "a" * 30_000, "x\n\n  y\t z  ", "naïve café — ok"] + ["".join(random.choice("abc  '.\n\t1é中") for _ in range(200)) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, t string, ids string")
    got = {r.doc_id: r.ids for r in K.encode(df, "doc_id", "t").collect()}
    assert got == {i: other.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    counts = {r.doc_id: r.tokens for r in K.count_tokens(df.select("doc_id", "t"), "t").collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert K.encode(df.limit(0), "doc_id", "t").count() == 0


def test_memo_may_overflow(tmp_path):
    path = tmp_path / "l.bin"
    path.write_bytes(K.compile_lexicon({"a": [RANKS[b"a"]]}))
    encoder = K.Encoder(K.Lexicon(str(path)), K.DEFAULT_RANKS)
    encoder.MEMO = 3
    first = [encoder.block([t])[0].tolist() for t in ("a b c d", "a e f g", "a b c d")]
    assert first[0] == first[2]


def test_lexicon_is_the_whole_vocabulary_and_reads_no_text(spark):
    from pyspark import SparkFiles

    lexicon = K.Lexicon(SparkFiles.get(K.build_lexicon(spark)))
    words = [w for w in (r.decode("utf-8", "replace") for r in RANKS) if "�" not in w and K.pieces(w) == [w]]
    raw = [w.encode() for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    found = lexicon.find(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size)
    assert len(words) > 30_000 and (found >= 0).all()
    assert [int(lexicon.ids[lexicon.start[at]]) for at in found] == [RANKS[r] for r in raw]
