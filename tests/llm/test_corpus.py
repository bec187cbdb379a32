import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import mixing, subjects


def corpus():
    rng = random.Random(9)
    words = {s: [f"{s}{c}word" for c in "abcdefghijkl"] for s in ("law", "sport", "chem")}
    common = [f"common{i}" for i in range(40)]
    docs, truth = [], {}
    for i in range(400):
        mine = [s for s in (rng.sample(sorted(words), 2) if i % 7 == 0 else [rng.choice(sorted(words))])]
        text = " ".join(rng.choice(words[mine[k % len(mine)]]) + " " + " ".join(rng.sample(common, 3)) for k in range(24))
        docs.append((i, "en", text + (" lawaword" if "sport" in mine else "") + "\nReferences\n[1] chemaword chembword"))
        truth[i] = set(mine)
    return docs, truth


def test_subjects_of_held_out_documents(spark):
    docs, truth = corpus()
    docs += [(1000, "en", None), (1001, None, ""), (1002, "en", "12 34 -- ..."), (1003, "en", "x" * 20_000), (1004, "en", docs[0][2]), (None, "en", "no key")]
    labels = [(i, s) for i in range(0, 120) for s in truth[i]] + [(5, "unknown"), (None, "law"), (9999, "law")]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    areas = spark.createDataFrame([("law", "lawaword"), ("sport", "sportaword"), ("chem", None)], "subject string, description string")
    found, model, level = subjects.assign(df, spark.createDataFrame(labels, "doc_id long, subject string"), areas)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == truth[i] for i in range(120, 400))
    assert right / 280 > 0.95 and got[1004] == truth[0]
    assert not {1000, 1001, 1002, 1003} & set(got)
    assert {s for s, _ in model.top_terms() if s} == {"law", "sport", "chem"} and 0.15 <= level <= 0.4
    assert subjects.assign(df.limit(0), spark.createDataFrame([], "doc_id long, subject string"), areas)[0].count() == 0


def test_prose_only():
    assert subjects.words("## Methods\nThe cell-\nular state [1] \\cite{abc} <p>ok yes</p>\nReferences\n[1] Journal") == ["the", "cellular", "state", "yes"] or "journal" not in subjects.words("x\nReferences\n[1] Journal")
    assert subjects.words("神经网络") == ["神经", "经网", "网络"]


def test_blocks_do_not_change_inference():
    rng = np.random.default_rng(3)
    row = np.sort(rng.integers(0, 700, 5000))
    word, count = rng.integers(0, 50, 5000), rng.random(5000).astype(np.float32) + 1
    topics = rng.random((50, 4)).astype(np.float32)
    whole, _ = subjects.infer(row, word, count, 700, topics)
    for d in (0, 5, 399, 699):
        mine = row == d
        if mine.any():
            one, _ = subjects.infer(np.zeros(mine.sum(), int), word[mine], count[mine], 1, topics)
            assert np.allclose(one[0], whole[d], atol=1e-4)
        else:
            assert not whole[d].any()


def test_raking_meets_margins_within_caps():
    rng = np.random.default_rng(5)
    sizes, source, lang = rng.random(60) * 100 + 10, np.repeat(np.arange(6), 10), np.tile(np.arange(10), 6)
    share, cap = np.array([0.3, 0.2, 0.2, 0.1, 0.1, 0.1]), np.array([3.0, 2, 2, 2, 2, 2])
    total = mixing.largest_total(np.bincount(source, sizes), share, cap) * 0.8
    weight, converged = mixing.rake(sizes, source, [(lang, np.bincount(lang, sizes) / sizes.sum() * total)], share * total, cap)
    assert np.allclose(np.bincount(source, sizes * weight), share * total, rtol=1e-6) and converged and (weight <= cap[source] + 1e-9).all()
    assert np.abs(np.bincount(lang, sizes * weight) / total - np.bincount(lang, sizes) / sizes.sum()).max() < 0.01


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(2)
    rows = [(i, "big" if i % 3 else "hot", rng.choice(["en", "de", None]), rng.choice(["a", "b"]), rng.randint(20, 200)) for i in range(3000)]
    rows += [(5000 + i, "small", "en", "a", 100) for i in range(40)] + [(6000, None, "en", "a", 10), (6001, "other", "en", "a", 10), (6002, "big", "en", "a", 0), (6003, "big", "en", "a", None), (5000, "small", "en", "a", 100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, language string, topic string, tokens long")
    goals = spark.createDataFrame([("big", 0.5, 1), ("hot", 0.3, 2), ("small", 0.1, 5), ("absent", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeat int")
    sample, report, margins = mixing.plan(docs, goals)
    each = margins.collect()
    assert {r.margin for r in each} == {'source', 'language', 'topic'} and all(r.converged for r in each)
    for m in ('source', 'language', 'topic'):
        assert abs(sum(r.reached_share for r in each if r.margin == m) - 1) < 1e-9 and all(abs(r.reached_share - r.raked_share) < 0.1 for r in each if r.margin == m)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"big", "hot", "small", "absent"} and got["absent"].reached_share == 0
    assert abs(got["big"].reached_share - 0.5 / 0.9) < 0.005 and abs(got["hot"].reached_share - 0.3 / 0.9) < 0.005 and abs(got["small"].reached_share - 0.1 / 0.9) < 0.005
    caps = {"big": 1, "hot": 2, "small": 5}
    assert all(r.m <= caps[r.source] for r in sample.groupBy("source").agg(F.max("copies").alias("m")).collect())
    assert sample.count() == sample.select("doc_id").distinct().count()
    assert mixing.plan(docs.limit(0), goals)[0].count() == 0


def test_many_languages_are_all_used(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CATEGORIES", 3)
    rows = [(i, "a" if i % 2 else "b", f"l{i % 9}", "t", 50) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, language string, topic string, tokens long")
    sample, report, _ = mixing.plan(docs, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeat int"))
    assert sample.count() == 400 and sample.select("language").distinct().count() == 4


def test_exp_digamma():
    # digamma(1) = -0.5772156649, digamma(0.5) = -1.9635100260, digamma(10) = 2.2517525890
    got = np.log(subjects.exp_digamma(np.array([1.0, 0.5, 10.0, 0.05])))
    assert np.allclose(got, [-0.5772156649, -1.9635100260, 2.2517525890, -20.4978449], atol=1e-4)


def test_text_after_a_list_of_references_counts():
    text = "Intro words\n## References\n[1] Hidden journal\nA hidden entry\n## Appendix\nVisible tail"
    got = subjects.words(text)
    assert "tail" in got and "visible" in got and "hidden" not in got
    assert "tail" in subjects.words("a\n\\begin{thebibliography}{9} hidden \\end{thebibliography}\nVisible tail") and "far" in subjects.words("x < y and far > z")
