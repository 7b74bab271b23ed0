"""Language and quality models: sums against enumeration, odd rows, learning."""

import itertools
import math

import pytest

from seqstates.llm import langid, quality


def segmentations(word):
    for marks in itertools.product((0, 1), repeat=len(word) - 1):
        cut = [0, *[i + 1 for i, m in enumerate(marks) if m], len(word)]
        yield [word[a:b] for a, b in zip(cut, cut[1:])]


@pytest.mark.parametrize("word", ["▁abab", "▁b", "▁xab", "aaaa"])
def test_forward_sums_all_segmentations(word):
    model = {"▁": [0.1, 0.2], "▁a": [0.2, 0.1], "a": [0.3, 0.05], "b": [0.1, 0.3], "ab": [0.2, 0.1], "aba": [0.05, 0.02], "▁ab": [0.05, 0.2]}
    logs = langid.forward(word, langid.tree(model), 2)
    for k in (0, 1):
        weights, uses = [], {}
        for cut in segmentations(word):
            if all(p in model or len(p) == 1 for p in cut):
                weights.append(math.prod(model.get(p, [langid.UNSEEN] * 2)[k] for p in cut))
                for p in cut:
                    uses[p] = uses.get(p, 0.0) + weights[-1]
        assert logs[k] == pytest.approx(math.log(sum(weights)))
        got = {}
        for p, c in langid.expected_pieces(word, langid.tree(model), k):
            got[p] = got.get(p, 0.0) + c
        assert got == pytest.approx({p: c / sum(weights) for p, c in uses.items()})


def corpus(spark):
    rows = [(i, f"the thing and that other {'nd' * (i % 3)}", "en") for i in range(60)]
    rows += [(100 + i, f"der und die einlich ü {'ch' * (i % 3)}", "de") for i in range(60)]
    rows += [(300, None, "en"), (301, "", "de"), (302, "12 !?", None), (303, "that thing " * 20000, None), (None, "und die", "de"), (1, "the thing", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", langid.F.lit("clash"))


def test_language(spark):
    docs = corpus(spark)
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    for doc_id in (300, 301, 302):
        assert (by_id[doc_id].lang_pred, by_id[doc_id].score) == ("und", 0.0)
    assert by_id[303].lang_pred == "en" and by_id[None].lang_pred == "de" and by_id[105].lang_pred == "de"
    assert {r.held_out for r in got} == {True, False}
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality(spark):
    rows = [(i, "plain words of some text. Then more", 1) if i % 2 else (i, "PLAIN!! WORDS!! OF!! SOME!!", 0) for i in range(200)]
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1000, None), (None, 1), (0, 0)], "doc_id long, quality int")
    texts = [(r[0], r[1]) for r in rows] + [(1000, None), (1001, ""), (None, "x"), (1002, "word " * 300000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("label", langid.F.lit(1))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(texts)
    assert all(got[r[0]].predicted == r[2] for r in rows)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == got[1001].score
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_blocks_give_the_same_features(monkeypatch):
    text = "One two two THREE, 4 five!! six " * 9
    whole = quality.Features().vector(text)
    monkeypatch.setattr(quality, "BLOCK", 7)
    parts = quality.Features().vector(text)
    assert (whole[0] == parts[0]).all() and whole[1] == pytest.approx(parts[1])
