"""Suffix order against sorting, repeated strings against counting all of them."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from seqstates.llm import suffixes
from seqstates.llm.common import table


def suffix(symbols, i):
    end = i
    while symbols[end]:
        end += 1
    return symbols[i:end]


def test_suffix_order():
    draw = random.Random(3)
    for _ in range(300):
        symbols, bounds = [], [0]
        for _ in range(draw.randint(1, 5)):
            symbols.append(0)
            for _ in range(draw.randint(1, 4)):
                word = [draw.randint(1, draw.choice([1, 2, 3, 5])) for _ in range(draw.randint(0, 12))]
                symbols += word * draw.choice([1, 1, 1, 4]) + [0]
            bounds.append(len(symbols))
        order = suffixes.suffix_order(np.array(symbols), np.array(bounds)).tolist()
        for a, b in zip(bounds, bounds[1:]):
            assert sorted(order[a:b]) == list(range(a, b))
            found = [suffix(symbols, i) for i in order[a:b]]
            assert found == sorted(found)


def expected(texts, length=suffixes.LENGTH):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone, kept, at = [], b"", 0
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                if gone and i <= gone[-1][1]:
                    gone[-1][1] = i + length
                else:
                    gone.append([i, i + length])
        for a, b in gone:
            kept += d[at:a]
            at = b
        kept += d[at:]
        out.append((len(d), len(d) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def odd_texts():
    draw = random.Random(5)
    fresh = lambda n: "".join(draw.choices("abcdefgh é\n", k=n))
    passage, notice, long = fresh(400), fresh(150), fresh(30_000)
    texts = [None, "", "x", "ab" * 300, "\0" * 250, fresh(199), passage[:199], passage[1:201], notice + fresh(300), notice + fresh(300)]
    texts += [fresh(50 + i) + passage + fresh(i) for i in range(20)]
    texts += [passage[:230] + "#" + passage[230:] for _ in range(3)] + [passage[:i] + "*" + passage[i + 1 :] for i in range(0, 400, 7)]
    texts += [long + "a", long + "b", long[:15_000] + "\0" + long[15_001:], fresh(2_000)]
    return texts + [fresh(500)] * 30  # a third of all rows


@pytest.mark.parametrize("hot_bytes", [suffixes.HOT_BYTES, 2_000])
def test_odd_rows(spark, monkeypatch, hot_bytes):
    """With the smaller bound the large buckets are counted by hashes."""
    monkeypatch.setattr(suffixes, "HOT_BYTES", hot_bytes)
    texts = odd_texts()
    ids = [None if i % 5 == 0 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").selectExpr("*", "'x' AS id", "1 AS k1", "'y' AS anchor", "2 AS removed")
    got = Counter(tuple(r) for r in suffixes.digests(docs).collect())
    assert got == Counter((i, *x) for i, x in zip(ids, expected(texts)))
    assert sum(x[2] * n for x, n in got.items()) > 0


def test_empty_and_segments(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert suffixes.digests(docs.limit(0)).count() == 0
    assert suffixes.digests(docs).first()[1:] == (1, 0, 0, hashlib.sha256(b"a").hexdigest())
    data = odd_texts()[-34].encode()
    whole = [np.concatenate(x) for x in zip(*suffixes.anchors(data))]
    monkeypatch.setattr(suffixes, "SEGMENT", 1000)
    parts = [np.concatenate(x) for x in zip(*suffixes.anchors(data))]
    spread = lambda x: np.repeat(x[0], x[2] - x[1]).tolist()
    assert spread(whole) == spread(parts) and parts[1].tolist() == [0, *parts[2][:-1].tolist()]


def test_given_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.collect()
    got = Counter(tuple(r) for r in suffixes.digests(docs).collect())
    assert got == Counter((r.doc_id, *x) for r, x in zip(rows, expected([r.text for r in rows])))
