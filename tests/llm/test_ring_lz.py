"""Sharding and fingerprints against direct definitions on small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from seqstates.llm import lzprint, ring
from seqstates.llm.common import table


def test_walk_places_every_row_once():
    counts = {5: 40, 900: 3, 901: 1, 65000: 60}
    owners, capacity = ring.virtual_nodes(5), ring.capacities(104, 5)
    runs = ring.walk(counts, owners, capacity)
    placed, slots = defaultdict(list), defaultdict(list)
    for cell, rank, shard, slot, count in runs:
        placed[cell] += range(rank, rank + count)
        slots[shard] += range(slot, slot + count)
    assert {c: sorted(r) for c, r in placed.items()} == {c: list(range(n)) for c, n in counts.items()}
    assert [sorted(slots[s]) for s in range(5)] == [list(range(n)) for n in capacity]


def test_rows_stay_at_home_while_there_is_room():
    """Only rows that find their shard full go on, to the next shard clockwise with room."""
    owners = {10: 0, 20: 1, 30: 2}
    runs = ring.walk({9: 5, 15: 1, 25: 1}, owners, [3, 2, 2])
    assert sorted(runs) == [(9, 0, 0, 0, 3), (9, 3, 1, 1, 1), (9, 4, 2, 1, 1), (15, 0, 1, 0, 1), (25, 0, 2, 0, 1)]


@pytest.mark.parametrize("hot", [False, True])
def test_assign(spark, sf_dir, hot):
    docs = table(spark, sf_dir, "documents").withColumn("shard", ring.F.lit("clash"))
    if hot:
        docs = docs.select("text", "shard", ring.F.expr("if(doc_id % 3 = 0, 7, doc_id)").alias("doc_id"))
        docs = docs.union(docs.selectExpr("CAST(NULL AS STRING) text", "shard", "CAST(NULL AS BIGINT) doc_id").limit(2))
    rows = docs.collect()
    got = ring.assign(docs).collect()
    wanted = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == wanted
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slots[s]) == list(range(len(slots[s]))) for s in range(24))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_empty_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    assert ring.assign(docs).count() == 0
    assert lzprint.edited_pairs(docs).count() == 0


def phrases(data):
    found, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in found:
            found.add(data[start:end])
            start = end
    return found


def test_parser_by_parts():
    data = b"abababab the the the thing"
    parser = lzprint.Parser()
    parser.feed(data[:7])
    other = parser.fork()
    parser.feed(data[7:])
    assert parser.phrases == phrases(data)
    other.feed(b"xyz")
    assert other.phrases == phrases(data[:7] + b"xyz")


def test_likeness_of_short_sets_is_exact():
    x, y = phrases(b"abcdefgh"), phrases(b"abcdeXYZ")
    assert lzprint.likeness(lzprint.fingerprint("abcdefgh"), lzprint.fingerprint("abcdeXYZ")) == len(x & y) / len(x | y)


@pytest.mark.parametrize("odd", [False, True])
def test_edited_pairs(spark, sf_dir, odd):
    docs = table(spark, sf_dir, "documents").withColumn("part", ring.F.lit("clash"))
    if odd:
        rows = [(5, "é" * 9, "x"), (5, "abc", "x"), (-3, None, "x"), (7, "", "x"), (None, "first one", "x"), (5, "abc", "x")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()))
    got = lzprint.edited_pairs(docs).collect()
    wanted = []
    for row, following in zip(rows, rows[1:] + rows[:1]):
        text, after = row.text or "", following.text or ""
        cut = len(text) // 4
        changed = text[: len(text) - cut] + after[:cut]
        own, other = lzprint.fingerprint(text), lzprint.fingerprint(changed)
        digest = hashlib.sha256(changed.encode()).hexdigest()
        near = lzprint.likeness(own, other), lzprint.likeness(own, lzprint.fingerprint(after))
        wanted.append((row.doc_id, len(text), digest, lzprint.shown(own), lzprint.shown(other), *near))
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)
