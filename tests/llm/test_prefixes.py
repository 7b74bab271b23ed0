"""The prefix trie against plain recursion and against its SQL, on odd rows and on small components."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from compare import differences
from seqstates.llm import prefixes

CONV = "conv_id long, turn long, role string, text string"


def expected(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    turns = {c: [(r[2], r[4]) for r in sorted(x)] for c, x in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children, name = defaultdict(list), {}
    for node in members:
        name[node] = min(members[node])
        if node:
            children[node[:-1]].append(node)
    out, total = [], {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [total[c] for c in children[node]]
        total[node] = (sum(b[0] for b in below) or 1, (len(members[node]) - 1) * words + sum(b[1] for b in below))
        ends = ",".join(map(str, sorted(c for c in members[node] if len(built[c]) == len(node))))
        parent = name[node[:-1]] if node else None
        out.append((name[node], len(node), parent, len(members[node]), len(children[node]), *total[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows():
    rows = [(c, t, "user" if t % 2 else "bot", f"turn {c % 7 if t < 2 else c} of {t}") for c in range(60) for t in range(c % 6)]
    rows += [(c, t, "user", "hello there") for c in range(100, 160) for t in range(3)]  # equal conversations
    rows += [(200, t, "user", f"long {t}") for t in range(300)]  # one of very many turns
    rows += [(210 + i, t, "user", f"long {t}") for i in range(3) for t in range(290)]
    rows += [(300, None, None, None), (300, None, "a", "x y"), (300, 1, "a", ""), (301, 0, "b", "\t two  words\n"), (302, 5, "b", "same"), (302, 5, "b", "same"), (302, 5, "b", "other"), (302, 5, "a", "z")]
    rows += [(None, 1, "user", "lost"), (-3, 0, "user", "negative"), (-20, 0, "user", "base"), (401, 0, "user", "w " * 50_000)]
    return rows


@pytest.mark.parametrize(("local", "chunk", "ends"), [(4_000, 1024, 4096), (40, 16, 8)])
def test_equals_recursion(spark, monkeypatch, local, chunk, ends):
    """With small bounds many rounds are shared by all tasks, and conversations and ends are cut into blocks."""
    monkeypatch.setattr(prefixes, "LOCAL", local)
    monkeypatch.setattr(prefixes, "CHUNK", chunk)
    monkeypatch.setattr(prefixes, "ENDS", ends)
    table = spark.createDataFrame(odd_rows(), CONV).selectExpr("*", "1 AS conv", "'x' AS depth", "2 AS rank", "3 AS reach", "4 AS node")
    assert sorted((tuple(r) for r in prefixes.trie(table).collect()), key=str) == expected(odd_rows())


def test_sql_and_empty(spark):
    rows = [r for r in odd_rows() if r[0] != 200 and not 210 <= (r[0] or 0) < 213]
    table = spark.createDataFrame(rows, CONV)
    connection = duckdb.connect()
    connection.register("conversations", table.toArrow())
    assert differences(prefixes.trie(table), connection, prefixes.ORACLE) is None
    assert prefixes.trie(table.limit(0)).count() == 0


def test_totals_of_any_weights(spark, monkeypatch):
    """The decomposition adds up any weights; a chain, a star and a comb as one trie."""
    monkeypatch.setattr(prefixes, "LOCAL", 6)
    rows = [(20, t, "u", f"c{t}") for t in range(60)] + [(c, 0, "u", f"s{c}") for c in range(40, 60)]
    rows += [(100 + c, t, "u", f"k{t}" if t < c else f"end {c}") for c in range(20) for t in range(c + 1)]
    nodes, named = prefixes.steps(prefixes.rebuilt(spark.createDataFrame(rows, CONV)))
    weighted = nodes.withColumn("w", prefixes.F.col("depth") + 1).withColumn("one", prefixes.F.lit(1).cast("long"))
    got = {(r.conv, r.depth): (r.w, r.one) for r in prefixes.subtree_totals(weighted, named, ["w", "one"]).collect()}
    wanted = {(r.conv, r.depth): [0, 0] for r in nodes.collect()}
    parent = {(r.conv, r.depth): None if r.parent is None else (r.parent, r.depth - 1) for r in nodes.collect()}
    for node in wanted:
        up = node
        while up is not None:
            wanted[up] = [wanted[up][0] + node[1] + 1, wanted[up][1] + 1]
            up = parent[up]
    assert got == {k: tuple(v) for k, v in wanted.items()}
