"""The manifest against a plain tree, on groups of one row to several blocks and on odd rows."""

import hashlib
import zlib
from collections import defaultdict

import duckdb

from compare import differences
from seqstates.llm import merkle

DOC = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    texts = [None if v is None else str(v) for v in row]
    return h(*["-" if t is None else f"{len(t.encode())}:{t}" for t in texts])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def steps(tree, place):
    found = []
    for level in tree[:-1]:
        run = place // 3 * 3
        found.append((level[run:place], level[place + 1 : run + 3]))
        place //= 3
    return found


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(levels([leaf(r) for r in groups[name]]))
    top = levels([tree[-1][0] for tree in trees])
    out = []
    for g, name in enumerate(names):
        for place, row in enumerate(groups[name]):
            path = steps(trees[g], place) + steps(top, g)
            tampered = row
            if row[4] is not None and zlib.crc32(b"" if row[0] is None else str(row[0]).encode()) % 2 == 0:
                tampered = (*row[:4], row[4].replace("\n", ""))
            node = leaf(tampered)
            for left, right in path:
                node = h(*left, node, *right)
            proof = h(*[x for left, right in path for x in (*left, *right)])
            out.append((row[0], leaf(row), trees[g][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def rows():
    made = [(i, "hot", "en", 3, f"a\n{i}") for i in range(800)]
    made += [(i, f"s{i % 9}", None, None, f"line {i}" + "\n" * (i % 2)) for i in range(60)]
    made += [(7, None, "de", 0, ""), (8, None, "de", 0, None), (None, None, None, None, None), (None, "", "x", 1, "\n"), (None, "", "y", 1, "z\n")]
    made += [(5, "é", "en", 2, "same\n")] * 5 + [(5, "é", "en", 2, "other")] + [(9, "z", "en", 1, "long \n" * 50_000), (-4, "Z", "en", 1, "neg\n")]
    return made


def test_equals_plain_tree(spark):
    docs = spark.createDataFrame(rows(), DOC).selectExpr("*", "'x' AS leaf", "'x' AS rank", "'x' AS key", "'x' AS inner", "1 AS n")
    got = sorted((tuple(r) for r in merkle.checked(docs).collect()), key=str)
    assert got == expected(rows())
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_sql(spark):
    docs = spark.createDataFrame(rows(), DOC)
    connection = duckdb.connect()
    connection.register("documents", docs.toArrow())
    assert differences(merkle.checked(docs), connection, merkle.ORACLE) is None


def test_paths_are_real_proofs(spark):
    """Of every group size up to two tiers, each path leads from its leaf to the root."""
    docs = spark.createDataFrame([(i, f"g{g}", "en", g, "t") for g in range(1, 40) for i in range(g)], DOC)
    found = merkle.manifest(docs, ["doc_id", "source"], "source", "doc_id", {"size": docs["n_chars"]})
    wrong = found.where(merkle.folded(merkle.F.col("leaf"), merkle.F.col("path")) != merkle.F.col("root"))
    assert wrong.count() == 0 and found.select("root").distinct().count() == 1
    assert found.groupBy("size").count().where("size != count").count() == 0


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "x")], DOC)
    row = merkle.checked(docs).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == h() and row.verified
    assert merkle.checked(docs.limit(0)).count() == 0
