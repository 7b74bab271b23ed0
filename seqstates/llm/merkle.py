"""Merkle manifest of a table: a tree of hashes per group, and one over the groups.

Every row is a leaf, H of its fields.  The leaves of a group ascend by the order column;
runs of `ARITY` neighbours become their H, level by level, until one node, the subroot, is
left.  The subroots of all groups give the root in the same way.

1. Rows are hashed where they are read and numbered in their group (`ranked`).
2. A block is `ARITY ** DIGITS` neighbours, so a group of any size is spread over tasks and
   no task ever holds more of it than a block.  The digits of the rank are grouped away one
   after the other, with the rows of a run nested into the struct of their parent; all
   levels of a block share one shuffle.  The nodes that are left, one per block, are the
   rows of the next tier, until every group has one block.
3. The way back: a node's struct holds its children, so a transform gives each child the
   hashes left and right of it, and an explode makes them rows; within a block there is no
   join.  Only the heads of the blocks, one row per block, meet the tier below by key.

NULL is a value of its own in every field and in the group, where it comes first; NULL in
the order column comes first, too.  Rows that tie are ordered by their leaf, so equal rows
are interchangeable.  Only the columns named are read, so others cannot clash; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqstates.llm.common import materialize, ranked, sized_join

ARITY = 3
DIGITS = 5
BLOCK = ARITY**DIGITS


def digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def leaf_of(fields: Sequence[Column]) -> Column:
    """H over the fields: `-` for NULL, else UTF-8 byte count, colon, value."""
    texts = [c.cast("string") for c in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def _hashed(level: int) -> Column:
    """Whether a group of n nodes has a run to hash at this level; a lone node goes up as it is."""
    return F.col("n") > ARITY**level


def rollup(nodes: DataFrame) -> DataFrame:
    """(key, n, rank, hash, inner) -> one row (key, n, block, hash, inner) per block, with its nodes nested in `inner`."""
    digits = [F.expr(f"CAST((rank div {ARITY**i}) % {ARITY} AS TINYINT)").alias(f"d{i}") for i in range(DIGITS)]
    rows = nodes.select("key", "n", F.expr(f"rank div {BLOCK}").alias("block"), *digits, "hash", "inner").repartition("key", "block")
    for level in range(DIGITS):
        left = ["key", "n", "block", *[f"d{i}" for i in range(level + 1, DIGITS)]]
        node = F.struct(F.col(f"d{level}").alias("digit"), "hash", "inner")
        rows = rows.groupBy(*left).agg(F.sort_array(F.collect_list(node)).alias("inner"))
        rows = rows.withColumn("hash", F.when(_hashed(level), digest(_joined(F.col("inner.hash")))).otherwise(F.col("inner")[0]["hash"]))
    return rows


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Written blocks of every tier; in the last one each key has a single block."""
    tiers: list[DataFrame] = []
    while True:
        tiers.append(materialize(rollup(nodes), "blocks"))
        largest = tiers[-1].agg(F.max("n")).first()[0]
        if largest is None or largest <= BLOCK:
            return tiers
        above = F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n")
        nodes = tiers[-1].select("key", above, F.col("block").alias("rank"), "hash", F.struct(F.lit(0).alias("none")).alias("inner"))


def _opened(blocks: DataFrame, heads: DataFrame) -> DataFrame:
    """(key, rank, hash, inner, path, ...) of every node of the blocks; `path` has its siblings from its own run up to the root."""
    carried = [c for c in heads.columns if c not in ("key", "block", "path")]
    rows = sized_join(blocks, heads, ["key", "block"]).withColumn("rank", F.col("block"))
    for level in reversed(range(DIGITS)):
        hashes = F.col("inner.hash")
        beside = lambda x, i: F.struct(x["digit"].alias("digit"), x["hash"].alias("hash"), x["inner"].alias("inner"), i.alias("i"))
        rows = rows.withColumn("hashes", hashes).withColumn("child", F.explode(F.transform("inner", beside)))
        step = F.struct(
            _joined(F.slice("hashes", F.lit(1), F.col("child.i"))).alias("left"),
            _joined(F.slice("hashes", F.col("child.i") + 2, F.lit(ARITY))).alias("right"),
        )
        path = F.when(_hashed(level), F.concat(F.array(step), F.col("path"))).otherwise(F.col("path"))
        rank = (F.col("rank") * ARITY + F.col("child.digit")).alias("rank")
        rows = rows.select("key", "n", rank, F.col("child.hash").alias("hash"), F.col("child.inner").alias("inner"), path.alias("path"), *carried)
    return rows.drop("n")


def _descended(tiers: list[DataFrame], heads: DataFrame) -> DataFrame:
    """The nodes of the lowest tier, from heads (key, path, ...) of the uppermost blocks."""
    heads = heads.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tiers):
        rows = _opened(blocks, heads)
        heads = rows.drop("hash", "inner").withColumnRenamed("rank", "block")
    return rows


def manifest(
    rows: DataFrame, fields: Sequence[str], group: str, order: str, carry: Mapping[str, Column] | None = None
) -> DataFrame:
    """(order, leaf, subroot, root, path, *carry) of every row.

    `path` is an array of (left, right): the hashes beside the row's node in its run, from
    the leaves up to the root.  `carry` names further columns to return with each row.
    """
    carry = dict(carry or {})
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # NULL comes first
    payload = F.struct(F.col(order).alias("order"), *[c.alias(n) for n, c in carry.items()])
    leaves = rows.select(name.alias("key"), payload.alias("inner"), leaf_of([F.col(c) for c in fields]).alias("hash"))
    leaves = leaves.withColumn("order", F.col("inner.order"))
    leaves = ranked(materialize(leaves, "leaves"), ["key"], ["order", "hash"]).withColumnRenamed("total", "n")
    groups = _tiers(leaves)
    subroots = groups[-1].select(F.lit("").alias("key"), F.struct(F.col("key").alias("name")).alias("inner"), "hash")
    subroots = ranked(subroots.withColumn("name", F.col("inner.name")), ["key"], ["name"]).withColumnRenamed("total", "n")
    whole = _tiers(subroots)
    none = F.array().cast("array<struct<left string, right string>>")
    heads = _descended(whole, whole[-1].select("key", none.alias("path"), F.col("hash").alias("root")))
    heads = heads.select(F.col("inner.name").alias("key"), "path", "root", F.col("hash").alias("subroot"))
    found = _descended(groups, heads)
    return found.select(F.col("inner.order").alias(order), F.col("hash").alias("leaf"), "subroot", "root", "path", *[F.col(f"inner.{n}").alias(n) for n in carry])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the hashes beside it."""
    return F.aggregate(path, leaf, lambda acc, step: digest(F.concat(step["left"], acc, step["right"])))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def checked(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, and the check of the same rows after line ends went from every text whose id has an even checksum.

    A NULL id counts as an empty text in the checksum.
    """
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    stripped = F.replace("text", F.lit("\n"), F.lit(""))
    fields = [stripped if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.when(even & (F.octet_length("text") > F.octet_length(stripped)), leaf_of(fields))
    rows = manifest(docs.select(*FIELDS), FIELDS, "source", "doc_id", {"tampered": tampered})
    proof = digest(_joined(F.transform("path", lambda step: F.concat(step["left"], step["right"]))))
    rows = rows.select(
        "doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS b)),
docs AS (
  SELECT doc_id, source, text,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    CASE WHEN doc_id IS NULL THEN 0 ELSE xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
      lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1]))) END AS crc
  FROM documents, crc_table),
hashed AS (
  SELECT doc_id, source, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
    CASE WHEN crc % 2 = 0 THEN sha256(concat(head, coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))) END AS tampered
  FROM docs),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM hashed),
nodes AS (
  SELECT source, 0 AS lvl, rank AS idx, leaf AS h, n FROM leaves
  UNION ALL
  SELECT source, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, lvl, idx // 3, n),
subroots AS (
  SELECT source, lvl AS depth, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, rank AS idx, subroot AS h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY lvl, idx // 3, n),
steps AS (
  SELECT l.doc_id, l.leaf, l.rank AS r, l.source, o.lvl,
    coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (WHERE o.idx < l.rank // (3 ** o.lvl)::BIGINT), '') AS lft,
    coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (WHERE o.idx > l.rank // (3 ** o.lvl)::BIGINT), '') AS rgt
  FROM leaves l JOIN nodes o ON o.source IS NOT DISTINCT FROM l.source AND o.n > 1 AND o.idx // 3 = l.rank // (3 ** (o.lvl + 1))::BIGINT
  GROUP BY ALL
  UNION ALL
  SELECT l.doc_id, l.leaf, l.rank, l.source, s.depth + o.lvl,
    coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (WHERE o.idx < s.rank // (3 ** o.lvl)::BIGINT), ''),
    coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (WHERE o.idx > s.rank // (3 ** o.lvl)::BIGINT), '')
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN tops o ON o.n > 1 AND o.idx // 3 = s.rank // (3 ** (o.lvl + 1))::BIGINT
  GROUP BY l.doc_id, l.leaf, l.rank, l.source, s.depth, s.rank, o.lvl),
paths AS (SELECT source, r, list({'l': lft, 'r': rgt} ORDER BY lvl) AS path, sha256(string_agg(lft || rgt, '' ORDER BY lvl)) AS proof FROM steps GROUP BY source, r),
folds AS (
  SELECT l.source, l.rank AS r, coalesce(l.tampered, l.leaf) AS h, coalesce(p.path, []) AS path FROM leaves l LEFT JOIN paths p ON p.source IS NOT DISTINCT FROM l.source AND p.r = l.rank
  UNION ALL
  SELECT source, r, sha256(concat(path[1].l, h, path[1].r)), path[2:] FROM folds WHERE len(path) > 0),
ends AS (SELECT source, r, h FROM folds WHERE len(path) = 0)
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN (SELECT h FROM tops WHERE n = 1) t ON true
JOIN ends e ON e.source IS NOT DISTINCT FROM l.source AND e.r = l.rank
LEFT JOIN paths p ON p.source IS NOT DISTINCT FROM l.source AND p.r = l.rank
"""
