"""Prefix trie of conversations with totals per subtree, by centroid decomposition.

1. Conversations are put together turn by turn (`rebuilt`), and a running hash of position,
   role and text names every prefix (`steps`); equal prefixes are one node of the trie, known
   by its smallest conversation and its depth.
2. Subtree totals come from a centroid decomposition of the parent edges
   (`subtree_totals`).  A node's reach, the number of turns from it to the ends of all its
   members, is a sum over its subtree that the grouping gives for free.  In each component the nodes that reach at
   least half of what its top does are a path from the top down; its end is the centroid.
   The centroid's total is that of the nodes below it; the total is added along the
   path to the top, and the component falls apart into the subtrees under the centroid and
   the rest above, each with at most half the reach.  All components take a round at once;
   those of at most `LOCAL` turns are finished by the same steps inside a task.  The number of rounds
   is the logarithm of the number of turns, however deep the trie is.
3. Which component below a centroid a node joins is an equi-join: its own conversation, at
   the depth below the centroid's, names the child that it passes.

Running hashes are windows over blocks of a conversation, and conversations that end in one
node are hashed in a stream of blocks, so a conversation or node may hold any part of the rows.

Rows that share conversation and turn are ordered by role, then by the MD5 of the text;
rows without a conversation belong to none and are left out.  Only the columns named are
read, so others cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from seqstates.llm.common import materialize, ranked, sized_join

HEADS = 20  # conversations that share the first turns of one of them
MOST_SHARED = 3
CHUNK = 1024  # turns of a conversation in one window
ENDS = 4096  # conversations whose ids are joined to one text
LOCAL = 4_000

_KEY = ["conv", "depth"]
_TOP = ["top_conv", "top_depth"]


def _shared_turns(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")


def _words(text: Column) -> Column:
    """Number of runs of characters other than blanks."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv, pos, t1, t2, words, len) of every turn, from 1, and a row with position 0 per conversation.

    The first turns of each conversation are those of the first conversation of its `HEADS`;
    the remainder of a negative id is negative, as in SQL.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        role.alias("role"),
        F.md5(text.cast("binary")).alias("digest"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit("second"), role, text).alias("t2"),
        _words(text).alias("words"),
    )
    turns = ranked(turns, ["conv"], ["turn", "role", "digest"])
    turns = materialize(turns.select("conv", "rank", "total", "t1", "t2", "words"), "turns")
    heads = turns.where(F.col("rank") < MOST_SHARED).groupBy(F.col("conv").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("rank", "t1", "t2", "words"))).alias("head"))
    convs = turns.groupBy("conv").agg(F.max("total").alias("total"))
    convs = convs.select("conv", "total", _shared_turns(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % HEADS).alias("base"))
    convs = convs.join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h"))
    convs = convs.select("conv", "h", head.alias("head"), F.greatest(F.col("total") - F.col("h"), F.lit(0)).alias("own"))
    convs = materialize(convs.withColumn("len", F.size("head") + F.col("own")), "convs")
    first = convs.select("conv", "len", F.posexplode("head").alias("i", "t"))
    first = first.select("conv", (F.col("i") + 1).cast("long").alias("pos"), "t.t1", "t.t2", "t.words", "len")
    none = F.lit(0).cast("long")
    root = convs.select("conv", none.alias("pos"), none.alias("t1"), none.alias("t2"), none.alias("words"), "len")
    own = turns.where(F.col("rank") >= _shared_turns(F.col("conv"))).join(convs.select("conv", "h", "len", F.size("head").alias("k")), "conv")
    own = own.select("conv", (F.col("rank") - F.col("h") + F.col("k") + 1).alias("pos"), "t1", "t2", "words", "len")
    return root.unionByName(first).unionByName(own)


def _only(rows: DataFrame) -> int | None:
    """The value of a table of one row and column, if there is one."""
    row = rows.first()
    return None if row is None else row[0]


def steps(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes, and every turn as (conv, depth, node, up): its node and the one before, by their conversations.

    Nodes are (conv, depth, parent, n_convs, words, reach), and carry their smallest conversation.
    """
    chunk = F.expr(f"pos div {CHUNK}").alias("chunk")
    marks = [F.when(F.col("pos") > 0, F.xxhash64("pos", t)).otherwise(F.lit(0)).alias(x) for t, x in (("t1", "x1"), ("t2", "x2"))]
    rows = materialize(turns.select("conv", F.col("pos").alias("depth"), chunk, *marks, "words", "len"), "marks")
    several = rows.groupBy("conv", "chunk").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    several = several.select("conv", "chunk", F.bit_xor("y1").over(before).alias("y1"), F.bit_xor("y2").over(before).alias("y2")).where("chunk > 0")
    running = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({x: F.bit_xor(x).over(running) for x in ("x1", "x2")})
    rows = sized_join(rows, several, ["conv", "chunk"], how="left")
    for i in (1, 2):
        rows = rows.withColumn(f"x{i}", F.col(f"x{i}").bitwiseXOR(F.coalesce(f"y{i}", F.lit(0))))
    rows = materialize(rows.select("conv", "depth", "x1", "x2", "words", "len"), "prefixes")

    name = ["depth", "x1", "x2"]
    nodes = rows.groupBy(*name).agg(
        F.min("conv").alias("node"),
        F.count("*").alias("n_convs"),
        F.max("words").alias("words"),
        F.sum(F.col("len") - F.col("depth") + 1).alias("reach"),
    )
    nodes = materialize(nodes, "nodes")
    root = F.lit(_only(nodes.where("depth = 0").select("node"))).cast("long")
    named = materialize(sized_join(rows.where("depth > 0"), nodes.select(*name, "node"), name).select("conv", "depth", "node", "len"), "named")
    above = named.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("up"))
    named = named.join(above, _KEY, "left").select("conv", "depth", "node", F.coalesce("up", root).alias("up"), "len")
    ends = rows.where("depth = 0 AND len = 0").select("conv", "depth", root.alias("node"), F.lit(None).cast("long").alias("up"), "len")
    named = materialize(named.unionByName(ends), "steps")
    parents = named.where("node = conv AND depth > 0").select("conv", "depth", F.col("up").alias("parent"))
    nodes = nodes.select(F.col("node").alias("conv"), "depth", "n_convs", "words", "reach").join(parents, _KEY, "left")
    return materialize(nodes, "tree"), named


def _local(weights: list[str]):
    """Finish whole components in a task, by the same decomposition."""

    def totals(rows: list[tuple]) -> Iterator[tuple]:
        """rows: (conv, depth, parent, reach, *weights, *added), sorted by depth; the first one is the top."""
        place = {row[:2]: i for i, row in enumerate(rows)}
        parent = [place.get((row[2], row[1] - 1), -1) for row in rows]
        parent[0] = -1
        children: list[set[int]] = [set() for _ in rows]
        for i, p in enumerate(parent):
            if p >= 0:
                children[p].add(i)
        reach = [row[3] for row in rows]
        own = [row[4 : 4 + len(weights)] for row in rows]
        added = [list(row[4 + len(weights) :]) for row in rows]
        waiting = [0]
        while waiting:
            top = waiting.pop()
            path = [top]
            while (below := next((c for c in children[path[-1]] if 2 * reach[c] >= reach[top]), None)) is not None:
                path.append(below)
            centroid, stack = path[-1], [path[-1]]
            sums = [0] * len(weights)
            while stack:
                i = stack.pop()
                sums = [a + b for a, b in zip(sums, own[i])]
                stack += children[i]
            for i in path:
                added[i] = [a + b for a, b in zip(added[i], sums)]
                if i != centroid:
                    reach[i] -= reach[centroid]
            if centroid != top:
                children[path[-2]].discard(centroid)
                waiting.append(top)
            waiting += children[centroid]
        for row, total in zip(rows, added):
            yield (*row[:2], *total)

    names = [*_KEY, *weights]

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        top, out = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != top and held:
                    out += totals(held)
                    held = []
                    if len(out) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                        out = []
                top = row[:2]
                held.append(row[2:])
        if held:
            out += totals(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return batches


def subtree_totals(nodes: DataFrame, named: DataFrame, weights: list[str]) -> DataFrame:
    """(conv, depth, *weights) with each node's weights summed over its subtree, itself included.

    `nodes` are (conv, depth, parent, reach, *weights), `named` the steps of the same trie.
    """
    added = [f"added_{w}" for w in weights]
    passed = named.select("conv", F.col("depth").alias("at"), F.col("node").alias("child"), "up")
    open_rows = nodes.select(*_KEY, "parent", "reach", *weights, *[F.lit(0).cast("long").alias(a) for a in added])
    root = F.lit(_only(nodes.where("depth = 0").select("conv"))).cast("long")
    open_rows = open_rows.withColumns({"top_conv": root, "top_depth": F.lit(0).cast("long")})
    done, local = [], []
    while True:
        sizes = open_rows.groupBy(*_TOP).agg(F.max("reach").alias("total"))
        rows = materialize(sized_join(open_rows, sizes, _TOP), "components")
        local.append(rows.where(F.col("total") <= LOCAL).drop("total"))
        large = rows.where(F.col("total") > LOCAL)
        on_path = F.col("reach") * 2 >= F.col("total")
        centre = large.where(on_path).groupBy(*_TOP).agg(F.max(F.struct("depth", "conv", "reach")).alias("c"))
        centre = centre.select(*_TOP, F.col("c.conv").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.reach").alias("c_reach"))
        if centre.isEmpty():
            break
        rows = sized_join(large, centre, _TOP).withColumn("at", F.when(F.col("depth") > F.col("c_depth"), F.col("c_depth") + 1))
        rows = rows.join(passed, ["conv", "at"], "left").withColumn("below", F.coalesce(F.col("up") == F.col("c_conv"), F.lit(False)))
        is_centre = (F.col("conv") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
        rows = materialize(rows.withColumn("centre", is_centre), "split")
        sums = rows.where("below OR centre").groupBy(*_TOP).agg(*[F.sum(w).alias(f"sum_{w}") for w in weights])
        rows = sized_join(rows, sums, _TOP)
        more = [F.when(on_path, F.col(a) + F.col(f"sum_{w}")).otherwise(F.col(a)).alias(a) for a, w in zip(added, weights)]
        settled = rows.where("centre").select(*_KEY, *[c.alias(w) for c, w in zip(more, weights)])
        done.append(materialize(settled, "settled"))
        open_rows = rows.where("NOT centre").select(
            *_KEY,
            "parent",
            F.when(on_path, F.col("reach") - F.col("c_reach")).otherwise(F.col("reach")).alias("reach"),
            *weights,
            *more,
            F.when(F.col("below"), F.col("child")).otherwise(F.col("top_conv")).alias("top_conv"),
            F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
        )
        open_rows = materialize(open_rows, "open")
    rest = local[0]
    for rows in local[1:]:
        rest = rest.unionByName(rows)
    rest = rest.select(*_TOP, *_KEY, "parent", "reach", *weights, *added).repartition(*_TOP).sortWithinPartitions(*_TOP, "depth")
    found = rest.mapInArrow(_local(weights), ", ".join(f"{c} long" for c in [*_KEY, *weights]))
    for rows in done:
        found = found.unionByName(rows)
    return found


def _end_digests(named: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) of the nodes in which conversations end: SHA-256 of their ids, ascending, with commas."""
    ends = named.where("depth = len").select(F.col("node"), "depth", F.col("conv").alias("id"))
    ends = ranked(ends, ["node", "depth"], ["id"]).withColumn("block", F.expr(f"rank div {ENDS}"))
    texts = ends.groupBy("node", "depth", "block").agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for node, depth, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (node, depth) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (node, depth), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*_KEY, "ends_sha256"])
                out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=[*_KEY, "ends_sha256"])

    laid = texts.repartition("node", "depth").sortWithinPartitions("node", "depth", "block")
    return laid.select("node", "depth", "ids").mapInArrow(batches, "conv long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations, with its counts and subtree totals."""
    nodes, named = steps(rebuilt(conversations))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, _KEY, "left").fillna({"n_children": 0})
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    nodes = materialize(nodes, "weighted")
    totals = materialize(subtree_totals(nodes, named, ["n_leaves", "saved_tokens"]), "totals")
    rows = nodes.drop("n_leaves", "saved_tokens").join(totals, _KEY).join(materialize(_end_digests(named), "ends"), _KEY, "left")
    return rows.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


ORACLE = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS b)),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
      lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1]))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
parts AS (
  SELECT c.conv_id, 0 AS part, o.r, o.role, o.text FROM convs c JOIN turns o ON o.conv_id = c.base AND o.r <= c.h
  UNION ALL SELECT c.conv_id, 1, o.r, o.role, o.text FROM convs c JOIN turns o ON o.conv_id = c.conv_id AND o.r > c.h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, r) AS depth, role, text FROM parts),
prefixes AS (
  SELECT conv_id, depth, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS name,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM placed
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
nodes AS (SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM prefixes GROUP BY depth, name),
members AS (SELECT p.conv_id AS member, n.* FROM prefixes p JOIN nodes n USING (depth, name)),
linked AS (SELECT n.*, m.conv_id AS parent FROM nodes n LEFT JOIN members m ON m.member = n.conv_id AND m.depth = n.depth - 1),
children AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM linked WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT l.*, coalesce(c.n, 0) AS n_children FROM linked l LEFT JOIN children c ON c.parent = l.conv_id AND c.depth = l.depth),
totals AS (
  SELECT m.conv_id, m.depth, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.words)::BIGINT AS saved_tokens
  FROM whole w JOIN members m ON m.member = w.conv_id AND m.depth <= w.depth GROUP BY m.conv_id, m.depth),
lengths AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
ends AS (SELECT m.conv_id, m.depth, string_agg(m.member::VARCHAR, ',' ORDER BY m.member) AS ids FROM members m JOIN lengths l ON l.conv_id = m.member AND l.depth = m.depth GROUP BY m.conv_id, m.depth)
SELECT w.conv_id, w.depth::BIGINT AS depth, w.parent AS parent_conv_id, w.n_convs, w.n_children, t.n_leaves, t.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM whole w JOIN totals t USING (conv_id, depth) LEFT JOIN ends e USING (conv_id, depth)
"""
