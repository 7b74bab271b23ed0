"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has `CELLS` cells.  A row's cell is the hash of its id; every shard owns
`NODES` cells (virtual nodes), and a row belongs to the first virtual node clockwise.
Shards have capacities that add up to the number of rows and differ by one at most, so
the law is `rows`.  Rows that find a shard full go on clockwise to the next virtual node
of a shard with room: in every round the shards with room take what has reached them, in
the order of the ring, and each round fills a shard or places all that is left.

Only the counts of the cells decide, so the walk runs on the driver over at most `CELLS`
numbers, whatever the number of rows.  It gives every cell a few runs (shard, count,
first slot); a row finds its run and slot by its rank in its cell.  Slots are gapless
from 0 in every shard.

NULL ids hash like any other value; NULL texts have size 8 and checksum 0.  Rows that
share an id share a cell and are ranked by checksum and size; equal rows are
interchangeable.  Only id and text are read, so other columns cannot clash; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqstates.llm.common import materialize

SHARDS = 24
NODES = 128
CELLS = 1 << 16


def virtual_nodes(shards: int, nodes: int = NODES, cells: int = CELLS) -> dict[int, int]:
    """Owner of every cell that is a virtual node; on a clash the smaller shard has it."""
    owners: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            digest = hashlib.md5(f"{shard}:{node}".encode()).digest()
            owners.setdefault(int.from_bytes(digest[:8], "big") % cells, shard)
    return owners


def capacities(rows: int, shards: int) -> list[int]:
    """As even as can be; the first shards take what is left over."""
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def walk(counts: dict[int, int], owners: dict[int, int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, first rank, shard, first slot, count) that place all rows of all cells."""
    room, used, runs = list(capacity), [0] * len(capacity), []
    waiting = [(cell, 0, counts[cell]) for cell in sorted(counts)]
    while waiting:
        places = sorted(cell for cell, shard in owners.items() if room[shard])
        if not places:  # a shard may have lost all its nodes to clashes
            owners = owners | {shard: shard for shard in range(len(room)) if room[shard]}
            continue
        over = []
        for cell, rank, count in waiting:
            shard = owners[places[bisect.bisect_left(places, cell) % len(places)]]
            taken = min(count, room[shard])
            if taken:
                runs.append((cell, rank, shard, used[shard], taken))
                room[shard] -= taken
                used[shard] += taken
            if count > taken:
                over.append((cell, rank + taken, count - taken))
        waiting = over
    return runs


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("draw", draw).withColumn("cell", F.expr(f"cast(pmod(draw, {CELLS}) AS int)"))
    rows = materialize(rows, "keys")
    counts = {r.cell: r["count"] for r in rows.groupBy("cell").count().collect()}
    runs = walk(counts, virtual_nodes(shards), capacities(sum(counts.values()), shards))
    runs = docs.sparkSession.createDataFrame(runs, "cell int, first_rank long, shard int, first_slot long, taken long")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("draw", "doc_id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("rank", rank)
    # At most one run per cell and one more per shard and round: a bounded table.
    placed = ranked.join(F.broadcast(runs), "cell").where("rank >= first_rank AND rank < first_rank + taken")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr("first_slot + rank - first_rank").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
