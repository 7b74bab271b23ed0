"""Helpers shared by the text operators."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqstates.sources.scratch import materialize, release, shared_folder, sized_join

__all__ = ["crc_fold", "is_held_out", "connected_components", "materialize", "mix64", "ranked", "release", "shared_folder", "sieve", "sized_join", "table", "without"]

SIEVE_WORDS = 1 << 18  # of 64 bits each, 4 MB when broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over a 64-bit word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows with 1 are held out of training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3 == 1


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`rows` with `rank`, from 0, and `total`, the number of rows, within every group.

    The rows are range-partitioned on all columns named, so a group of any size, and any
    number of rows that tie, are spread over tasks; tied rows get any order.  The layout is
    written, as counts and rows have to see the same one.  Group columns must not be NULL.
    """
    keys = [*group, *order, "_tie"]
    laid = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = materialize(laid.drop("_tie").withColumn("_pos", F.monotonically_increasing_id()), "laid")
    laid = laid.withColumn("_part", F.shiftright("_pos", 33))
    runs = laid.groupBy(*group, "_part").agg(F.count("*").alias("c"), F.min("_pos").alias("first"))
    whole = Window.partitionBy(*group)  # a row per partition of the layout
    runs = runs.select(
        *group, "_part", (F.sum("c").over(whole.orderBy("_part")) - F.col("c") - F.col("first")).alias("_shift"), F.sum("c").over(whole).alias("total")
    )
    return sized_join(laid, runs, [*group, "_part"]).withColumn("rank", F.col("_pos") + F.col("_shift")).drop("_pos", "_part", "_shift")


def sieve(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose `key` sets a bit that one of the written table `wanted` sets; few others pass.

    `key` is SQL for a 64-bit hash, of columns that both have.  A join that follows then
    moves few rows without a partner, however large the rows are; NULL keys do not pass.
    """
    return _with_bits(rows, wanted, key, "inner").where(f"getbit(_bits, cast({key} & 63 AS int)) = 1").drop("_slot", "_bits")


def _with_bits(rows: DataFrame, wanted: DataFrame, key: str, how: str) -> DataFrame:
    slot = F.expr(f"pmod(shiftrightunsigned({key}, 6), {SIEVE_WORDS})")
    bits = wanted.groupBy(slot.alias("_slot")).agg(F.expr(f"bit_or(shiftleft(1L, cast({key} & 63 AS int)))").alias("_bits"))
    return rows.join(F.broadcast(bits), slot == F.col("_slot"), how)


def without(rows: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """The rows whose `on` is not in the written table `gone`; those that meet none of its bits stay without a shuffle."""
    key = f"xxhash64({on})"
    clear = _with_bits(rows, gone, key, "left").where(f"coalesce(getbit(_bits, cast({key} & 63 AS int)), 0) = 0")
    return clear.drop("_slot", "_bits").unionByName(sieve(rows, gone, key).join(gone, on, "left_anti"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node reachable, for every node that has a link.

    Alternates two star steps until nothing changes.  The first hangs the larger
    neighbours of a node on its smallest neighbour, the second does the same with its
    smaller ones; the number of rounds grows with the logarithm of the longest path.
    Smallest neighbours are combined on the map side and written, so that the join
    with a node of very many links can be split.  Every round is a written table, and
    only the last one stays.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "stars")

    def fingerprint(table: DataFrame):
        return table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    current = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = materialize(current.where("u != v").distinct(), "links")
    before = fingerprint(current)
    while before[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars = smallest(both)
        hung = both.join(stars, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = materialize(hung.distinct(), "hung")
        release(current, stars)
        stars = smallest(hung)
        starred = hung.join(stars, "u").selectExpr("inline(array(struct(u, m AS v), struct(v AS u, m AS v)))")
        current = materialize(starred.where("u != v").distinct(), "links")
        release(hung, stars)
        after = fingerprint(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
