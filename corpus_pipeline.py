"""Corpus preparation in stages: every stage takes all that the one before kept.

All stages but the last return the columns of `documents`.  NULL and empty texts have no
letters and go in the first stage; the operators' docstrings say what holds for other odd
rows.  Stages decide per id and text, so a NULL or repeated id takes no other row along;
rows with equal id and text are one document and go or stay together.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqstates.llm import bpe, langid, lines, minhash, templates
from seqstates.llm.common import materialize, release, table, without

LEAST_SCORE = 0.5  # of the predicted language
CACHE_CHUNKS = 200_000  # of the encoder, whose workers run beside executors that earlier stages have filled


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with `_hash` of the text and `_row`: the id if it stands for one text, else a hash of both."""
    docs = docs.withColumn("_hash", F.xxhash64("text"))
    several = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("_hash").alias("lo"), F.max("_hash").alias("hi"))
    several = materialize(several.where("lo != hi").select(F.col("doc_id").alias("_several")), "several")
    docs = docs.join(several, F.col("doc_id") == F.col("_several"), "left")
    row = F.when(F.col("doc_id").isNull() | F.col("_several").isNotNull(), F.xxhash64(F.lit("row"), "doc_id", "_hash"))
    return docs.withColumn("_row", row.otherwise(F.col("doc_id").cast("long"))).drop("_several")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is not settled, go."""
    rows = keyed(docs)
    named = langid.identify(rows, id_col="_row")
    # All rows have a prediction, equal ones the same; those that go are the fewer to join with.
    settled = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    gone = materialize(named.where(~F.coalesce(settled, F.lit(False))).select(F.col("doc_id").alias("_row")).distinct(), "gone")
    return without(rows, gone, "_row").where(F.col("text").rlike(r"\p{L}")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which no line stays goes with them."""
    cut = lines.dedupe_lines(docs).where("n_kept > 0 OR n_lines = 0")
    changed = F.col("n_kept") < F.col("n_lines")
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group stays, by id and text hash; NULL ids come last."""
    rows = keyed(docs)
    near = minhash.near_duplicates(rows, id_col="_row")
    near = materialize(near.select(F.col("doc_id").alias("_row"), "component_id", "kept"), "near")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_hash", "_row")
    first = near.join(rows.select("_row", "doc_id", "_hash"), "_row").groupBy("component_id").agg(F.min(place).alias("first"))
    # Hashes as ids have no order: where they hide the first document, it changes places with the one kept.
    moved = materialize(first.select("component_id", F.col("first._row").alias("_row")).where("_row != component_id"), "moved")
    dropped = near.where("NOT kept").join(moved.select("_row"), "_row", "left_anti").select("_row")
    dropped = dropped.union(moved.select("component_id")).distinct()
    dropped = materialize(dropped, "dropped")
    release(near, moved)
    return without(rows, dropped, "_row").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return templates.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.encoded_digests(docs, cache_chunks=CACHE_CHUNKS)


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]
ORACLE_SQL = None  # SQL cannot express the language model or the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
