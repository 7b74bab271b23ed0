"""Lempel-Ziv phrase fingerprints: documents that compress alike get alike signatures.

A text's bytes are parsed into dictionary phrases: a phrase is the shortest piece, from
where the last one ended, that is not in the dictionary yet, and then joins it.  The
fingerprint holds the `WIDTH` smallest hashes of the phrases, and the likeness of two
fingerprints estimates the Jaccard similarity of their phrase sets from the smallest
hashes of their union.

`edited_pairs` compares every document with an edited copy of itself, whose last quarter
is taken from the next document in id order, and with that next document.  The documents
are cut into ranges of ids at quantiles, and every range also gets the first document of
the next one, so that a partition sees all its neighbours in one pass over its rows in
order, holding two texts at a time.  The parse of a text goes on from the three quarters
that it shares with its edited copy.

NULL texts count as empty; two empty texts have likeness 1, an empty and another one 0.
Rows that share an id are ordered by their text; NULL ids come first.  The row after the
last is the first one, also of a table of one row.  Only id and text are read, so other
columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 128
RANGES_PER_PARTITION = 4


class Parser:
    """Incremental parse; the phrases may be copied and the parse be continued twice."""

    def __init__(self, phrases: set[bytes] | None = None, rest: bytes = b""):
        self.phrases, self.rest = set() if phrases is None else phrases, rest

    def feed(self, data: bytes) -> None:
        data, known, start = self.rest + data, self.phrases, 0
        for end in range(len(self.rest) + 1, len(data) + 1):
            phrase = data[start:end]
            if phrase not in known:
                known.add(phrase)
                start = end
        self.rest = data[start:]

    def fork(self) -> Parser:
        return Parser(set(self.phrases), self.rest)

    def signature(self) -> np.ndarray:
        """The smallest hashes in ascending order; an unfinished phrase is one already."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.phrases), np.uint64, len(self.phrases))
        if len(hashes) > WIDTH:
            hashes = np.partition(hashes, WIDTH - 1)[:WIDTH]
        return np.unique(hashes)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of common hashes among the smallest ones of the union."""
    if not len(x) and not len(y):
        return 1.0
    smallest = np.union1d(x, y)[:WIDTH]
    return float(np.isin(smallest, x).astype(int) @ np.isin(smallest, y).astype(int)) / len(smallest)


def shown(signature: np.ndarray) -> str:
    """A fingerprint as text: upper halves of its hashes in hexadecimal."""
    return (signature >> np.uint64(32)).astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> np.ndarray:
    parser = Parser()
    parser.feed((text or "").encode("utf-8", "replace"))
    return parser.signature()


def edited(text: str, following: str) -> tuple[str, str]:
    """What stays of a text, and what replaces its last quarter."""
    cut = len(text) // 4
    return text[: len(text) - cut], following[:cut]


def _place(bounds: list[int]) -> Column:
    """Number of bounds up to the id, by a search in blocks and then in one block; 0 for NULL."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda values: "array(" + ", ".join(f"{v}L" for v in values) + ")"
    block = f"size(filter({longs(b[0] for b in blocks)}, b -> b <= doc_id))"
    inside = f"size(filter(array({', '.join(map(longs, blocks))})[block - 1], b -> b <= doc_id))"
    search = inside.replace("block", block)
    return F.expr(f"cast(CASE WHEN doc_id IS NULL OR doc_id < {bounds[0]}L THEN 0 ELSE ({block} - 1) * {step} + {search} END AS int)")


def _ranges(docs: DataFrame) -> DataFrame:
    """Rows (part, doc_id, text, own); `own` is false for the copy of the next range's first row."""
    spark = docs.sparkSession
    count = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select("doc_id")
    bounds = keys.approxQuantile("doc_id", [i / count for i in range(1, count)], 1 / (8 * count))
    bounds = sorted(set(int(b) for b in bounds))
    rows = docs.withColumn("part", _place(bounds))
    # One row per range; NULL ids are of the first one and come before all others.
    firsts = rows.groupBy("part").agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    firsts = sorted((r.part, None if r.nulls else r.first) for r in firsts.collect())
    heads = [(before[0], first[1]) for before, first in zip(firsts, firsts[1:] + firsts[:1])]
    heads = spark.createDataFrame(heads, "part int, doc_id long")
    copies = docs.join(F.broadcast(heads), docs.doc_id.eqNullSafe(heads.doc_id)).select("part", docs.doc_id, "text")
    copies = copies.groupBy("part", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # the first of rows that share the id
    return rows.select("part", "doc_id", "text", F.lit(True).alias("own")).union(copies.select("part", "doc_id", "text", F.lit(False)))


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every row and of its edited copy, and their likenesses."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before, waiting for its neighbour
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                part, doc_id, text, own = (batch.column(c)[i].as_py() for c in range(4))
                kept, _ = edited(text, "")
                parser = Parser()
                parser.feed(kept.encode("utf-8", "replace"))
                begun = parser.fork() if own else None
                parser.feed(text[len(kept) :].encode("utf-8", "replace"))
                signature = parser.signature()
                if held is not None and held[0] == part:
                    out.append(_compare(held[1:], text, signature))
                held = (part, doc_id, text, kept, begun, signature) if own else None
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] if out else [[]] * 7, schema=schema)

    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )
    rows = _ranges(docs)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(partitions, "part").sortWithinPartitions("part", F.col("own").desc(), F.col("doc_id").asc_nulls_first(), "text")
    return rows.mapInArrow(compared, _RESULT)


def _compare(row: tuple, following: str, next_signature: np.ndarray) -> tuple:
    doc_id, text, kept, begun, signature = row
    tail = following[: len(text) - len(kept)]
    begun.feed(tail.encode("utf-8", "replace"))
    changed = begun.signature()
    digest = hashlib.sha256((kept + tail).encode("utf-8", "replace")).hexdigest()
    return doc_id, len(text), digest, shown(signature), shown(changed), likeness(signature, changed), likeness(signature, next_signature)
