"""Text quality by logistic regression over hashed word n-grams, trained with FTRL-proximal.

A text is a sequence of words and runs of signs.  Its features are its single tokens, its
pairs of tokens and its triples of token shapes (case, digits, signs as they are, and
whether a token repeats the one before), each hashed to one of `SLOTS` weights and
weighted by its share of the text.  A score is the logistic function of the sparse dot
product of features and weights.

Training uses at most `SAMPLE_BUCKETS * SAMPLE_PER_BUCKET` labelled rows that are not held
out, those with the smallest id hashes.  They are dealt to `SHARDS` learners, which go
over their rows `PASSES` times in id order and whose weights are averaged; one vector of
`SLOTS` weights per learner reaches the driver.

NULL and empty texts have no features and get the logistic of the bias.  Without labels
all weights are 0 and every score is 0.5.  Rows without a label or id train nothing; a
row with two labels counts twice.  Repeated rows are scored one by one.  Only the named
columns are read, so others cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqstates.llm.common import crc_fold, mix64

SLOTS = 1 << 18
SAMPLE_BUCKETS, SAMPLE_PER_BUCKET = 64, 192
SHARDS, PASSES = 8, 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
SCALE = 30.0
CACHE_TOKENS = 300_000
BLOCK = 200_000  # tokens weighted at once
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_BIAS = 0


def shape(token: str) -> str:
    if token[0].isalpha():
        return "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a"
    return "9" if token[0].isdigit() else token[:4]


class Features:
    """Hashed features of texts; token hashes are kept in a bounded cache."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def token(self, token: str) -> tuple[int, int]:
        if len(self.known) >= CACHE_TOKENS:
            self.known.clear()
        found = self.known[token] = zlib.crc32(token.encode("utf-8", "replace")), zlib.crc32(shape(token).encode("utf-8", "replace"), 7)
        return found

    def slots(self, text: str | None) -> Iterator[np.ndarray]:
        """Slots of all n-grams of a text, a bounded number of tokens at a time."""
        tokens = _TOKEN.findall(text or "")
        for begin in range(0, len(tokens), BLOCK):
            lead = min(begin, 3)
            part = tokens[begin - lead : begin + BLOCK]
            known = self.known.get
            pairs = np.array([known(t) or self.token(t) for t in part], np.uint64)
            own, form = pairs[:, 0], pairs[:, 1].copy()
            form[1:] += (own[1:] == own[:-1]).astype(np.uint64) << np.uint64(33)
            grams = [own[lead:]]
            if len(own) > 1:
                grams.append((mix64(own[:-1] + np.uint64(1 << 40)) + own[1:])[max(0, lead - 1) :])
            if len(own) > 2:
                grams.append((mix64(mix64(form[:-2] + np.uint64(1 << 41)) + form[1:-1]) + form[2:])[max(0, lead - 2) :])
            yield (mix64(np.concatenate(grams)) % np.uint64(SLOTS - 1)).astype(np.int64) + 1

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct slots of a text and their values, the bias first."""
        found = list(self.slots(text))
        if not found:
            return np.array([_BIAS]), np.array([1.0])
        slots, counts = np.unique(np.concatenate(found), return_counts=True)
        return np.concatenate([[_BIAS], slots]), np.concatenate([[1.0], SCALE * counts / counts.sum()])

    def dot(self, text: str | None, weights: np.ndarray) -> float:
        total, count = 0.0, 0
        for slots in self.slots(text):
            total += float(weights[slots].sum())
            count += len(slots)
        return float(weights[_BIAS]) + (SCALE * total / count if count else 0.0)


class Learner:
    """Follow the regularised leader, one step size per weight."""

    def __init__(self):
        self.z, self.n = np.zeros(SLOTS), np.zeros(SLOTS)

    def weights(self, slots: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        shrunk = z - np.clip(z, -L1, L1)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def step(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        gradient = (logistic(float(w @ values)) - label) * values
        self.z[slots] += gradient - (np.sqrt(self.n[slots] + gradient**2) - np.sqrt(self.n[slots])) / ALPHA * w
        self.n[slots] += gradient**2


def logistic(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -40, 40))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights learned from the labelled rows that are not held out."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    marked = marked.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 1))
    marked = marked.withColumn("draw", F.xxhash64("doc_id")).withColumn("bucket", F.expr(f"pmod(draw, {SAMPLE_BUCKETS})"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("draw", "doc_id", "label"))
    chosen = marked.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_PER_BUCKET).select("doc_id", "label", "bucket")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select(F.expr(f"bucket % {SHARDS}").alias("shard"), "doc_id", "label", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, held = Features(), []
        for batch in batches:
            for doc_id, label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                held.append((doc_id, label, *features.vector(text.as_py())))
        if held:
            held.sort(key=lambda row: (zlib.crc32(str(row[0]).encode(), 99), row[0], row[1]))
            learner = Learner()
            for _ in range(PASSES):
                for _, label, slots, values in held:
                    learner.step(slots, values, label)
            weights = learner.weights()
            used = np.flatnonzero(weights)
            yield pa.RecordBatch.from_pydict(
                {
                    "rows": pa.array([len(held)], pa.int64()),
                    "slots": pa.array([used.tolist()], pa.list_(pa.int32())),
                    "weights": pa.array([weights[used].tolist()], pa.list_(pa.float64())),
                }
            )

    learned = rows.repartition(SHARDS, "shard").mapInArrow(learn, "rows long, slots array<int>, weights array<double>")
    total, seen = np.zeros(SLOTS), 0
    for count, slots, weights in sorted(tuple(r) for r in learned.collect()):
        total[slots] += count * np.array(weights)
        seen += count
    return total / max(seen, 1)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    weights = weights.astype(np.float32)

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            scores = np.array([logistic(features.dot(text.as_py(), weights)) for text in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (crc_fold(F.col(id_col)) == 1).alias("held_out")
    )
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows and score every row."""
    return score(docs, fit(docs, labels))
