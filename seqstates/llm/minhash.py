"""Near-duplicate documents by SuperMinHash, banding, verification and connected components.

1. Every text becomes its set of hashed word shingles, a SuperMinHash signature of
   `BANDS * ROWS` slots and one key per band (`document_sets`).  Documents with equal
   sets form a class; only its smallest id goes on.
2. Classes with an equal band key are candidates.  At a similarity of 0.75 a pair
   shares none of the 64 bands of 5 slots with a probability of 3e-8.
3. First each class is checked against one other: every bucket names the member that
   meets the most others over all its buckets, which is the original in a group of its
   copies, and a class takes the one that most of its buckets name.  That settles groups
   of copies with one check per copy.  Documents of buckets that still hold different
   components go on to an exact filter (`prefix_pairs`): two of them meet only if they
   share an element among the rarest of both, early enough for a link.  So texts with
   one passage in common, or somewhat unlike copies of one text, do not meet in pairs.
4. Links are confirmed on the full shingle sets of both texts, and `connected_components`
   turns them into groups.

Rows with NULL or blank text have an empty set and are linked with nothing, not even
with each other.  Repeated rows are copies of each other; rows that share an id are one
node only if their texts share a set.  Only the id and text columns are read, so other
columns cannot clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqstates.llm.common import connected_components, materialize, mix64, release, sieve

WORDS = 5
THRESHOLD = 75  # per cent
ROWS, BANDS = 5, 64
CHUNK = 60_000  # shingles whose permutations are held at once
_NONE = np.uint64(2**64 - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    bytes.lower and bytes.split treat exactly A-Z and the six ASCII blanks.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    count = len(tokens) - width + 1
    mixed = np.full(count, np.uint64(width), np.uint64)
    for i in range(width):
        mixed = mix64(mixed * _STEP + hashes[i : i + count])
    return np.unique(mixed)


def superminhash(elements: np.ndarray, owner: np.ndarray, sets: int, slots: int) -> np.ndarray:
    """Signatures (sets x slots) of the sets that `owner` assigns the elements to.

    Every element has a random permutation of the slots; in step j it offers the value
    j + u, u random in [0, 1), to the slot at place j.  The permutation is shuffled one
    place per step for all elements together, and a set leaves as soon as no later step
    can lower any of its slots.  A value is held as j in the upper and u in the lower
    half of a word.
    """
    signature = np.full(sets * slots, _NONE, np.uint64)
    order, first = None, None
    for j in range(slots):
        drawn = mix64(elements + np.uint64((j + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        place = (((drawn >> _HALF) * np.uint64(slots - j)) >> _HALF).astype(np.int64) + j
        if j == 0:
            slot = first = place
        else:
            rows = np.arange(len(elements))
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
                order[rows, first] = 0
                order[:, 0] = first
            slot = order[rows, place].astype(np.int64)
            order[rows, place] = order[:, j]
            order[:, j] = slot
        np.minimum.at(signature, owner * slots + slot, (np.uint64(j) << _HALF) | (drawn & _LOW))
        open_sets = signature.reshape(sets, slots).max(axis=1) >> _HALF > np.uint64(j)
        stay = open_sets[owner]
        if not stay.any():
            break
        if not stay.all():
            elements, owner, first = elements[stay], owner[stay], first[stay]
            order = None if order is None else order[stay]
    return signature.reshape(sets, slots)


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of `rows` slots."""
    sets, slots = signatures.shape
    keys = np.tile(np.arange(1, slots // rows + 1, dtype=np.uint64), (sets, 1))
    for i in range(rows):
        keys = mix64(keys * _STEP + signatures[:, i::rows][:, : slots // rows])
    return keys.view(np.int64)


_SETS = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"


def document_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Set size, 128-bit set hash and band keys of every row."""

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                held.append(shingles(text.as_py()))
                size += len(held[-1])
                if size >= CHUNK:
                    yield _sets_batch(ids, held)
                    ids, held, size = [], [], 0
            if ids:
                yield _sets_batch(ids, held)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        batches, _SETS
    )


def _sets_batch(ids: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([len(x) for x in held])
    elements = np.concatenate(held)
    owner = np.repeat(np.arange(len(held)), sizes)
    sums = np.zeros((2, len(held)), np.uint64)
    np.add.at(sums[0], owner, mix64(elements + _STEP))
    np.add.at(sums[1], owner, mix64(elements ^ _STEP))
    keys = np.empty((len(held), BANDS), np.int64)
    begin = 0
    while begin < len(held):  # a longer set than CHUNK stands alone, in slices
        end = begin + 1
        total = int(sizes[begin])
        while end < len(held) and total + sizes[end] <= CHUNK:
            total += int(sizes[end])
            end += 1
        keys[begin:end] = band_keys(_signatures(held[begin:end]))
        begin = end
    bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
    columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), bands]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "h1", "h2", "bands"])


def _signatures(held: list[np.ndarray]) -> np.ndarray:
    """Of several small sets, or of one, whose slices are combined by their minima."""
    slots = ROWS * BANDS
    if len(held) > 1 or len(held[0]) <= CHUNK:
        elements = np.concatenate(held)
        owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
        return superminhash(elements, owner, len(held), slots)
    whole = held[0]
    parts = [whole[i : i + CHUNK] for i in range(0, len(whole), CHUNK)]
    return np.minimum.reduce([superminhash(x, np.zeros(len(x), np.int64), 1, slots) for x in parts])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the threshold; `texts` holds (doc_id, text)."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = shingles(left.as_py()), shingles(right.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= THRESHOLD * (len(x) + len(y) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(linked, "a long, b long")


def set_elements(texts: DataFrame) -> DataFrame:
    """(doc_id, sum, n, element) of every element of the sets of (doc_id, text); `sum` tells sets of one id apart."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = shingles(text.as_py())
                for i in range(0, len(held), CHUNK):
                    part = held[i : i + CHUNK]
                    constants = (doc_id, int(mix64(held).sum().view(np.int64)), len(held))
                    columns = [pa.array(np.full(len(part), c, np.int64)) for c in constants]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(part.view(np.int64))], names=["doc_id", "sum", "n", "element"])

    return texts.mapInArrow(flat, "doc_id long, sum long, n long, element long")


def prefix_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of `nodes` (doc_id, component) in different components that can be linked.

    The elements of a set are ordered by how many of these sets hold them, the rarest first.
    If the first element that two sets share has the places i and j, they share at most
    min(n - i, m - j) elements.  So linked sets meet on an element that lies early enough in
    both, and sets that share only what many others hold, too, do not meet.
    """
    held = texts.join(nodes.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    held = materialize(set_elements(held), "elements")
    shared = held.groupBy("element").agg(F.count("*").alias("df")).where("df > 1")
    shared = materialize(shared, "shared")
    common = held.join(shared, "element")
    of_set = Window.partitionBy("doc_id", "sum")
    place = F.col("n") - F.count("*").over(of_set) + F.row_number().over(of_set.orderBy("df", "element")) - 1
    early = common.withColumn("i", place).where(f"100 * (n - i) >= {THRESHOLD} * n")
    first = materialize(early.select("doc_id", "n", "i", "element").join(nodes, "doc_id"), "early")
    release(held, shared)
    # The documents of an element's largest component need not meet each other.
    sides = first.groupBy("element", "component").agg(F.count("*").alias("c")).groupBy("element")
    sides = sides.agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("sides")).where("sides > 1")
    sides = materialize(sides.select("element", F.col("top.component").alias("top")), "sides")
    early = materialize(first.join(sides, "element"), "early")
    release(first, sides)
    x, y = early.where("component != top").alias("x"), early.alias("y")
    reach = f"least(x.n - x.i, y.n - y.i) * {100 + THRESHOLD} >= {THRESHOLD} * (x.n + y.n)"
    once = "x.component != y.component AND (y.component = y.top OR x.component < y.component)"
    pairs = x.join(y, (F.col("x.element") == F.col("y.element")) & F.expr(once) & F.expr(reach))
    pairs = materialize(pairs.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct(), "pairs")
    release(early)
    return pairs


def _sizes_allow(small: str, large: str) -> str:
    return f"100 * least({small}, {large}) >= {THRESHOLD} * greatest({small}, {large})"


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """Keys of the rows that occur in more than one component."""
    mixed = rows.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    return materialize(mixed.select(key), "mixed")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Bands and texts without a partner are left out by `sieve` before they are shuffled, and
    written tables go after their last use: of the bands no copy stays.
    """
    sets = materialize(document_sets(docs, id_col, text_col), "sets")
    classes = sets.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = sets.join(classes.select(F.col("rep").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"], "left_semi")
    reps = materialize(reps.select("doc_id", "n_shingles", "bands"), "reps")
    sizes = materialize(sets.drop("bands"), "sizes")
    release(sets)
    keys = reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("c"))
    buckets = materialize(buckets.where("lo != hi").select("key", "c"), "buckets")
    found = materialize(sieve(keys, buckets, "key").join(buckets, "key"), "met")
    release(reps, buckets)
    met = found.groupBy("doc_id").agg(F.sum("c").alias("met"))
    centers = found.join(met, "doc_id").groupBy("key").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("id"), "n")).alias("best"))
    centers = materialize(centers.select("key", (-F.col("best.id")).alias("center"), F.col("best.n").alias("center_n")), "centers")
    members = materialize(found.drop("c").join(centers, "key"), "members")
    release(found, centers)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = sieve(texts, members, "xxhash64(doc_id)").join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = materialize(texts, "texts")
    shared = members.where("doc_id != center").where(_sizes_allow("n", "center_n"))
    shared = shared.groupBy("doc_id", "center").agg(F.count("*").alias("bands"))
    best = shared.groupBy("doc_id").agg(F.max(F.struct("bands", (-F.col("center")).alias("c"))).alias("best"))
    nearest = best.select(F.col("doc_id").alias("a"), (-F.col("best.c")).alias("b"))
    confirmed = materialize(confirm(nearest, texts), "confirmed")
    groups = materialize(connected_components(confirmed), "groups")

    grouped = members.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    grouped = grouped.select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    grouped = materialize(grouped, "grouped")
    release(members, groups)
    mixed = _mixed(grouped, "key")
    open_docs = materialize(grouped.join(mixed, "key").select("doc_id", "component").distinct(), "open")
    release(grouped, mixed)
    open_pairs = prefix_pairs(open_docs, texts)
    groups = connected_components(confirmed.union(confirm(open_pairs, texts)))
    release(open_docs, open_pairs, texts, confirmed)

    named = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    rows = sizes.join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.expr("doc_id <=> component_id"))


ORACLE = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM tokens),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS nx, y.n AS ny, count(*) AS c
  FROM elements x JOIN elements y ON x.e = y.e AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (nx + ny - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.seen) AS component_id, s.doc_id = min(r.seen) AS kept
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
