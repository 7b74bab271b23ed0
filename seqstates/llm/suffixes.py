"""Repeated byte strings across a corpus, from suffix arrays by linear grouping.

A byte goes if a string of `LENGTH` bytes covers it that starts anywhere else, too.

1. Texts are cut into pieces.  Every string of `LENGTH` bytes has an anchor, its `GRAM` bytes
   of the smallest hash; neighbouring strings with one anchor form a piece.  Equal strings
   have equal anchors at the same place, so they can only meet in the bucket of that anchor,
   and buckets are independent.  Anchors that occur once are left out by a join.
2. The pieces of the other anchors are fetched from their texts.  Equal pieces of a bucket
   are combined before the shuffle and counted; a piece with a count repeats as a whole.
3. A task sorts the suffixes of its buckets (`suffix_order`).  Strings that repeat are
   neighbours in that order, and are compared byte by byte.  A bucket of over `HOT_BYTES`
   distinct bytes goes another exact way: its strings are counted by their 128-bit hashes,
   in as many tasks as there are.
4. Pieces tell their texts which of their strings repeat; the bytes covered are cut out.

Only one row per text takes part; if a text of `LENGTH` bytes or more has several rows, all
of it goes in each of them.  NULL counts as an empty text.  Results depend on the text
alone, so NULL and repeated ids are as good as others.  Only the id and text columns are
read, so others cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqstates.llm.common import materialize, sized_join

LENGTH = 200
GRAM = 64
HOT_BYTES = 2 << 20
SEGMENT = 1 << 19  # strings of a long text whose hashes are held at once
BLOCK_BYTES = 1 << 20  # text whose suffixes are sorted at once
HELD_BYTES = 16 << 20  # text from which buckets of a like size are put into one block
_PLACE = np.uint64((1 << 24) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for `size[0]` numbers, then the same from first[1], and so on."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


def suffix_order(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Suffix arrays of many texts laid end to end; `bounds` are their starts and the end.

    A symbol of 0 separates; every text begins and ends with one, and a suffix counts up to
    its next separator.  In a first pass the groups of each text, suffixes with one known
    prefix, are taken in descending order.  A group is then complete: its prefix is the
    Lyndon prefix of its suffixes.  A suffix leaves a list of those that are still open; its
    neighbour to the left there is its previous smaller suffix, whose prefix it prolongs.
    Of a group only the suffixes whose prefix was prolonged move up, those by a longer run of
    copies higher.  A second pass goes up through the groups and orders each by what follows
    the run: a smaller suffix, which has its place already.  No renaming, no recursion; all
    texts take a step at a time, so that array operations do the work.
    """
    n, texts = len(symbols), len(bounds) - 1
    text = np.repeat(np.arange(texts, dtype=np.int32), np.diff(bounds))
    keys = text.astype(np.int64) * 257 + symbols
    order = np.argsort(keys, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    keys = keys[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[begin, n])
    group = np.empty(n, np.int64)  # by suffix: first place of its group
    group[order] = np.repeat(begin, size)
    end = np.zeros(n + 1, np.int64)  # by first place of a group
    end[begin] = begin + size
    del keys
    left, right = np.arange(-1, n - 1), np.arange(1, n + 1)
    after, copies = np.zeros(n, np.int32), np.zeros(n, np.int32)
    moved = np.full(n, -1, np.int32)
    floor = bounds[:-1] + np.bincount(text[symbols == 0], minlength=texts)
    top = bounds[1:].copy()
    open_texts, step = np.flatnonzero(top > floor), 0
    while len(open_texts):
        stop = top[open_texts]
        start = group[order[stop - 1]]
        top[open_texts] = start
        members = np.sort(order[_ragged(start, stop - start)])
        # Open neighbours of one group are a run of copies of its prefix.
        head = np.flatnonzero(np.r_[True, left[members[1:]] != members[:-1]])
        run = np.diff(np.r_[head, len(members)])
        smaller, following = left[members[head]], right[members[head + run - 1]]
        right[smaller], left[following] = following, smaller
        after[members] = np.repeat(following, run)
        copies[members] = np.repeat(head + run, run) - np.arange(len(members))
        real = symbols[smaller] != 0
        parent, run = smaller[real], run[real]
        if len(parent):
            was = group[parent]
            by = np.argsort(was * (n + 1) + run)
            parent, was, run = parent[by], was[by], run[by]
            fresh = np.r_[True, was[1:] != was[:-1]]
            first = np.flatnonzero(fresh)
            count = np.diff(np.r_[first, len(parent)])
            tail = end[was[first]] - count
            target = np.repeat(tail - first, count) + np.arange(len(parent))
            source = place[parent]
            moved[parent] = step
            there = order[target]
            there = there[moved[there] != step]
            vacant = source[source < np.repeat(tail, count)]
            order[vacant], place[there] = there, vacant
            order[target], place[parent] = parent, target
            part = np.flatnonzero(fresh | np.r_[True, run[1:] != run[:-1]])
            length = np.diff(np.r_[part, len(parent)])
            end[was[first]] = tail
            end[target[part]] = target[part] + length
            group[parent] = np.repeat(target[part], length)
        open_texts = open_texts[start > floor[open_texts]]
        step += 1

    begin = np.unique(group[symbols != 0])
    size = end[begin] - begin
    begin, size = begin[size > 1], size[size > 1]
    of = text[order[begin]]
    turn = np.arange(len(of)) - np.searchsorted(of, of)  # of the group in its text
    by = np.argsort(turn, kind="stable")
    begin, size = begin[by], size[by]
    cut = np.r_[np.flatnonzero(np.r_[True, np.diff(turn[by]) > 0]), len(by)] if len(by) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        places = _ragged(begin[a:b], size[a:b])
        members = order[places]
        by = np.lexsort((copies[members].astype(np.int64) * n + place[after[members]], np.repeat(np.arange(b - a), size[a:b])))
        order[places], place[members[by]] = members[by], places
    return order


def repeated(pieces: list[bytes], counts: list[int], bounds: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For every piece the spans of its strings that repeat in its bucket; `bounds` cut the list into buckets."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    first_of_bucket = np.zeros(len(pieces), bool)
    first_of_bucket[bounds[:-1]] = True
    begin = np.cumsum(sizes + 1 + first_of_bucket) - sizes - 1  # of the pieces, behind their bucket's separators
    raw = np.zeros(int(begin[-1] + sizes[-1] + 1), np.int64)
    everywhere = _ragged(begin, sizes)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    raw[everywhere] = data.astype(np.int64) + 1
    ends = begin + sizes + 1
    order = suffix_order(raw, np.r_[0, ends[np.asarray(bounds[1:]) - 1]])

    strings = np.maximum(sizes - length + 1, 0)
    valid = np.zeros(len(raw), bool)
    valid[_ragged(begin, strings)] = True
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[everywhere] = data
    words = np.ndarray((len(raw),), "<u8", padded.data, strides=(1,))
    bucket = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(np.r_[0, ends[np.asarray(bounds[1:]) - 1]]))
    pair = np.flatnonzero(valid[order[1:]] & valid[order[:-1]] & (bucket[order[1:]] == bucket[order[:-1]]))
    for offset in (length - 8, *range(0, length - 8, 8)):
        pair = pair[words[order[pair] + offset] == words[order[pair + 1] + offset]]
    again = np.zeros(len(raw), bool)
    again[order[pair]] = again[order[pair + 1]] = True
    again[_ragged(begin[np.asarray(counts) > 1], strings[np.asarray(counts) > 1])] = True
    edges = np.diff(np.r_[0, again.astype(np.int8), 0])
    opens, closes = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    owner = np.searchsorted(begin, opens, side="right") - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in pieces]
    for o, a, b in zip(owner.tolist(), (opens - begin[owner]).tolist(), (closes - begin[owner]).tolist()):
        spans[o].append((a, b))
    return spans


def _gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    h, width = (data.astype(np.uint64) + np.uint64(1)) * _STEP, 1
    while width < gram:
        h = (h[:-width] * np.uint64(3) + h[width:]) * _MIX
        h ^= h >> np.uint64(31)
        width *= 2
    return h


def anchors(data: bytes, length: int = LENGTH, begin: int = 0, stop: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first string, end) of the runs of strings with one anchor, among those that start in [begin, stop).

    A long range is hashed in segments, whose ends also end a run.
    """
    stop = len(data) - length + 1 if stop is None else stop
    for at in range(begin, stop, SEGMENT):
        count = min(SEGMENT, stop - at)
        hashes = _gram_hashes(np.frombuffer(data, np.uint8, count + length - 1, at))
        low = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        width, wanted = 1, length - GRAM + 1
        while width * 2 <= wanted:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:count], low[wanted - width : wanted - width + count])
        anchor = (low & _PLACE).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        yield hashes[anchor[cut]].view(np.int64), cut + at, np.r_[cut[1:], count] + at


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _halves(data: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data)
    return (h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


_TEXT = ["k1", "k2"]
_PIECE = ["anchor", "c1", "c2"]
_SPANS = "array<struct<a: int, b: int>>"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text as bytes, k1, k2); both keys are hashes of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    return rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), "text")})


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, types[f.split()[1]]) for c, f in zip(columns, schema.split(", "))], names=names)


def _union(span: Column) -> Column:
    """Aggregate of the spans (a, b) of a text, with those that meet merged."""
    none = F.array().cast(_SPANS)
    last = lambda acc: F.element_at(acc, -1)

    def add(acc: Column, s: Column) -> Column:
        grown = F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], s["b"]).alias("b"))
        meets = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["b"] >= s["a"])
        return F.when(meets, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(F.collect_list(span)), none, add)


_SPOTS = "k1 long, k2 long, anchor long, a int, b int"
_CUT = "k1 long, k2 long, start int, anchor long, c1 long, c2 long, content binary"
_COUNTED = "w1 long, w2 long, anchor long, c1 long, c2 long, at int, c long"


def _spots(rows: DataFrame, length: int) -> DataFrame:
    """All pieces: text, anchor and range of strings."""

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = np.column_stack([batch.column(i).to_numpy() for i in (0, 1)]), batch.column(2)
            held, size = [], 0
            for i in range(batch.num_rows):
                for hashes, a, b in anchors(texts[i].as_py(), length):
                    held.append((np.full(len(a), i), hashes, a, b))
                    size += len(a)
                if held and (size >= 100_000 or i + 1 == batch.num_rows):
                    row, hashes, a, b = (np.concatenate(x) for x in zip(*held))
                    arrays = [*keys[row].T, hashes, a.astype(np.int32), b.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["k1", "k2", "anchor", "a", "b"])
                    held, size = [], 0

    return rows.select("k1", "k2", "text").mapInArrow(batches, _SPOTS)


def _contents(rows: DataFrame, length: int) -> DataFrame:
    """The pieces of the wanted ranges of strings, with their bytes."""

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_pylist() for i in (0, 1))
            out, size = [], 0
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py()
                for begin, stop in _merged((s["a"], s["b"]) for s in batch.column(3)[i].as_py()):
                    for hashes, starts, ends in anchors(data, length, begin, stop):
                        for h, a, b in zip(hashes.tolist(), starts.tolist(), ends.tolist()):
                            content = data[a : b + length - 1]
                            out.append((k1[i], k2[i], a, h, *_halves(content), content))
                            size += len(content)
                if size > 8 << 20 or i + 1 == batch.num_rows:
                    yield _rows(_CUT, out)
                    out, size = [], 0

    return rows.select("k1", "k2", "text", "wanted").mapInArrow(batches, _CUT)


def _sorted_spans(distinct: DataFrame, length: int) -> DataFrame:
    """(anchor, c1, c2, spans) of distinct pieces with repeated strings, bucket by bucket."""

    def solved(buckets: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        buckets.sort(key=lambda rows: sum(len(r[4]) for r in rows))
        block: list[tuple] = []
        bounds, size = [0], 0
        for i, rows in enumerate(buckets):
            block += rows
            bounds.append(len(block))
            size += sum(len(r[4]) for r in rows)
            if size >= BLOCK_BYTES or i + 1 == len(buckets):
                spans = repeated([r[4] for r in block], [r[3] for r in block], bounds, length)
                found = [(r, s) for r, s in zip(block, spans) if s]
                columns = [pa.array([r[c] for r, _ in found], pa.int64()) for c in range(3)]
                nested = pa.array([[{"a": a, "b": b} for a, b in s] for _, s in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*columns, nested], names=[*_PIECE, "spans"])
                block, bounds, size = [], [0], 0

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: list[list[tuple]] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if buckets and buckets[-1][0][0] == row[0]:
                    buckets[-1].append(row)
                else:
                    if size >= HELD_BYTES:
                        yield from solved(buckets)
                        buckets, size = [], 0
                    buckets.append([row])
                size += len(row[4])
        if buckets:
            yield from solved(buckets)

    rows = distinct.select(*_PIECE, "c", "content").repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(batches, f"anchor long, c1 long, c2 long, spans {_SPANS}")


def _counted_spans(distinct: DataFrame, length: int) -> DataFrame:
    """The same for buckets of any size, by counts of the hashes of all their strings."""

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, c1, c2, c, data in zip(*(x.to_pylist() for x in batch.columns)):
                out += [(*_halves(data[i : i + length]), anchor, c1, c2, i, c) for i in range(len(data) - length + 1)]
                if len(out) > 50_000:
                    yield _rows(_COUNTED, out)
                    out = []
            yield _rows(_COUNTED, out)

    strings = materialize(distinct.select(*_PIECE, "c", "content").mapInArrow(batches, _COUNTED), "strings")
    often = strings.groupBy("w1", "w2").agg(F.sum("c").alias("all")).where("all > 1").select("w1", "w2")
    spans = F.collect_list(F.expr("named_struct('a', at, 'b', at + 1)")).alias("spans")  # a piece has few strings
    return strings.join(often, ["w1", "w2"]).groupBy(*_PIECE).agg(spans)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(k1, k2, whole, spans) of the texts, by their hashes, that hold repeated strings.

    `spans` are ranges of places where such strings start; a text of several rows is `whole`.
    """
    rows = _keyed(docs, id_col, text_col).where(F.octet_length("text") >= length)
    same = F.struct(F.col("id").isNull(), F.col("id"))
    copies = rows.groupBy(*_TEXT).agg(F.count("*").alias("rows"), F.min(same).alias("first")).where("rows > 1")
    copies = materialize(copies, "copies")
    one = sized_join(rows, copies, _TEXT, how="left").where(F.col("rows").isNull() | (same == F.col("first")) | same.eqNullSafe(F.col("first")))
    one = one.select("text", *_TEXT)

    spots = materialize(_spots(one, length), "spots")
    # Written first, so that both sides of the join can be split where an anchor is frequent.
    shared = materialize(spots.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "shared")
    hits = spots.join(shared.hint("merge"), "anchor").groupBy(*_TEXT).agg(_union(F.struct("a", "b")).alias("wanted"))
    pieces = materialize(_contents(sized_join(one, hits, _TEXT), length), "pieces")

    distinct = pieces.groupBy(*_PIECE).agg(F.count("*").alias("c"), F.first("content").alias("content"))
    distinct = materialize(distinct, "distinct")
    hot = distinct.groupBy("anchor").agg(F.sum(F.octet_length("content")).alias("bytes")).where(F.col("bytes") > HOT_BYTES)
    hot = materialize(hot.select("anchor", F.lit(True).alias("hot")), "hot")
    marked = sized_join(distinct, hot, ["anchor"], how="left")
    found = _sorted_spans(marked.where("hot IS NULL"), length)
    if hot.count():
        found = found.unionByName(_counted_spans(marked.where("hot"), length))
    found = materialize(found, "repeated")

    starts = pieces.select(*_TEXT, "start", *_PIECE).join(found, _PIECE)
    starts = starts.select(*_TEXT, F.explode(F.expr("transform(spans, s -> named_struct('a', s.a + start, 'b', s.b + start))")).alias("s"))
    texts = starts.groupBy(*_TEXT).agg(_union(F.col("s")).alias("spans"))
    both = texts.select(*_TEXT, F.lit(False).alias("whole"), "spans").unionByName(
        copies.select(*_TEXT, F.lit(True).alias("whole"), F.lit(None).cast(_SPANS).alias("spans"))
    )
    return both.groupBy(*_TEXT).agg(F.max("whole").alias("whole"), F.first("spans", ignorenulls=True).alias("spans"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, removed, kept) of every row: byte ranges that go, and what is left, as bytes."""

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept = [], []
            for text, whole, spans in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                data, at, left = text.as_py(), 0, []
                ranges = [(0, len(data))] if whole else _merged((s["a"], s["b"] + length - 1) for s in spans.as_py() or ())
                for a, b in ranges:
                    left.append(data[at:a])
                    at = b
                left.append(data[at:])
                gone.append([{"a": a, "b": b} for a, b in ranges])
                kept.append(b"".join(left))
            ranges = pa.array(gone, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            columns = [*(batch.column(i) for i in range(3, batch.num_columns)), ranges, pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "removed", "kept"])

    rows = sized_join(_keyed(docs, id_col, text_col), repeated_spans(docs, id_col, text_col, length), _TEXT, how="left")
    rows = rows.select("text", "whole", "spans", "id", F.octet_length("text").cast("long").alias("n_bytes"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(batches, f"`{id_col}` {kind}, n_bytes long, removed {_SPANS}, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """Counts and a digest of what `cut_repeats` leaves of every document."""
    return cut_repeats(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
