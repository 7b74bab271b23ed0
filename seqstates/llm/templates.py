"""Benchmark decontamination by template windows.  DataFrame operations only.

A text becomes a template: numbers, the units after them, and names (capitalised words
inside a sentence) turn into typed placeholders, whatever signs stand before them, all
other words into their letters in lower case.  A document and a benchmark item meet on equal windows of `WINDOW` template
words with at least `LITERALS` words among them.  Windows at one distance of their places
(a diagonal) belong to one passage; its slots are consistent if each value of the item
stands for one value of the document.  A consistent passage counts as a leak if it has
`ENOUGH` windows of the item, or half of them if the item has few; of an inconsistent one
only the windows without a slot count.  If a slot differs, it is the question with new
parameters.

An item without such a window has to stand in the document with its own words, values
included: by windows of `WINDOW` words if it has as many, as a whole if it has `LITERALS`
words or more, else as a line of its own.

The documents are read twice.  The first pass keeps only the documents that share a
window hash with the benchmark, the second compares those in full.  The window hashes of
the benchmark and the documents found are broadcast only if their written size allows it,
else joined by key.

NULL and empty texts, and texts of signs alone, match nothing.  Rows with equal id and
text are one document; rows that share an id but not a text are compared each, and the
best passage counts.  Only id and text are read, so other columns cannot clash; an empty
table on either side gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqstates.llm.common import materialize

WINDOW = 8
LITERALS = 5
ENOUGH = 6
MAX_BROADCAST_BYTES = 4 << 20
# Units of measure that may follow a number.
UNITS = "mm cm m km mg g kg t ml l s ms min h hour hours day days week weeks month months year years kb mb gb tb percent usd eur dollars euros cents miles feet inches pounds degrees".split()
SIGNS = ".,;:!?\"'()[]{}<>|/\\\\*&%$#+=_~^`“”„«»…-"


def _templates(texts: DataFrame, key: list[str]) -> DataFrame:
    """(key, text, plain, template): the words without signs in lower case, and the template words.

    Signs and letter case are taken off the whole text at once, which leaves its spaces in
    place, so that a word costs a few comparisons.
    """
    spaced = texts.select(*key, "text", F.regexp_replace(F.trim("text"), r"\s+", " ").alias("spaced"))
    bare = F.regexp_replace("spaced", _sign_class(), "")
    rows = spaced.select(*key, "text", F.split("spaced", " ").alias("raw"), F.split(bare, " ").alias("cased"), F.split(F.lower(bare), " ").alias("plain"))
    units = ", ".join(f"'{u}'" for u in UNITS)
    ended = " OR ".join(f"endswith(raw[i - 1], '{c}')" for c in ".!?")
    kind = f"""CASE WHEN x >= '0' AND x < ':' THEN '<number>'
        WHEN i > 0 AND x != cased[i] AND left(x, 1) != left(cased[i], 1) AND cased[i] != upper(cased[i]) AND NOT ({ended}) THEN '<name>'
        WHEN i > 0 AND plain[i - 1] >= '0' AND plain[i - 1] < ':' AND x IN ({units}) THEN '<unit>'
        ELSE x END"""
    return rows.select(*key, "text", "plain", F.expr(f"transform(plain, (x, i) -> {kind})").alias("template"))


def _sign_class() -> str:
    return "[" + "".join("\\" + c for c in dict.fromkeys(SIGNS.replace("\\\\", "\\"))) + "]"


def _line(text: Column) -> Column:
    """The words of a line without signs in lower case, one space between them."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, _sign_class(), "")), r"\s+", " "))


def _places(words: str, size: int) -> str:
    """SQL text: the places of all windows of `size` in an array."""
    return f"if(size({words}) >= {size}, sequence(1, size({words}) - {size - 1}), CAST(array() AS ARRAY<INT>))"


def _window_hash() -> str:
    """SQL text: the hash of the window of `hashes` at place `i`, by its elements, as a slice would be copied."""
    return "xxhash64(" + ", ".join(f"hashes[i + {j}]" for j in range(-1, WINDOW - 1)) + ")"


def _hashes(rows: DataFrame, key: list[str], sizes: list[int]) -> DataFrame:
    """(key, hash) of every window, also of those of `sizes` plain words, 0 standing for a line."""
    rows = rows.select("*", F.expr("transform(template, x -> xxhash64(x))").alias("hashes"))
    windows = [F.expr(f"transform({_places('hashes', WINDOW)}, i -> {_window_hash()})")]
    if sizes:
        windows.append(F.transform(_own_words(sizes), lambda w: F.xxhash64(w["words"])))
    return rows.select(*key, F.explode(F.concat(*windows)).alias("hash"))


def _own_words(sizes: list[int]) -> Column:
    """Array of (place, words): windows of plain words, or lines."""
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("place"), F.array(_line(t)).alias("words")))
    parts = [lines] if 0 in sizes else []
    parts += [F.expr(f"transform({_places('plain', n)}, i -> struct(i AS place, slice(plain, i, {n}) AS words))") for n in sizes if n]
    return F.concat(*parts)


def _slotted(rows: DataFrame, key: list[str], extra: str) -> DataFrame:
    """Windows with the plain words of their slots."""
    values = "transform(plain, (x, i) -> if(substring(template[i], 1, 1) = '<', x, NULL))"
    rows = rows.withColumn("values", F.expr(values)).withColumn("hashes", F.expr("transform(template, x -> xxhash64(x))"))
    window = f"struct({_window_hash()} AS hash, slice(template, i, {WINDOW}) AS words, filter(slice(values, i, {WINDOW}), v -> v IS NOT NULL) AS slots)"
    rows = rows.select(*key, F.posexplode(F.expr(f"transform({_places('template', WINDOW)}, i -> {window})")).alias(f"{extra}place", "w"))
    return rows.select(*key, f"{extra}place", F.col("w.hash").alias("hash"), F.col("w.words").alias("words"), F.col("w.slots").alias(f"{extra}slots"))


def _worded(rows: DataFrame, key: list[str], sizes: list[int], extra: str) -> DataFrame:
    """Windows of plain words and lines, as windows without a slot."""
    rows = rows.select(*key, F.explode(_own_words(sizes)).alias("w")).where("exists(w.words, x -> x != '')")
    return rows.select(*key, F.col("w.place").alias(f"{extra}place"), F.xxhash64("w.words").alias("hash"), F.col("w.words").alias("words"), F.expr("CAST(array() AS ARRAY<STRING>)").alias(f"{extra}slots"))


def _item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """Written template windows of items, windows by own words of items without one, and the sizes of these."""
    rows = _templates(items, ["item_id"])
    slotted = _slotted(rows, ["item_id"], "item_").where(f"size(filter(words, w -> w != '' AND substring(w, 1, 1) != '<')) >= {LITERALS}")
    slotted = materialize(slotted.distinct(), "windows")
    size = F.expr(f"CASE WHEN size(plain) >= {LITERALS} THEN least(size(plain), {WINDOW}) ELSE 0 END")
    rest = rows.join(slotted.select("item_id").distinct(), "item_id", "left_anti").withColumn("size", size)
    rest = materialize(rest, "short")
    sizes = sorted(r["size"] for r in rest.select("size").distinct().collect())  # at most 0, LITERALS to WINDOW
    whole = rest.where("size = 0").withColumn("text", F.regexp_replace("text", r"\s+", " "))
    parts = [_worded(whole if n == 0 else rest.where(F.col("size") == n), ["item_id"], [n], "item_") for n in sizes]
    worded = reduce(DataFrame.union, parts, slotted.limit(0).withColumn("item_place", F.col("item_place").cast("int")))
    return slotted, materialize(worded.select(*slotted.columns).distinct(), "worded"), sizes


def _small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its values are few bytes."""
    size = table.agg(F.sum(sum((F.octet_length(F.col(c).cast("string")) for c in table.columns), F.lit(0)))).first()[0] or 0
    return F.broadcast(table) if size <= MAX_BROADCAST_BYTES else table


def _passages(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, n_changed) of every leaked passage."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("text_hash"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL")
    slotted, worded, sizes = _item_windows(items)
    own = slotted.union(worded)
    totals = own.groupBy("item_id").agg(F.countDistinct("item_place").alias("total"))

    key = ["doc_id", "text_hash"]
    hashes = materialize(own.select("hash").distinct(), "hashes")
    near = _hashes(_templates(texts, key), key, sizes).join(_small(hashes), "hash", "left_semi").select(*key).distinct()
    near = _small(materialize(near, "candidates"))
    same = texts["doc_id"].eqNullSafe(near["doc_id"]) & (texts["text_hash"] == near["text_hash"])
    found = _templates(texts.join(near, same, "left_semi"), key).distinct()

    met = _slotted(found, key, "").join(_small(slotted), ["hash", "words"])
    if sizes:
        met = met.unionByName(_worded(found, key, sizes, "").join(_small(worded), ["hash", "words"]))
    met = met.withColumn("diagonal", F.col("place") - F.col("item_place"))
    met = materialize(met.select(*key, "item_id", "diagonal", "item_place", "item_slots", "slots"), "met")
    passage = [*key, "item_id", "diagonal"]
    pairs = met.select(*passage, F.explode(F.arrays_zip("item_slots", "slots")).alias("p")).select(*passage, "p.item_slots", "p.slots").distinct()
    slots = pairs.groupBy(*passage).agg(
        F.count("*").alias("pairs"),
        F.countDistinct("item_slots").alias("left"),
        F.count_if(F.col("item_slots") != F.col("slots")).alias("n_changed"),
    )
    free = F.when(F.size("slots") == 0, F.col("item_place"))
    counts = met.groupBy(*passage).agg(F.countDistinct("item_place").alias("n_windows"), F.countDistinct(free).alias("n_free"))
    names = {c: f"_{c}" for c in passage}
    equal = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    joined = counts.join(slots.withColumnsRenamed(names), equal, "left").join(_small(materialize(totals, "totals")), "item_id")
    joined = joined.withColumn("n_windows", F.expr("if(pairs IS NULL OR pairs = left, n_windows, n_free)"))
    return joined.where(f"n_windows >= least({ENOUGH}, (total + 1) div 2)")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, n_changed): leaked items, their matched windows and changed slots."""
    joined = _passages(docs, benchmark, id_col, text_col)
    best = F.max(F.struct("n_windows", (-F.coalesce("n_changed", F.lit(0))).alias("same"))).alias("best")
    return joined.groupBy("doc_id", "item_id").agg(best).selectExpr("doc_id", "item_id", "best.n_windows", "-best.same AS n_changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the table without a leak in their own text."""
    found = _passages(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_leaked"), F.col("text_hash").alias("_leaked_hash")).distinct()
    found = _small(materialize(found, "leaked"))
    same = docs[id_col].cast("long").eqNullSafe(found["_leaked"]) & (F.xxhash64(docs[text_col]) == found["_leaked_hash"])
    return docs.join(found, same, "left_anti")


def _oracle() -> str:
    signs = "concat(" + ", ".join(f"chr({ord(c)})" for c in dict.fromkeys(SIGNS.replace("\\\\", "\\"))) + ")"
    units = ", ".join(f"'{u}'" for u in UNITS)
    templates = f"""
      SELECT {{key}}, text, p, [CASE WHEN p[i] >= '0' AND p[i] < ':' THEN '<number>'
        WHEN i > 1 AND c[i][1] != p[i][1] AND c[i] != upper(c[i]) AND right(w[i - 1], 1) NOT IN ('.', '!', '?') THEN '<name>'
        WHEN i > 1 AND p[i - 1] >= '0' AND p[i - 1] < ':' AND p[i] IN ({units}) THEN '<unit>' ELSE p[i] END FOR x, i IN w] AS t
      FROM (SELECT *, [lower(x) FOR x IN c] AS p FROM (SELECT *, [translate(x, {signs}, '') FOR x IN w] AS c
        FROM (SELECT {{key}}, text, string_split_regex(trim(text), '\\s+') AS w FROM {{table}})))"""
    windows = f"SELECT {{key}}, i AS {{place}}, t[i:i + {WINDOW - 1}] AS words, [p[j] FOR j IN range(i, i + {WINDOW}) IF t[j][1] = '<'] AS {{slots}} FROM {{table}}, unnest(range(1, len(t) - {WINDOW - 2})) AS r(i)"
    line = f"trim(regexp_replace(lower(translate({{}}, {signs}, '')), '\\s+', ' ', 'g'))"
    worded = f"""SELECT * FROM (
      SELECT {{key}}, i AS {{place}}, size, p[i:i + size - 1] AS words FROM {{table}}, unnest(range(1, len(p) - size + 2)) AS r(i) WHERE size > 0
      UNION ALL SELECT {{key}}, i, 0, [{line.format("l[i]")}] FROM (SELECT *, {{lines}} AS l FROM {{table}} WHERE size = 0), unnest(range(1, len(l) + 1)) AS r(i)
    ) WHERE len([x FOR x IN words IF x != '']) > 0"""
    return f"""
WITH item_templates AS ({templates.format(key="item_id", table="benchmark")}),
doc_templates AS ({templates.format(key="doc_id", table="documents")}),
item_windows AS (SELECT * FROM ({windows.format(key="item_id", place="item_place", slots="item_slots", table="item_templates")})
  WHERE len([x FOR x IN words IF x != '' AND x[1] != '<']) >= {LITERALS}),
short_items AS (SELECT item_id, text, p, CASE WHEN len(p) >= {LITERALS} THEN least(len(p), {WINDOW}) ELSE 0 END AS size
  FROM item_templates WHERE item_id NOT IN (SELECT item_id FROM item_windows)),
item_words AS ({worded.format(key="item_id", place="item_place", table="short_items", lines="[text]")}),
sized_docs AS (SELECT doc_id, text, p, size FROM doc_templates, (SELECT DISTINCT size FROM short_items)),
doc_words AS ({worded.format(key="doc_id", place="place", table="sized_docs", lines="string_split(text, chr(10))")}),
totals AS (SELECT item_id, count(DISTINCT item_place) AS total
  FROM (SELECT item_id, item_place FROM item_windows UNION ALL SELECT item_id, item_place FROM item_words) GROUP BY item_id),
doc_windows AS ({windows.format(key="doc_id", place="place", slots="slots", table="doc_templates")}),
met AS (SELECT doc_id, item_id, place - item_place AS diagonal, item_place, item_slots, slots FROM doc_windows JOIN item_windows USING (words)
  UNION ALL SELECT doc_id, item_id, place - item_place, item_place, [], [] FROM doc_words JOIN item_words USING (size, words)),
pairs AS (SELECT DISTINCT doc_id, item_id, diagonal, unnest(item_slots) AS a, unnest(slots) AS b FROM met),
slot_counts AS (SELECT doc_id, item_id, diagonal, count(*) AS p, count(DISTINCT a) AS l, count(*) FILTER (WHERE a != b) AS changed FROM pairs GROUP BY ALL),
counts AS (SELECT doc_id, item_id, diagonal, count(DISTINCT item_place) AS n_all,
  count(DISTINCT item_place) FILTER (WHERE len(slots) = 0) AS n_free FROM met GROUP BY ALL),
passages AS (
  SELECT c.doc_id, c.item_id, CASE WHEN p IS NULL OR p = l THEN n_all ELSE n_free END AS n, coalesce(changed, 0) AS changed
  FROM counts c LEFT JOIN slot_counts s USING (doc_id, item_id, diagonal) JOIN totals USING (item_id)
  WHERE n >= least({ENOUGH}, (total + 1) // 2))
SELECT doc_id, item_id, max(n) AS n_windows, -(max((n, -changed))[2]) AS n_changed FROM passages GROUP BY doc_id, item_id
"""


ORACLE = _oracle()
