"""Near-duplicate lines across a corpus, by a join of deletion neighbourhoods.  DataFrame operations only.

A line is compared in lower case and without blanks around it.  An occurrence goes if an
earlier one, by document id and line, is a duplicate of it, whether or not that one stays;
all other lines stay.  Equal lines of any length are duplicates.  Lines of at least
`MIN_UNITS` words, cut at single blanks, also are if one word inserted, removed or replaced
turns one into the other.  So are lines of fewer words, those of languages written
without blanks among them, if they have at least `MIN_UNITS` letters and one letter does.
In a line of fewer units one edit is no small change, so it only has equal duplicates.
Lines compared by words and lines compared by letters are not compared with each other.
Empty lines stay.

1. Every line is hashed, to 128 bits, where it is read; distinct forms keep their first
   occurrence, which stands for the form from then on.
2. Two lines one unit apart share their first or their last half, so a form without a
   partner for any of its halves needs no neighbourhood.  The text of those that have one
   is read anew, by way of a broadcast table of bits, whose size is fixed.  Keys that no
   other form has do not pass such a table, so most of them are shuffled only once.
3. These forms emit a key per unit, for the form without that unit: one that holds the
   place, which a line with another unit there shares, and one for the shorter line as a
   whole.  A running XOR of the units' hashes gives each key in constant time.
4. Per key only the earliest form is kept, so no pairs are made, however many lines share
   a key.  For the shorter line these are two, the earliest line that has its units as a
   whole and the earliest that lost one; each of the two kinds meets only the other, so
   all partners are one unit away.  The earliest partner of a form is verified on the
   units of both.

NULL texts stay NULL and have no lines.  Rows with equal id and text are one document and
get the same result each; NULL ids come first.  All columns of the table are carried
through one join on id and text, so extra columns may have any names but those that begin
with `_line`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqstates.llm.common import materialize, release, sieve

MIN_UNITS = 8
PLACE = ["doc_id", "text_hash", "line"]
HASH = ["h1", "h2"]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, line, words, h1, h2) of every line that is not empty; `words` is one text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    rows = rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    rows = rows.select(*PLACE, F.lower(F.trim("raw")).alias("words")).where("words != ''")
    return rows.withColumns({"h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit("second"), "words")})


def _with_units(lines: DataFrame) -> DataFrame:
    """Whether a line is compared by words, and its number `n` of units."""
    blanks = "octet_length(words) - octet_length(replace(words, ' ', ''))"
    lines = lines.withColumn("by_words", F.expr(f"{blanks} + 1 >= {MIN_UNITS}"))
    return lines.withColumn("n", F.expr(f"if(by_words, {blanks} + 1, char_length(words))"))


def _half_keys() -> list[str]:
    """Keys of both halves, as a line of n units and as the longer of a pair of n - 1 and n."""
    keys = []
    for m in ("n", "n - 1"):
        half = f"cast(({m}) div 2 AS int)"
        rest = f"({m}) - {half}"
        keys.append(f"xxhash64({m}, 1, by_words, if(by_words, substring_index(words, ' ', {half}), left(words, {half})))")
        keys.append(f"xxhash64({m}, 2, by_words, if(by_words, substring_index(words, ' ', -({rest})), right(words, {rest})))")
    return [f"if(n >= {MIN_UNITS}, {key}, NULL)" for key in keys]


def _near_forms(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line) of the forms that have an earlier form one unit away."""
    halves = forms.select("h1", F.explode(F.array(*[f"half{i}" for i in range(4)])).alias("key")).where("key IS NOT NULL")
    shared = halves.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo != hi").select("key")
    shared = materialize(shared, "shared")
    each = forms.select(*HASH, "first.*", F.explode(F.array(*[f"half{i}" for i in range(4)])).alias("key"))
    partnered = sieve(each, shared, "key").join(shared, "key", "left_semi").select(*HASH, *PLACE).distinct()
    partnered = materialize(partnered, "partnered")

    # The text of the forms with a partner, from their first occurrence only.
    place = partnered.select(*[F.col(c).alias(f"_{c}") for c in PLACE])
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")) & (F.col("line") == F.col("_line"))
    words = _with_units(sieve(lines, partnered, "h1")).join(place, same, "left_semi").dropDuplicates(PLACE)
    words = words.selectExpr(*PLACE, "by_words", "n", "if(by_words, split(words, ' '), split(words, '')) AS units")
    words = materialize(words, "words")

    # Dealt out by form before the units are, so that the windows need no other shuffle.
    each = words.repartition(*PLACE).select(*PLACE, "by_words", "n", F.posexplode("units").alias("i", "unit"))
    each = each.select(*PLACE, "by_words", "n", "i", F.xxhash64("unit", "i").alias("here"), F.xxhash64("unit", F.col("i") - 1).alias("moved"))
    whole = Window.partitionBy(*PLACE)
    ordered = whole.orderBy("i")
    each = each.select(
        *PLACE,
        "by_words",
        "n",
        "i",
        F.coalesce(F.bit_xor("here").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        (F.bit_xor("moved").over(whole).bitwiseXOR(F.bit_xor("moved").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))).alias("after"),
        F.bit_xor("here").over(whole).alias("all"),
    )
    keys = each.selectExpr(
        f"struct({', '.join(PLACE)}) AS first",
        "inline(array(struct(xxhash64(n, by_words, i, before, after) AS key, 'place' AS side),"
        " struct(xxhash64(n - 1, by_words, before ^ after) AS key, 'shorter' AS side),"
        " struct(if(i = 0, xxhash64(n, by_words, all), NULL) AS key, 'whole' AS side)))",
    ).where("key IS NOT NULL")
    keys = materialize(keys, "keys")
    # Two forms that both lost a unit may be two apart: these meet only whole forms.
    earliest = keys.groupBy("key").agg(
        F.expr("min(first) FILTER (WHERE side != 'shorter')").alias("whole"),
        F.expr("min(first) FILTER (WHERE side = 'shorter')").alias("shorter"),
        F.max("first").alias("latest"),
    )
    earliest = earliest.where("latest > least(whole, shorter)").select("key", "whole", "shorter")
    earliest = materialize(earliest, "earliest")
    best = F.expr("if(side = 'whole', shorter, whole)").alias("best")
    found = sieve(keys, earliest, "key").join(earliest, "key").select("first", best).where("best < first").groupBy("first").agg(F.min("best").alias("best"))
    found = materialize(found.select(*[F.col(f"first.{c}") for c in PLACE], *[F.col(f"best.{c}").alias(f"{c}2") for c in PLACE]), "partners")
    release(shared, partnered, keys, earliest)

    def with_text(rows: DataFrame, end: str) -> DataFrame:
        text = words.select(*[F.col(c).alias(f"_{c}") for c in PLACE], F.col("n").alias(f"n{end}"), F.col("units").alias(f"units{end}"))
        on = F.col(f"doc_id{end}").eqNullSafe(F.col("_doc_id")) & (F.col(f"text_hash{end}") == F.col("_text_hash")) & (F.col(f"line{end}") == F.col("_line"))
        return rows.join(text, on).drop(*[f"_{c}" for c in PLACE])

    both = with_text(with_text(found, ""), "2")
    first_difference = "coalesce(nullif(array_position(zip_with({a}, {b}, (x, y) -> NOT (x <=> y)), true), 0) - 1, n)"
    start = first_difference.format(a="units", b="units2")
    end = first_difference.format(a="reverse(units)", b="reverse(units2)")
    near = materialize(both.where(f"abs(n - n2) <= 1 AND {start} + {end} >= greatest(n, n2) - 1").select(*PLACE), "near")
    release(words, found)
    return near


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, removed): line numbers that go, for documents that lose any."""
    lines = _lines(docs, id_col, text_col)
    # The half keys are equal in all rows of a form, so their minimum is any of them.
    forms = _with_units(lines).selectExpr(*PLACE, *HASH, *[f"{key} AS half{i}" for i, key in enumerate(_half_keys())])
    forms = forms.groupBy(*HASH).agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("c"), *[F.min(f"half{i}").alias(f"half{i}") for i in range(4)])
    forms = materialize(forms, "forms")
    near = _near_forms(lines, forms)
    same = near.select(F.struct(*PLACE).alias("near"))
    going = forms.join(same, F.col("first").eqNullSafe(F.col("near")), "left").where("c > 1 OR near IS NOT NULL")
    going = materialize(going.select(*HASH, "first", F.col("near").isNotNull().alias("near")), "going")
    release(forms, near)
    gone = sieve(lines.drop("words"), going, "h1").join(going, HASH)
    gone = gone.where(F.col("near") | (F.col("first") != F.struct(*PLACE)))
    removed = materialize(gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("removed")), "removed")
    release(going)
    return removed


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with the duplicate lines cut out of its texts, and `n_lines` and `n_kept`."""
    removed = removed_lines(docs, id_col, text_col)
    removed = removed.select(F.col("doc_id").alias("_line_doc"), F.col("text_hash").alias("_line_hash"), F.col("removed").alias("_line_removed"))
    rows = docs.withColumn("_line_key", F.xxhash64(text_col))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_line_doc")) & (F.col("_line_key") == F.col("_line_hash"))
    rows = rows.join(removed, same, "left").withColumn("_lines", F.split(text_col, "\n"))
    kept = F.expr("filter(_lines, (x, i) -> NOT array_contains(_line_removed, i))")
    kept = F.when(F.col("_line_removed").isNull(), F.col("_lines")).otherwise(kept)
    rows = rows.withColumn("_lines_kept", kept)
    columns = [F.array_join("_lines_kept", "\n").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    counts = [F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(count(c)).alias(n) for c, n in (("_lines", "n_lines"), ("_lines_kept", "n_kept"))]
    return rows.select(*columns, *counts)


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS raw FROM documents),
cut AS (SELECT doc_id, line, lower(trim(raw, ' ')) AS s FROM lines),
split AS (SELECT *, string_split(s, ' ') AS w FROM cut WHERE s != ''),
full_lines AS (
  SELECT doc_id, line, s, len(w) >= 8 AS by_words,
    CASE WHEN len(w) >= 8 THEN w WHEN length(s) >= 8 THEN string_split(s, '') ELSE [] END AS u FROM split),
forms AS (SELECT s, any_value(by_words) AS by_words, any_value(u) AS u, len(any_value(u)) AS n, min((doc_id, line)) AS first FROM full_lines GROUP BY s),
places AS (SELECT *, unnest(range(1, n + 1)) AS i FROM forms),
neighbours AS (
  SELECT 'place' AS side, s, first, concat_ws(chr(31), by_words, n, i, array_to_string(u[1:i - 1], chr(31)), '/', array_to_string(u[i + 1:], chr(31))) AS k FROM places
  UNION SELECT 'shorter', s, first, concat_ws(chr(31), 'short', by_words, array_to_string(list_concat(u[1:i - 1], u[i + 1:]), chr(31))) FROM places
  UNION SELECT 'whole', s, first, concat_ws(chr(31), 'short', by_words, array_to_string(u, chr(31))) FROM forms WHERE n > 0),
-- Two forms that both lost a word may be two words apart: they meet only whole ones.
earliest AS (
  SELECT k, min(first) FILTER (WHERE side != 'shorter') AS whole, min(first) FILTER (WHERE side = 'shorter') AS shorter FROM neighbours GROUP BY k),
partners AS (
  SELECT n.s, min(CASE WHEN n.side = 'whole' THEN e.shorter ELSE e.whole END) AS best FROM neighbours n JOIN earliest e USING (k) GROUP BY n.s),
gone AS (
  SELECT l.doc_id, l.line FROM full_lines l JOIN forms f ON l.s = f.s LEFT JOIN partners p ON l.s = p.s
  WHERE p.best < f.first OR (l.doc_id, l.line) != f.first),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.line IS NULL) AS n_kept,
    coalesce(string_agg(l.raw, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_kept, 0) AS n_kept, k.text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
