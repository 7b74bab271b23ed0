"""Symbol series from any table: key, total order, predicate -> (series_id, t, x, length).

`t` is the dense 0-based position in the series and `length` the number of its
symbols.  Two ways to number the rows, both exact:

* `grouped_index` sorts one group per (series, bucket) and adds the group's
  offset.  Lazy, one shuffle of the rows, for groups that fit a task.
* `range_index` range-partitions on the whole order, so that a single series of
  any size, with any number of equal leading values, is spread over tasks.

`symbol_series` counts first and takes the second way as soon as one group is
larger than `max_group_rows`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqstates.sources.scratch import materialize, sized_join

MAX_GROUP_ROWS = 4_000_000
MAX_WINDOW_BUCKETS = 1_000_000  # of all series; more take the prefix sum in two levels, with the same result


def _series_id(series: Sequence[str]) -> Column:
    """One text key; NULL keys stay a series of their own."""
    if not series:
        return F.lit("all")
    texts = [F.regexp_replace(F.col(c).cast("string"), r"([\\|])", r"\\$1") for c in series]
    return F.concat_ws("|", *[F.coalesce(text, F.lit("\\N")) for text in texts])


def _keyed_rows(df, series, order, predicate, bucket, latent):
    """Project to the few columns needed, so that the scan reads nothing else."""
    if bucket is None:
        bucket = F.lit(0)
    bucket = F.coalesce(bucket.cast("long"), F.lit(-(2**63)))
    columns = [_series_id(series).alias("series_id"), bucket.alias("bucket")]
    columns += [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    columns.append(F.coalesce(predicate, F.lit(False)).cast("int").alias("x"))
    if latent is not None:
        columns.append(latent.cast("int").alias("latent"))
    return df.select(*columns), [f"o{i}" for i in range(len(order))]


def _tie() -> Column:
    """Ends the job: with equal order keys the numbering would depend on the layout."""
    return F.raise_error(F.lit("two rows of a series are equal in all order columns")).cast("boolean")


def _checked_place(window, order: Sequence[str]) -> Column:
    """Row number, from a sort that shows equal neighbours."""
    own = F.struct(*order)
    tied = F.lag(own).over(window.orderBy(*order)) == own
    return F.when(F.coalesce(tied, F.lit(False)), _tie().cast("int")).otherwise(F.row_number().over(window.orderBy(*order)))


def _groups_fit(rows: DataFrame, max_group_rows: int) -> bool:
    """Whether no series has more rows; small tables need only a plain count."""
    if rows.count() <= max_group_rows:
        return True
    counts = rows.groupBy("series_id").agg(F.count("*").alias("c"))
    return counts.agg(F.max("c")).first()[0] <= max_group_rows


def _disorder() -> ValueError:
    return ValueError("the bucket decreases along the order of a series, or falls between rows that are equal in it")


def bucket_table(rows: DataFrame, order: Sequence[str], max_window_buckets: int = MAX_WINDOW_BUCKETS) -> tuple[DataFrame, int]:
    """(series_id, bucket, c, offset, length) of every bucket: its rows, those before it, those of the series; and the largest c.

    Ends the job if a bucket does not lie behind the one before it: the largest value of the
    first order column in all earlier buckets is compared with the smallest one; where they
    are equal, so are the rows with that value, on the whole order.
    """
    first = F.col(order[0])
    counts = rows.groupBy("series_id", "bucket").agg(
        F.count("*").alias("c"), F.min(first).alias("lo"), F.max(first).alias("hi"), F.count_if(first.isNull()).alias("nulls")
    )
    counts = materialize(counts, "buckets")
    placed = _before_each(counts, max_window_buckets)
    # NULL comes first, so no value may lie before it.
    wrong = F.expr("lo < hi_before OR (nulls > 0 AND hi_before IS NOT NULL)")
    equal = F.expr("lo = hi_before OR (nulls > 0 AND nulls_before > 0)")
    bad, doubtful, largest = placed.agg(F.count_if(wrong), F.count_if(equal), F.max("c")).first()
    if bad:
        raise _disorder()
    if doubtful:
        value = F.when(F.col("nulls") > 0, F.lit(None)).otherwise(F.col("lo"))
        shared = placed.where(equal).select("series_id", value.alias("value")).distinct()
        shared = shared.withColumnRenamed("series_id", "of")
        ends = rows.join(shared, (rows.series_id == shared.of) & first.eqNullSafe(shared.value), "left_semi")
        key = F.struct(*order)
        ends = ends.groupBy("series_id", order[0], "bucket").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        earlier = Window.partitionBy("series_id", order[0]).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        if not ends.withColumn("hi_before", F.max("hi").over(earlier)).where("hi_before >= lo").isEmpty():
            raise _disorder()
    return placed.select("series_id", "bucket", "c", "offset", "length"), largest or 0


def _before_each(counts: DataFrame, max_window_buckets: int) -> DataFrame:
    """The buckets with what lies before each in its series: rows (`offset`), largest value, NULLs.

    A table of many buckets is laid out in ranges; sums run inside each range and over the
    totals of the ranges, so that the buckets of one series are never in one task.
    """
    sums = {"offset": F.sum("c"), "hi_before": F.max("hi"), "nulls_before": F.sum("nulls")}
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    length = F.sum("c").over(Window.partitionBy("series_id")).alias("length")
    if counts.count() <= max_window_buckets:
        found = counts.select("*", *[s.over(earlier(["series_id"], "bucket")).alias(n) for n, s in sums.items()], length)
        return found.fillna(0, ["offset", "nulls_before"])
    laid = counts.repartitionByRange("series_id", "bucket").withColumn("part", F.spark_partition_id())
    laid = materialize(laid, "laid")
    parts = laid.groupBy("series_id", "part").agg(F.sum("c").alias("c"), F.max("hi").alias("hi"), F.sum("nulls").alias("nulls"))
    parts = parts.select("series_id", "part", *[s.over(earlier(["series_id"], "part")).alias(f"part_{n}") for n, s in sums.items()], length)
    found = laid.withColumns({n: s.over(earlier(["series_id", "part"], "bucket")) for n, s in sums.items()})
    found = sized_join(found, parts, ["series_id", "part"])
    for n in ("offset", "nulls_before"):
        found = found.withColumn(n, F.coalesce(n, F.lit(0)) + F.coalesce(f"part_{n}", F.lit(0)))
    found = found.withColumn("hi_before", F.greatest("hi_before", "part_hi_before"))
    return materialize(found.select(*counts.columns, *sums, "length"), "offsets")


def _result(df: DataFrame) -> DataFrame:
    columns = ["series_id", "t", "x", "length"]
    return df.select(*columns, *[c for c in df.columns if c == "latent"])


def grouped_index(rows: DataFrame, order: Sequence[str], buckets: DataFrame | None = None) -> DataFrame:
    """Number rows within (series_id, bucket), then add the count of earlier buckets.

    Without buckets the length is a window count on the same partitions.
    With a `bucket_table` the merge join has the keys and the sort of the window, so it neither
    shuffles nor sorts the rows again.
    """
    if buckets is None:
        whole = Window.partitionBy("series_id")
        numbered = rows.withColumns(
            {"t": _checked_place(whole, order) - 1, "length": F.count("*").over(whole)}
        )
        return _result(numbered.withColumn("t", F.col("t").cast("long")))
    offsets = buckets.select("series_id", "bucket", "offset", "length")
    numbered = rows.withColumn("place", _checked_place(Window.partitionBy("series_id", "bucket"), order))
    joined = numbered.join(offsets.hint("merge"), ["series_id", "bucket"])
    return _result(joined.withColumn("t", F.col("offset") + F.col("place") - 1))


def range_index(rows: DataFrame, order: Sequence[str], keep: Sequence[str] = ("x", "latent")) -> DataFrame:
    """Number rows from a range-partitioned sort of all of them.

    `monotonically_increasing_id` counts along each sorted partition.  The layout
    is written once, because the offsets and the rows have to see the same one.
    There is an offset per series and partition, usually few enough to broadcast.
    Else the join is on (series_id, partition), whose groups are never larger than a
    partition, however large the series.
    """
    keys = ["series_id", *order]
    # Equal keys share a range, so finding ties needs no other shuffle.
    values = [c for c in keep if c in rows.columns and c not in keys]
    laid = rows.repartitionByRange(*keys).groupBy(*keys).agg(F.count("*").alias("c"), *[F.max(c).alias(c) for c in values])
    laid = laid.where(F.when(F.col("c") > 1, _tie()).otherwise(F.lit(True))).sortWithinPartitions(*keys)
    kept = ["series_id", *[c for c in keep if c in rows.columns]]
    laid = laid.select(*kept, F.monotonically_increasing_id().alias("pos"))
    laid = materialize(laid, "series").withColumn("part", F.shiftright("pos", 33))
    runs = laid.groupBy("series_id", "part").agg(F.count("*").alias("c"), F.min("pos").alias("first_pos"))
    whole = Window.partitionBy("series_id")
    offsets = runs.select(
        "series_id",
        "part",
        (F.sum("c").over(whole.orderBy("part")) - F.col("c") - F.col("first_pos")).alias("shift"),
        F.sum("c").over(whole).alias("length"),
    )
    joined = sized_join(laid, offsets, ["series_id", "part"]).withColumn("t", F.col("pos") + F.col("shift"))
    return joined.select("series_id", "t", *kept[1:], "length") if "x" not in kept else _result(joined)


def symbol_series(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    predicate: Column,
    *,
    bucket: Column | None = None,
    latent: Column | None = None,
    method: str = "auto",
    max_group_rows: int = MAX_GROUP_ROWS,
    max_window_buckets: int = MAX_WINDOW_BUCKETS,
) -> DataFrame:
    """0/1 series of `predicate` (NULL counts as 0) per `series` key, ordered by `order`.

    `order` has to be a total order within a series; equal rows end the job, in either way.  `bucket`, if given, is an
    integer that must not decrease along `order` (the day of a timestamp, say), which is
    checked; it splits the sort of long series without writing their rows.  `method` is "auto", "group" or "range".
    """
    if method not in ("auto", "group", "range"):
        raise ValueError(f"unknown method: {method}")
    rows, order_names = _keyed_rows(df, series, order, predicate, bucket, latent)
    buckets, largest = (None, 0) if bucket is None else bucket_table(rows, order_names, max_window_buckets)
    if method == "auto":
        fits = largest <= max_group_rows if bucket is not None else _groups_fit(rows, max_group_rows)
        method = "group" if fits else "range"
    if method == "range":
        return range_index(rows, order_names)
    return grouped_index(rows, order_names, buckets)


def bucketed_index(
    df: DataFrame,
    order: Sequence[str],
    predicate: Column,
    bucket: Column,
    **options,
) -> DataFrame:
    """The whole table as one series, numbered bucket by bucket."""
    return symbol_series(df, [], order, predicate, bucket=bucket, **options)


def as_symbol_series(df: DataFrame) -> DataFrame:
    """Check a ready-made (series_id, t, x[, latent]) table and add `length`.

    Raises when a symbol is not 0 or 1 or positions are not 0..n-1.
    """
    missing = {"series_id", "t", "x"} - set(df.columns)
    if missing:
        raise ValueError(f"a series needs {sorted(missing)}")
    # 62 positions share a word; as many different bits as rows means that no position
    # occurs twice, and with the largest one below the length that none is left out.
    bad = ~F.coalesce(F.col("x").isin(0, 1) & (F.col("t") >= 0), F.lit(False))
    place = F.expr("if(t >= 0, shiftleft(1L, CAST(t % 62 AS INT)), 0L)")
    words = df.groupBy("series_id", F.expr("t div 62").alias("w")).agg(
        F.count("*").alias("c"), F.bit_count(F.bit_or(place)).alias("places"), F.max("t").alias("hi"), F.count_if(bad).alias("bad")
    )
    lengths = words.groupBy("series_id").agg(
        F.sum("c").alias("length"), F.sum("places").alias("places"), F.max("hi").alias("hi"), F.sum("bad").alias("bad")
    )
    wrong = lengths.where("bad > 0 OR places != length OR hi != length - 1")
    example = wrong.select("series_id").first()
    if example is not None:
        raise ValueError(f"series {example[0]!r}: symbols must be 0 or 1 at positions 0..n-1")
    return _result(sized_join(df, lengths.select("series_id", "length"), ["series_id"], salt="t"))
