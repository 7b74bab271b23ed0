"""Numbering of rows, flips and subsampling."""

import pytest
from pyspark.sql import functions as F

from seqstates.conditions import Condition
from seqstates.operators.perturb import flip_noise, perturb, perturb_grid, subsample, train_test_split
from seqstates.sources import scratch
from seqstates.sources.series import as_symbol_series, symbol_series


@pytest.fixture(scope="module")
def skewed(spark):
    """One series with most rows, most of them at the same time; also a NULL key."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 == 7, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("key"),
        F.when(F.col("id") % 3 > 0, F.lit(500)).otherwise(F.col("id") % 1000).alias("time"),
        (F.col("id") * 7919 % 3001).alias("tie"),
    )
    return materialized(rows)


def materialized(df):
    return scratch.materialize(df, "fixture")


def numbered(df, **options):
    value = F.col("tie") % 3 == 0
    return sorted(map(tuple, symbol_series(df, ["key"], ["time", "tie"], value, **options).collect()))


def test_all_ways_to_number_agree(skewed):
    plain = numbered(skewed, method="group")
    expected = {}
    for r in skewed.collect():
        expected.setdefault("\\N" if r.key is None else r.key, []).append((r.time, r.tie))
    wanted = [
        (s, t, int(tie % 3 == 0), len(rows)) for s, rows in expected.items() for t, (_, tie) in enumerate(sorted(rows))
    ]
    assert plain == sorted(wanted)
    assert numbered(skewed, bucket=F.col("time"), method="group") == plain
    assert numbered(skewed, method="range") == plain


@pytest.mark.parametrize("method", ["auto", "group", "range"])
@pytest.mark.parametrize("window", [0, 1_000_000])
def test_decreasing_buckets_end_the_job(spark, method, window):
    """In every way to number, whether the first order column shows it or only the whole order."""

    def run(rows, bucket):
        df = spark.createDataFrame(rows, "o1 int, o2 int, b int")
        found = symbol_series(df, [], ["o1", "o2"], F.col("o2") % 2 == 0, bucket=bucket, method=method, max_window_buckets=window)
        return [r.t for r in found.orderBy("t").collect()]

    good = [(None, 1, -1), (None, 2, 0), (1, 1, 0), (1, 2, 1), (2, 0, 1), (2, 5, 3), (3, 0, 9)]
    assert run(good, F.col("b")) == list(range(7))
    for i, b in ((2, 4), (3, 0), (4, 0), (0, 1), (1, -2)):
        bad = [*good[:i], (*good[i][:2], b), *good[i + 1 :]]
        decreases = any(x[2] > y[2] for x, y in zip(bad, bad[1:]))
        if decreases:
            with pytest.raises(ValueError, match="bucket decreases"):
                run(bad, F.col("b"))
        else:
            assert run(bad, F.col("b")) == list(range(7))
    with pytest.raises(ValueError, match="bucket decreases"):
        run([(1, 1, 0), (1, 1, 1)], F.col("b"))  # equal in all order columns


def test_offsets_in_two_levels(spark, monkeypatch):
    """200,000 buckets in one series and a few small ones: equal offsets, and no window over a series' buckets."""
    from seqstates.sources import series as module

    rows = spark.range(200_000).selectExpr("if(id % 50 = 0, concat('s', id % 7), 'hot') AS series_id", "id AS bucket", "id AS o0")
    plain, largest = module.bucket_table(rows, ["o0"])
    levels, same = module.bucket_table(rows, ["o0"], 0)
    assert largest == same == 1
    assert plain.exceptAll(levels).isEmpty() and plain.count() == levels.count() == 200_000
    counts = materialized(rows.selectExpr("series_id", "bucket", "1L AS c", "o0 AS lo", "o0 AS hi", "0L AS nulls"))
    written = []
    real = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, label: written.append((label, df)) or real(df, label))
    module._before_each(counts, 0)
    plan = dict(written)["offsets"]._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("part" in line for line in windows)


def test_large_groups_take_the_range_index(skewed, monkeypatch):
    taken = []
    import seqstates.sources.series as module

    real = module.range_index
    monkeypatch.setattr(module, "range_index", lambda *a: taken.append(1) or real(*a))
    assert numbered(skewed, max_group_rows=100) == numbered(skewed)
    assert numbered(skewed, bucket=F.col("time"), max_group_rows=2900) and taken == [1]


def test_range_index_with_a_large_lookup(skewed, monkeypatch):
    monkeypatch.setattr(scratch.sized_join, "__kwdefaults__", {**scratch.sized_join.__kwdefaults__, "max_broadcast_rows": 0})
    assert numbered(skewed, method="range") == numbered(skewed)


def test_several_key_columns_do_not_collide(spark):
    rows = [("a|b", "c", 0), ("a", "b|c", 1), ("a", None, 2), (None, "a", 3)]
    df = spark.createDataFrame(rows, "p string, q string, o int")
    found = symbol_series(df, ["p", "q"], ["o"], F.lit(True)).collect()
    assert len({r.series_id for r in found}) == 4 and all(r.length == 1 for r in found)


def test_ready_made_series_are_checked(spark):
    good = spark.createDataFrame([("a", 0, 1), ("a", 1, 0)], "series_id string, t long, x int")
    assert sorted(r.length for r in as_symbol_series(good).collect()) == [2, 2]
    for rows in ([("a", 0, 2)], [("a", 1, 1)], [("a", 0, None)]):
        with pytest.raises(ValueError):
            as_symbol_series(spark.createDataFrame(rows, "series_id string, t long, x int"))
    with pytest.raises(ValueError):
        as_symbol_series(good.drop("x"))


@pytest.fixture(scope="module")
def long_series(spark):
    rows = spark.range(10000).select(
        F.lit("a").alias("series_id"),
        F.col("id").alias("t"),
        (F.col("id") % 2).cast("int").alias("x"),
        F.lit(10000).cast("long").alias("length"),
        (F.col("id") % 5).cast("int").alias("latent"),
    )
    return materialized(rows)


def values(df):
    return [r.x for r in df.orderBy("t").collect()]


def test_flips_are_reproducible_and_nested(long_series):
    base = values(long_series)
    low, again = values(flip_noise(long_series, 0.1)), values(flip_noise(long_series.repartition(9), 0.1))
    high = values(flip_noise(long_series, 0.3))
    assert low == again
    flips_low = {t for t, (a, b) in enumerate(zip(base, low)) if a != b}
    flips_high = {t for t, (a, b) in enumerate(zip(base, high)) if a != b}
    assert flips_low < flips_high and 800 < len(flips_low) < 1200 and 2700 < len(flips_high) < 3300
    assert values(flip_noise(long_series, 0.1, seed=1)) != low
    assert values(flip_noise(long_series, 0.0)) == base
    assert values(flip_noise(long_series, 1.0)) == [1 - v for v in base]


def test_subsample_keeps_labels(long_series):
    kept = subsample(long_series, 3).orderBy("t").collect()
    assert [(r.t, r.x, r.latent) for r in kept] == [(i, 3 * i % 2, 3 * i % 5) for i in range(3334)]
    assert {r.length for r in kept} == {3334}


def test_flip_comes_before_subsampling(long_series):
    both = values(perturb(long_series, Condition(0.1, 2)))
    assert both == values(flip_noise(long_series, 0.1))[::2]
    grid = perturb_grid(long_series, [Condition(0.1, 2), Condition()])
    assert values(grid.where("condition_id = 'flip0.1_sub2'")) == both
    with pytest.raises(ValueError):
        flip_noise(long_series, -0.1)
    with pytest.raises(ValueError):
        subsample(long_series, 0)


def test_split_truncates(spark):
    lengths = spark.createDataFrame([(n,) for n in range(1, 60)], "length long")
    rows = lengths.select(F.lit("a").alias("series_id"), F.explode(F.expr("sequence(0L, length - 1)")).alias("t"), "length")
    for frac in (0.8, 0.7, 0.29):
        counts = train_test_split(rows, frac).where("role = 'train'").groupBy("length").count().collect()
        found = {r.length: r["count"] for r in counts}
        assert all(found.get(n, 0) == int(n * frac) for n in range(1, 60))
