"""Input that has to be refused, or kept apart."""

import pytest
from pyspark.sql import functions as F

from seqstates.catalog import queries as catalog
from seqstates.conditions import Condition, condition_grid
from seqstates.operators import grams, perturb, reconstruct
from seqstates.plans import analysis, sweep
from seqstates.sources.series import as_symbol_series, symbol_series


@pytest.mark.parametrize("ts", [[0, 0, 2], [0, 1, None, 3], [1, 2, 3], [0, 2, 3], [-1, 0, 1], [0, 1, 1]])
def test_positions_have_to_be_dense(spark, ts):
    df = spark.createDataFrame([("a", t, 1) for t in ts], "series_id string, t long, x int")
    with pytest.raises(ValueError, match="positions"):
        as_symbol_series(df)


def test_dense_positions_pass(spark):
    df = spark.range(200).selectExpr("'a' AS series_id", "id AS t", "CAST(id % 2 AS INT) AS x")
    assert {r.length for r in as_symbol_series(df).collect()} == {200}


def test_null_keys_stay_apart(spark):
    df = spark.createDataFrame([(None, 1), ("\\N", 2), ("a|b", 3)], "g string, o int")
    got = symbol_series(df, ["g"], ["o"], F.lit(True)).collect()
    assert len({r.series_id for r in got}) == 3 and {r.length for r in got} == {1}


@pytest.mark.parametrize("method", ["group", "range"])
@pytest.mark.parametrize("bucket", [None, "b"])
def test_ties_end_the_job(spark, method, bucket):
    df = spark.createDataFrame([(1, 0), (2, 0), (2, 0), (3, 1)], "o int, b int")
    series = lambda rows: symbol_series(rows, [], ["o"], F.lit(True), bucket=bucket and F.col(bucket), method=method)
    with pytest.raises(Exception, match="equal in all order columns"):
        series(df).collect()
    assert [r.t for r in series(df.distinct()).orderBy("t").collect()] == [0, 1, 2]


def test_shares_and_distances_are_bounded(spark, sf_dir):
    series = catalog.ev_type(spark, sf_dir)
    for frac in (1.5, -0.1, float("nan")):
        with pytest.raises(ValueError, match="train_frac"):
            perturb.train_test_split(series, frac)
    with pytest.raises(ValueError, match="eps"):
        reconstruct.assign_states(grams.contexts(series, [1]), -0.1)
    for bad in (-0.1, 1.1, float("nan")):
        with pytest.raises(ValueError, match="probability"):
            Condition(bad)
    with pytest.raises(ValueError, match="counts from 1"):
        Condition(subsample_step=0)


def test_conditions_with_one_id_are_refused(spark, sf_dir):
    with pytest.raises(ValueError, match="share the id"):
        condition_grid([0.1234567, 0.1234568])
    close = [Condition(0.1234567), Condition(0.1234568)]
    with pytest.raises(ValueError, match="share the id"):
        sweep.fit(catalog.ev_type(spark, sf_dir), [1], close)
    assert len(condition_grid([0.1234567, 0.1234568], style="json")) == 2


def test_state_sequence_counts_are_the_occupancy(spark, sf_dir):
    series = catalog.ev_type(spark, sf_dir)
    fitted = sweep.fit(series, [3])
    labelled = grams.last_k(series, 3, transitions_only=True).where("role = 'train'")
    keys = ["series_id", "state"]
    states = reconstruct.state_sequence(labelled, fitted).groupBy(*keys).count()
    visits = reconstruct.state_occupancy(reconstruct.transition_counts(fitted)).select(*keys, "c")
    assert sorted(map(tuple, states.collect())) == sorted(map(tuple, visits.collect()))


def test_perturbed_symbols_are_those_the_sweep_counts(spark, sf_dir):
    """The row transforms and the packed counting agree on every condition."""
    series = catalog.ev_type(spark, sf_dir)
    grid = condition_grid([0.0, 0.2], [1, 3])
    rows = perturb.perturb_grid(series, grid).groupBy("series_id", "condition_id").agg(F.sum("x").alias("ones"), F.count("*").alias("n"))
    counted = grams.positions(series, 2, grid).groupBy("series_id", "condition_id").agg(F.sum("y").alias("ones"), F.count("*").alias("n"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, counted.collect()))


def test_grid_keeps_extra_keys_apart(spark, sf_dir):
    series = catalog.ev_type(spark, sf_dir)
    runs = [sweep.sweep_runs(series, [1, 2], base_process="ev", eps=eps) for eps in (0.01, 0.3)]
    runs = runs[0].union(runs[1])
    summary = analysis.summarise(runs, ["eps"])
    wide = analysis.phase_grid_wide(summary, [1, 2]).collect()
    assert sorted(r.eps for r in wide) == [0.01, 0.3]
    assert {r.eps for r in analysis.metric_vs_k(summary).collect()} == {0.01, 0.3}
    report = analysis.closure_report(runs, extra_keys=["eps"])
    assert report["phase"].count() == 4 and "eps" in report["phase"].columns
    with pytest.raises(Exception, match="several rows"):
        analysis.phase_grid_wide(summary.drop("eps"), [1, 2]).collect()
