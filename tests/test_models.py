"""Run rows against the sequential definition, on series around every boundary."""

import random

import pytest
from pyspark.sql import functions as F

from sequential import observe, scores
from seqstates.conditions import condition_grid
from seqstates.operators.grams import contexts, last_k
from seqstates.operators.reconstruct import assign_states, state_sequence
from seqstates.plans.sweep import fit, fitted_edges, sweep_runs
from seqstates.sources.scratch import materialize
from seqstates.sources.series import as_symbol_series

METRICS = ["logloss", "n_states", "C_mu_empirical", "unifilarity_score", "branch_entropy"]
LENGTHS = [1, 2, 3, 5, 9, 61, 62, 63, 64, 78, 124, 125, 200, 700]


def bits(length):
    rng = random.Random(length)
    x = [1]
    while len(x) < length:
        x.append(int(rng.random() < (0.2 if sum(x[-3:]) > 1 else 0.7)))
    return x[:length]


SYMBOLS = {f"s{n}": bits(n) for n in LENGTHS}


@pytest.fixture(scope="module")
def series(spark):
    rows = [(s, t, v) for s, x in SYMBOLS.items() for t, v in enumerate(x)]
    return as_symbol_series(spark.createDataFrame(rows, "series_id string, t long, x int").repartition(5))


def check(runs, conditions, ks, eps, train_frac=0.8, noise_seed=None):
    found = {(r.series_id, r.condition_id, r.k): r for r in runs.collect()}
    assert len(found) == len(SYMBOLS) * len(conditions) * len(ks)
    for s, x in SYMBOLS.items():
        for c in conditions:
            seen = observe(s, x, c.flip_p, c.subsample_step)
            for k in ks:
                row = found[s, c.condition_id, k]
                assert row.length == len(x)
                wanted = scores(seen, k, eps, train_frac, noise_seed)
                for m in METRICS:
                    assert row[m] == pytest.approx(wanted[m], abs=1e-9), (s, c, k, m)


def test_grid(series):
    ks, grid = [1, 2, 3, 4, 5, 6], condition_grid([0.0, 0.15, 1.0], [1, 2, 3])
    check(sweep_runs(series, ks, grid, base_process="p"), grid, ks, 0.02)


def test_without_merging(series):
    ks, grid = [1, 3, 6], condition_grid([0.0, 0.3])
    check(sweep_runs(series, ks, grid, base_process="p", eps=0.0), grid, ks, 0.0)


def test_noisy_representation(series):
    ks, grid = [1, 2, 4], condition_grid([0.0, 0.1], [1, 2])
    runs = sweep_runs(series, ks, grid, base_process="p", noise_seed=7)
    check(runs, grid, ks, 0.02, noise_seed=7)
    assert {r.representation for r in runs.collect()} == {"last_1_noisy", "last_2_noisy", "last_4_noisy"}


@pytest.mark.parametrize("train_frac", [0.35, 0.999])
def test_long_history_and_split(series, train_frac):
    ks, grid = [7, 33, 60], condition_grid()
    runs = sweep_runs(series, ks, grid, base_process="p", train_frac=train_frac, eps=0.1)
    check(runs, grid, ks, 0.1, train_frac)


def test_partitioning_does_not_matter(spark, series):
    def result(partitions, layout):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        fitted = fit(layout, [2, 5], condition_grid([0.2], [1, 3]))
        return sorted(tuple(r) for r in fitted.collect())

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert result(1, series) == result(16, series.repartition(7, F.rand(1)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fine_eps_agrees_with_no_merging(series):
    """Both ways to number states give the same when eps separates all estimates."""
    counted = materialize(contexts(series, [1, 4]), "contexts")
    rows = [sorted(tuple(r) for r in assign_states(counted, eps).collect()) for eps in (0.0, 1e-9)]
    assert [[v if v is not None else -1 for v in r] for r in rows[0]] == [
        [v if v is not None else -1 for v in r] for r in rows[1]
    ]


def test_state_sequence_by_salted_join(series):
    labelled = last_k(series, 2).where("role = 'train'")
    fitted = fit(series, [2])
    small = state_sequence(labelled, fitted).collect()
    salted = state_sequence(labelled, fitted, max_broadcast_rows=0).select(
        *state_sequence(labelled, fitted).columns
    )
    assert sorted(map(tuple, small)) == sorted(map(tuple, salted.collect()))


def test_transition_probabilities_are_distributions(series):
    sums = fitted_edges(fit(series, [1, 3])).groupBy("series_id", "k", "state", "sym")
    rows = sums.agg(F.sum("p").alias("p"), F.min("p").alias("lo"), F.max("p").alias("hi")).collect()
    assert rows and all(abs(r.p - 1) < 1e-9 and r.lo > 0 and r.hi <= 1 and r.sym in (0, 1) for r in rows)


def test_bad_parameters(series):
    with pytest.raises(ValueError):
        contexts(series, [0])
    with pytest.raises(ValueError):
        condition_grid([1.5])
    with pytest.raises(ValueError):
        condition_grid([0.1], [0])
