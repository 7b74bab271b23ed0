"""Known structures, built from the events in SQL: what the scores have to be."""

import math

import pytest
from pyspark.sql import functions as F

from seqstates.plans.sweep import sweep_runs
from seqstates.sources.series import as_symbol_series, bucketed_index


@pytest.fixture(scope="module")
def runs(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    day = F.unix_date(F.to_date("ts"))
    base = bucketed_index(events, ["ts", "event_id"], F.col("value") > 35, day).select("t", F.col("x").alias("b"))
    base.createOrReplaceTempView("base_bits")
    series = spark.sql("""
        SELECT 'coin' AS series_id, t, b AS x FROM base_bits
        UNION ALL SELECT 'periodic', t, int(t % 3 = 0) FROM base_bits
        UNION ALL SELECT 'no_two_zeros', c.t, 1 - int(c.b = 0 AND coalesce(p.b, 0) = 1)
                  FROM base_bits c LEFT JOIN base_bits p ON p.t = c.t - 1""")
    found = sweep_runs(as_symbol_series(series), [1, 2, 3], base_process="known", eps=0.03)
    return {(r.series_id, r.k): r for r in found.collect()}


def entropy(p):
    return -p * math.log(p) - (1 - p) * math.log(1 - p)


def test_coin(runs):
    for k in (1, 2):
        r = runs["coin", k]
        assert (r.n_states, r.unifilarity_score, r.branch_entropy) == (1, 1.0, 0.0)
        assert r.logloss == pytest.approx(math.log(2), abs=0.01) and r.C_mu_empirical == 0.0
        assert math.copysign(1, r.C_mu_empirical) == 1


def test_periodic(runs):
    one, two = runs["periodic", 1], runs["periodic", 2]
    assert one.n_states == two.n_states == 2
    assert one.logloss == pytest.approx(2 / 3 * math.log(2), abs=1e-3)
    assert (one.unifilarity_score, one.branch_entropy) == (1.0, 0.0)
    assert two.logloss == pytest.approx(0.0, abs=1e-9)
    assert two.C_mu_empirical == pytest.approx(entropy(1 / 3), abs=1e-3)
    assert two.unifilarity_score == pytest.approx(2 / 3, abs=1e-3)
    assert two.branch_entropy == pytest.approx(2 / 3, abs=1e-3)


def test_no_two_zeros(runs):
    one, two = runs["no_two_zeros", 1], runs["no_two_zeros", 2]
    assert (one.n_states, one.unifilarity_score, one.branch_entropy) == (2, 1.0, 0.0)
    assert one.logloss == pytest.approx(0.75 * entropy(1 / 3), abs=0.02)
    assert one.C_mu_empirical == pytest.approx(entropy(0.25), abs=0.02)
    assert two.n_states == 3 and two.unifilarity_score == 1.0


def test_ranges(runs):
    for r in runs.values():
        assert 0 <= r.unifilarity_score <= 1 and 0 <= r.branch_entropy < 10 and math.isfinite(r.logloss)
        if r.unifilarity_score > 0.999:
            assert r.branch_entropy < 1e-2
