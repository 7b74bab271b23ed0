"""Representations as entries: the two given ones, one added here, and refusals."""

from collections import Counter

import pytest
from pyspark.errors import PySparkException

from seqstates.catalog import queries as catalog
from seqstates.conditions import Condition
from seqstates.operators import reconstruct, represent
from seqstates.plans import sweep


def rows(table):
    return sorted(map(tuple, table.select("series_id", "condition_id", "k", "state", "sym", "next_state", "c").collect()))


@pytest.mark.parametrize("key, noise_seed", [("last_k", None), ("last_k_noisy", 123)])
def test_given_entries_equal_the_built_in_ones(spark, sf_dir, key, noise_seed):
    series, conditions = catalog.ev_type(spark, sf_dir), [Condition(), Condition(0.1, 2)]
    wanted = reconstruct.transition_counts(sweep.fit(series, [1, 3], conditions, noise_seed=noise_seed))
    got = represent.represented_transitions(*represent.fit_represented(series, key, [1, 3], conditions, noise_seed=noise_seed))
    assert rows(got) == rows(wanted)


@pytest.fixture
def entry(monkeypatch):
    monkeypatch.setattr(represent, "REPRESENTATIONS", dict(represent.REPRESENTATIONS))
    return lambda reach, context: represent.register("added", represent.Representation("added_{k}", reach, context))


def test_an_added_entry(spark, entry):
    """The newest symbol and the sum of the k before it, against a walk over the series."""
    entry(lambda k: k + 1, lambda hist, k, z: f"shiftleft(CAST(bit_count(shiftright({hist}, 1)) AS BIGINT), 1) | ({hist} & 1L)")
    x = [(i * i + i // 3) % 7 % 2 for i in range(200)] + [0] * 5
    series = spark.createDataFrame([("a", t, v, len(x)) for t, v in enumerate(x)] + [("b", 0, 1, 1)], "series_id string, t long, x int, length long")
    got = represent.represented_counts(series, "added", [2], train_frac=1.0).collect()
    code = lambda t: sum(x[t - 2 : t]) * 2 + x[t]
    wanted = Counter((code(t - 1), code(t), x[t]) for t in range(3, len(x)))
    assert {(r.ctx, r.nxt, r.y): r.n_fit for r in got if r.ctx >= 0} == wanted
    assert {r.series_id for r in got if r.ctx < 0} == {"a", "b"}
    edges = represent.represented_edges(series, "added", [2], train_frac=1.0).collect()
    assert sum(e.c for e in edges) <= sum(wanted.values()) and {e.representation for e in edges} == {"added_2"}


def test_contract(spark, entry):
    series = spark.createDataFrame([("a", t, t % 2, 9) for t in range(9)], "series_id string, t long, x int, length long")
    with pytest.raises(ValueError, match="name"):
        represent.Representation("fixed", lambda k: k, lambda hist, k, z: hist)
    with pytest.raises(ValueError, match="already"):
        represent.register("last_k", represent.REPRESENTATIONS["last_k"])
    with pytest.raises(ValueError, match="noise seed"):
        represent.represented_counts(series, "last_k_noisy", [1])
    with pytest.raises(ValueError, match="reaches"):
        represent.represented_counts(series, "every_second", [40])
    entry(lambda k: k, lambda hist, k, z: f"{hist} - 1")
    with pytest.raises(PySparkException, match="context code"):
        represent.represented_counts(series, "added", [1]).collect()
