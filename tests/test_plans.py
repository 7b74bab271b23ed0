"""What the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from seqstates.catalog import queries as catalog
from seqstates.operators import reconstruct
from seqstates.operators.grams import contexts, histories
from seqstates.operators.reconstruct import assign_states, context_stats, greedy_anchors, linked_anchors, state_occupancy, transition_counts, transition_rows
from seqstates.plans.sweep import run_rows
from seqstates.operators.grams import PLAIN
from seqstates.sources.scratch import materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def long_series(spark, sf_dir):
    return catalog.li_all(spark, sf_dir)


def test_counting_reads_only_its_columns_and_needs_no_python(long_series):
    text = plan(histories(long_series, 10))
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
    assert "l_extendedprice" not in text and "l_comment" not in text
    # rows; written bucket counts to their sums and to the join; words, halo, histories
    assert text.count("Exchange hashpartitioning") + text.count("Exchange SinglePartition") == 6


def test_contexts_spread_by_model_and_context(long_series):
    counted = materialize(contexts(long_series, [1, 2]), "contexts")
    text = plan(run_rows(assign_states(counted), PLAIN, base_process="p"))
    shuffles = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert "ctx" in shuffles[-1] and "REPARTITION" not in text  # the one below all others
    assert text.count("Scan parquet") <= 2  # the contexts once, and the anchors
    assert "Python" not in text and "Cartesian" not in text


def test_one_model_fills_all_partitions(spark, long_series):
    counted = materialize(contexts(long_series, [12]), "contexts")
    moves = transition_rows(assign_states(counted))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        by_partition = moves.groupBy(F.spark_partition_id()).agg(F.count("*").alias("rows"), F.max("next_state"))
        sizes = [r["rows"] for r in by_partition.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_no_model_is_gathered_for_its_total(long_series):
    """Nothing is dealt out by model alone, at eps 0 neither, where a model has very many states."""
    counted = materialize(contexts(long_series, [12]), "contexts")
    found = state_occupancy(transition_counts(assign_states(counted, 0.0)))
    text = plan(found)
    assert "Window" not in text and "Exchange hashpartitioning" not in text
    assert abs(found.agg(F.sum("pi")).first()[0] - 1) < 1e-9


@pytest.mark.parametrize("eps", [0.05, 0.3])
def test_linked_anchors_equal_the_fold(long_series, eps):
    stats = context_stats(materialize(contexts(long_series, [3, 8]), "contexts"))
    fold, linked = greedy_anchors(stats, eps), greedy_anchors(stats, eps, max_gathered=0)
    assert sorted(map(str, fold.collect())) == sorted(map(str, linked.collect()))


@pytest.mark.parametrize("eps", [0.05, 0.3])
def test_states_by_linked_anchors_equal_the_search(long_series, eps):
    counted = materialize(contexts(long_series, [3, 8]), "contexts")
    search, linked = assign_states(counted, eps), assign_states(counted, eps, max_gathered=0)
    assert search.exceptAll(linked).isEmpty() and linked.exceptAll(search).isEmpty()
    assert "Window" not in plan(search)


def test_fine_eps_takes_few_rounds(spark, monkeypatch):
    """1,900 bins, on differences that lie at eps but for their rounding too; no array holds the estimates."""
    rounds = []
    monkeypatch.setattr(reconstruct, "materialize", lambda df, label: rounds.append(label) or materialize(df, label))
    eps, ends = 0.0005, {}
    values = {"even": [i * 0.0005 for i in range(2000)], "ratios": sorted({i / n for n in range(1, 120) for i in range(n + 1)})}
    for name, ascending in values.items():
        ends[name] = []
        for p in ascending:
            if not ends[name] or p - ends[name][-1] > eps:
                ends[name].append(p)
    rows = [(name, "c", 1, p) for name, v in values.items() for p in v]
    estimates = spark.createDataFrame(rows, "series_id string, condition_id string, k int, p_hat double")
    found = linked_anchors(materialize(estimates, "estimates"), eps)
    got = {name: sorted(r.p_hat for r in found.where(F.col("series_id") == name).collect()) for name in values}
    assert got == ends and max(len(v) for v in ends.values()) > 900
    assert rounds.count("reached") <= 12
