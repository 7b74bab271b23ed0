"""Edge tables: number texts, cleaning, classes, fall-backs of the metrics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqstates.conditions import Condition, condition_grid
from seqstates.functions.text import extract_k, fixed_text
from seqstates.operators import machine, metrics

EDGE = "series_id string, condition_id string, k int, state int, sym int, next_state int, c long, p double"


def edges(spark, rows):
    return spark.createDataFrame([("a", "c", 2, *r) for r in rows], EDGE)


def test_number_texts_round_like_c(spark):
    rng = random.Random(1)
    numbers = [0.0, 1.0, 0.5, 0.0625, 0.1875, 1.005, 0.0005, 0.0015, 0.9995, 0.99949999, 1e-9]
    numbers += [rng.randint(0, n) / n for n in range(1, 400)] + [i / 2000 for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in numbers], "p double")
    rows = df.select("p", fixed_text(F.col("p")).alias("three"), fixed_text(F.col("p"), 2).alias("two"), fixed_text(F.col("p"), 3, True).alias("short")).collect()
    assert df.select(fixed_text(-F.col("p")).alias("t")).where("t LIKE '-%'").count() == sum(v > 0 for v in numbers)
    for r in rows:
        assert r.three == f"{r.p:.3f}" and r.two == f"{r.p:.2f}"
        assert r.short == f"{r.p:.3f}".rstrip("0").rstrip(".")


def test_cleaning(spark):
    values = [float("nan"), float("inf"), -float("inf"), None, 1e-13, -1e-13, 1 - 1e-13, 1 + 1e-13, 0.25, 1.1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p double")
    found = [r.p for r in df.select("i", machine.clean_probability(F.col("p")).alias("p")).orderBy("i").collect()]
    assert found == [None, None, None, None, 0.0, 0.0, 1.0, 1.0, 0.25, 1.1]
    kept = df.select("i", machine.clean_probability(F.col("p"), clamp=False).alias("p")).orderBy("i").collect()
    assert [r.p for r in kept][:6] == [None, None, None, None, 1e-13, -1e-13]


ROWS = [(0, 0, 0, 2, 0.5), (0, 1, 1, 2, 0.5), (0, 0, 1, 2, 0.25), (1, 1, 0, 1, 0.3), (1, 0, 2, 1, 0.4), (2, 0, 2, 0, float("nan"))]


def test_labels_and_classes(spark):
    table = edges(spark, ROWS)
    labels = {(r.state, r.next_state): r.label for r in machine.edge_labels(table, symbol_names={1: "up"}).collect()}
    assert labels == {(0, 0): "0: 0.500", (0, 1): "0: 0.250\nup: 0.500", (1, 0): "up: 0.300", (1, 2): "0: 0.400"}
    apart = machine.edge_labels(table, merge_parallel=False, strip_trailing_zeros=True, state_names={1: "one"}).collect()
    assert sorted(r.label for r in apart) == ["0: 0.25", "0: 0.4", "0: 0.5", "1: 0.3", "1: 0.5"]
    assert {r.next_state_name for r in apart} == {"S0", "one", "S2"}
    classes = {(r.state, r.next_state): (r.edge_class, r.p_max, r.strong) for r in machine.edge_classes(table).collect()}
    assert classes == {
        (0, 0): ("self", 0.5, True),
        (0, 1): ("reciprocal", 0.5, True),
        (1, 0): ("reciprocal", 0.3, False),
        (1, 2): ("plain", 0.4, False),
    }
    assert [(r.a, r.b) for r in machine.reciprocal_pairs(table).collect()] == [(0, 1)]
    assert sorted(r.state for r in machine.machine_nodes(table).collect()) == [0, 1, 2]


def test_scores_of_an_edge_table_without_counts(spark):
    rows = [(0, 0, 0, 0, 0.5), (0, 0, 1, 0, 0.5), (1, 1, 0, 0, 1.0)]
    for table in (edges(spark, rows), edges(spark, rows).drop("c")):
        assert metrics.unifilarity(table).first().unifilarity_score == 0.75
        assert metrics.branching_entropy(table).first().branch_entropy == pytest.approx(math.log(2) / 2)
        assert metrics.branching_entropy_weighted(table, 2.0).first().branch_entropy == pytest.approx(0.5)


def test_condition_names():
    grid = condition_grid([0.0, 0.05, 1e-5], [1, 2])
    assert [c.condition_id for c in grid] == [
        "flip0_sub1", "flip0_sub2", "flip0.05_sub1", "flip0.05_sub2", "flip1e-05_sub1", "flip1e-05_sub2"]
    assert [c.wrappers for c in grid[:4]] == ["", "sub=2", "flip=0.05", "flip=0.05|sub=2"]
    assert grid[3].process_name("x") == "x_flip0.05_sub2"
    assert Condition(0.05, 2, "json").condition_id == '{"flip_p": 0.05, "subsample_step": 2}'
    assert condition_grid(flip_p=0.3) == [Condition(0.3, 1)]
    with pytest.raises(ValueError):
        Condition(style="other")


def test_extract_k(spark):
    df = spark.createDataFrame([("last_3",), ("last_12_noisy",), ("other",)], "r string")
    assert [r.k for r in df.select(extract_k(F.col("r")).alias("k")).collect()] == [3, 12, None]


def test_symbols_in_the_order_of_a_column(spark):
    edges = spark.createDataFrame([("a", "c", 1, 0, 1, 1, 0.9, 0), ("a", "c", 1, 0, 0, 1, 0.1, 1)], "series_id string, condition_id string, k int, state int, sym int, next_state int, p double, place int")
    symbols = lambda **o: [s.sym for s in machine.parallel_edges(edges, **o).first().symbols]
    assert symbols() == [0, 1] and symbols(order=F.col("place")) == [1, 0] and symbols(order=-F.col("p")) == [1, 0]


def test_listing_defaults(spark):
    grid = condition_grid([0.1, 0.2], [2, 1])
    rows = [(s, c.condition_id, 1, 0, 1, 0, c.flip_p + c.subsample_step) for s in "ba" for c in grid]
    edges = spark.createDataFrame(rows, "series_id string, condition_id string, k int, state int, sym int, next_state int, p double")
    chosen = lambda **o: machine.transition_listing(edges, "last_1", conditions=grid, **o).first()
    assert (chosen().series_id, chosen().condition_id) == ("a", "flip0.1_sub2")
    assert chosen(flip_p=0.2).condition_id == "flip0.2_sub2" and chosen(subsample_step=1, series_id="b").condition_id == "flip0.1_sub1"
    assert machine.transition_listing(edges, "last_1").count() == 0
