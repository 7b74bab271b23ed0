"""One query per operator, over whole tables of a data folder.

`oracle.py` has the same results as plain SQL.  Sums of doubles are rounded to 10
decimals, as their last bits depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqstates.conditions import Condition, condition_grid
from seqstates.functions.text import extract_k
from seqstates.operators import grams, machine, metrics, perturb, reconstruct, represent
from seqstates.operators.grams import MODEL, PLAIN
from seqstates.plans import analysis, sweep
from seqstates.sources import tables
from seqstates.sources.scratch import materialize, scratch_path
from seqstates.sources.series import bucketed_index, symbol_series

Query = Callable[[SparkSession, str], DataFrame]

EPS = 0.02
NOISE_SEED = 123
KS = range(1, 7)
GRID = condition_grid([0.0, 0.1, 0.2], [1, 2])
RUN_DOUBLES = ["logloss", "C_mu_empirical", "unifilarity_score", "branch_entropy"]
SUMMARY_DOUBLES = [f"{m}_{s}" for m in analysis.METRICS for s in ("mean", "std")]

_queries: dict[str, Query] = {}


def query(function: Query) -> Query:
    _queries[function.__name__.rstrip("_")] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_queries)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 10) + F.lit(0.0) for c in columns})


# Series ---------------------------------------------------------------------------


def ev_type(spark: SparkSession, sf_dir: str, latent: bool = False) -> DataFrame:
    """Five series of events, by type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    label = F.floor(F.col("value") / 25) if latent else None
    return symbol_series(events, ["event_type"], ["ts", "event_id"], F.col("value") > 35, latent=label)


def ord_prio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five series of orders, by priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return symbol_series(orders, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], F.col("o_totalprice") > 250000)


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]


def li_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series of line items per supplier."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return symbol_series(lines, ["l_suppkey"], LINE_ORDER, F.col("l_quantity") > 25)


def li_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as one long series, numbered day by day."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.unix_date(F.to_date("l_shipdate"))
    return bucketed_index(lines, LINE_ORDER, F.col("l_quantity") > 25, day)


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many series of a few symbols: who speaks in a conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return symbol_series(turns, ["conv_id"], ["turn"], F.col("role") == "user")


# Sources and row transforms -------------------------------------------------------


@query
def symbol_series_(spark, sf_dir):
    return ev_type(spark, sf_dir, latent=True)


@query
def bucketed_index_(spark, sf_dir):
    return li_all(spark, sf_dir)


@query
def minute_buckets(spark, sf_dir):
    """All events as one series in buckets of a minute, whose offsets are summed in two levels."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    return bucketed_index(events, ["ts", "event_id"], F.col("value") > 35, minute, max_window_buckets=0)


@query
def range_index(spark, sf_dir):
    """The write-once numbering that splits a series of any size over tasks."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    order = ["o_orderdate", "o_orderkey"]
    return symbol_series(orders, ["o_orderstatus"], order, F.col("o_totalprice") > 250000, method="range")


@query
def flip_noise(spark, sf_dir):
    return perturb.flip_noise(ev_type(spark, sf_dir), 0.2)


@query
def subsample(spark, sf_dir):
    return perturb.subsample(ev_type(spark, sf_dir, latent=True), 3)


@query
def flip_then_subsample(spark, sf_dir):
    return perturb.perturb_grid(ev_type(spark, sf_dir), [Condition(0.1, 2), Condition(0.3, 3)])


@query
def train_test_split(spark, sf_dir):
    return perturb.train_test_split(ev_type(spark, sf_dir), 0.8)


@query
def noise_bit(spark, sf_dir):
    split = perturb.train_test_split(ev_type(spark, sf_dir), 0.8)
    return perturb.add_noise_bit(split, NOISE_SEED).select("series_id", "t", "role", "lt", "z")


@query
def last_k(spark, sf_dir):
    return grams.last_k(ev_type(spark, sf_dir), 3)


@query
def last_k_long(spark, sf_dir):
    """Histories of more than one word."""
    return grams.last_k(ord_prio(spark, sf_dir), 70)


@query
def last_k_noisy(spark, sf_dir):
    return grams.last_k(ev_type(spark, sf_dir), 2, noise_seed=NOISE_SEED)


@query
def next_symbol(spark, sf_dir):
    return grams.next_symbol(ord_prio(spark, sf_dir))


# Reconstruction -------------------------------------------------------------------


@query
def gram_counts(spark, sf_dir):
    counts = grams.histories(ev_type(spark, sf_dir), 4, GRID)
    return grams.gram_counts(counts, range(1, 5))


@query
def gram_counts_noisy(spark, sf_dir):
    counts = grams.histories(ev_type(spark, sf_dir), 3, noise_seed=NOISE_SEED)
    return grams.gram_counts(counts, [1, 2, 3], noisy=True)


@query
def gram_counts_long(spark, sf_dir):
    counts = grams.histories(li_all(spark, sf_dir), 10)
    return grams.gram_counts(counts, range(1, 11))


def _fit(spark, sf_dir, **options):
    return sweep.fit(ev_type(spark, sf_dir), KS, eps=EPS, **options)


def _transitions(spark, sf_dir):
    return reconstruct.transition_counts(_fit(spark, sf_dir))


def _edges(spark, sf_dir):
    return sweep.fitted_edges(_fit(spark, sf_dir))


@query
def context_stats(spark, sf_dir):
    counted = grams.contexts(li_supp(spark, sf_dir), [1, 2, 3])
    stats = reconstruct.context_stats(counted)
    return stats.select(*MODEL, *reconstruct.shown_context(stats, False), "n", "n1", "p_hat")


@query
def greedy_anchors(spark, sf_dir):
    counted = grams.contexts(ev_type(spark, sf_dir), KS)
    anchors = reconstruct.greedy_anchors(reconstruct.context_stats(counted), EPS)
    return anchors.select(*MODEL, F.posexplode("anchors").alias("state", "anchor"))


@query
def linked_anchors(spark, sf_dir):
    """The anchors of models that no array could hold."""
    counted = materialize(grams.contexts(ev_type(spark, sf_dir), KS), "contexts")
    estimates = materialize(reconstruct.context_stats(counted).select(*MODEL, "p_hat").distinct(), "estimates")
    return reconstruct.linked_anchors(estimates, EPS).withColumnRenamed("p_hat", "anchor")


@query
def context_states_linked(spark, sf_dir):
    counted = materialize(grams.contexts(ev_type(spark, sf_dir), KS), "contexts")
    return reconstruct.context_states(reconstruct.assign_states(counted, EPS, max_gathered=0))


@query
def context_states(spark, sf_dir):
    return reconstruct.context_states(_fit(spark, sf_dir))


@query
def context_states_noisy(spark, sf_dir):
    return reconstruct.context_states(_fit(spark, sf_dir, noise_seed=NOISE_SEED))


@query
def state_probabilities(spark, sf_dir):
    return reconstruct.state_probabilities(_fit(spark, sf_dir))


@query
def transition_counts(spark, sf_dir):
    return _transitions(spark, sf_dir)


@query
def state_occupancy(spark, sf_dir):
    return reconstruct.state_occupancy(_transitions(spark, sf_dir))


@query
def every_second_edges(spark, sf_dir):
    """Machines whose contexts hold every second symbol of the past."""
    return represent.represented_edges(ev_type(spark, sf_dir), "every_second", [1, 2, 3], GRID, eps=EPS)


@query
def transition_probs(spark, sf_dir):
    return reconstruct.transition_probs(_transitions(spark, sf_dir))


@query
def state_symbol_counts(spark, sf_dir):
    return reconstruct.state_symbol_counts(_transitions(spark, sf_dir))


@query
def state_sequence(spark, sf_dir):
    """State of every training position that starts a transition."""
    series = ev_type(spark, sf_dir)
    labelled = grams.last_k(series, 3, transitions_only=True).where("role = 'train'")
    return reconstruct.state_sequence(labelled, sweep.fit(series, [3], eps=EPS))


# Metrics --------------------------------------------------------------------------


@query
def log_loss(spark, sf_dir):
    return rounded(metrics.log_loss(_fit(spark, sf_dir)), "logloss")


@query
def statistical_complexity(spark, sf_dir):
    occupancy = reconstruct.state_occupancy(_transitions(spark, sf_dir))
    return rounded(metrics.statistical_complexity(occupancy), "C_mu_empirical")


@query
def n_states(spark, sf_dir):
    return metrics.n_states(_fit(spark, sf_dir))


@query
def unifilarity(spark, sf_dir):
    return rounded(metrics.unifilarity(_edges(spark, sf_dir)), "unifilarity_score")


@query
def branching_entropy(spark, sf_dir):
    return rounded(metrics.branching_entropy(_edges(spark, sf_dir)), "branch_entropy")


@query
def branching_entropy_weighted(spark, sf_dir):
    return rounded(metrics.branching_entropy_weighted(_edges(spark, sf_dir), 2.0), "branch_entropy")


# State machines -------------------------------------------------------------------


@query
def edge_list(spark, sf_dir):
    return machine.edge_list(_edges(spark, sf_dir))


@query
def edges_for_representation(spark, sf_dir):
    return machine.edges_for_representation(_edges(spark, sf_dir), "last_3")


@query
def machine_nodes(spark, sf_dir):
    return machine.machine_nodes(_edges(spark, sf_dir))


@query
def reciprocal_pairs(spark, sf_dir):
    return machine.reciprocal_pairs(_edges(spark, sf_dir))


@query
def parallel_edges(spark, sf_dir):
    merged = machine.parallel_edges(_edges(spark, sf_dir))
    opened = merged.select(*MODEL, "state", "next_state", F.posexplode("symbols").alias("place", "s"))
    return opened.select(*MODEL, "state", "next_state", "place", "s.sym", "s.p")


@query
def clean_probabilities(spark, sf_dir):
    """On edges whose probabilities are made invalid or slightly off in some rows."""
    p = F.col("p")
    off = (
        F.when(F.col("c") % 5 == 0, F.lit(float("nan")))
        .when(F.col("c") % 5 == 1, F.lit(1.0) + F.lit(1e-13))
        .when(F.col("c") % 5 == 2, F.lit(-1e-13))
        .otherwise(p)
    )
    cleaned = machine.clean_probabilities(_edges(spark, sf_dir).withColumn("p", off))
    return cleaned.withColumn("p", F.col("p") + F.lit(0.0))


@query
def edge_labels(spark, sf_dir):
    return machine.edge_labels(_edges(spark, sf_dir), symbol_names={1: "high"}, state_names={0: "low"}, separator=", ")


@query
def edge_classes(spark, sf_dir):
    return machine.edge_classes(_edges(spark, sf_dir))


@query
def transition_listing(spark, sf_dir):
    return machine.transition_listing(_edges(spark, sf_dir), "last_5", "click", Condition().condition_id)


# Sweep ----------------------------------------------------------------------------


@query
def condition_grid_(spark, sf_dir):
    return sweep.condition_lengths(ev_type(spark, sf_dir), GRID, "ev_type")


@query
def condition_ids(spark, sf_dir):
    """Both styles of condition ids, with the symbols that each condition leaves."""
    grid = [Condition(c.flip_p, c.subsample_step, style) for c in GRID for style in ("flip_sub", "json")]
    return sweep.condition_lengths(ord_prio(spark, sf_dir), grid, "ord_prio").select(
        "series_id", "condition_id", "wrappers", "process", "n_symbols"
    )


def _runs(spark, sf_dir, source=ev_type, name="ev_type", ks=KS, conditions=PLAIN, **options):
    return sweep.sweep_runs(source(spark, sf_dir), ks, conditions, base_process=name, **options)


@query
def sweep_runs(spark, sf_dir):
    return rounded(_runs(spark, sf_dir, conditions=GRID), *RUN_DOUBLES)


@query
def sweep_runs_long(spark, sf_dir):
    return rounded(_runs(spark, sf_dir, li_all, "li_all", range(1, 11)), *RUN_DOUBLES)


@query
def sweep_runs_long_histories(spark, sf_dir):
    return rounded(_runs(spark, sf_dir, ord_prio, "ord_prio", [2, 61, 70]), *RUN_DOUBLES)


@query
def sweep_runs_one_series(spark, sf_dir):
    """One series and up to 2^16 contexts in a model."""
    return rounded(_runs(spark, sf_dir, li_all, "li_all", [12, 16]), *RUN_DOUBLES)


@query
def sweep_runs_fine_bins(spark, sf_dir):
    return rounded(_runs(spark, sf_dir, ord_prio, "ord_prio", eps=1e-4), *RUN_DOUBLES)


@query
def sweep_runs_noisy(spark, sf_dir):
    return rounded(_runs(spark, sf_dir, ord_prio, "ord_prio", [1, 2, 3], noise_seed=NOISE_SEED), *RUN_DOUBLES)


@query
def sweep_runs_unmerged(spark, sf_dir):
    """eps = 0: every distinct estimate is a state."""
    return rounded(_runs(spark, sf_dir, ord_prio, "ord_prio", eps=0.0), *RUN_DOUBLES)


@query
def sweep_runs_many(spark, sf_dir):
    return rounded(_runs(spark, sf_dir, li_supp, "li_supp", [1, 2, 3, 4]), *RUN_DOUBLES)


@query
def sweep_runs_short(spark, sf_dir):
    """Series too short for some k keep their rows, with the scores of an empty model."""
    return rounded(_runs(spark, sf_dir, conv, "conv", [1, 2, 3, 8]), *RUN_DOUBLES)


@query
def stored_runs(spark, sf_dir):
    """A store of runs that is written twice: some models of one condition are replaced, others are added, the rest stays."""
    path = scratch_path(spark, "runs-store")
    tables.put_runs(_runs(spark, sf_dir, ks=[1, 2, 3], conditions=GRID), path, ["series_id", "k"])
    tables.put_runs(_runs(spark, sf_dir, ks=[2, 3, 4], conditions=GRID[1:2], eps=0.1), path, ["series_id", "k"])
    return rounded(tables.read_stored(spark, path, tables.RUN_SCHEMA), *RUN_DOUBLES)


@query
def stored_edges(spark, sf_dir):
    """A store of edges: one representation first, another one later, then the first anew with wider bins."""
    path = scratch_path(spark, "edges-store")
    series = ev_type(spark, sf_dir)
    for k, eps in ((2, EPS), (3, EPS), (2, 0.1)):
        edges = sweep.fitted_edges(sweep.fit(series, [k], eps=eps))
        tables.put_edges(edges, path)
        schema = machine.edges_for_representation(edges).schema
    return rounded(tables.read_stored(spark, path, schema), "p")


@query
def resumed_runs(spark, sf_dir):
    """A sweep over stored runs: only series that the store lacks are computed."""
    path = scratch_path(spark, "runs-store")
    series = materialize(ev_type(spark, sf_dir), "series")
    tables.put_runs(sweep.sweep_runs(series.where("series_id < 'd'"), [1, 2], base_process="ev_type"), path)
    wanted = series.select("series_id").distinct()
    fresh = series.join(tables.not_stored(wanted, path, ["series_id"]), "series_id", "left_semi")
    tables.put_runs(sweep.sweep_runs(fresh, [1, 2], base_process="ev_type"), path)
    return rounded(tables.read_stored(spark, path, tables.RUN_SCHEMA), *RUN_DOUBLES)


@query
def read_back_runs(spark, sf_dir):
    """Runs of two draws, kept apart by their seeds, written as text and read with a check of every cell."""
    path = scratch_path(spark, "runs-csv")
    noisy = [Condition(0.2, 1)]
    for seed in (0, 1):
        runs = _runs(spark, sf_dir, ks=[1, 2], conditions=noisy, seed=seed, keep_seeds=True)
        tables.append_table(runs.where("draw_seed = 0"), path, "csv")
    return rounded(tables.read_runs(spark, path), *RUN_DOUBLES)


@query
def extract_k_(spark, sf_dir):
    """k recovered from the names of plain and noisy representations."""
    plain = _runs(spark, sf_dir, ks=[1, 2, 12])
    noisy = _runs(spark, sf_dir, ks=[3], noise_seed=NOISE_SEED)
    names = plain.select("series_id", "representation").union(noisy.select("series_id", "representation"))
    return names.withColumn("k", extract_k(F.col("representation")))


# Analysis -------------------------------------------------------------------------


def _summary(spark, sf_dir):
    return analysis.summarise(_runs(spark, sf_dir, conditions=GRID), ordered=False)


@query
def summary_by_condition(spark, sf_dir):
    return rounded(analysis.summarise(_runs(spark, sf_dir, conditions=GRID)), *SUMMARY_DOUBLES)


@query
def summary_simple(spark, sf_dir):
    kept = [c for c in SUMMARY_DOUBLES if c in analysis.SIMPLE_COLUMNS]
    return rounded(analysis.summary_simple(_summary(spark, sf_dir)), *kept)


@query
def filter_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir, conditions=GRID)
    kept = analysis.filter_runs(runs, subsample_step=2, base_process="ev_type", representation="last_3")
    return rounded(kept, *RUN_DOUBLES)


@query
def filter_flip_tolerance(spark, sf_dir):
    runs = _runs(spark, sf_dir, conditions=GRID)
    return rounded(analysis.filter_runs(runs, flip_ps=[0.1 + 1e-13, 0.2 + 1e-9]), *RUN_DOUBLES)


@query
def metric_vs_k(spark, sf_dir):
    summary = materialize(_summary(spark, sf_dir), "summary")
    step_one = analysis.filter_runs(summary, subsample_step=1)
    return rounded(analysis.metric_vs_k(step_one, ["branch_entropy", "unifilarity_score", "logloss"]), "mean", "std")


@query
def phase_grid(spark, sf_dir):
    return rounded(analysis.phase_grid(_summary(spark, sf_dir)), "branch_entropy", "one_minus_unifilarity")


@query
def phase_grid_wide(spark, sf_dir):
    wide = analysis.phase_grid_wide(_summary(spark, sf_dir), list(KS), "omu")
    wide = wide.withColumnsRenamed({str(k): f"k{k}" for k in KS})
    return rounded(wide, *[f"k{k}" for k in KS])


@query
def closure_mask(spark, sf_dir):
    mask = analysis.closure_mask(_summary(spark, sf_dir))
    return rounded(mask, "branch_entropy", "one_minus_unifilarity")


@query
def closure_report(spark, sf_dir):
    """The curves of a report, each point with whether its cell is closed."""
    report = analysis.closure_report(_runs(spark, sf_dir, conditions=GRID), flip_ps=[0.0, 0.2])
    closed = report["phase"].where("subsample_step = 1").select("flip_p", "k", "closed")
    return rounded(report["metric_vs_k"].join(closed, ["flip_p", "k"]), "mean", "std")
