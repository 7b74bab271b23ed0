"""The sweep: series x conditions x k, one metrics row each, in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqstates.conditions import Condition
from seqstates.functions.text import representation_name
from seqstates.operators.grams import PLAIN, contexts
from seqstates.operators.metrics import run_scores
from seqstates.operators.reconstruct import (
    RECONSTRUCTOR_NAMES,
    RECONSTRUCTORS,
    transition_counts,
    transition_probs,
)
from seqstates.sources.scratch import materialize
from seqstates.sources.tables import RUN_COLUMNS, SEED_COLUMNS


def fit(
    series: DataFrame,
    ks: Sequence[int],
    conditions: Sequence[Condition] = PLAIN,
    *,
    eps: float = 0.02,
    train_frac: float = 0.8,
    seed: int = 0,
    noise_seed: int | None = None,
    reconstructor: str = "one_step",
) -> DataFrame:
    """Contexts with their states, for every series, condition and k.

    The only step that reads the rows.  The context counts are written once per
    call: every table of the model is derived from them, some from several branches.
    A noise seed selects the noisy representation.
    """
    counted = contexts(series, ks, conditions, train_frac=train_frac, seed=seed, noise_seed=noise_seed)
    assign = RECONSTRUCTORS[reconstructor]
    return assign(materialize(counted, "contexts"), eps)


def fitted_edges(fitted: DataFrame) -> DataFrame:
    return transition_probs(transition_counts(fitted))


def _condition_fields(conditions: Sequence[Condition], base_process: str) -> list[Column]:
    """Per condition a struct of literals, with the columns it has in the runs table."""
    return [
        F.struct(
            F.lit(base_process).alias("base_process"),
            F.lit(c.process_name(base_process)).alias("process"),
            F.lit(c.condition_id).alias("condition_id"),
            F.lit(c.flip_p).alias("flip_p"),
            F.lit(c.subsample_step).alias("subsample_step"),
            F.lit(c.wrappers).alias("wrappers"),
        )
        for c in conditions
    ]


def condition_lengths(series: DataFrame, conditions: Sequence[Condition], base_process: str) -> DataFrame:
    """The grid with every series: identifiers, wrappers and symbols left per condition."""
    lengths = series.groupBy("series_id").agg(F.count("*").alias("length"))
    fields = _condition_fields(conditions, base_process)
    rows = lengths.select("*", F.inline(F.array(*fields)))
    return rows.withColumn("n_symbols", F.expr("(length + subsample_step - 1) div subsample_step"))


def run_rows(
    fitted: DataFrame,
    conditions: Sequence[Condition],
    *,
    base_process: str,
    eps: float = 0.02,
    train_frac: float = 0.8,
    noisy: bool = False,
    reconstructor: str = "one_step",
    seeds: tuple[int, int | None] | None = None,
) -> DataFrame:
    """Run rows of a `fit` result, with one row for every model, however short its series.

    `seeds`, those of the draws and of the noise bit, become columns if given.
    """
    scores = run_scores(fitted)
    ids = [F.lit(c.condition_id) for c in conditions]
    fields = _condition_fields(conditions, base_process)
    by_id = F.create_map(*[part for pair in zip(ids, fields) for part in pair])
    scores = scores.withColumn("condition", by_id[F.col("condition_id")]).drop("condition_id")
    rows = scores.select(
        "*",
        "condition.*",
        F.lit(float(train_frac)).alias("train_frac"),
        F.lit(float(eps)).alias("eps"),
        representation_name(F.col("k"), noisy).alias("representation"),
        F.lit(RECONSTRUCTOR_NAMES[reconstructor]).alias("reconstructor"),
    )
    if seeds is None:
        return rows.select(*RUN_COLUMNS)
    return rows.select(*RUN_COLUMNS, *[F.lit(s).cast("long").alias(c) for s, c in zip(seeds, SEED_COLUMNS)])


def sweep_runs(
    series: DataFrame,
    ks: Sequence[int],
    conditions: Sequence[Condition] = PLAIN,
    *,
    base_process: str,
    eps: float = 0.02,
    train_frac: float = 0.8,
    seed: int = 0,
    noise_seed: int | None = None,
    reconstructor: str = "one_step",
    keep_seeds: bool = False,
) -> DataFrame:
    """One row of the runs table per (series, condition, k); with `keep_seeds` runs of several seeds can be told apart."""
    fitted = fit(
        series,
        ks,
        conditions,
        eps=eps,
        train_frac=train_frac,
        seed=seed,
        noise_seed=noise_seed,
        reconstructor=reconstructor,
    )
    return run_rows(
        fitted,
        conditions,
        base_process=base_process,
        eps=eps,
        train_frac=train_frac,
        noisy=noise_seed is not None,
        reconstructor=reconstructor,
        seeds=(seed, noise_seed) if keep_seeds else None,
    )
