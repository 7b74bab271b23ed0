"""Scores of a machine for prediction, complexity and closure.

Log-loss and state count come from the fitted contexts, complexity from the
occupancy and closure from the edges; `run_scores` has all of them from the fitted
contexts in one go.  All give one row per model.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqstates.operators.grams import MODEL
from seqstates.operators.reconstruct import transition_rows

BACKOFF_P = 0.5  # probability for a test context never seen in training
MIN_P = 1e-12  # clip of predicted probabilities
MIN_PI = 1e-18  # clip of occupancies
LOSS = f"-(m1 * ln(greatest(p_one, {MIN_P!r}D)) + m0 * ln(greatest(1 - p_one, {MIN_P!r}D)))"


def _no_negative_zero(value: Column) -> Column:
    return value + F.lit(0.0)


def _state_losses(fitted: DataFrame, backoff_p: float) -> DataFrame:
    """Per state (NULL: unseen contexts): test loss in nats and number of targets."""
    per_state = fitted.groupBy(*MODEL, "state").agg(
        F.expr("max(length) AS length"),
        F.expr(f"coalesce(sum(n1) / nullif(sum(n0 + n1), 0), {float(backoff_p)!r}D) AS p_one"),
        F.expr("sum(m0) AS m0"),
        F.expr("sum(m1) AS m1"),
    )
    return per_state.withColumn("loss", F.expr(LOSS))


def prediction_scores(fitted: DataFrame, backoff_p: float = BACKOFF_P) -> DataFrame:
    """(length, logloss, n_states) of every model, those without contexts included.

    Log-loss is the mean over test positions in nats, 0 when there are none.
    """
    return _state_losses(fitted, backoff_p).groupBy(*MODEL).agg(
        F.expr("max(length) AS length"),
        F.expr("coalesce(sum(loss) / nullif(sum(m0 + m1), 0), 0D) + 0D AS logloss"),
        F.expr("CAST(count(state) AS INT) AS n_states"),
    )


def log_loss(fitted: DataFrame, backoff_p: float = BACKOFF_P) -> DataFrame:
    return prediction_scores(fitted, backoff_p).select(*MODEL, "logloss")


def n_states(fitted: DataFrame) -> DataFrame:
    return prediction_scores(fitted).select(*MODEL, "n_states")


def statistical_complexity(occupancy: DataFrame) -> DataFrame:
    """Entropy in nats of the visited states."""
    pi = F.col("pi")
    entropy = -F.sum(pi * F.ln(F.greatest(pi, F.lit(MIN_PI))))
    return occupancy.groupBy(*MODEL).agg(_no_negative_zero(entropy).alias("C_mu_empirical"))


def _per_state_symbol(edges: DataFrame) -> DataFrame:
    """Per (state, symbol): visits `w`, largest `p` and entropy `h` (nats) of the next state.

    An edge table from elsewhere may have no counts; its weights are 0.
    """
    p = F.col("p")
    weight = F.coalesce(F.sum("c"), F.lit(0)) if "c" in edges.columns else F.lit(0)
    return edges.groupBy(*MODEL, "state", "sym").agg(
        weight.alias("w"),
        F.max("p").alias("u"),
        F.sum(F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0))).alias("h"),
    )


def _weighted_or_plain_mean(value: Column) -> Column:
    """Mean weighted by visits; the plain mean when all weights are 0."""
    total = F.sum("w")
    return F.when(total > 0, F.sum(F.col("w") * value) / total).otherwise(F.avg(value))


def _unifilarity(per_key: DataFrame) -> Column:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _weighted_or_plain_mean(F.col("u"))))
    return clamped.alias("unifilarity_score")


def _entropy_in(log_base: float) -> Column:
    return F.col("h") if log_base == math.e else F.col("h") / F.lit(math.log(log_base))


def unifilarity(edges: DataFrame) -> DataFrame:
    """Visit-weighted mean of the largest next-state probability."""
    keys = _per_state_symbol(edges)
    return keys.groupBy(*MODEL).agg(_unifilarity(keys))


def branching_entropy(edges: DataFrame, log_base: float = math.e) -> DataFrame:
    """Plain mean over (state, symbol) of the entropy of the next state."""
    mean = F.avg(_entropy_in(log_base))
    return _per_state_symbol(edges).groupBy(*MODEL).agg(_no_negative_zero(mean).alias("branch_entropy"))


def branching_entropy_weighted(edges: DataFrame, log_base: float = math.e) -> DataFrame:
    """Visit-weighted mean over (state, symbol) of the entropy of the next state."""
    mean = _weighted_or_plain_mean(_entropy_in(log_base))
    return _per_state_symbol(edges).groupBy(*MODEL).agg(_no_negative_zero(mean).alias("branch_entropy"))


def run_scores(fitted: DataFrame) -> DataFrame:
    """All scores of a run row, for every model, in one chain of aggregations.

    Context rows and moves travel together, so the contexts are read once and no two
    results have to be joined.  With w visits of a (state, symbol), of which c go to
    a next state, the entropy of the next state is ln w - sum(c ln c) / w; likewise
    for the occupancy of the states.  Models without transitions score 0.
    """
    counts = ["length", "n0", "n1", "m0", "m1"]
    carried = [F.expr("max(length) AS length"), *[F.sum(c).alias(c) for c in counts[1:]]]
    rows = transition_rows(fitted, counts).where("sym IS NULL OR next_state IS NOT NULL")
    target = F.expr("if(sym IS NULL, NULL, next_state)").alias("next_state")
    rows = rows.groupBy(*MODEL, "state", "sym", target).agg(F.sum("c").alias("c"), *carried)
    rows = rows.groupBy(*MODEL, "state", "sym").agg(
        F.expr("sum(c) AS w"),
        F.expr("max(c) AS wu"),
        F.expr("if(count(*) > 1, sum(c) * ln(sum(c)) - sum(c * ln(c)), 0D) AS wh"),
        *carried,
    )
    rows = rows.groupBy(*MODEL, "state").agg(
        F.expr("sum(w) AS v"), F.expr("sum(wu) AS wu"), F.expr("sum(wh) AS wh"), *carried
    )
    rows = rows.withColumn("p_one", F.expr(f"coalesce(n1 / nullif(n0 + n1, 0), {BACKOFF_P!r}D)"))
    visited = "nullif(sum(v), 0)"
    return rows.groupBy(*MODEL).agg(
        F.expr("max(length) AS length"),
        F.expr(f"coalesce(sum({LOSS}) / nullif(sum(m0 + m1), 0), 0D) + 0D AS logloss"),
        F.expr("CAST(count(state) AS INT) AS n_states"),
        F.expr(f"greatest(0D, coalesce(ln({visited}) - sum(if(v > 0, v * ln(v), 0D)) / {visited}, 0D)) AS C_mu_empirical"),
        F.expr(f"least(1D, coalesce(sum(wu) / {visited}, 0D)) AS unifilarity_score"),
        F.expr(f"coalesce(sum(wh) / {visited} / ln(2D), 0D) + 0D AS branch_entropy"),
    )
