"""Row transforms of symbol series: observation noise, subsampling, noise bits.

All are narrow: they read `t` of the row they change and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqstates.conditions import Condition, distinct_ids
from seqstates.functions.draws import flip_draw, flipped, noise_bit


def flip_noise(series: DataFrame, flip_p: float, seed: int = 0) -> DataFrame:
    """Flip each symbol with probability `flip_p`; latent labels stay."""
    Condition(flip_p=flip_p)  # checks the probability
    drawn = series.withColumn("draw", F.expr(flip_draw(seed)))
    return drawn.withColumn("x", F.expr(flipped(flip_p))).drop("draw")


def subsample(series: DataFrame, step: int) -> DataFrame:
    """Keep positions 0, step, 2*step, ... with their labels and number them anew."""
    Condition(subsample_step=step)  # checks the step
    kept = series.where(F.col("t") % step == 0)
    return kept.withColumns(
        {"t": F.expr(f"t div {int(step)}"), "length": F.expr(f"(length + {int(step) - 1}) div {int(step)}")}
    )


def perturb(series: DataFrame, condition: Condition, seed: int = 0) -> DataFrame:
    """Flip first, subsample second.

    The draw belongs to the position before subsampling, so dropping rows before
    the hash is computed gives the same symbols for less work.
    """
    kept = series.where(F.col("t") % condition.subsample_step == 0)
    noisy = flip_noise(kept, condition.flip_p, seed) if condition.flip_p > 0 else kept
    return subsample(noisy, condition.subsample_step)


def perturb_grid(series: DataFrame, conditions: Sequence[Condition], seed: int = 0) -> DataFrame:
    """Rows of every condition, keyed by `condition_id`, from one pass over the series."""
    distinct_ids(conditions)
    if any(c.flip_p > 0 for c in conditions):
        series = series.withColumn("draw", F.expr(flip_draw(seed)))
    versions = []
    for c in conditions:
        step = int(c.subsample_step)
        fields = [
            F.lit(c.condition_id).alias("condition_id"),
            F.expr(f"t div {step} AS t"),
            F.expr(f"{flipped(c.flip_p) if c.flip_p > 0 else 'x'} AS x"),
            F.expr(f"(length + {step - 1}) div {step} AS length"),
        ]
        versions.append(F.when(F.col("t") % step == 0, F.struct(*fields)))
    rest = [c for c in series.columns if c not in ("series_id", "t", "x", "length", "draw")]
    rows = series.select("series_id", *rest, F.explode(F.array(*versions)).alias("v"))
    return rows.where("v IS NOT NULL").select("series_id", "v.*", *rest)


def train_test_split(series: DataFrame, train_frac: float = 0.8) -> DataFrame:
    """Add `role` and the position `lt` within train or test.

    The first trunc(n * train_frac) symbols are for training, n being the length
    after perturbation.
    """
    split = split_position("length", train_frac)
    return series.withColumns(
        {
            "role": F.expr(f"if(t < {split}, 'train', 'test')"),
            "lt": F.expr(f"if(t < {split}, t, t - {split})"),
        }
    )


def split_position(length: str, train_frac: float) -> str:
    """Number of training symbols, as SQL text: truncated in double arithmetic."""
    if not 0.0 <= train_frac <= 1.0:
        raise ValueError(f"train_frac is a share of the series, got {train_frac}")
    return f"CAST(CAST({length} AS DOUBLE) * CAST({float(train_frac)!r} AS DOUBLE) AS BIGINT)"


def add_noise_bit(series: DataFrame, noise_seed: int = 123, position: str = "lt") -> DataFrame:
    """Add the auxiliary bit `z` of the noisy representation."""
    return series.withColumn("z", F.expr(noise_bit(noise_seed, position)))
