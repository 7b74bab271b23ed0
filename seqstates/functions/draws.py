"""Reproducible draws: a value depends on what is hashed, never on the partitioning.

All functions return SQL text over the columns of the row.
"""

from __future__ import annotations


def uniform(salt: str, seed: int, *parts: str) -> str:
    """Uniform double in [0, 1): the first 32 bits of an md5 over salt, seed and parts."""
    text = ", ".join([f"'{salt}'", f"'{seed}'", *[f"CAST({part} AS STRING)" for part in parts]])
    bits = f"conv(substring(md5(concat_ws(':', {text})), 1, 8), 16, 10)"
    return f"(CAST({bits} AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def flip_draw(seed: int) -> str:
    """Draw that decides on a flip; `flip_p` is left out, so smaller p flips a subset."""
    return uniform("flip", seed, "series_id", "t")


def noise_bit(seed: int, position: str = "lt") -> str:
    """Fair bit per local position, the same for all series and for train and test."""
    return f"CAST({uniform('rep', seed, position)} < 0.5 AS INT)"


def flipped(flip_p: float) -> str:
    """Symbol `x` after a flip with probability `flip_p`, given the column `draw`."""
    return f"(x ^ CAST(draw < CAST({float(flip_p)!r} AS DOUBLE) AS INT))"
