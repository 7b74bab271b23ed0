"""Codes of contexts: the last k symbols, oldest first.

Up to `WORD_K` symbols, and the noise bit below them if there is one, are the bits of one
BIGINT.  If the longest k of a call is larger, all its contexts are texts of 0 and 1, with
the noise bit as last letter.  The type of the `ctx` column tells which; results are the
same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD_K = 60


def is_text(table: DataFrame, column: str = "ctx") -> bool:
    return isinstance(table.schema[column].dataType, StringType)


def no_context(text: bool) -> str:
    """SQL text: code of the row that stands for the model itself."""
    return "''" if text else "-1L"


def last_symbols(hist: str, k: str, z: str | None, text: bool) -> str:
    """SQL text: the context of the last `k` symbols of a history."""
    if text:
        return f"right({hist}, {k})" if z is None else f"concat(right({hist}, {k}), {z})"
    code = f"{hist} & (shiftleft(1L, {k}) - 1)"
    return code if z is None else f"shiftleft({code}, 1) | {z}"


def successor(y: int, z_next: int | None = None, text: bool = False) -> str:
    """SQL text: the context after `ctx` and symbol `y` (and noise bit `z_next`)."""
    if text:
        return f"concat(substring(ctx, 2, k - 1), '{y}{'' if z_next is None else z_next}')"
    symbols = "ctx" if z_next is None else "shiftright(ctx, 1)"
    moved = f"(shiftleft({symbols}, 1) | {y}L) & (shiftleft(1L, k) - 1)"
    return moved if z_next is None else f"shiftleft({moved}, 1) | {z_next}L"


def context_text(ctx: Column, k: Column, noisy: bool = False, text: bool = False) -> Column:
    """Symbols of a context as text, oldest first, e.g. '101'."""
    if text:
        return F.left(ctx, k)
    symbols = F.shiftright(ctx, 1) if noisy else ctx
    return F.lpad(F.bin(symbols), k, F.lit("0"))


def context_noise(ctx: Column, noisy: bool = False, text: bool = False) -> Column:
    """Noise bit of a context; NULL for a plain representation."""
    if noisy and text:
        return F.right(ctx, F.lit(1)).cast("int")
    return ctx.bitwiseAND(F.lit(1)).cast("int") if noisy else F.lit(None).cast("int")
