"""Names and number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def representation_name(k: Column, noisy: bool = False) -> Column:
    return F.concat(F.lit("last_"), k.cast("string"), F.lit("_noisy" if noisy else ""))


def extract_k(representation: Column) -> Column:
    """k from a representation name, NULL when the name has none."""
    return F.nullif(F.regexp_extract(representation, "last_([0-9]+)", 1), F.lit("")).cast("int")


def representation_family(representation: Column) -> Column:
    """Name without its k, e.g. last_k_noisy: the same for all columns of a grid."""
    return F.regexp_replace(representation, "last_[0-9]+", "last_k")


def fixed_text(value: Column, precision: int = 3, strip_zeros: bool = False) -> Column:
    """Fixed-point text that rounds the binary value, ties to even, as C and Python do.

    `format_string` and `format_number` round the decimal text of the value.  Here the
    rounding error of the scaled value decides where the scaled value is a tie; it is
    exact, as a split of the value into 26-bit halves makes all products exact.
    """
    scale = 10**precision
    size = F.abs(value)
    scaled = size * F.lit(float(scale))
    high = size * F.lit(134217729.0) - (size * F.lit(134217729.0) - size)
    error = (high * F.lit(float(scale)) - scaled) + (size - high) * F.lit(float(scale))
    whole = F.floor(scaled)
    rest = scaled - whole
    tie_up = (error > 0) | ((error == 0) & (whole % 2 == 1))
    digits = whole + ((rest > 0.5) | ((rest == 0.5) & tie_up)).cast("long")
    after = digits % scale
    parts = [F.when(value < 0, "-").otherwise(""), ((digits - after) / scale).cast("long").cast("string")]
    if precision > 0:
        parts += [F.lit("."), F.lpad(after.cast("string"), precision, "0")]
    text = F.concat(*parts)
    if not strip_zeros:
        return text
    text = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.when(text == "-0", F.lit("0")).otherwise(text)
