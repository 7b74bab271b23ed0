"""Counts of (context, next symbol), for all conditions and all k, from one pass.

Every model table is a function of these counts.  The plan:

1. `pack_words`: 62 consecutive symbols become the bits of one BIGINT.  The rows
   arrive in series order, so the map-side aggregation already shrinks them about
   62-fold and the shuffle carries words, not symbols.  All flip probabilities
   share the pass: each adds an aggregate column, not a copy of the rows.
2. `with_halo`: each word gets the symbols before it from the word before it.
3. `positions`: each word yields its positions with the history before them.
   Needs no window and no order, so one long series spreads over all tasks.
4. `histories`: counts per distinct history of the longest k.  Hot histories
   collapse on the map side.
5. `contexts` / `gram_counts`: only then one copy per k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqstates.functions.codes import WORD_K, context_noise, context_text, is_text, last_symbols, no_context
from seqstates.functions.draws import flip_draw, noise_bit
from seqstates.operators.perturb import flipped, split_position
from seqstates.conditions import Condition, distinct_ids

WORD = 62
MODEL = ["series_id", "condition_id", "k"]
PLAIN = (Condition(),)


def check_ks(ks: Sequence[int]) -> list[int]:
    ks = sorted(set(int(k) for k in ks))
    if not ks or ks[0] < 1:
        raise ValueError("k must be at least 1")
    return ks


def pack_words(series: DataFrame, conditions: Sequence[Condition] = PLAIN, seed: int = 0) -> DataFrame:
    """(series_id, t, x, length) -> (series_id, step, w, bits0, bits1, ..., length, n).

    Word `w` holds positions 62w .. 62w+61 of the series subsampled by `step`, the
    oldest in the highest bit, once per flip probability in ascending order.
    `length` is that of the series and `n` the one after subsampling.
    """
    distinct_ids(conditions)
    steps = sorted({c.subsample_step for c in conditions})
    flips = _flips(conditions)
    if flips[-1] > 0:
        series = series.withColumn("draw", F.expr(flip_draw(seed)))
    if len(steps) > 1:
        kept = ", ".join(f"if(t % {step} = 0, {step}, NULL)" for step in steps)
        rows = series.selectExpr("*", f"explode(array({kept})) AS step").where("step IS NOT NULL")
    else:
        rows = series.selectExpr("*", f"{steps[0]} AS step").where(f"t % {steps[0]} = 0")
    bits = []
    for i, flip_p in enumerate(flips):
        x = flipped(flip_p) if flip_p > 0 else "x"
        bit = f"shiftleft(CAST({x} AS BIGINT), CAST({WORD - 1} - t div step % {WORD} AS INT))"
        bits.append(F.expr(f"bit_or({bit})").alias(f"bits{i}"))
    words = rows.groupBy("series_id", "step", F.expr(f"t div step div {WORD}").alias("w"))
    words = words.agg(F.max("length").alias("length"), *bits)
    return words.withColumn("n", F.expr("(length + step - 1) div step"))


def _flips(conditions: Sequence[Condition]) -> list[float]:
    return sorted({c.flip_p for c in conditions})


def with_halo(words: DataFrame, conditions: Sequence[Condition], reach: int = 1) -> DataFrame:
    """One row per condition and word: (series_id, condition_id, w, bits, halo, [earlier,] length, n).

    `halo` is the word before, zero for the first.  Every word is sent to itself and
    to its `reach` successors; that many rows and one more meet per key.  With a reach
    over 1, `earlier` holds the symbols of all these words before as text.  The partition count is set here, as a
    word row grows 62-fold in `positions` and sizing by the bytes of the words would
    leave too few tasks.
    """
    flips = _flips(conditions)
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [f"if(ahead = {a}, bits{i}, NULL) AS b{i}_{a}" for i in range(len(flips)) for a in range(reach + 1)]
    sent = words.selectExpr("*", f"explode(sequence(0, {reach})) AS ahead")
    sent = sent.selectExpr("series_id", "step", "w + ahead AS w", "length", "n", *columns)
    sent = sent.where(f"w * {WORD} < n")  # there is no word after the last
    sent = sent.withColumn("place", F.expr("xxhash64(series_id, step, w)")).repartition(partitions, "place")
    both = sent.groupBy("place", "series_id", "step", "w").agg(
        F.max("length").alias("length"),
        F.max("n").alias("n"),
        *[F.expr(f"coalesce(max(b{i}_{a}), 0L) AS b{i}_{a}") for i in range(len(flips)) for a in range(reach + 1)],
    )
    versions = []
    for c in conditions:
        i = flips.index(c.flip_p)
        fields = [F.lit(c.condition_id).alias("condition_id"), F.expr(f"b{i}_0 AS bits"), F.expr(f"b{i}_1 AS halo")]
        if reach > 1:
            shown = ", ".join(f"lpad(bin(b{i}_{a}), {WORD}, '0')" for a in range(reach, 0, -1))
            fields.append(F.expr(f"concat({shown}) AS earlier"))
        versions.append(F.when(F.col("step") == c.subsample_step, F.struct(*fields)))
    rows = both.select("series_id", "w", "length", "n", F.explode(F.array(*versions)).alias("v"))
    return rows.where("v IS NOT NULL").select("series_id", "v.*", "w", "length", "n")


def positions(
    series: DataFrame,
    k_max: int,
    conditions: Sequence[Condition] = PLAIN,
    train_frac: float = 0.8,
    seed: int = 0,
    noise_seed: int | None = None,
) -> DataFrame:
    """One row per symbol `y`, with the up to `k_max` symbols before it.

    `t` is the position of `y` in the series and `lt` the one within train or
    test, of `n_role` symbols.  History never crosses the split: `hist_len` is
    `least(k_max, lt)`.  With a noise seed, `z` is the noise bit of the position
    before `y` and `z_next` that of `y`.
    """
    text = k_max > WORD_K
    words = with_halo(pack_words(series, conditions, seed), conditions, max(2, -(-k_max // WORD)) if text else 1)
    rows = words.selectExpr(
        "*",
        f"{split_position('n', train_frac)} AS split",
        f"w * {WORD} AS first",
        f"explode(sequence(0, CAST(least({WORD}L, n - w * {WORD}) - 1 AS INT))) AS i",
    )
    noise = []
    if noise_seed is not None:
        noise = [f"{noise_bit(noise_seed, 'lt - 1')} AS z", f"{noise_bit(noise_seed, 'lt')} AS z_next"]
    # The word before, moved up by i, then the first i symbols of the word itself.
    hist = f"(shiftleft(halo, i) | shiftrightunsigned(bits, {WORD} - i)) & (shiftleft(1L, hist_len) - 1) AS hist"
    if text:
        hist = f"right(concat(earlier, left(lpad(bin(bits), {WORD}, '0'), i)), hist_len) AS hist"
    return rows.selectExpr(
        "series_id",
        "condition_id",
        "length",
        "n",
        "first + i AS t",
        "first + i >= split AS test",
        "first + i - if(test, split, 0L) AS lt",
        "if(test, n - split, split) AS n_role",
        f"CAST(least({k_max}L, lt) AS INT) AS hist_len",
        hist,
        f"CAST(shiftrightunsigned(bits, {WORD - 1} - i) & 1 AS INT) AS y",
        *noise,
    )


def histories(
    series: DataFrame,
    k_max: int,
    conditions: Sequence[Condition] = PLAIN,
    train_frac: float = 0.8,
    seed: int = 0,
    noise_seed: int | None = None,
) -> DataFrame:
    """Counts per distinct (history, next symbol) of each series, condition and role.

    `n_fit` counts all targets; `n_trans` leaves out the last one of a role, whose
    successor context has no target of its own.
    """
    rows = positions(series, k_max, conditions, train_frac, seed, noise_seed)
    keys = ["series_id", "condition_id", "test", "hist_len", "hist", "y"]
    keys += ["z", "z_next"] if noise_seed is not None else []
    return rows.groupBy(*keys).agg(
        F.max("length").alias("length"),
        F.count("*").alias("n_fit"),
        F.count_if(F.col("lt") <= F.col("n_role") - 2).alias("n_trans"),
    )


def _per_k(counts: DataFrame, ks: Sequence[int], noisy: bool, keep_start: bool) -> DataFrame:
    """One copy of the counts per k whose context they determine.

    With `keep_start` the first position of a role, which has no history, goes to
    every k and stands for the model.
    """
    start = " OR hist_len = 0" if keep_start else ""
    fitting = ", ".join(f"if(hist_len >= {k}{start}, {k}, NULL)" for k in ks)
    rows = counts.selectExpr("*", f"explode(array({fitting})) AS k").where("k IS NOT NULL")
    text = is_text(counts, "hist")
    ctx = last_symbols("hist", "k", "z" if noisy else None, text)
    return rows.withColumn("ctx", F.expr(f"if(hist_len >= k, {ctx}, {no_context(text)})"))


def gram_counts(counts: DataFrame, ks: Sequence[int], noisy: bool = False) -> DataFrame:
    """(series_id, condition_id, k, role, ctx, [z,] y) -> n_fit, n_trans; `ctx` as text."""
    rows = _per_k(counts, check_ks(ks), noisy, keep_start=False)
    keys = [*MODEL, "test", "ctx", "y"]
    grams = rows.groupBy(*keys).agg(F.sum("n_fit").alias("n_fit"), F.sum("n_trans").alias("n_trans"))
    columns = [*MODEL, F.when(F.col("test"), "test").otherwise("train").alias("role")]
    text = is_text(grams)
    columns.append(context_text(F.col("ctx"), F.col("k"), noisy, text).alias("ctx"))
    if noisy:
        columns.append(context_noise(F.col("ctx"), True, text).alias("z"))
    return grams.select(*columns, "y", "n_fit", "n_trans")


def contexts(
    series: DataFrame,
    ks: Sequence[int],
    conditions: Sequence[Condition] = PLAIN,
    *,
    train_frac: float = 0.8,
    seed: int = 0,
    noise_seed: int | None = None,
) -> DataFrame:
    """One row per model and context with all counts the model needs.

    `n0`, `n1` count the training targets after the context, `m0`, `m1` the test
    targets, `c<y>` (or `c<y><z_next>`) the training transitions.  One more row per
    model, with `ctx` -1 and no counts, keeps models without contexts.
    """
    ks = check_ks(ks)
    noisy = noise_seed is not None
    counts = histories(series, ks[-1], conditions, train_frac, seed, noise_seed)
    rows = _per_k(counts, ks, noisy, keep_start=True)

    def total(column: str, condition: str, name: str) -> Column:
        counted = f"ctx != {no_context(is_text(rows))} AND {condition}"
        return F.expr(f"coalesce(sum({column}) FILTER (WHERE {counted}), 0L)").alias(name)

    sums = [F.max("length").alias("length")]
    for y in (0, 1):
        sums.append(total("n_fit", f"NOT test AND y = {y}", f"n{y}"))
        sums.append(total("n_fit", f"test AND y = {y}", f"m{y}"))
        if noisy:
            sums += [total("n_trans", f"NOT test AND y = {y} AND z_next = {z}", f"c{y}{z}") for z in (0, 1)]
        else:
            sums.append(total("n_trans", f"NOT test AND y = {y}", f"c{y}"))
    return rows.groupBy(*MODEL, "ctx").agg(*sums)


def last_k(
    series: DataFrame,
    k: int,
    conditions: Sequence[Condition] = PLAIN,
    *,
    train_frac: float = 0.8,
    seed: int = 0,
    noise_seed: int | None = None,
    transitions_only: bool = False,
) -> DataFrame:
    """Context and next symbol at every position that has both.

    `t` is the position of the context's last symbol; `next_x` follows it.  With
    `transitions_only` the last position of train and test is left out, as no
    transition starts there.
    """
    k = check_ks([k])[0]
    rows = positions(series, k, conditions, train_frac, seed, noise_seed)
    rows = rows.where(F.col("hist_len") >= k)
    if transitions_only:
        rows = rows.where(F.col("lt") <= F.col("n_role") - 2)
    columns = ["series_id", "condition_id", F.when(F.col("test"), "test").otherwise("train").alias("role")]
    columns += [(F.col("t") - 1).alias("t"), (F.col("lt") - 1).alias("lt")]
    columns.append(context_text(F.col("hist"), F.lit(k), text=is_text(rows, "hist")).alias("ctx"))
    if noise_seed is not None:
        columns.append("z")
    return rows.select(*columns, F.col("y").alias("next_x"))


def next_symbol(series: DataFrame) -> DataFrame:
    """Each symbol with the one after it; the last symbol of a series has none."""
    pairs = last_k(series, 1, train_frac=1.0)
    return pairs.select("series_id", "t", F.col("ctx").cast("int").alias("x"), "next_x")
