"""Representations: what of the past a context holds.

A representation is an entry of `REPRESENTATIONS`; new ones are added with `register`.  It
tells how many symbols it reaches back and how a context is coded from them.  The context
that follows need not be a function of context and symbol, as for every second symbol: the
counting step knows the whole history, so it codes both contexts and counts the moves between
them.  Counts, moves and states are spread by context; no table is gathered by model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqstates.conditions import Condition
from seqstates.functions.codes import WORD_K
from seqstates.operators.grams import MODEL, PLAIN, check_ks, histories
from seqstates.operators.reconstruct import RECONSTRUCTORS, transition_probs
from seqstates.sources.scratch import materialize, sized_join


@dataclass(frozen=True)
class Representation:
    """`name` holds `{k}`.  `reach(k)` is the number of symbols that a context of `k` is made of.

    `context(hist, k, z)` is SQL text for its code, a BIGINT from 0: `hist` has the last
    `reach(k)` symbols as bits, the newest lowest, and `z` is the noise bit of the newest
    position, given only to a `noisy` representation.
    """

    name: str
    reach: Callable[[int], int]
    context: Callable[[str, int, str | None], str]
    noisy: bool = False

    def __post_init__(self) -> None:
        if "{k}" not in self.name:
            raise ValueError(f"a representation's name holds {{k}}, got {self.name!r}")

    def checked_reach(self, k: int) -> int:
        reach = self.reach(k)
        if not 1 <= reach <= WORD_K:
            raise ValueError(f"{self.name} reaches {reach} symbols back for k {k}; 1 to {WORD_K} are possible")
        return reach


def _every_second(hist: str, k: int, z: str | None) -> str:
    return " | ".join(f"shiftleft(shiftright({hist}, {2 * j}) & 1L, {j})" for j in range(k))


REPRESENTATIONS: dict[str, Representation] = {}


def register(key: str, representation: Representation) -> Representation:
    """Add a representation; a key that is taken is refused."""
    if key in REPRESENTATIONS:
        raise ValueError(f"there is a representation {key!r} already")
    return REPRESENTATIONS.setdefault(key, representation)


register("last_k", Representation("last_{k}", lambda k: k, lambda hist, k, z: hist))
register("last_k_noisy", Representation("last_{k}_noisy", lambda k: k, lambda hist, k, z: f"shiftleft({hist}, 1) | {z}", noisy=True))
register("every_second", Representation("every_second_{k}", lambda k: 2 * k - 1, _every_second))


def represented_counts(
    series: DataFrame,
    key: str,
    ks: Sequence[int],
    conditions: Sequence[Condition] = PLAIN,
    *,
    train_frac: float = 0.8,
    seed: int = 0,
    noise_seed: int | None = None,
) -> DataFrame:
    """(MODEL, ctx, nxt, y, test) -> n_fit, n_trans, length, of the representation `key`.

    `nxt` is the context after the symbol `y`.  One more row per model, with `ctx` -1 and no
    counts, keeps models without contexts.  A context code that is NULL or negative ends the job.
    """
    form = REPRESENTATIONS[key]
    if form.noisy != (noise_seed is not None):
        raise ValueError(f"{form.name} {'needs a' if form.noisy else 'has no'} noise seed")
    reaches = {k: form.checked_reach(k) for k in check_ks(ks)}
    counts = histories(series, max(reaches.values()), conditions, train_frac, seed, noise_seed)
    versions = []
    for k, reach in reaches.items():
        masks = (f"(hist & {(1 << reach) - 1}L)", f"((shiftleft(hist, 1) | CAST(y AS BIGINT)) & {(1 << reach) - 1}L)")
        ctx, nxt = (form.context(h, k, z) for h, z in zip(masks, ("z", "z_next") if form.noisy else (None, None)))
        codes = [f"if(({c}) >= 0, CAST({c} AS BIGINT), raise_error('a context code of {form.name} is no number from 0'))" for c in (ctx, nxt)]
        seen = F.expr(f"struct({k} AS k, {codes[0]} AS ctx, {codes[1]} AS nxt)")
        start = F.expr(f"struct({k} AS k, -1L AS ctx, -1L AS nxt)")
        versions.append(F.when(F.col("hist_len") >= reach, seen).when(F.col("hist_len") == 0, start))
    rows = counts.select("*", F.explode(F.array(*versions)).alias("v")).where("v IS NOT NULL").select("*", "v.*")

    def total(column: str) -> Column:
        return F.sum(F.expr(f"if(ctx >= 0, {column}, 0L)")).alias(column)

    return rows.groupBy(*MODEL, "ctx", "nxt", "y", "test").agg(total("n_fit"), total("n_trans"), F.max("length").alias("length"))


def fit_represented(
    series: DataFrame,
    key: str,
    ks: Sequence[int],
    conditions: Sequence[Condition] = PLAIN,
    *,
    eps: float = 0.02,
    reconstructor: str = "one_step",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Contexts with their states, and the moves (MODEL, ctx, sym, nxt, c) of the training part.

    The counts are written once; both tables are derived from them.
    """
    counts = materialize(represented_counts(series, key, ks, conditions, **options), "represented")
    parts = [(f"{'m' if test else 'n'}{y}", f"y = {y} AND {'' if test else 'NOT '}test") for y in (0, 1) for test in (False, True)]
    sums = [F.expr(f"coalesce(sum(n_fit) FILTER (WHERE {which}), 0L)").alias(name) for name, which in parts]
    contexts = counts.groupBy(*MODEL, "ctx").agg(F.max("length").alias("length"), *sums)
    moves = counts.where("NOT test AND ctx >= 0 AND n_trans > 0")
    moves = moves.select(*MODEL, "ctx", F.col("y").alias("sym"), "nxt", F.col("n_trans").alias("c"))
    return RECONSTRUCTORS[reconstructor](materialize(contexts, "contexts"), eps), moves


def represented_transitions(fitted: DataFrame, moves: DataFrame) -> DataFrame:
    """Visits `c` of (state, symbol, next state)."""
    states = fitted.where("state IS NOT NULL").select(*MODEL, "ctx", "state")
    after = states.select(*MODEL, F.col("ctx").alias("nxt"), F.col("state").alias("next_state"))
    found = sized_join(sized_join(moves, states, [*MODEL, "ctx"], salt="hash(nxt)"), after, [*MODEL, "nxt"], salt="hash(ctx)")
    return found.groupBy(*MODEL, "state", "sym", "next_state").agg(F.sum("c").alias("c"))


def represented_edges(series: DataFrame, key: str, ks: Sequence[int], conditions: Sequence[Condition] = PLAIN, **options) -> DataFrame:
    """Edge table of the machines, with the name of the representation."""
    edges = transition_probs(represented_transitions(*fit_represented(series, key, ks, conditions, **options)))
    name = F.replace(F.lit(REPRESENTATIONS[key].name), F.lit("{k}"), F.col("k").cast("string"))
    return edges.withColumn("representation", name)
