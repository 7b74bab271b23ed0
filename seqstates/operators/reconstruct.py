"""From context counts to the state machine.

All tables are keyed by MODEL = (series_id, condition_id, k).  State ids are
0, 1, 2, ... in ascending order of the next-symbol probability, per model.

No table is partitioned by MODEL before it is small: contexts and their moves are
spread by model and context, and what follows is combined on the map side to states
first.  So a single model with very many contexts keeps all tasks busy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqstates.functions.codes import context_noise, context_text, is_text, no_context, successor
from seqstates.operators.grams import MODEL
from seqstates.sources.scratch import materialize, release, sized_join
from seqstates.sources.series import range_index

MAX_GATHERED = 2_000_000  # contexts of a model whose estimates one array may hold
MAX_SEARCHED = 10_000  # anchors of a model that every context may search


def is_noisy(contexts: DataFrame) -> bool:
    return "c00" in contexts.columns


def _transition_columns(contexts: DataFrame) -> list[tuple[str, int, int | None]]:
    """(count column, symbol, next noise bit) of every kind of transition."""
    if is_noisy(contexts):
        return [(f"c{y}{z}", y, z) for y in (0, 1) for z in (0, 1)]
    return [(f"c{y}", y, None) for y in (0, 1)]


def shown_context(table: DataFrame, noisy: bool) -> list[Column]:
    """The context as text, and the noise bit of a noisy one."""
    as_text = is_text(table)
    text = context_text(F.col("ctx"), F.col("k"), noisy, as_text).alias("ctx")
    return [text, context_noise(F.col("ctx"), True, as_text).alias("z")] if noisy else [text]


def context_stats(contexts: DataFrame) -> DataFrame:
    """Support `n`, ones `n1` and estimate `p_hat` of every context seen in training."""
    n = F.col("n0") + F.col("n1")
    seen = contexts.where((F.col("ctx") != F.expr(no_context(is_text(contexts)))) & (n > 0))
    return seen.select(*MODEL, "ctx", n.alias("n"), "n1", (F.col("n1") / n).alias("p_hat"))


def _gathers(contexts: DataFrame, eps: float, max_gathered: int) -> bool:
    """Whether the distinct estimates of a model may meet in one array.

    The rows of the contexts, which a count of a written table gives without a shuffle, bound
    the estimates.  With a fine `eps` the anchors may be as many as the estimates, and each
    context would search them all.
    """
    most = contexts.count()
    if most > max_gathered or (most > MAX_SEARCHED and eps * MAX_SEARCHED < 1):
        most = contexts.groupBy(*MODEL).count().agg(F.max("count")).first()[0] or 0
    return most <= max_gathered and (most <= MAX_SEARCHED or eps * MAX_SEARCHED >= 1)


def greedy_anchors(stats: DataFrame, eps: float, max_gathered: int = MAX_GATHERED) -> DataFrame:
    """First `p_hat` of every bin, ascending, as one array per model.

    A bin takes in estimates while they are within `eps` of its first one.  Up to
    `max_gathered` contexts in a model its distinct estimates are folded in one array; with
    more the anchors are found by `linked_anchors`, where no task ever holds those of a
    model.  Both give the same anchors, 1/eps + 1 of them at most.
    """
    estimates = stats.select(*MODEL, "p_hat").distinct()
    if _gathers(stats, eps, max_gathered):
        return _folded_anchors(estimates, eps)
    linked = linked_anchors(materialize(estimates, "estimates"), eps)
    return linked.groupBy(*MODEL).agg(F.sort_array(F.collect_list("p_hat")).alias("anchors"))


def _folded_anchors(estimates: DataFrame, eps: float) -> DataFrame:
    def extend(anchors: Column, p: Column) -> Column:
        last = F.get(anchors, F.size(anchors) - 1)
        starts_bin = (F.size(anchors) == 0) | (F.abs(p - last) > F.lit(float(eps)))
        return F.when(starts_bin, F.concat(anchors, F.array(p))).otherwise(anchors)

    ascending = F.sort_array(F.collect_list("p_hat"))
    anchors = F.aggregate(ascending, F.array().cast("array<double>"), extend)
    return estimates.groupBy(*MODEL).agg(anchors.alias("anchors"))


def _farthest_within(eps: float) -> Column:
    """The largest double whose difference from `p_hat`, as a double, is at most `eps`.

    `p_hat + eps` is at most one double away from it; the candidates are its neighbours.
    """
    total = F.col("p_hat") + F.lit(float(eps))
    step = total * F.lit(0.6 * 2.0**-52)  # rounds to the next double, up or down
    near = F.array(total - step, total, total + step)
    return F.coalesce(F.array_max(F.filter(near, lambda x: x - F.col("p_hat") <= F.lit(float(eps)))), F.col("p_hat"))


def _successors(estimates: DataFrame, eps: float) -> DataFrame:
    """(MODEL, p_hat, next): the smallest estimate more than `eps` above each that has one.

    Estimates and the ends of their bins are laid out in one range-partitioned sort; the
    next estimate behind an end lies in its range, or is the first of a later range.
    """
    rows = estimates.withColumn("end", _farthest_within(eps)).selectExpr(
        *MODEL,
        "inline(array(struct(p_hat AS at, false AS asks, p_hat), struct(end AS at, true AS asks, p_hat)))",
    )
    keys = [*MODEL, "at", "asks"]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id())
    laid = materialize(laid, "ends").withColumn("part", F.shiftright("pos", 33))
    estimate = F.expr("if(asks, NULL, at)")
    heads = laid.groupBy(*MODEL, "part").agg(F.min(estimate).alias("head"))
    later = Window.partitionBy(*MODEL).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    heads = heads.select(*MODEL, "part", F.min("head").over(later).alias("later"))
    behind = Window.partitionBy("part", *MODEL).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    found = laid.withColumn("here", F.min(estimate).over(behind)).where("asks")
    found = sized_join(found, heads, [*MODEL, "part"]).withColumn("next", F.coalesce("here", "later"))
    return found.where("next IS NOT NULL").select(*MODEL, "p_hat", "next")


def linked_anchors(estimates: DataFrame, eps: float) -> DataFrame:
    """(MODEL, p_hat) of the anchors, from a written table of the distinct estimates.

    The anchors are the chain of successors from the smallest estimate on.  Each round
    doubles the reach of all links and adds to the anchors found what their links reach, so
    the rounds grow with the logarithm of 1/eps.  Links and anchors are keyed by model and
    estimate, so a model of any size is spread over all tasks.
    """
    links = materialize(_successors(estimates, eps), "links")
    found = materialize(estimates.groupBy(*MODEL).agg(F.min("p_hat").alias("p_hat")), "anchors")
    while True:
        reached = links.join(found, [*MODEL, "p_hat"]).select(*MODEL, F.col("next").alias("p_hat"))
        reached = materialize(reached, "reached")
        if reached.isEmpty():
            return found
        longer = materialize(found.union(reached), "anchors")
        further = links.select(*MODEL, F.col("p_hat").alias("next"), F.col("next").alias("further"))
        doubled = materialize(links.join(further, [*MODEL, "next"]).select(*MODEL, "p_hat", F.col("further").alias("next")), "links")
        release(links, found, reached)
        links, found = doubled, longer


def _linked_states(contexts: DataFrame, eps: float) -> DataFrame:
    """(MODEL, p_hat, state) of every distinct estimate: how many anchors lie below or at it, less one."""
    estimates = materialize(context_stats(contexts).select(*MODEL, "p_hat").distinct(), "estimates")
    anchors = linked_anchors(estimates, eps).withColumn("starts", F.lit(1))
    marked = estimates.join(anchors, [*MODEL, "p_hat"], "left").fillna(0, ["starts"])
    keys = [*MODEL, "p_hat"]
    laid = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id())
    laid = materialize(laid, "marked").withColumn("part", F.shiftright("pos", 33))
    parts = laid.groupBy(*MODEL, "part").agg(F.sum("starts").alias("c"))
    before = F.sum("c").over(Window.partitionBy(*MODEL).orderBy("part")) - F.col("c")
    running = Window.partitionBy("part", *MODEL).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    counted = laid.withColumn("place", F.sum("starts").over(running))
    counted = sized_join(counted, parts.select(*MODEL, "part", before.alias("before")), [*MODEL, "part"])
    return counted.select(*keys, (F.col("before") + F.col("place") - 1).cast("int").alias("state"))


def _bins_up_to(p: Column) -> Column:
    """Number of anchors up to `p`: searched among every 64th, then in one block."""
    blocks = F.filter("anchors", lambda a, i: (i % 64 == 0) & (a <= p))
    block = F.greatest(F.size(blocks), F.lit(1)) - 1
    return block * 64 + F.size(F.filter(F.slice("anchors", block * 64 + 1, F.lit(64)), lambda a: a <= p))


def assign_states(contexts: DataFrame, eps: float = 0.02, max_gathered: int = MAX_GATHERED) -> DataFrame:
    """Add `p_hat` and `state` to a written `contexts` table.

    `state` is NULL for contexts seen only in the test part and for the row that
    stands for the model.  With `eps` 0 every distinct estimate is a state, numbered by
    a range-partitioned sort; so are the bins of models that are too large, or whose `eps`
    is too fine, for an array of anchors.
    """
    if not eps >= 0:
        raise ValueError(f"eps is a distance of probabilities, got {eps}")
    n = F.col("n0") + F.col("n1")
    estimated = contexts.withColumn("p_hat", F.when(n > 0, F.col("n1") / n))
    if eps == 0:
        distinct = context_stats(contexts).select(*MODEL, "p_hat").distinct()
        keyed = distinct.select(F.struct(*MODEL).alias("series_id"), "p_hat")
        ranked = range_index(keyed, ["p_hat"], keep=["p_hat"])
        ranked = ranked.select("series_id.*", "p_hat", F.col("t").cast("int").alias("state"))
        return sized_join(estimated, ranked, [*MODEL, "p_hat"], how="left").select(*estimated.columns, "state")
    if not _gathers(contexts, eps, max_gathered):
        states = _linked_states(contexts, eps)
        return sized_join(estimated, states, [*MODEL, "p_hat"], salt="hash(ctx)", how="left").select(*estimated.columns, "state")
    anchors = _folded_anchors(context_stats(contexts).select(*MODEL, "p_hat").distinct(), eps)
    joined = sized_join(estimated, anchors, MODEL, salt="hash(ctx)", how="left")
    state = F.when(F.col("p_hat").isNotNull(), _bins_up_to(F.col("p_hat")) - 1)
    return joined.withColumn("state", state).drop("anchors")


RECONSTRUCTORS = {"one_step": assign_states}
RECONSTRUCTOR_NAMES = {"one_step": "one_step_greedy_merge"}


def context_states(fitted: DataFrame) -> DataFrame:
    """State of every context seen in training."""
    noisy = is_noisy(fitted)
    seen = fitted.where(F.col("state").isNotNull())
    n = (F.col("n0") + F.col("n1")).alias("n")
    return seen.select(*MODEL, *shown_context(seen, noisy), n, "n1", "p_hat", "state")


def state_probabilities(fitted: DataFrame) -> DataFrame:
    """P(next symbol = 1) of every state, pooled over its contexts by their support."""
    seen = fitted.where(F.col("state").isNotNull())
    n, n1 = F.sum(F.col("n0") + F.col("n1")), F.sum("n1")
    return seen.groupBy(*MODEL, "state").agg((n1 / n).alias("p_one"), n.alias("n"))


def transition_rows(fitted: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Rows of (state, sym, next_state, c), and one row per context with `sym` NULL.

    The next context follows from the context and the symbol, so the counts of the
    contexts are enough.  Its state is found by sending each move to the next
    context, where a window over a context's own row and its few moves hands over the
    state.  The rows of the contexts keep the columns in
    `carry`, which are NULL for moves.
    """
    names = ["ctx", "own_state", "state", "sym", "c", *carry]
    message = "named_struct(" + ", ".join(f"'{name}', {{}}" for name in names) + ")"
    no_int, no_count = "CAST(NULL AS INT)", ["CAST(NULL AS BIGINT)"] * len(carry)
    messages = [message.format("ctx", "state", "state", no_int, "0L", *carry)]
    for column, y, z in _transition_columns(fitted):
        messages.append(message.format(successor(y, z, is_text(fitted)), no_int, "state", y, column, *no_count))
    sent = fitted.selectExpr(*MODEL, f"inline(array({', '.join(messages)}))").where("sym IS NULL OR c > 0")
    return sent.withColumn("next_state", F.max("own_state").over(Window.partitionBy(*MODEL, "ctx")))


def transition_counts(fitted: DataFrame) -> DataFrame:
    """Visits `c` of (state, symbol, next state)."""
    moves = transition_rows(fitted.where("state IS NOT NULL")).where("sym IS NOT NULL AND next_state IS NOT NULL")
    return moves.groupBy(*MODEL, "state", "sym", "next_state").agg(F.sum("c").alias("c"))


def state_occupancy(transitions: DataFrame) -> DataFrame:
    """Share `pi` of the visited positions per state.

    A model may have as many states as contexts, so its total is combined on the map side
    and joined, not summed in a window that would gather the model in one task.
    """
    counts = materialize(transitions.groupBy(*MODEL, "state").agg(F.sum("c").alias("c")), "occupancy")
    totals = counts.groupBy(*MODEL).agg(F.sum("c").alias("total"))
    return sized_join(counts, totals, MODEL, salt="state").withColumn("pi", F.col("c") / F.col("total")).drop("total")


def transition_probs(transitions: DataFrame) -> DataFrame:
    """Edge table: probability `p` of the next state given state and symbol."""
    total = F.sum("c").over(Window.partitionBy(*MODEL, "state", "sym"))
    return transitions.withColumn("p", F.col("c") / total)


def state_symbol_counts(transitions: DataFrame) -> DataFrame:
    """Visits `w` of every (state, symbol)."""
    return transitions.groupBy(*MODEL, "state", "sym").agg(F.sum("c").alias("w"))


def state_sequence(labelled: DataFrame, fitted: DataFrame, **options) -> DataFrame:
    """State of every position of `last_k` rows, for the same k.

    Contexts unseen in training have no state and their positions are left out.
    """
    noisy = is_noisy(fitted)
    seen = fitted.where(F.col("state").isNotNull())
    states = seen.select("series_id", "condition_id", *shown_context(seen, noisy), "state")
    keys = ["series_id", "condition_id", "ctx"] + (["z"] if noisy else [])
    return sized_join(labelled, states, keys, salt="t", **options)
