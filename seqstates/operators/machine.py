"""Edge tables: node sets, reciprocal pairs, labels and listings of state machines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqstates.conditions import Condition
from seqstates.functions.text import fixed_text, representation_name
from seqstates.operators.grams import MODEL, PLAIN

PROB_EPSILON = 1e-12
STRONG_P = 0.5


def edge_list(edges: DataFrame) -> DataFrame:
    return edges.select(*MODEL, "state", "sym", "next_state", "p")


def edges_for_representation(edges: DataFrame, representation: str | None = None, noisy: bool = False) -> DataFrame:
    """Edges with the representation's name, restricted to one if given."""
    named = edges.withColumn("representation", representation_name(F.col("k"), noisy))
    return named if representation is None else named.where(F.col("representation") == representation)


def machine_nodes(edges: DataFrame) -> DataFrame:
    """States at either end of an edge, each once."""
    ends = F.explode(F.array("state", "next_state")).alias("state")
    return edges.select(*MODEL, ends).distinct()


def reciprocal_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs a < b with an edge in both directions.

    A pair is reciprocal when both directions occur among its edges, which one
    aggregation tells without joining the edges to themselves.
    """
    low, high = F.least("state", "next_state"), F.greatest("state", "next_state")
    crossing = edges.where(F.col("state") != F.col("next_state"))
    pairs = crossing.groupBy(*MODEL, low.alias("a"), high.alias("b")).agg(
        F.bool_or(F.col("state") < F.col("next_state")).alias("up"),
        F.bool_or(F.col("state") > F.col("next_state")).alias("down"),
    )
    return pairs.where("up and down").select(*MODEL, "a", "b")


def clean_probability(p: Column, clamp: bool = True, eps: float = PROB_EPSILON) -> Column:
    """NULL for NaN and infinities; values within `eps` of 0 or 1 snap to them."""
    value = p.cast("double")
    infinite = value.isin(float("inf"), float("-inf"))
    finite = F.when(~F.isnan(value) & ~infinite, value)
    if not clamp:
        return finite
    nearest = F.rint(finite)
    snaps = nearest.isin(0.0, 1.0) & finite.between(nearest - eps, nearest + eps)
    return F.when(snaps, nearest + 0.0).otherwise(finite)


def clean_probabilities(edges: DataFrame, clamp: bool = True, eps: float = PROB_EPSILON) -> DataFrame:
    return edges.withColumn("p", clean_probability(F.col("p"), clamp, eps))


def parallel_edges(edges: DataFrame, merge_parallel: bool = True, order: Column | None = None) -> DataFrame:
    """Symbols and probabilities per (state, next state), by ascending symbol or by another column of the edges.

    Rows of a table have no order of their own, so edges that should keep the one in which
    they were listed need a column with their place, `order`; ties go by symbol.
    A binary machine has at most two edges between two states, so the gathered
    arrays have at most two entries.  Not merged, each edge is a row of its own.
    """
    keys = [*MODEL, "state", "next_state"]
    symbols = F.struct("sym", "p")
    if merge_parallel:
        placed = F.struct(F.col("sym").alias("place") if order is None else order.alias("place"), "sym", "p")
        gathered = F.sort_array(F.collect_list(placed))
        return edges.groupBy(*keys).agg(F.transform(gathered, lambda e: F.struct(e["sym"].alias("sym"), e["p"].alias("p"))).alias("symbols"))
    return edges.select(*keys, F.array(symbols).alias("symbols"))


def _named(value: Column, names: Mapping[int, str] | None, default: Column) -> Column:
    """Name of a value; the mapping is a short one given by the caller."""
    if not names:
        return default
    pairs = [F.lit(part) for item in names.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), default)


def state_name(state: Column, names: Mapping[int, str] | None = None, prefix: str = "S") -> Column:
    return _named(state, names, F.concat(F.lit(prefix), state.cast("string")))


def edge_labels(
    edges: DataFrame,
    *,
    symbol_names: Mapping[int, str] | None = None,
    state_names: Mapping[int, str] | None = None,
    merge_parallel: bool = True,
    precision: int = 3,
    strip_trailing_zeros: bool = False,
    clamp: bool = True,
    eps: float = PROB_EPSILON,
    separator: str = "\n",
    state_prefix: str = "S",
) -> DataFrame:
    """Label text `sym: p` per drawn edge; edges without a usable probability are left out."""
    usable = clean_probabilities(edges, clamp, eps).where(F.col("p").isNotNull())

    def line(item: Column) -> Column:
        symbol = _named(item["sym"], symbol_names, item["sym"].cast("string"))
        return F.concat(symbol, F.lit(": "), fixed_text(item["p"], precision, strip_trailing_zeros))

    return parallel_edges(usable, merge_parallel).select(
        *MODEL,
        "state",
        "next_state",
        state_name(F.col("state"), state_names, state_prefix).alias("state_name"),
        state_name(F.col("next_state"), state_names, state_prefix).alias("next_state_name"),
        F.array_join(F.transform("symbols", line), separator).alias("label"),
    )


def edge_classes(edges: DataFrame) -> DataFrame:
    """Per drawn edge: self / reciprocal / plain, largest probability, and whether it is strong.

    Both directions of a pair meet in one aggregation, so no join is needed.
    """
    low, high = F.least("state", "next_state"), F.greatest("state", "next_state")
    up = F.col("state") < F.col("next_state")
    # Reciprocity looks at all edges, also those whose probability is unusable.
    marked = edges.withColumn("p", clean_probability(F.col("p")))
    pairs = marked.groupBy(*MODEL, low.alias("a"), high.alias("b")).agg(
        F.bool_or(up).alias("has_up"),
        F.bool_or(F.col("state") > F.col("next_state")).alias("has_down"),
        F.max(F.when(F.col("state") <= F.col("next_state"), F.col("p"))).alias("p_up"),
        F.max(F.when(F.col("state") > F.col("next_state"), F.col("p"))).alias("p_down"),
    )
    directions = F.array(
        F.struct(F.col("a").alias("state"), F.col("b").alias("next_state"), F.col("p_up").alias("p_max")),
        F.struct(F.col("b").alias("state"), F.col("a").alias("next_state"), F.col("p_down").alias("p_max")),
    )
    drawn = pairs.select(*MODEL, (F.col("has_up") & F.col("has_down")).alias("both"), F.explode(directions).alias("d"))
    drawn = drawn.select(*MODEL, "both", "d.*").where(F.col("p_max").isNotNull())
    kind = F.when(F.col("state") == F.col("next_state"), "self").when(F.col("both"), "reciprocal").otherwise("plain")
    strength = F.greatest(F.lit(0.0), F.col("p_max"))
    return drawn.select(
        *MODEL,
        "state",
        "next_state",
        kind.alias("edge_class"),
        strength.alias("p_max"),
        (strength >= STRONG_P).alias("strong"),
    )


def transition_listing(
    edges: DataFrame,
    representation: str,
    series_id: str | None = None,
    condition_id: str | None = None,
    noisy: bool = False,
    *,
    conditions: Sequence[Condition] = PLAIN,
    flip_p: float | None = None,
    subsample_step: int | None = None,
) -> DataFrame:
    """One machine as ordered lines such as `S0 --1: 0.411--> S1`.

    Without a series it is the first one by name.  Without a condition id, flip probability
    and step choose the condition; what is left out is that of the first condition of the sweep.
    """
    if condition_id is None:
        first = conditions[0]
        chosen = (first.flip_p if flip_p is None else flip_p, first.subsample_step if subsample_step is None else subsample_step)
        condition_id = Condition(*chosen, first.style).condition_id
    if series_id is None:
        series_id = edges.agg(F.min("series_id")).first()[0]
    machine = edges_for_representation(edges, representation, noisy).where(
        (F.col("series_id") == series_id) & (F.col("condition_id") == condition_id)
    )
    line = F.concat(
        state_name(F.col("state")),
        F.lit(" --"),
        F.col("sym").cast("string"),
        F.lit(": "),
        fixed_text(F.col("p")),
        F.lit("--> "),
        state_name(F.col("next_state")),
    )
    columns = ["series_id", "condition_id", "representation", "state", "sym", "next_state", "p"]
    return machine.select(*columns, line.alias("line")).orderBy("state", "sym", "next_state")
