"""The results of `queries.py` as SQL over the same tables, for DuckDB.

Written from the definitions, not from the Spark plans: contexts are strings from
a sliding window, bins come from a recursive query, transitions pair consecutive
contexts.
"""

from __future__ import annotations

from collections.abc import Sequence

from seqstates.catalog.queries import EPS, GRID, KS, NOISE_SEED
from seqstates.conditions import Condition
from seqstates.operators.grams import PLAIN

MODEL = "series_id, condition_id, k"

SERIES = {
    "ev_type": ("events", "event_type", "ts, event_id", "value > 35"),
    "ev_all": ("events", "'all'", "ts, event_id", "value > 35"),
    "ord_prio": ("orders", "o_orderpriority", "o_orderdate, o_orderkey", "o_totalprice > 250000"),
    "ord_status": ("orders", "o_orderstatus", "o_orderdate, o_orderkey", "o_totalprice > 250000"),
    "li_supp": ("lineitem", "l_suppkey", "l_shipdate, l_orderkey, l_linenumber, l_partkey", "l_quantity > 25"),
    "li_all": ("lineitem", "'all'", "l_shipdate, l_orderkey, l_linenumber, l_partkey", "l_quantity > 25"),
    "conv": ("conversations", "conv_id", "turn", "role = 'user'"),
}


def double(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 10) + 0.0 AS {c}" for c in columns)


def draw(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / {double(4294967296.0)})"


def series_cte(source: str) -> str:
    table, key, order, predicate = SERIES[source]
    latent = "CAST(floor(value / 25) AS INTEGER)" if table == "events" else "NULL"
    return f"""ser AS MATERIALIZED (
  SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY {order}) - 1 AS t, x, latent,
         count(*) OVER (PARTITION BY series_id) AS length
  FROM (SELECT *, CAST({key} AS VARCHAR) AS series_id, CAST(({predicate}) AS INTEGER) AS x, {latent} AS latent
        FROM {table}))"""


def observed_cte(conditions: Sequence[Condition]) -> str:
    parts = []
    for c in conditions:
        flip = f"CAST({draw(repr('flip'), repr('0'), 'series_id', 't')} < {double(c.flip_p)} AS INTEGER)"
        x = f"xor(x, {flip})" if c.flip_p > 0 else "x"
        parts.append(
            f"SELECT series_id, '{c.condition_id}' AS condition_id, {double(c.flip_p)} AS flip_p,"
            f" CAST({c.subsample_step} AS INTEGER) AS subsample_step, '{c.wrappers}' AS wrappers,"
            f" length, t // {c.subsample_step} AS t, {x} AS x, count(*) OVER (PARTITION BY series_id) AS n"
            f" FROM ser WHERE t % {c.subsample_step} = 0"
        )
    return "obs AS MATERIALIZED (\n  " + "\n  UNION ALL ".join(parts) + ")"


def split_cte(train_frac: float) -> str:
    return f"""parts AS MATERIALIZED (
  SELECT *, t >= split AS test, CASE WHEN t >= split THEN t - split ELSE t END AS lt,
         CASE WHEN t >= split THEN n - split ELSE split END AS n_role
  FROM (SELECT *, CAST(floor(n * {double(train_frac)}) AS BIGINT) AS split FROM obs))"""


def model_ctes(
    source: str,
    ks: Sequence[int] = KS,
    conditions: Sequence[Condition] = PLAIN,
    eps: float = EPS,
    noise_seed: int | None = None,
    train_frac: float = 0.8,
    every: int = 1,
) -> str:
    """WITH clause up to machines and scores; a query uses the part it needs."""
    k_max = every * (max(ks) - 1) + 1
    k_list = ", ".join(f"({k})" for k in ks)
    ctx, nxt = "right(h, k)", "right(h || y, k)"
    if every > 1:
        ctx, nxt = (f"array_to_string([({h})[-1 - {every} * j] FOR j IN range(k - 1, -1, -1)], '')" for h in ("h", "h || y"))
    if noise_seed is not None:
        bit = "CAST({} < 0.5 AS INTEGER)"
        z = bit.format(draw("'rep'", f"'{noise_seed}'", "(lt - 1)"))
        z_next = bit.format(draw("'rep'", f"'{noise_seed}'", "lt"))
        ctx, nxt = f"{ctx} || '/' || {z}", f"{nxt} || '/' || {z_next}"
    noisy = "_noisy" if noise_seed is not None else ""
    return f"""WITH RECURSIVE {series_cte(source)},
{observed_cte(conditions)},
{split_cte(train_frac)},
hist AS (
  SELECT *, x AS y, array_to_string(list(x) OVER (PARTITION BY series_id, condition_id, test ORDER BY lt
                                    ROWS BETWEEN {k_max} PRECEDING AND 1 PRECEDING), '') AS h
  FROM parts),
rep AS (
  SELECT series_id, condition_id, k, test, t, lt, n_role, {ctx} AS ctx, y, {nxt} AS nxt
  FROM hist JOIN (VALUES {k_list}) ks(k) ON length(h) >= {every} * (k - 1) + 1),
grams AS MATERIALIZED (
  SELECT series_id, condition_id, k, test, ctx, y, nxt, count(*) AS n_fit,
         count(*) FILTER (WHERE lt <= n_role - 2) AS n_trans
  FROM rep GROUP BY ALL),
stats AS MATERIALIZED (
  SELECT {MODEL}, ctx, CAST(sum(n_fit) AS BIGINT) AS n, CAST(sum(n_fit * y) AS BIGINT) AS n1,
         CAST(sum(n_fit * y) AS DOUBLE) / CAST(sum(n_fit) AS DOUBLE) AS p_hat
  FROM grams WHERE NOT test GROUP BY {MODEL}, ctx),
anchors AS (
  SELECT {MODEL}, 0 AS state, min(p_hat) AS anchor FROM stats GROUP BY {MODEL}
  UNION ALL
  SELECT a.series_id, a.condition_id, a.k, a.state + 1, min(s.p_hat)
  FROM anchors a JOIN stats s ON s.series_id = a.series_id AND s.condition_id = a.condition_id AND s.k = a.k
  WHERE s.p_hat > a.anchor AND abs(s.p_hat - a.anchor) > {double(eps)}
  GROUP BY a.series_id, a.condition_id, a.k, a.state),
ctxs AS MATERIALIZED (
  SELECT s.series_id, s.condition_id, s.k, s.ctx, s.n, s.n1, s.p_hat, max(a.state) AS state
  FROM stats s JOIN anchors a ON s.series_id = a.series_id AND s.condition_id = a.condition_id AND s.k = a.k
  WHERE a.anchor <= s.p_hat GROUP BY ALL),
states AS (
  SELECT {MODEL}, state, CAST(sum(n1) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS p_one, CAST(sum(n) AS BIGINT) AS n
  FROM ctxs GROUP BY {MODEL}, state),
trans AS MATERIALIZED (
  SELECT g.series_id, g.condition_id, g.k, a.state, g.y AS sym, b.state AS next_state,
         CAST(sum(g.n_trans) AS BIGINT) AS c
  FROM grams g
  JOIN ctxs a ON a.series_id = g.series_id AND a.condition_id = g.condition_id AND a.k = g.k AND a.ctx = g.ctx
  JOIN ctxs b ON b.series_id = g.series_id AND b.condition_id = g.condition_id AND b.k = g.k AND b.ctx = g.nxt
  WHERE NOT g.test AND g.n_trans > 0 GROUP BY ALL),
occ AS (
  SELECT {MODEL}, state, CAST(sum(c) AS BIGINT) AS c,
         CAST(sum(c) AS DOUBLE) / CAST(sum(sum(c)) OVER (PARTITION BY {MODEL}) AS DOUBLE) AS pi
  FROM trans GROUP BY {MODEL}, state),
edges AS MATERIALIZED (
  SELECT *, CAST(c AS DOUBLE) / CAST(sum(c) OVER (PARTITION BY {MODEL}, state, sym) AS DOUBLE) AS p FROM trans),
branch AS (
  SELECT {MODEL}, state, sym, sum(c) AS w, max(p) AS u, -sum(p * ln(p)) AS h FROM edges GROUP BY {MODEL}, state, sym),
losses AS (
  SELECT {MODEL}, sum(n * -ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12))) / sum(n) AS logloss
  FROM (SELECT g.series_id, g.condition_id, g.k, g.y, g.n_fit AS n, coalesce(s.p_one, {double(0.5)}) AS p
        FROM grams g
        LEFT JOIN ctxs a ON a.series_id = g.series_id AND a.condition_id = g.condition_id AND a.k = g.k AND a.ctx = g.ctx
        LEFT JOIN states s ON s.series_id = a.series_id AND s.condition_id = a.condition_id AND s.k = a.k AND s.state = a.state
        WHERE g.test)
  GROUP BY {MODEL}),
scores AS (
  SELECT {MODEL}, sum(w * u) / sum(w) AS unifilarity_score, sum(w * h) / sum(w) / ln({double(2.0)}) AS branch_entropy,
         avg(h) AS plain_entropy
  FROM branch GROUP BY {MODEL}),
entropies AS (SELECT {MODEL}, -sum(pi * ln(greatest(pi, 1e-18))) AS C_mu_empirical FROM occ GROUP BY {MODEL}),
sizes AS (SELECT {MODEL}, CAST(count(DISTINCT state) AS INTEGER) AS n_states FROM ctxs GROUP BY {MODEL}),
grid AS (
  SELECT DISTINCT series_id, condition_id, length, flip_p, subsample_step, wrappers, CAST(k AS INTEGER) AS k
  FROM obs CROSS JOIN (VALUES {k_list}) ks(k)),
runs AS MATERIALIZED (
  SELECT series_id, length, {double(train_frac)} AS train_frac,
         '{source}' || CASE WHEN flip_p > 0 THEN '_flip' || flip_p ELSE '' END
                    || CASE WHEN subsample_step > 1 THEN '_sub' || subsample_step ELSE '' END AS process,
         '{source}' AS base_process, {double(eps)} AS eps, flip_p, subsample_step, wrappers, condition_id,
         'last_' || k || '{noisy}' AS representation, k, 'one_step_greedy_merge' AS reconstructor,
         round(coalesce(logloss, 0), 10) + 0.0 AS logloss,
         coalesce(n_states, 0) AS n_states,
         round(coalesce(C_mu_empirical, 0), 10) + 0.0 AS C_mu_empirical,
         round(coalesce(unifilarity_score, 0), 10) + 0.0 AS unifilarity_score,
         round(coalesce(branch_entropy, 0), 10) + 0.0 AS branch_entropy
  FROM grid LEFT JOIN losses USING ({MODEL}) LEFT JOIN sizes USING ({MODEL})
       LEFT JOIN entropies USING ({MODEL}) LEFT JOIN scores USING ({MODEL}))
"""


METRICS = ["logloss", "n_states", "C_mu_empirical", "unifilarity_score", "branch_entropy"]
SUMMARY_KEYS = "base_process, condition_id, flip_p, subsample_step, reconstructor, representation, k"


def summary_ctes() -> str:
    stats = ", ".join(
        f"avg(CAST({m} AS DOUBLE)) AS {m}_mean, coalesce(stddev_samp(CAST({m} AS DOUBLE)), 0) AS {m}_std"
        for m in METRICS
    )
    head = model_ctes("ev_type", conditions=GRID)
    # Means of the unrounded scores, as in the query.
    head = head.replace("round(coalesce(", "(coalesce(").replace(", 0), 10) + 0.0", ", 0) + 0.0)")
    return f"{head}, summary AS (SELECT {SUMMARY_KEYS}, count(*) AS n, {stats} FROM runs GROUP BY {SUMMARY_KEYS})\n"


def oracle_sql() -> dict[str, str]:
    ev = model_ctes("ev_type")
    role = "CASE WHEN test THEN 'test' ELSE 'train' END AS role"
    runs = "SELECT * FROM runs"
    grid_runs = model_ctes("ev_type", conditions=GRID)
    summary = summary_ctes()
    ser = "WITH " + series_cte("ev_type")
    noisy_ctx = "split_part(ctx, '/', 1) AS ctx, CAST(split_part(ctx, '/', 2) AS INTEGER) AS z"
    condition_pair = [Condition(0.1, 2), Condition(0.3, 3)]
    both_styles = [Condition(c.flip_p, c.subsample_step, s) for c in GRID for s in ("flip_sub", "json")]
    process = """CASE WHEN flip_p > 0 THEN '_flip' || flip_p ELSE '' END
       || CASE WHEN subsample_step > 1 THEN '_sub' || subsample_step ELSE '' END AS process"""
    sql = {
        "symbol_series": f"{ser} SELECT series_id, t, x, length, latent FROM ser",
        "bucketed_index": f"WITH {series_cte('li_all')} SELECT series_id, t, x, length FROM ser",
        "minute_buckets": f"WITH {series_cte('ev_all')} SELECT series_id, t, x, length FROM ser",
        "range_index": f"WITH {series_cte('ord_status')} SELECT series_id, t, x, length FROM ser",
        "flip_noise": f"{ser}, {observed_cte([Condition(0.2)])} SELECT series_id, t, x, length FROM obs",
        "subsample": f"{ser} SELECT series_id, t // 3 AS t, x, count(*) OVER (PARTITION BY series_id) AS length, latent"
        " FROM ser WHERE t % 3 = 0",
        "flip_then_subsample": f"{ser}, {observed_cte(condition_pair)}"
        " SELECT series_id, condition_id, t, x, n AS length FROM obs",
        "train_test_split": f"{ser}, {observed_cte(PLAIN)}, {split_cte(0.8)}"
        f" SELECT series_id, t, x, length, {role}, lt FROM parts",
        "noise_bit": f"{ser}, {observed_cte(PLAIN)}, {split_cte(0.8)} SELECT series_id, t, {role}, lt,"
        f" CAST({draw(repr('rep'), repr(str(NOISE_SEED)), 'lt')} < 0.5 AS INTEGER) AS z FROM parts",
        "last_k": model_ctes("ev_type", [3])
        + f"SELECT series_id, condition_id, {role}, t - 1 AS t, lt - 1 AS lt, ctx, y AS next_x FROM rep",
        "last_k_long": model_ctes("ord_prio", [70])
        + f"SELECT series_id, condition_id, {role}, t - 1 AS t, lt - 1 AS lt, ctx, y AS next_x FROM rep",
        "last_k_noisy": model_ctes("ev_type", [2], noise_seed=NOISE_SEED)
        + f"SELECT series_id, condition_id, {role}, t - 1 AS t, lt - 1 AS lt, {noisy_ctx}, y AS next_x FROM rep",
        "next_symbol": f"WITH {series_cte('ord_prio')} SELECT * FROM (SELECT series_id, t, x,"
        " lead(x) OVER (PARTITION BY series_id ORDER BY t) AS next_x FROM ser) WHERE next_x IS NOT NULL",
        "gram_counts": model_ctes("ev_type", range(1, 5), GRID)
        + f"SELECT {MODEL}, {role}, ctx, y, n_fit, n_trans FROM grams",
        "gram_counts_noisy": model_ctes("ev_type", [1, 2, 3], noise_seed=NOISE_SEED)
        + f"SELECT {MODEL}, {role}, {noisy_ctx}, y, CAST(sum(n_fit) AS BIGINT) AS n_fit,"
        f" CAST(sum(n_trans) AS BIGINT) AS n_trans FROM grams g GROUP BY {MODEL}, test, g.ctx, y",
        "gram_counts_long": model_ctes("li_all", range(1, 11))
        + f"SELECT {MODEL}, {role}, ctx, y, n_fit, n_trans FROM grams",
        "context_stats": model_ctes("li_supp", [1, 2, 3]) + "SELECT * FROM stats",
        "greedy_anchors": ev + "SELECT * FROM anchors",
        "linked_anchors": ev + "SELECT * EXCLUDE (state) FROM anchors",
        "context_states": ev + "SELECT * FROM ctxs",
        "context_states_linked": ev + "SELECT * FROM ctxs",
        "context_states_noisy": model_ctes("ev_type", noise_seed=NOISE_SEED)
        + f"SELECT {MODEL}, {noisy_ctx}, n, n1, p_hat, state FROM ctxs",
        "state_probabilities": ev + "SELECT * FROM states",
        "transition_counts": ev + "SELECT * FROM trans",
        "state_occupancy": ev + "SELECT * FROM occ",
        "every_second_edges": model_ctes("ev_type", [1, 2, 3], GRID, every=2)
        + "SELECT *, 'every_second_' || k AS representation FROM edges",
        "transition_probs": ev + "SELECT * FROM edges",
        "state_symbol_counts": ev
        + f"SELECT {MODEL}, state, sym, CAST(sum(c) AS BIGINT) AS w FROM trans GROUP BY {MODEL}, state, sym",
        "state_sequence": model_ctes("ev_type", [3])
        + f"SELECT r.series_id, r.condition_id, {role}, r.t - 1 AS t, r.lt - 1 AS lt, r.ctx, r.y AS next_x, c.state"
        " FROM rep r JOIN ctxs c USING (series_id, condition_id, k, ctx) WHERE NOT test AND r.lt <= r.n_role - 2",
        "log_loss": ev + f"SELECT {MODEL}, {rounded('logloss')} FROM losses",
        "statistical_complexity": ev + f"SELECT {MODEL}, {rounded('C_mu_empirical')} FROM entropies",
        "n_states": ev + "SELECT * FROM sizes",
        "unifilarity": ev + f"SELECT {MODEL}, {rounded('unifilarity_score')} FROM scores",
        "branching_entropy": ev + f"SELECT {MODEL}, round(plain_entropy, 10) + 0.0 AS branch_entropy FROM scores",
        "branching_entropy_weighted": ev + f"SELECT {MODEL}, {rounded('branch_entropy')} FROM scores",
        "edge_list": ev + f"SELECT {MODEL}, state, sym, next_state, p FROM edges",
        "edges_for_representation": ev + "SELECT *, 'last_' || k AS representation FROM edges WHERE k = 3",
        "machine_nodes": ev + f"SELECT {MODEL}, state FROM edges UNION SELECT {MODEL}, next_state FROM edges",
        "reciprocal_pairs": ev
        + f"SELECT DISTINCT {MODEL}, e.state AS a, e.next_state AS b FROM edges e WHERE e.state < e.next_state"
        " AND EXISTS (SELECT 1 FROM edges r WHERE r.series_id = e.series_id AND r.condition_id = e.condition_id"
        " AND r.k = e.k AND r.state = e.next_state AND r.next_state = e.state)",
        "parallel_edges": ev
        + f"SELECT {MODEL}, state, next_state, CAST(row_number() OVER (PARTITION BY {MODEL}, state, next_state"
        " ORDER BY sym) - 1 AS INTEGER) AS place, sym, p FROM edges",
        "clean_probabilities": ev
        + f"SELECT {MODEL}, state, sym, next_state, c, CASE c % 5 WHEN 0 THEN NULL WHEN 1 THEN {double(1.0)}"
        f" WHEN 2 THEN {double(0.0)} ELSE p END AS p FROM edges",
        "edge_labels": ev
        + f"SELECT {MODEL}, state, next_state,"
        " CASE state WHEN 0 THEN 'low' ELSE 'S' || state END AS state_name,"
        " CASE next_state WHEN 0 THEN 'low' ELSE 'S' || next_state END AS next_state_name,"
        " string_agg(CASE sym WHEN 1 THEN 'high' ELSE '0' END || ': ' || printf('%.3f', p), ', ' ORDER BY sym) AS label"
        f" FROM edges GROUP BY {MODEL}, state, next_state",
        "edge_classes": ev
        + f"SELECT {MODEL}, state, next_state, CASE WHEN state = next_state THEN 'self' WHEN EXISTS (SELECT 1 FROM"
        " edges r WHERE r.series_id = e.series_id AND r.condition_id = e.condition_id AND r.k = e.k"
        " AND r.state = e.next_state AND r.next_state = e.state) THEN 'reciprocal' ELSE 'plain' END AS edge_class,"
        f" max(p) AS p_max, max(p) >= 0.5 AS strong FROM edges e GROUP BY {MODEL}, state, next_state",
        "transition_listing": ev
        + "SELECT series_id, condition_id, 'last_' || k AS representation, state, sym, next_state, p,"
        " 'S' || state || ' --' || sym || ': ' || printf('%.3f', p) || '--> S' || next_state AS line"
        " FROM edges WHERE k = 5 AND series_id = 'click'",
        "condition_grid": f"{ser}, {observed_cte(GRID)} SELECT DISTINCT series_id, length, 'ev_type' AS base_process,"
        f" 'ev_type' || {process}, condition_id, flip_p, subsample_step, wrappers, n AS n_symbols FROM obs",
        "condition_ids": f"WITH {series_cte('ord_prio')}, {observed_cte(both_styles)} SELECT DISTINCT series_id,"
        f" condition_id, wrappers, 'ord_prio' || {process}, n AS n_symbols FROM obs",
        "sweep_runs": grid_runs + runs,
        "stored_runs": f"SELECT * FROM ({model_ctes('ev_type', [1, 2, 3], GRID)} {runs}"
        f" WHERE NOT (condition_id = '{GRID[1].condition_id}' AND k > 1))"
        f" UNION ALL SELECT * FROM ({model_ctes('ev_type', [2, 3, 4], GRID[1:2], eps=0.1)} {runs})",
        "stored_edges": " UNION ALL ".join(
            f"SELECT *, 'last_' || k AS representation FROM ({model_ctes('ev_type', [k], eps=eps)}"
            f" SELECT {MODEL}, state, sym, next_state, c, round(p, 10) + 0.0 AS p FROM edges)"
            for k, eps in ((3, EPS), (2, 0.1))
        ),
        "resumed_runs": model_ctes("ev_type", [1, 2]) + runs,
        "read_back_runs": model_ctes("ev_type", [1, 2], [Condition(0.2, 1)]) + runs,
        "sweep_runs_long": model_ctes("li_all", range(1, 11)) + runs,
        "sweep_runs_long_histories": model_ctes("ord_prio", [2, 61, 70]) + runs,
        "sweep_runs_one_series": model_ctes("li_all", [12, 16]) + runs,
        "sweep_runs_fine_bins": model_ctes("ord_prio", eps=1e-4) + runs,
        "sweep_runs_noisy": model_ctes("ord_prio", [1, 2, 3], noise_seed=NOISE_SEED) + runs,
        "sweep_runs_unmerged": model_ctes("ord_prio", eps=0.0) + runs,
        "sweep_runs_many": model_ctes("li_supp", [1, 2, 3, 4]) + runs,
        "sweep_runs_short": model_ctes("conv", [1, 2, 3, 8]) + runs,
        "extract_k": f"{ser} SELECT DISTINCT series_id, r AS representation, CAST(regexp_extract(r, '[0-9]+') AS INTEGER)"
        " AS k FROM ser CROSS JOIN (VALUES ('last_1'), ('last_2'), ('last_12'), ('last_3_noisy')) v(r)",
        "summary_by_condition": summary
        + f"SELECT {SUMMARY_KEYS}, n, {rounded(*[f'{m}_{s}' for m in METRICS for s in ('mean', 'std')])} FROM summary",
        "summary_simple": summary
        + "SELECT base_process, flip_p, subsample_step, k, "
        + rounded(*[f"{m}_{s}" for m in ("logloss", "unifilarity_score", "branch_entropy") for s in ("mean", "std")])
        + " FROM summary",
        "filter_runs": grid_runs + f"{runs} WHERE subsample_step = 2 AND k = 3",
        "filter_flip_tolerance": grid_runs + f"{runs} WHERE flip_p = 0.1",
        "metric_vs_k": summary
        + " UNION ALL ".join(
            f"SELECT '{m}' AS metric, flip_p, k, round({m}_mean, 10) + 0.0 AS mean, round({m}_std, 10) + 0.0 AS std"
            " FROM summary WHERE subsample_step = 1"
            for m in ("branch_entropy", "unifilarity_score", "logloss")
        ),
        "phase_grid": summary + f"SELECT {phase_columns()} FROM summary",
        "phase_grid_wide": summary
        + "SELECT base_process, reconstructor, 'last_k' AS representation, subsample_step, flip_p, "
        + ", ".join(f"max(CASE k WHEN {k} THEN round(1 - unifilarity_score_mean, 10) + 0.0 END) AS k{k}" for k in KS)
        + " FROM summary GROUP BY base_process, reconstructor, subsample_step, flip_p",
        "closure_mask": summary + f"SELECT {phase_columns()}, {closed()} AS closed FROM summary",
        "closure_report": summary
        + " UNION ALL ".join(
            f"SELECT flip_p, k, '{m}' AS metric, round({m}_mean, 10) + 0.0 AS mean, round({m}_std, 10) + 0.0 AS std,"
            f" {closed()} AS closed FROM summary WHERE subsample_step = 1 AND flip_p IN (0, 0.2)"
            for m in ("branch_entropy", "unifilarity_score", "logloss")
        ),
    }
    return sql


def phase_columns() -> str:
    return (
        "base_process, reconstructor, representation, subsample_step, flip_p, k,"
        " round(branch_entropy_mean, 10) + 0.0 AS branch_entropy,"
        " round(1 - unifilarity_score_mean, 10) + 0.0 AS one_minus_unifilarity"
    )


def closed() -> str:
    return (
        f"({double(1.0)} - unifilarity_score_mean <= {double(1.0)} - {double(0.98)}"
        f" AND branch_entropy_mean <= {double(0.02)})"
    )
