"""The definitions, one symbol after the other, for short series."""

from __future__ import annotations

import hashlib
import math
from collections import Counter


def uniform(*parts) -> float:
    text = ":".join(str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32


def observe(series_id, x, flip_p, step, seed=0):
    flipped = [v ^ (uniform("flip", seed, series_id, t) < flip_p) for t, v in enumerate(x)]
    return [int(v) for v in flipped[::step]]


def targets(x, k, noise_seed=None):
    """(context, symbol, next context) for every symbol with k symbols before it."""

    def context(end):
        symbols = "".join(map(str, x[end - k : end]))
        if noise_seed is None:
            return symbols
        return symbols + "/" + str(int(uniform("rep", noise_seed, end - 1) < 0.5))

    return [(context(u), x[u], context(u + 1)) for u in range(k, len(x))]


def scores(x, k, eps, train_frac=0.8, noise_seed=None):
    split = int(len(x) * train_frac)
    train, test = targets(x[:split], k, noise_seed), targets(x[split:], k, noise_seed)
    n = Counter(c for c, _, _ in train)
    ones = Counter(c for c, y, _ in train if y)
    estimates = sorted({ones[c] / n[c] for c in n})
    anchors = []
    for p in estimates:
        if not anchors or abs(p - anchors[-1]) > eps:
            anchors.append(p)
    state = {c: sum(a <= ones[c] / n[c] for a in anchors) - 1 for c in n}
    p_one = {s: sum(ones[c] for c in n if state[c] == s) / sum(n[c] for c in n if state[c] == s) for s in state.values()}

    moves = Counter((state[a], y, state[b]) for a, y, b in train[:-1])
    visits, weight = Counter(), Counter()
    for (s, y, _), c in moves.items():
        visits[s] += c
        weight[s, y] += c
    total = sum(visits.values())
    largest, entropy = Counter(), Counter()
    for (s, y, _), c in moves.items():
        p = c / weight[s, y]
        largest[s, y] = max(largest[s, y], p)
        entropy[s, y] -= p * math.log2(p)
    losses = []
    for c, y, _ in test:
        p = p_one[state[c]] if c in state else 0.5
        losses.append(-math.log(max(p if y else 1 - p, 1e-12)))
    return {
        "logloss": sum(losses) / len(losses) if losses else 0.0,
        "n_states": len(p_one),
        "C_mu_empirical": -sum(v / total * math.log(v / total) for v in visits.values()),
        "unifilarity_score": sum(weight[q] * largest[q] for q in weight) / total if total else 0.0,
        "branch_entropy": sum(weight[q] * entropy[q] for q in weight) / total if total else 0.0,
    }
