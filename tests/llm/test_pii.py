"""Base spans against plain patterns, the random field against enumeration."""

import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqstates.llm import pii


def plain(text):
    """The four patterns as they are written, searched from left to right."""
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.5@-+ ()%é\n92", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000, "1.1." * 50_000, "a@" * 50_000, "+1" * 100_000, "1 " * 100_000):
        pii.base_spans(text)


def test_luhn():
    assert pii.luhn("4465758382889437") is (sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate("4465758382889437"[::-1])) % 10 == 0)


def test_viterbi_and_marginals_by_enumeration():
    rng = np.random.default_rng(5)
    field = pii.Field()
    field.emit, field.move = rng.normal(size=field.emit.shape), rng.normal(size=field.move.shape)
    slots = rng.integers(0, pii.SLOTS, size=(1, 4, 7))
    e = field.scores(slots)[0]
    paths = list(itertools.product(range(5), repeat=4))
    score = lambda p: sum(e[t, y] for t, y in enumerate(p)) + sum(field.move[a, b] for a, b in zip((0, *p), (*p, 0)))
    weights = np.exp([score(p) for p in paths])
    assert tuple(field.viterbi(slots)[0]) == paths[int(weights.argmax())]
    single, pairs = field.marginals(slots)
    for t in range(4):
        for y in range(5):
            assert single[0, t, y] == pytest.approx(sum(w for w, p in zip(weights, paths) if p[t] == y) / weights.sum())
    assert pairs[0, 1, 2, 3] == pytest.approx(sum(w for w, p in zip(weights, paths) if p[1:3] == (2, 3)) / weights.sum())


def test_table(spark):
    rows = [(i, f"word a.b{i}@mail.example.com and +1 (743) 555-38{i % 100:02d} end {i} of 10.0.0.{i % 200}", None) for i in range(300)]
    rows += [(900, None, "x"), (901, "", None), (None, "call 12 now", None), (902, "plain " * 60_000 + "1.2.3.4", None), (902, "é 1.2.3.4", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[3].n_email, by_id[3].n_phone, by_id[3].n_ip) == (1, 1, 1)
    assert by_id[900].spans == by_id[901].spans == by_id[None].spans == ""
    assert {r.spans for r in got if r.doc_id == 902} == {"ip:360000:360007", "ip:2:9"}
    assert pii.find(docs.limit(0)).count() == 0


def test_field_adds_forms_that_the_patterns_miss(spark):
    rows = [(i, f"pay 4111111111111111 to x{i} now and 12 more or 2019") for i in range(200)] + [(1000, "pay 5500.0000.0000.0004 today")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000].spans == "card:4:23"
    assert got[5].n_card == 1
