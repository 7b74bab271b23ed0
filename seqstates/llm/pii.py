"""Personal data by fixed patterns and a linear-chain conditional random field.

The four base patterns always hold.  The random field tags what they leave out: it
labels the tokens between blanks as other, email, ip, card or phone, from features of the
token's shape, its neighbours' shapes and its length, and with weights for neighbouring
labels.  It is trained on a small labelled table: tokens of at most `SAMPLE` documents
with a base match, labelled by the base matches, and the same tokens with their separators
swapped (a card with dots, a number without plus), which teaches it forms that the
patterns miss.  The gradient is that of the exact log likelihood, by the forward and
backward algorithm; decoding is Viterbi, in numpy, for all runs of a batch at a time.

Only tokens with a digit or an @ may be personal data.  All others are fixed as `other`,
which splits a text into independent runs of candidate tokens, so that runs are all the
decoder sees, without any loss.  A tagged run becomes a span only where it touches no base
span and where its probability reaches `CERTAIN`, a stated precision limit.

NULL and empty texts have no spans; the counts are those of all spans.  Offsets are code
points.  Repeated rows get the same spans each.  Only id and text are read, so other
columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqstates.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
SAMPLE_BUCKETS, SAMPLE_PER_BUCKET = 64, 16
STEPS, RATE, DECAY = 60, 0.5, 1e-4
CERTAIN = 0.9
SLOTS = 4096
LONGEST_RUN = 256  # tokens decoded together; longer runs are cut, each part on its own

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# A run of digits starts where no digit stands before it, so a failing run is not read again.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"\S*[0-9@]\S*")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Around each @, what a leftmost search for the pattern finds, without trying every start."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1].isalnum() and text[begin - 1].isascii() or text[begin - 1] in "._%+-"):
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield "email", begin, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, by kind and then by start."""
    spans = list(emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Maximal runs of candidate tokens that only blanks separate, as (start, end) of the tokens."""
    held: list[tuple[int, int]] = []
    for m in _CANDIDATE.finditer(text):
        if held and (len(held) == LONGEST_RUN or text[held[-1][1] : m.start()].strip()):
            yield held
            held = []
        held.append(m.span())
    if held:
        yield held


def word_shape(token: str) -> str:
    """Classes of characters, repeats shortened."""
    out: list[str] = []
    for c in token[:40]:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if len(out) < 2 or not out[-1] == out[-2] == k:
            out.append(k)
    return "".join(out)


def features(tokens: list[str]) -> list[list[int]]:
    """Hashed feature slots per token: its shape, parts, length and the shapes around it."""
    shapes = [word_shape(t.strip(".,;:!?#$%&*()\"'")) for t in tokens]
    out = []
    for i, token in enumerate(tokens):
        digits = sum(c.isdigit() for c in token)
        names = [
            "shape " + shapes[i],
            f"before {shapes[i - 1] if i else '^'}",
            f"after {shapes[i + 1] if i + 1 < len(tokens) else '$'}",
            f"digits {min(digits, 20)}",
            f"dots {min(token.count('.'), 4)} at {min(token.count('@'), 2)} plus {token.startswith('+')}",
            f"around {sum(sum(c.isdigit() for c in t) for t in tokens[max(0, i - 3) : i + 4]) // 2}",
            "bias",
        ]
        out.append([int.from_bytes(hashlib.md5(n.encode("utf-8", "replace")).digest()[:4], "big") % SLOTS for n in names])
    return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights of token features and of neighbouring labels; runs start and end beside `other`."""

    def __init__(self):
        self.emit = np.zeros((SLOTS, len(LABELS)))
        self.move = np.zeros((len(LABELS), len(LABELS)))

    def scores(self, slots: np.ndarray) -> np.ndarray:
        return self.emit[slots].sum(axis=-2)

    def marginals(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels per token and of pairs of neighbouring labels, of runs of one length."""
        e = self.scores(slots)  # runs x tokens x labels
        count, length, labels = e.shape
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[:, 0] = e[:, 0] + self.move[0]
        for t in range(1, length):
            alpha[:, t] = e[:, t] + _logsumexp(alpha[:, t - 1, :, None] + self.move, 1)
        beta[:, -1] = self.move[:, 0]
        for t in range(length - 2, -1, -1):
            beta[:, t] = _logsumexp(self.move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _logsumexp(alpha[:, -1] + beta[:, -1], 1)
        single = np.exp(alpha + beta - z[:, None, None])
        pairs = np.exp(alpha[:, :-1, :, None] + self.move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        return single, pairs

    def viterbi(self, slots: np.ndarray) -> np.ndarray:
        """Best labels of runs of one length."""
        e = self.scores(slots)
        count, length, labels = e.shape
        best, back = e[:, 0] + self.move[0], np.zeros((count, length, labels), np.int8)
        for t in range(1, length):
            paths = best[:, :, None] + self.move
            back[:, t] = paths.argmax(axis=1)
            best = e[:, t] + paths.max(axis=1)
        path = np.empty((count, length), np.int8)
        path[:, -1] = (best + self.move[:, 0]).argmax(axis=1)
        for t in range(length - 1, 0, -1):
            path[:, t - 1] = back[np.arange(count), t, path[:, t]]
        return path

    def learn(self, table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Gradient ascent with per-weight steps; `table` holds slots, labels and counts of the runs by length."""
        squares_emit, squares_move = np.full_like(self.emit, 1e-8), np.full_like(self.move, 1e-8)
        one_hot = np.eye(len(LABELS))
        for _ in range(STEPS):
            emit, move = -DECAY * self.emit, -DECAY * self.move
            for slots, gold, count in table.values():
                single, pairs = self.marginals(slots)
                difference = (one_hot[gold] - single) * count[:, None, None]
                for f in range(slots.shape[2]):
                    np.add.at(emit, slots[:, :, f].ravel(), difference.reshape(-1, len(LABELS)))
                np.add.at(move, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), np.repeat(count, gold.shape[1] - 1))
                move -= (pairs * count[:, None, None, None]).sum(axis=(0, 1))
                move[0] += difference[:, 0].sum(axis=0)
                move[:, 0] += difference[:, -1].sum(axis=0)
            squares_emit += emit**2
            squares_move += move**2
            self.emit += RATE * emit / np.sqrt(squares_emit)
            self.move += RATE * move / np.sqrt(squares_move)


def labelled_runs(text: str) -> Iterator[tuple[list[str], list[int]]]:
    """Runs of candidate tokens with the labels of the base spans that they overlap, also in other forms."""
    spans = base_spans(text)
    for run in runs(text):
        gold = [next((LABELS.index(k) for k, a, b in spans if a < end and begin < b), 0) for begin, end in run]
        tokens = [text[a:b] for a, b in run]
        yield tokens, gold
        if any(gold):
            swapped = []
            for token, label in zip(tokens, gold):
                if LABELS[label] == "card":
                    digits = "".join(c for c in token if c.isdigit())
                    token = ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
                elif LABELS[label] == "phone":
                    token = token.replace("+", "00").replace("-", "/")
                elif LABELS[label] == "email":
                    token = token.replace("@", "(at)@" if "(" in token else "@", 1)
                swapped.append(token)
            if swapped != tokens:
                yield swapped, gold


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Train on the labelled table of at most `SAMPLE_BUCKETS * SAMPLE_PER_BUCKET` documents with digits."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("text").rlike("[0-9]{4}|@"))
    ids = rows.select("id", F.xxhash64("id").alias("draw")).withColumn("bucket", F.expr(f"pmod(draw, {SAMPLE_BUCKETS})"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("draw", "id"))
    chosen = ids.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_PER_BUCKET).select("id").distinct()
    rows = rows.join(F.broadcast(chosen), "id", "left_semi")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for text in batch.column(0) for x in labelled_runs(text.as_py())]
            columns = [pa.array([x[k] for x in found], kind) for k, kind in ((0, pa.list_(pa.string())), (1, pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, names=["tokens", "labels"])

    table = rows.select("text").mapInArrow(label, "tokens array<string>, labels array<int>")
    table = materialize(table.groupBy("tokens", "labels").agg(F.count("*").alias("c")), "labelled")
    # The labelled table is small by the bound on its documents; the largest counts are kept.
    table = table.orderBy(F.desc("c"), "tokens").limit(4000).collect()
    by_length: dict[int, tuple[list, list, list]] = {}
    for row in table:
        slots, gold, count = by_length.setdefault(len(row.tokens), ([], [], []))
        slots.append(features(row.tokens))
        gold.append(row.labels)
        count.append(float(row.c))
    field = Field()
    if table:
        field.learn({n: tuple(map(np.array, columns)) for n, columns in by_length.items()})
    return field


def added_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """What the random field finds beside the base spans, for all texts of a batch together."""
    waiting: dict[int, list[tuple[int, list, list]]] = {}
    for i, text in enumerate(texts):
        for run in runs(text) if text else ():
            waiting.setdefault(len(run), []).append((i, run, features([text[a:b] for a, b in run])))
    found: list[list[Span]] = [[] for _ in texts]
    for group in waiting.values():
        for begin in range(0, len(group), 4096):
            part = group[begin : begin + 4096]
            slots = np.array([x[2] for x in part])
            best = field.viterbi(slots)
            hits = np.flatnonzero(best.any(axis=1))
            if not len(hits):
                continue
            single, _ = field.marginals(slots[hits])
            for h, marginal in zip(hits, single):
                i, run, _ = part[h]
                t = 0
                while t < len(run):
                    end = t + 1
                    while end < len(run) and best[h, end] == best[h, t]:
                        end += 1
                    label = best[h, t]
                    if label and marginal[t:end, label].min() >= CERTAIN:
                        span = LABELS[label], run[t][0], run[end - 1][1]
                        if not any(a < span[2] and span[1] < b for _, a, b in base[i]):
                            found[i].append(span)
                    t = end
    return found


def _shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def detect(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                spans = [b + a for b, a in zip(base, added_spans(texts, base, field))]
                counts = [pa.array([sum(s[0] == k for s in x) for x in spans], pa.int64()) for k in KINDS]
                digests = pa.array([hashlib.sha256(_shown(b).encode()).hexdigest() for b in base])
                names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array(list(map(_shown, spans)))], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(batches, f"doc_id long, {counts}, base_sha256 string, spans string")


def find(docs: DataFrame) -> DataFrame:
    """Fit on the table and tag every row of it."""
    return detect(docs, fit(docs))
