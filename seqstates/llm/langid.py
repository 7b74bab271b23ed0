"""Language of texts by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.  A word's
probability in a language is the sum over all ways to cut it into pieces, by the forward
algorithm; a text's is the product over its words.  Pieces do not cross words, so the
vector of a word over the languages is computed once and kept in a bounded cache.  The
algorithm runs in numpy over blocks of words, one place of all words at a time.

The piece probabilities are fitted by expectation maximisation over the same sums: words
of a training sample are counted in Spark, every round computes expected piece counts by
the forward and backward algorithm, and only (languages x vocabulary) numbers reach the
driver.  The sample has at most `SAMPLE_BUCKETS * SAMPLE_PER_BUCKET` documents per
language, those with the smallest id hashes; whole texts, with a language, and not held out.

NULL texts and texts without letters are `und` with score 0, and so is everything if there
is nothing to learn from.  Words over `MAX_WORD` letters are scored in slices.  Repeated
rows are scored one by one.  Only id, text and, for fitting, language are read, so other
columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqstates.llm.common import crc_fold, materialize, release

SAMPLE_BUCKETS, SAMPLE_PER_BUCKET = 64, 24
ROUNDS = 3
MAX_WORD = 32
CACHE_WORDS = 400_000
HELD_WORDS = 50_000  # words scored together
AT_ONCE = 8_192  # words whose lattices are held at once
SMOOTHING = 0.1
UNSEEN = 1e-6  # probability of a letter that is no piece
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
Model = dict[str, list[float]]  # piece -> probability per language


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> list[str]:
    """Pieces that consist of letters, in lower case; the leading mark stands for a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in known if p and all(c.isalpha() or c == "▁" for c in p))


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case, each with the mark of a word's start, long ones in slices."""
    found = _LETTERS.findall((text or "").lower())
    if all(len(w) < MAX_WORD for w in found):
        return ["▁" + w for w in found]
    marked = ("▁" + w for w in found)
    return [w[i : i + MAX_WORD] for w in marked for i in range(0, len(w), MAX_WORD)]


class Tree:
    """The pieces as a tree of letters, in arrays: a step goes from a node and a letter to a node."""

    def __init__(self, model: Model):
        nodes = {"": 0}
        for piece in model:
            for i in range(1, len(piece) + 1):
                nodes.setdefault(piece[:i], len(nodes))
        keys = np.array([nodes[p[:-1]] << 21 | ord(p[-1]) for p in nodes if p])
        order = np.argsort(keys)
        self.keys, self.children = keys[order], order + 1
        self.pieces = list(model)
        self.piece = np.full(len(nodes), -1)
        self.piece[[nodes[p] for p in model]] = np.arange(len(model))
        known = np.array(list(model.values()))
        self.probabilities = np.vstack([known, np.full((1, known.shape[1]), UNSEEN)])  # -1 is a letter that is no piece

    def step(self, nodes: np.ndarray | int, letters: np.ndarray) -> np.ndarray:
        wanted = nodes << 21 | letters
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.children[at], -1)

    def cuts(self, found: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, words, pieces): the words that have a piece at this place; each letter is one at least."""
        width = max(map(len, found))
        letters = np.array(found, f"U{width}").view(np.uint32).reshape(len(found), width).astype(np.int64)
        for begin in range(width):
            rows = np.flatnonzero(letters[:, begin])
            nodes = self.step(0, letters[rows, begin])
            yield begin, begin + 1, rows, np.where(nodes < 0, -1, self.piece[nodes])
            for end in range(begin + 2, width + 1):
                rows, nodes = rows[nodes >= 0], nodes[nodes >= 0]
                if not len(rows):
                    break
                nodes = self.step(nodes, letters[rows, end - 1])
                piece = np.where(nodes < 0, -1, self.piece[nodes])
                yield begin, end, rows[piece >= 0], piece[piece >= 0]


def tree(model: Model) -> Tree:
    return Tree(model)


def forward_all(found: list[str], grown: Tree) -> np.ndarray:
    """Log probabilities (words x languages), each summed over all segmentations of the word."""
    ends = np.array([len(w) for w in found])
    alpha = np.zeros((ends.max() + 1, len(found), grown.probabilities.shape[1]))
    alpha[0] = 1.0
    for begin, end, rows, piece in grown.cuts(found):
        alpha[end][rows] += alpha[begin][rows] * grown.probabilities[piece]
    return np.log(alpha[ends, np.arange(len(found))])


def shares(found: list[str], language: np.ndarray, grown: Tree) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, words, pieces, expected uses), each word under its own language."""
    ends, every = np.array([len(w) for w in found]), np.arange(len(found))
    reached = [(b, e, rows, piece, grown.probabilities[piece, language[rows]]) for b, e, rows, piece in grown.cuts(found)]
    alpha = np.zeros((ends.max() + 1, len(found)))
    beta = np.zeros_like(alpha)
    alpha[0] = beta[ends, every] = 1.0
    for begin, end, rows, _, p in reached:
        alpha[end][rows] += alpha[begin][rows] * p
    for begin, end, rows, _, p in reversed(reached):
        beta[begin][rows] += beta[end][rows] * p
    for begin, end, rows, piece, p in reached:
        yield begin, end, rows, piece, alpha[begin][rows] * p * beta[end][rows] / beta[0][rows]


def forward(word: str, grown: Tree, languages: int) -> list[float]:
    """Of one word."""
    return forward_all([word], grown)[0, :languages].tolist()


def expected_pieces(word: str, grown: Tree, k: int) -> list[tuple[str, float]]:
    """Expected uses of every piece in one word, under language k."""
    return [(word[b:e], float(c)) for b, e, _, _, share in shares([word], np.array([k]), grown) for c in share]


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text) of the bounded training sample."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id")) != 1))
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("draw"))
    ids = ids.withColumn("bucket", F.expr(f"pmod(draw, {SAMPLE_BUCKETS})"))
    rank = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("draw", "doc_id"))
    chosen = ids.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_PER_BUCKET).select("doc_id", "lang").distinct()
    return rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")


def fit(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], Model]:
    """Languages and piece probabilities, from the documents that are not held out."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts.update((lang, w) for w in words(text.as_py()))
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([k[0] for k in counts], pa.string()),
                    "word": pa.array([k[1] for k in counts], pa.string()),
                    "c": pa.array(list(counts.values()), pa.int64()),
                }
            )

    found = sample(docs, id_col, text_col, lang_col).mapInArrow(counted, "lang string, word string, c long")
    found = materialize(found.groupBy("lang", "word").agg(F.sum("c").alias("c")), "words")
    languages = [r.lang for r in found.select("lang").distinct().orderBy("lang").collect()]
    known = pieces(vocabulary or default_vocabulary())
    model: Model = {p: [1.0 / len(known)] * len(languages) for p in known}
    for _ in range(ROUNDS if languages else 0):
        model = _round(found, languages, model)
    release(found)
    return languages, model


def _round(found: DataFrame, languages: list[str], model: Model) -> Model:
    place = {lang: k for k, lang in enumerate(languages)}
    grown = tree(model)

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(grown.pieces), len(languages)))
        for batch in batches:
            for begin in range(0, batch.num_rows, AT_ONCE):
                langs, found, counts = (column.to_pylist() for column in batch.slice(begin, AT_ONCE).columns)
                language, count = np.array([place[x] for x in langs]), np.array(counts)
                for _, _, rows, piece, share in shares(found, language, grown):
                    known = piece >= 0
                    rows = rows[known]
                    np.add.at(totals, (piece[known], language[rows]), count[rows] * share[known])
        piece, language = np.nonzero(totals)
        columns = [pa.array([languages[k] for k in language], pa.string()), pa.array([grown.pieces[i] for i in piece], pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(totals[piece, language])], names=["lang", "piece", "c"])

    # Rounded sums do not depend on the order of the rows.
    counts = found.mapInArrow(expected, "lang string, piece string, c double").groupBy("lang", "piece")
    fresh = {p: [SMOOTHING] * len(languages) for p in model}
    for lang, piece, c in counts.agg(F.round(F.sum("c"), 6).alias("c")).collect():
        fresh[piece][place[lang]] += c
    totals = [sum(p[k] for p in fresh.values()) for k in range(len(languages))]
    return {piece: [c / total for c, total in zip(p, totals)] for piece, p in fresh.items()}


def predict(docs: DataFrame, languages: list[str], model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; the score is the posterior of the prediction."""
    count, grown = len(languages), tree(model)

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        vectors = np.zeros((CACHE_WORDS, max(count, 1)))

        def totals(held: list[list[str]]) -> np.ndarray:
            scores = np.zeros((len(held), count))
            owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
            flat = [w for found in held for w in found]
            for begin in range(0, len(flat) if count else 0, HELD_WORDS):
                part = flat[begin : begin + HELD_WORDS]
                if len(place) + len(part) > CACHE_WORDS:
                    place.clear()
                fresh = sorted(set(part).difference(place), key=len)  # words of about one length share a block
                for i in range(0, len(fresh), AT_ONCE):
                    block = fresh[i : i + AT_ONCE]
                    vectors[len(place) : len(place) + len(block)] = forward_all(block, grown)
                    place.update(zip(block, range(len(place), len(place) + len(block))))
                np.add.at(scores, owner[begin : begin + HELD_WORDS], vectors[[place[w] for w in part]])
            return scores

        def labelled(ids: list, folds: list, held: list[list[str]]) -> pa.RecordBatch:
            names, likely = [], []
            for found, score in zip(held, totals(held)):
                if not found or not count:
                    names.append(UNDETERMINED)
                    likely.append(0.0)
                    continue
                best = int(score.argmax())
                names.append(languages[best])
                likely.append(float(1.0 / np.exp(np.maximum(score - score[best], -700)).sum()))
            columns = [pa.array(ids, pa.int64()), pa.array(folds, pa.bool_()), pa.array(names, pa.string()), pa.array(likely, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

        for batch in batches:
            begin, held, size = 0, [], 0
            ids, folds = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, text in enumerate(batch.column(1)):
                held.append(words(text.as_py()))
                size += len(held[-1])
                if size >= HELD_WORDS or i + 1 == len(ids):
                    yield labelled(ids[begin : i + 1], folds[begin : i + 1], held)
                    begin, held, size = i + 1, [], 0

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (crc_fold(F.col(id_col)) == 1).alias("held_out")
    )
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(
    docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Fit on the table and predict every row of it; rows come back under `doc_id`, whatever `id_col` is."""
    languages, model = fit(docs, vocabulary, id_col, text_col, lang_col)
    return predict(docs, languages, model, id_col, text_col)
