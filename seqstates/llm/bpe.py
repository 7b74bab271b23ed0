"""BPE encoding and decoding as streaming transducers with bounded memory.

`Transducer` encodes one word at a time.  Whether two neighbouring symbols merge depends
on what follows only through a chain of rules: a merge can be pre-empted by a merge of its
right part with the next symbol that has a better rank, that one by the next, and so on.
The longest such chain times the longest token is the sufficient lookahead of the merge
list.  A word is read into a window; tokens that end at least a lookahead before the end
of the window are stable, are emitted, and leave the window.  So a word of any length
needs memory for one window only.  Texts are cut into blocks at blanks, and repeated
words are served from a cache of bounded size that keeps those used of late.

`Decoder` is the reverse state machine: ids in, text out, piece by piece, holding back
at most the bytes of one unfinished character.  `joined` gives what the library's decode
returns for a tokenizer file without a decoder: the token strings joined by blanks.

NULL and empty texts have no tokens and decode to the empty text.  Ids of repeated rows
are computed for each row.  Only the id and text columns are read; an empty table gives
an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


CACHE_CHUNKS = 500_000  # words in the cache
SHORT = 24  # symbols that are merged by plain search
BLOCK = 1_000_000  # characters encoded, and ids emitted, at once
END = "</w>"
# What the tokenizer library's Unicode tables (16.0) have other than ours.
# White space of its pattern engine; letters and numbers too new for it; lower case of letters too new for Python's.
_BLANK = r"\t-\r\x20\x85\p{Z}"
_TOO_NEW = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    r"\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8"
    r"\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    r"\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6"
    r"\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    r"\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
_LETTER, _NUMBER = rf"[\p{{L}}--[{_TOO_NEW}]]", rf"[\p{{N}}--[{_TOO_NEW}]]"
_LOWER = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {
    0x10D50 + i: 0x10D70 + i for i in range(22)
}
_ODD_CASE = re.compile("[" + "".join(map(chr, _LOWER)) + "]")
_BEYOND = re.compile("[\U00010000-\U0010FFFF]")


def word_pattern() -> regex.Pattern:
    """Fixed value: the word pattern of the tokenizer file."""
    other = rf"[^[{_BLANK}][\p{{L}}\p{{N}}--[{_TOO_NEW}]]]"
    return regex.compile(f"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{_LETTER}+|{_NUMBER}|{other}+")


def plain_pattern() -> re.Pattern:
    """`word_pattern` for texts of characters up to U+FFFF, with ranges for its classes, which Python's engine looks up faster."""
    every = "".join(map(chr, range(0x10000)))

    def ranges(one: str) -> str:
        return "".join(rf"\u{ord(m[0][0]):04X}-\u{ord(m[0][-1]):04X}" for m in regex.finditer(f"(?V1){one}+", every))

    letters, numbers, blanks = map(ranges, (_LETTER, _NUMBER, f"[{_BLANK}]"))
    return re.compile(f"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{numbers}]|[^{blanks}{letters}{numbers}]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    shown = {b: chr(b) for b in own}
    shown.update((b, chr(256 + i)) for i, b in enumerate(b for b in range(256) if b not in shown))
    return [shown[b] for b in range(256)]


class Transducer:
    """Encoder for one tokenizer file."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        self.cache_chunks = cache_chunks
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.merged = [left + right for left, right in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.bytes_shown = byte_characters()
        self.bytes_ending = [c + END for c in self.bytes_shown]
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.pattern, self.plain = word_pattern(), plain_pattern()
        self.lookahead = sufficient_lookahead(merges)
        self.shown = pa.array(map(self.names.get, range(max(self.names) + 1)), pa.string())
        self.decimal = pa.array(map(str, range(max(self.names) + 1)), pa.string())
        self.id_bytes = {t: np.int32(i).tobytes() for t, i in self.vocab.items()}
        self.cache: dict[str, bytes] = {}  # ids of words
        self.older: dict[str, bytes] = {}  # words that go with the next half of a cache, unless met before

    def symbols(self, word: str, start: int, length: int) -> Iterator[str]:
        """The symbols of a piece of a word; the last one of the word carries the end mark."""
        shown = self.bytes_shown
        for i in range(start, min(start + length, len(word))):
            data = word[i].encode("utf-8")
            for j, byte in enumerate(data):
                yield shown[byte] + (END if i == len(word) - 1 and j == len(data) - 1 else "")

    def merge(self, symbols: list[str]) -> list[str]:
        """Apply the best-ranked merge, leftmost first, until none is left."""
        ranks, n = self.ranks, len(symbols)
        if n <= SHORT:
            get, none = ranks.get, len(self.merged)
            costs = [get(p, none) for p in zip(symbols, symbols[1:])]
            while costs and (best := min(costs)) != none:
                i = costs.index(best)
                symbols[i] = token = self.merged[best]
                del symbols[i + 1], costs[i]
                if i:
                    costs[i - 1] = get((symbols[i - 1], token), none)
                if i < len(costs):
                    costs[i] = get((token, symbols[i + 1]), none)
            return symbols
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = [(ranks[p], i, p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in ranks]
        heapq.heapify(queue)
        gone = [False] * n
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if gone[i] or j >= n or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i] += symbols[j]
            gone[j] = True
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (symbols[i], symbols[after[i]])) in ranks:
                    heapq.heappush(queue, (ranks[p], i, p))
            if before[i] >= 0 and (p := (symbols[before[i]], symbols[i])) in ranks:
                heapq.heappush(queue, (ranks[p], before[i], p))
        return [s for s, dead in zip(symbols, gone) if not dead]

    def tokens(self, word: str) -> Iterator[str]:
        """Tokens of a word, each as soon as no later symbol can change it."""
        step = 3 * self.lookahead
        window: list[str] = []
        for start in range(0, len(word), step):
            window.extend(self.symbols(word, start, step))
            if start + step >= len(word):
                break
            fresh, size, used = self.merge(list(window)), len(window), 0
            for token in fresh:
                if used + len(token) > size - self.lookahead:
                    break
                used += len(token)
                yield token
            del window[:used]
        yield from self.merge(window)

    def word(self, word: str) -> bytes:
        """Ids of a word that the newer half of the cache does not have."""
        found = self.older.get(word)
        if found is None:
            if len(word) <= SHORT:  # one window
                data, shown = word.encode(), self.bytes_shown
                tokens = self.merge([*map(shown.__getitem__, data[:-1]), self.bytes_ending[data[-1]]])
            else:
                tokens = self.tokens(word)
            found = b"".join(map(self.id_bytes.__getitem__, tokens))
        if len(word) <= 64:
            if 2 * len(self.cache) >= self.cache_chunks:
                self.older.clear()
                self.older.update(self.cache)
                self.cache.clear()
            self.cache[word] = found
        return found

    def blocks(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text in order, a bounded part of the text and a bounded number of them at a time."""
        known, done = self.cache.get, 0
        for match in itertools.chain(self.cut.finditer(text) if "<|" in text else (), (None,)):
            end = match.start() if match else len(text)
            while done < end:
                stop = text.find(" ", min(done + BLOCK, end), end)  # nothing composes across a blank
                stop = end if stop < 0 else stop
                part = normalised(text[done:stop])
                pattern = self.plain if part.isascii() or _BEYOND.search(part) is None else self.pattern
                ids = np.frombuffer(b"".join([known(w) or self.word(w) for w in pattern.findall(part)]), np.int32)
                yield from (ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK))
                done = stop
            if match:
                yield np.array([self.special[match[0]]], np.int32)
                done = match.end()

    def encode(self, text: str | None) -> list[int]:
        return [i for block in self.blocks(text or "") for i in block.tolist()]

    def joined(self, ids: Iterable[int]) -> str:
        """Token strings joined by blanks."""
        return " ".join(self.names[i] for i in ids)


def normalised(text: str) -> str:
    """Composed and in lower case, character by character: a final sigma is no exception.

    Blanks need no folding, as no word holds any.
    """
    text = unicodedata.normalize("NFC", text)
    return (text if text.isascii() or _ODD_CASE.search(text) is None else text.translate(_LOWER)).lower()


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols to the right that can change whether a token ends here.

    `chain[t]` is the longest chain of ever better-ranked rules that starts with a rule
    whose left part is t; rules are visited from the best rank on.
    """
    chain: dict[str, int] = {}
    longest, widest = 0, 1
    for left, right in merges:
        length = 1 + chain.get(right, 0)
        chain[left] = max(chain.get(left, 0), length)
        longest = max(longest, length)
        widest = max(widest, len((left + right).removesuffix(END)))
    return (longest + 1) * widest


class Decoder:
    """Incremental byte-to-text state machine: feed ids, take text as it becomes whole."""

    def __init__(self, transducer: Transducer):
        self.names, self.special = transducer.names, set(transducer.special.values())
        self.bytes = {c: i for i, c in enumerate(transducer.bytes_shown)}
        self.pending = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token_id: int) -> str:
        name = self.names[token_id]
        if token_id in self.special:
            return self.pending.decode(b"", True) + name
        ends = name.endswith(END)
        data = bytes(self.bytes[c] for c in (name.removesuffix(END) if ends else name))
        return self.pending.decode(data + b" " * ends)

    def finish(self) -> str:
        return self.pending.decode(b"", True)


class Joiner:
    """Incremental decoder of a file that names no decoder: the strings of the tokens, with a blank between two.

    Takes any number of ids at a time and gives the text they add.
    """

    def __init__(self, strings: pa.Array):
        self.strings, self.begun = strings, False

    def feed(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        row = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), self.strings.take(pa.array(ids)))
        text = pc.binary_join(row, " ")[0].as_py()
        if self.begun:
            return " " + text
        self.begun = True
        return text


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_loaded: dict[str, Transducer] = {}


def transducer(path: str, cache_chunks: int = CACHE_CHUNKS) -> Transducer:
    """One per process and file; the size of its cache is that of the last call."""
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    _loaded[path].cache_chunks = cache_chunks
    return _loaded[path]


def encoded_digests(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", cache_chunks: int = CACHE_CHUNKS
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: ids as they are emitted, and the text that they decode to.

    `cache_chunks` bounds the memory of a worker; the results do not depend on it.
    """
    path = path or default_path()

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = transducer(path, cache_chunks)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1):
                total, ids_hash, decoded_hash = 0, hashlib.sha256(), hashlib.sha256()
                lister, decoder = Joiner(encoder.decimal), Joiner(encoder.shown)
                for emitted in encoder.blocks(text.as_py() or ""):
                    total += len(emitted)
                    ids_hash.update(lister.feed(emitted).encode())
                    decoded_hash.update(decoder.feed(emitted).encode())
                counts.append(total)
                ids.append(ids_hash.hexdigest())
                decoded.append(decoded_hash.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    path = path or default_path()

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = transducer(path)
        for batch in batches:
            ids = [encoder.encode(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text), by the state machine; blanks stand where words end."""
    path = path or default_path()

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                machine = Decoder(transducer(path))
                texts.append("".join([machine.feed(i) for i in ids.as_py() or []]) + machine.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(batches, "doc_id long, text string")


