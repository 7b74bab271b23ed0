"""The transducer against the tokenizers library, and round trips of the state machine."""

import hashlib
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqstates.llm import bpe

PATH = bpe.default_path()
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.Transducer(PATH)
EDGES = [
    "", " ", "Hello, WORLD's 123 don't!!", "áé ΟΔΟΣ İstanbul ǅ ﬁ", "x<|endoftext|>y<|startoftext|><|endoftext|",
    "\u0085  a　b\x1cb\x1f", "日本語 🙂🙂‍↔️ é", "ab\u0000c", "½ ² ٣ Ⅷ", "'S 'll''re", "​﻿_-_",
]


@pytest.mark.parametrize("text", EDGES)
def test_edges(text):
    assert OWN.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.joined(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["a", "ab", "then", "abcdefghij", "!?-", "éß"])
def test_long_words_stream(letters):
    """Words of many windows; equal to the library's, which sees them whole."""
    rng = random.Random(7)
    word = "".join(rng.choice(letters) for _ in range(9 * OWN.lookahead + 17))
    assert len(word) > 2 * 3 * OWN.lookahead
    assert OWN.encode(word) == LIBRARY.encode(word, add_special_tokens=False).ids


def counting(cache_chunks):
    """A transducer, and the words it merges, by their symbols."""
    own, merged, merge = bpe.Transducer(PATH, cache_chunks), [], bpe.Transducer.merge
    own.merge = lambda symbols: merged.append("".join(symbols).removesuffix(bpe.END)) or merge(own, symbols)
    return own, merged


def test_words_merge_once_whatever_stands_beside_them():
    own, merged = counting(1000)
    text = "stone, stone. (stone) Stone;stone's <stone>\nstone!? \U0001F642stone"
    assert own.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert merged.count("stone") == 1 and len(merged) == len(set(merged))
    assert len(own.cache) + len(own.older) == len(merged)  # no entry but words


def test_words_in_use_stay_in_a_full_cache():
    own, merged = counting(20)
    rare = ["".join(p) for p in itertools.product("abcdef", repeat=3)]
    text = " ".join(f"stone {word}" for word in rare)
    assert own.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert merged.count("stone") == 1 and len(merged) == len(rare) + 1
    assert len(own.cache) + len(own.older) <= 21


def test_plain_pattern_cuts_as_the_word_pattern():
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(5)
    for text in ["".join(every), " ".join(every), "'".join(every), "".join(rng.choices(every, k=200_000)), "'re've'll'r'd'S'sa''t"]:
        assert OWN.plain.findall(text) == OWN.pattern.findall(text)


def test_pieces_of_ids_are_bounded(monkeypatch):
    """A text without a blank gives several pieces of ids; their strings join to those of the whole."""
    monkeypatch.setattr(bpe, "BLOCK", 7)
    text = "stone,fish;" * 9 + "<|endoftext|> end"
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    pieces = list(OWN.blocks(text))
    assert [i for p in pieces for i in p.tolist()] == ids and max(map(len, pieces)) == 7
    lister, decoder = bpe.Joiner(OWN.decimal), bpe.Joiner(OWN.shown)
    assert "".join(map(lister.feed, pieces)) == " ".join(map(str, ids))
    assert "".join(map(decoder.feed, pieces)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_decoder_gives_words_back():
    machine = bpe.Decoder(OWN)
    text = "größe 日本 the end"
    assert "".join(machine.feed(i) for i in OWN.encode(text)) + machine.finish() == text + " "


def test_table(spark):
    rows = [(1, "Some text 12."), (2, None), (3, ""), (4, "Some text 12."), (5, "word " * 9000), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", bpe.F.lit("clash"))
    small = sorted(map(str, bpe.encoded_digests(docs, cache_chunks=1).collect()))
    got = {r.doc_id: r for r in bpe.encoded_digests(docs).collect()}
    assert small == sorted(map(str, got.values()))
    for doc_id, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert got[doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encoded_digests(docs.limit(0)).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back[1] == "some text 1 2 . " and back[2] == back[3] == ""
