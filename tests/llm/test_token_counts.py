"""Token counts against the library's own encoding of whole texts."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from helpers import awkward, frame, ids_first
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from soundkeel.llm import token_counts
from soundkeel.llm.queries import op12_token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(PATH)
WHOLE = token_counts.whole_tokens(PATH)
WORDS = token_counts.Words(PATH, WHOLE)


def library(text: str | None) -> int:
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


ODD = [
    "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|ENDOFTEXT|>", "it's IT'S don't we'll 'ſ", "H̱ ẖ Å Å ẞ ΣΑΣ Σ", "x y z　w",
    "\x1c\x1f\x85 a\x00b", "12345 ½ Ⅷ ٣", "中文没有空格的句子", "́ leading mark", "a ́b", "😀😀!!!", "İstanbul ŉ ﬁne", "\r\n\t\x0b\x0c", "한글 한",
    "<|endo ftext|>", "a<|endoftext|", "é" * 50, "z" * 5000,
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert WORDS.count(text.encode()) == library(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", "<|startoftext|>", " ", "\n", "'re", "́", "the", "Σ"])), max_size=12))
def test_any_text(parts):
    text = "".join(parts)
    assert WORDS.count(text.encode()) == library(text)


def test_proved_strings_are_one_token():
    plain = [w for w in WHOLE if w.isascii() and w.isalpha() and w == w.lower()]
    assert len(WHOLE) > 30_000 and all(library(w) == 1 for w in plain[:3000])
    left = [s for s in LIBRARY.get_vocab(with_added_tokens=False) if s.endswith("</w>") and s[:-4] not in WHOLE and s != "</w>"]
    assert all(len(LIBRARY.model.tokenize(s[:-4])) > 1 for s in left)


def test_only_the_rest_is_merged():
    words = token_counts.Words(PATH, WHOLE)
    merged = []

    class Spy:
        def tokenize(self, piece):
            merged.append(piece)
            return LIBRARY.model.tokenize(piece)

    class Library:
        normalizer, pre_tokenizer, model = LIBRARY.normalizer, LIBRARY.pre_tokenizer, Spy()

    words.tokenizer = Library()
    assert words.count(b"the whale, zzqqxv the whale") == library("the whale, zzqqxv the whale") and merged == ["zzqqxv"]


def test_pieces_and_memory(monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 50)
    monkeypatch.setattr(token_counts, "MEMO_BYTES", 6)
    words = token_counts.Words(PATH, WHOLE)
    rng = random.Random(3)
    text = " ".join(rng.choice(["abc", "Wörter", "x" * 80, " ", "whales."]) for _ in range(400))
    assert words.count(text.encode()) == library(text)
    assert words and max(map(len, words)) <= 6


def test_rows(spark):
    rows = awkward() + [(200 + i, t, "en", "a") for i, t in enumerate(ODD)]
    got = token_counts.count_tokens(frame(spark, rows), PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), library(t), library(t) > 2048) for i, t, *_ in rows]
    assert ids_first(map(tuple, got.collect())) == ids_first(want)
    assert any(r[3] for r in want)
    assert token_counts.count_tokens(frame(spark, rows).limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.Words(public_tokenizers.path("byte_bpe_50k.json"), frozenset())


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op12_token_counts(spark, SF).collect()}
    assert got == {i: (len((t or "").encode()), library(t), library(t) > 2048) for i, t in docs}
