"""Token counts of texts by the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, on the vocabulary
(``whole_tokens``).  A text is cut at ASCII white space into words, a word by the tokenizer's own normalizer
and pre-tokenizer into pre-tokens.  A pre-token of that table counts one; only the others are
merged, and the ids themselves are never built.

A cut at ASCII white space changes nothing where the pre-tokenizer drops white space:
no pre-token holds any, composed characters never join across it, and letters are lowered one by
one.  Special strings hold none either; a word with one is encoded by the library as it is.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import raw

#: Words whose counts a worker remembers, and the longest of them in bytes.
MEMO_WORDS = 1_000_000
MEMO_BYTES = 64
#: Bytes of texts that are cut into words at a time.
PIECE = 1 << 20
#: Tokens above which a document is over the limit.
LIMIT = 2048
_BLANK = re.compile(rb"[\t-\r ]")


def _load(path: str) -> tuple[Tokenizer, str]:
    """The tokenizer, and the suffix that its model gives the last piece of a pre-token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer, json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix") or ""


def whole_tokens(path: str) -> frozenset[str]:
    """Pre-tokens, as the pre-tokenizer writes them, that the model encodes as one token.

    Every vocabulary string that can end a pre-token is run alone through the model: it is
    proved if one token comes back and it is that string.  At most one entry per vocabulary string.
    """
    tokenizer, suffix = _load(path)
    found = set()
    for string in tokenizer.get_vocab(with_added_tokens=False):
        if string.endswith(suffix) and len(string) > len(suffix):
            alone = string[: len(string) - len(suffix)]
            tokens = tokenizer.model.tokenize(alone)
            if len(tokens) == 1 and tokens[0].value == string:
                found.add(alone)
    return frozenset(found)


class Words(dict):
    """Token counts of words (UTF-8, without ASCII white space), found as they are asked for."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer, _ = _load(path)
        self.whole = whole
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        seen = [piece for piece, _ in self._pieces("a b\tc")]
        if len(seen) != 3 or any(s.split() != [s] for s in self.special):
            raise ValueError("the shortcut needs a tokenizer that drops white space between its pre-tokens")

    def _pieces(self, word: str) -> list[tuple[str, tuple[int, int]]]:
        normalizer = self.tokenizer.normalizer
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(normalizer.normalize_str(word) if normalizer else word)

    def __missing__(self, word: bytes) -> int:
        text = word.decode()
        if any(s in text for s in self.special):
            n = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            n = sum(1 if p in self.whole else len(self.tokenizer.model.tokenize(p)) for p, _ in self._pieces(text))
        if len(word) <= MEMO_BYTES:
            self[word] = n
        return n

    def count(self, text: bytes) -> int:
        return sum(sum(map(self.__getitem__, piece.split())) for piece in _pieces_of(text))


def _pieces_of(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end before white space, so that its words are never all held at once."""
    at = 0
    while len(text) - at > PIECE:
        blank = _BLANK.search(text, at + PIECE)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


_WORDS: dict[str, Words] = {}


def counter(path: str, whole: frozenset[str]) -> Words:
    """One memory of words a worker, which lasts over its tasks."""
    if path not in _WORDS:
        _WORDS[path] = Words(path, whole)
    if len(_WORDS[path]) > MEMO_WORDS:
        _WORDS[path].clear()
    return _WORDS[path]


def n_tokens(text: Column, path: str) -> Column:
    """Tokens of a string column as the tokenizers library counts them, without special tokens added; null: 0.

    ``path``: a tokenizer file that every worker can read, whose pre-tokenizer drops white space.
    """
    whole = whole_tokens(path)

    @F.arrow_udf(T.LongType())
    def run(column: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(column), 64):
            words = counter(path, whole)
            out += [words.count(t) if t else 0 for t in raw(column.slice(i, 64))]
        return pa.array(out, pa.int64())

    return run(text)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row.

    Null and empty texts have 0 bytes and 0 tokens; texts of white space alone have no tokens.  Special
    strings inside texts count as the library's default counts them, one token each.  Texts
    are counted whole, a piece at a time.  Null ids stay, repeated rows count each, other columns
    are left out; an empty table gives none.
    """
    if Path(path).suffix != ".json":
        raise ValueError("a tokenizer file of the tokenizers library is needed")
    rows = df.select(F.col(id_col), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(F.col(text), path).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
