"""Sizes of texts in tokens of a public byte-level BPE vocabulary.

A piece of text between blanks is encoded once per worker and remembered, so
whole texts are counted at the speed of a dictionary. The memory is bounded
and holds exact counts: splitting before a blank that follows no blank never
cuts a token, and texts with any other use of blanks are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT = 300_000


class _Whole(Exception):
    """The text must be encoded whole."""


class _Counts(dict):
    """Word -> tokens, with a lead (a blank, or nothing) before the word."""

    def __init__(self, encode, lead: str) -> None:
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> int:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Whole
        if len(self) >= KEPT:
            self.clear()
        n = len(self.encode(self.lead + word))
        if len(word) < 64:
            self[word] = n
        return n


def counter(vocabulary: str):
    """A function from text to its number of tokens; null and empty texts have none."""
    with open(vocabulary, "rb") as f:
        return _counter(f.read())


@lru_cache(maxsize=4)
def _counter(lines: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    first, later = _Counts(encode, ""), _Counts(encode, " ")
    newline = len(encode("\n"))

    def count(text: str | None) -> int:
        if not text:
            return 0
        try:
            lines = text.split("\n")
            n = newline * (len(lines) - 1)
            for line in lines:
                words = line.split(" ")
                n += first[words[0]]
                del words[0]
                n += sum(map(later.__getitem__, words))
            return n
        except _Whole:
            return len(encode(text))

    return count


def token_counts(documents: DataFrame, columns: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``columns`` of the documents and n_tokens, the size of the whole text.

    The vocabulary, a file of a few MB, is read where the query is made and
    sent to the workers, which need not have it.
    """
    with open(vocabulary, "rb") as f:
        lines = documents.sparkSession.sparkContext.broadcast(f.read())
    kept = documents.select(*columns, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text") + ", n_tokens long"

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(lines.value)
        for pdf in batches:
            yield pdf[columns].assign(n_tokens=[count(t) for t in pdf["_text"]])

    return kept.mapInPandas(sizes, schema)
