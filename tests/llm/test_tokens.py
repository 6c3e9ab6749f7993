import base64
import random

import tiktoken

from specstrata.llm import tokens
from specstrata.llm.tokens import PATTERN, VOCABULARY, token_counts


def plain():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_counts_equal_the_tokenizer(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 40)
    encode, count = plain(), tokens._counter.__wrapped__(open(VOCABULARY, "rb").read())
    rng = random.Random(2)
    parts = ["word", "don't", "x1", "é̂", " ", "  ", "\n", "\n\n", " \n ", "\t", " ", " ", "​", "…", "日本", "a" * 80, "'s", "\r\n", "\x85", "\x1c", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(8)))
        assert count(text) == len(encode(text)), repr(text)
    assert count(None) == count("") == 0


def test_columns(spark):
    df = spark.createDataFrame([(1, "a b", "s", 9), (2, None, None, 9), (3, "", "s", 9)], "doc_id long, text string, source string, n_tokens int")
    assert [tuple(r) for r in token_counts(df, ["doc_id", "source"]).orderBy("doc_id").collect()] == [(1, "s", 2), (2, None, 0), (3, "s", 0)]
