import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quirestack.llm.bpe import Encoder, encode_corpus, vocabulary_path

P = pytest.importorskip("public_tokenizers")
with open(vocabulary_path(), "rb") as f:
    RANKS = f.read()
TRUTH = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={})
MINE = Encoder(RANKS)


def ids(texts):
    flat, start = MINE.encode(texts)
    return [flat[a:z].tolist() for a, z in zip(start[:-1], start[1:], strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)) | st.sampled_from("etaoin 's\n\t19"), max_size=60), max_size=6))
def test_any_text(texts):
    assert ids(texts) == [TRUTH.encode_ordinary(t) for t in texts]


def test_long_words_and_markers():
    r = random.Random(3)
    texts = ["a" * 5000, "ab" * 20000, "".join(r.choice("etaoinshr") for _ in range(3000)), "<|endoftext|>", "", "   ", "\n\n x", "it's 'LL", "﻿🙂‍↔️漢字"]
    texts += ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 300))) for _ in range(300)]
    assert ids(texts) == [TRUTH.encode_ordinary(t) for t in texts]


def test_words_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr("quirestack.llm.bpe.KEPT_WORDS", 2)
    e = Encoder(RANKS)
    for t in ("one two three four", "five six one two", ""):
        flat, _ = e.encode([t])
        assert flat.tolist() == TRUTH.encode_ordinary(t)


def test_operator(spark):
    df = spark.createDataFrame([(1, "one two", "x"), (2, None, "y"), (3, "", None), (None, "z", "z"), (1, "one two", "x")], "ids long, text string, extra string")
    got = sorted(map(tuple, encode_corpus(df, "text", ["ids"]).collect()), key=str)
    assert got == sorted(2 * [(1, TRUTH.encode_ordinary("one two"))] + [(2, []), (3, []), (None, TRUTH.encode_ordinary("z"))], key=str)
    assert encode_corpus(df.limit(0), "text", ["ids"]).count() == 0
