import random

import numpy as np
import pyarrow as pa

from quirestack.llm.leak import leaks, reproduced, runs, tiles, word_hashes
from quirestack.llm.queries import p7_found

R = random.Random(8)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(5)) for _ in range(400)]


def text(n):
    return [R.choice(WORDS) for _ in range(n)]


def brute(doc, item, window=12, others=1):
    return any(sum(a == b for a, b in zip(doc[i : i + window], item[j : j + window], strict=True)) >= window - others for i in range(len(doc) - window + 1) for j in range(len(item) - window + 1))


def hashes(words):
    return word_hashes(pa.array([" ".join(words)]))[0]


def test_against_brute_force():
    for _ in range(300):
        item = text(R.randrange(5, 40))
        doc = text(R.randrange(0, 60))
        if R.random() < 0.8:
            a = R.randrange(len(item))
            part = item[a : a + R.randrange(3, 20)]
            for _ in range(R.randrange(0, 3)):
                part[R.randrange(len(part))] = "zzz"
            k = R.randrange(len(doc) + 1)
            doc[k:k] = part
        x, y = hashes(doc), hashes(item)
        assert bool(reproduced(x, y, runs(x, y))) == brute(doc, item)


def test_words():
    a, b = (word_hashes(pa.array([t]))[0] for t in ("**Hello**, _WORLD_!  café​ — x", "hello world café X"))
    assert np.array_equal(a, b)
    h, at = word_hashes(pa.array(["a b", None, "", " . ", "c"]))
    assert at.tolist() == [0, 2, 2, 2, 2, 3] and len(h) == 3


def test_reordered_tiles():
    item = text(30)
    doc = item[15:] + item[:15]
    x, y = hashes(doc), hashes(item)
    found = tiles(x, y, runs(x, y))
    assert sorted(n for _, _, n in found) == [15, 15]


def test_operator(spark):
    passage = " ".join(text(30))
    words = passage.split()
    docs = [(1, "x " + " ".join(words[3:15]) + " y"), (2, " ".join(words[3:12])), (3, None), (4, ""), (5, passage.upper().replace(" ", "  ")), (5, passage.upper().replace(" ", "  ")), (6, " ".join(words[:6] + ["other"] + words[7:12])), (None, passage)]
    items = [(10, passage, "short question"), (11, passage, None), (12, None, ""), (10, passage, "short question")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, passage string, question string")
    for size in (20_000_000, 1):
        got = {(r.doc_id, r.item_id) for r in leaks(d, "text", "doc_id", i, "item_id", ["passage", "question"], pass_chars=size).collect()}
        assert got == {(x, y) for x in (1, 5, 6, None) for y in (10, 11)}
        assert leaks(d.limit(0), "text", "doc_id", i, "item_id", ["passage"], pass_chars=size).count() == 0
    assert leaks(d, "text", "doc_id", i.limit(0), "item_id", ["passage"]).count() == 0


def test_another_order_and_an_inserted_word(spark):
    words = text(30)
    short = text(20)
    docs = [(1, " ".join(["a", *words[20:], "b", *words[:10], "c", *words[10:20]])), (2, " ".join([*short[:10], "new", *short[10:]])), (3, " ".join(words[:10])), (4, " ".join(words))]
    items = [(10, " ".join(words)), (11, " ".join(short))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    for size in (20_000_000, 1):
        got = {(r.doc_id, r.item_id): (r.copied_words, r.covered_words) for r in leaks(d, "text", "doc_id", i, "item_id", ["passage"], pass_chars=size).collect()}
        assert got == {(1, 10): (0, 30), (2, 11): (0, 20), (4, 10): (30, 30)}


def test_an_item_quoted_twice():
    """The tile of the first quotation takes the words of the second, whose diagonal counts all the same."""
    item = text(12)
    x, y = hashes([*item[2:12], "q", "r", "s", *item[:5], "zzz", *item[6:12]]), hashes(item)
    assert reproduced(x, y, runs(x, y)) == 12


def test_held_out_queries_against_brute_force(spark):
    """Both queries on the smallest tables, window by window."""
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: hashes(r.text.split()) for r in spark.read.parquet(f"{d}/documents.parquet").where("text is not null").collect()}
    items = [(r.item_id, hashes((t or "").split())) for r in spark.read.parquet(f"{d}/eval_items.parquet").collect() for t in (r.passage, r.question)]
    want = set()
    for k, item in items:
        for n, doc in docs.items():
            if len(item) >= 12 and len(doc) >= 12:
                a, b = (np.lib.stride_tricks.sliding_window_view(v, 12) for v in (doc, item))
                if any((a == w).sum(1).max() >= 11 for w in b):
                    want.add((n, k))
    assert {tuple(r) for r in p7_found(spark, d).collect()} == want
