import hashlib
import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirestack.functions import geometry as G
from quirestack.functions import text as X
from quirestack.operators.order import pack
from quirestack.operators.retrieval import greedy_match, nearest_vectors, section_outline, verify_claims
from quirestack.sources.documents import asset_uri, last_page, nest_pages, page_text, read_lines, shred_pages, write_csv, write_lines


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_nearest_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, i % 3 if i else None, [float(x) for x in r.random(4)]) for i in range(60)] + [(99, 1, None)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    for part in (["label"], []):
        got = {(x.query_id, x.place): (x.hit_id, x.distance) for x in nearest_vectors(df, df.where("vec_id % 10 = 0"), "vec_id", "embedding", part, 4).collect()}
        for q, lab, v in rows:
            if v is None or q % 10:
                continue
            near = sorted((round(float(np.sqrt(((np.array(v, np.float32).astype(float) - np.array(w, np.float32).astype(float)) ** 2).sum())), 6), i) for i, m, w in rows if w is not None and (not part or m == lab))[:4]
            assert [got[q, k + 1] for k in range(len(near))] == [(i, s) for s, i in near]
    assert nearest_vectors(df, df, "vec_id", "embedding", [], 0).count() == 0
    assert nearest_vectors(df.limit(0), df.limit(0), "vec_id", "embedding", [], 3).count() == 0


def test_packing_skips_what_does_not_fit(spark):
    rows = [("q", "selected", 1, "aaaa"), ("q", "selected", 2, "b" * 40), ("q", "selected", 3, "cc"), ("q", "selected", 4, None), ("q", "other", 5, "x"), ("r", "selected", 1, "z" * 9)]
    df = spark.createDataFrame(rows, "question string, stage string, no int, text string")
    got = {(r.question, r.stage, r.no): (r.tokens, r.kept, r.used_after) for r in pack(df, ["question"], "stage", ["no"], "text", {"selected": 8}).collect()}
    assert got == {("q", "selected", 1): (4, True, 4), ("q", "selected", 2): (40, False, 4), ("q", "selected", 3): (2, True, 6), ("q", "selected", 4): (0, True, 6), ("q", "other", 5): (1, False, 0), ("r", "selected", 1): (9, False, 0)}


@pytest.mark.parametrize("text,floor,want", [("abc def", 1, 7), ("abc def", 4, 2), ("é", 1, 2), ("a.b", 1, 3), ("", 1, 0), (None, 1, 0), ("\n\n", 1, 2), ("  hello", 4, 2)])
def test_token_estimate(spark, text, floor, want):
    assert one(spark, X.estimate_tokens(F.lit(text).cast("string"), floor).alias("n")).n == want


def test_claims(spark):
    rows = [(1, "ResNet-50 reaches 94.2 accuracy", "we see ResNet-50 with 94.2 accuracy reaches all"), (2, "It reaches 95.1 accuracy now", "accuracy of 94.2 reaches all"), (3, "it does not", ""), (4, "some claim", None)]
    got = {r.id: (r.claim_coverage, list(r.missing_numbers), r.supported) for r in verify_claims(spark.createDataFrame(rows, "id int, claim string, ev string"), "claim", "ev").collect()}
    assert got[1] == (1.0, [], True) and got[2][1:] == (["95.1"], False) and got[3] == (1.0, [], True) and not got[4][2]


def test_text_functions(spark):
    t = lambda f, s: one(spark, f(F.lit(s)).alias("v")).v
    assert t(X.citation_labels, "see [1, 3–5] and [1]") == ["1", "3", "5"]
    assert (t(X.caption_kind, "Figure 3. A plot"), t(X.caption_number, "Table A.1: x"), t(X.caption_kind, "Figures show")) == ("figure", "A.1", None)
    assert (t(X.section_number, "2.1 Methods"), t(X.section_number, "Methods")) == ("2.1", None)
    assert (t(X.arxiv_id, "arXiv: 1706.03762v5"), t(X.last_year, "arXiv:1706.03762 in 2017, 2019"), t(X.last_year, "none")) == ("1706.03762", 2019, None)
    assert (t(X.dehyphenate, "con-\n tinue so­ft"), t(X.sanitise, "a<b>\x07  c​")) == ("continue soft", "a b c")
    assert t(X.looks_unterminated, "as in Fig.") and not t(X.looks_unterminated, "It ends.") and t(X.opens_mid_sentence, " lower")
    assert (t(X.furniture_key, " Page 12 "), t(lambda c: X.truncated(c, 5), "abcdefgh"), t(X.strip_reasoning, "<think>x</think> y"), t(X.camel_case, "block_id_now")) == ("page #", "abcd…", "y", "blockIdNow")
    assert t(X.mixed_script, "pаper") and not t(X.mixed_script, "paper") and t(X.is_name_list, "Ada Lovelace and Alan Turing")
    assert t(X.equation_number, "x = y (3.2)") == "(3.2)" and t(X.is_page_number, "- 12 -") and t(X.is_prose, "some words")
    assert t(X.content_tokens, "The ResNet-50, is_used.") == ["resnet-50", "is_used"]


def test_derived_id(spark):
    digest = hashlib.sha256(b"h|1|2").digest()
    assert one(spark, X.base32_id("blk_", 16, F.lit("h"), F.lit("1"), F.lit("2")).alias("v")).v == "blk_" + base64.b32encode(digest).decode().lower()[:16]


def test_geometry(spark):
    box = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    r = one(spark, G.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)).alias("i"), G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("z"), G.x_overlap_share(box(0, 0, 2, 1), box(1, 0, 5, 1)).alias("x"), G.quantise(F.lit(-0.5)).alias("q"), G.rotation(F.lit(-90)).alias("t"), G.rotation(F.lit(45)).alias("n"), G.signed_area(G.ring(box(0, 0, 2, 3))).alias("a"), G.extent(G.ring(box(0, 1, 2, 3))).alias("e"), G.point_in_polygon(F.lit(1.0), F.lit(1.0), G.ring(box(0, 0, 2, 2))).alias("p"), G.point_in_polygon(F.lit(3.0), F.lit(1.0), G.ring(box(0, 0, 2, 2))).alias("o"))
    assert (round(r.i, 6), r.z, r.x, r.q, r.t, r.n, r.a, r.e, r.p, r.o) == (0.142857, 0.0, 0.5, 0, 270, None, 6.0, [0, 1, 2, 3], True, False)


def test_greedy_match(spark):
    r = random.Random(3)
    rows = [("p", a, b, round(r.choice([0.5, 0.6, 0.7, 0.9]), 1)) for a in range(8) for b in range(8) if r.random() < 0.5]
    used, want = (set(), set()), set()
    for s, a, b in sorted(((s, a, b) for _, a, b, s in rows), reverse=True):
        if a not in used[0] and b not in used[1]:
            used[0].add(a)
            used[1].add(b)
            want.add((a, b, s))
    got = {(x.a, x.b, x.s) for x in greedy_match(spark.createDataFrame(rows, "g string, a int, b int, s double"), ["g"], "a", "b", "s").collect()}
    assert got == want


def test_outline(spark):
    rows = [("d", 1, 1, "a"), ("d", 2, 2, "b"), ("d", 3, 3, "c"), ("d", 4, 2, "e"), ("d", 5, 1, "f"), ("d", 6, 3, "g"), ("d", 7, 14, "h"), ("d", 8, None, "i"), ("d", 9, 15, "j")]
    got = {r.k: r.parent_heading for r in section_outline(spark.createDataFrame(rows, "d string, place int, level int, k string"), ["d"], ["place"], "level", "k").collect()}
    assert got == {"a": None, "b": "a", "c": "b", "e": "a", "f": None, "g": "f", "h": "g", "i": None, "j": "h"}


def test_documents(spark, tmp_path):
    rows = [("p", 1, 0, 1, 11, "b1", "paragraph", "body", None, None, ["x"], [0.0, 1.0, 2.0, 3.0], "té\n\"q\"", "ocr", 0.5), ("p", 1, 0, 0, 10, "b0", "title", "body", 0, "b1", None, [0.0] * 4, None, "ocr", None)]
    df = spark.createDataFrame(rows + rows[:1], "paper_id string, generation int, page_index int, sibling_order int, block_no long, block_id string, block_type string, flow_kind string, doc_order int, parent_id string, child_ids array<string>, bbox array<double>, text string, source_kind string, confidence double")
    pages = nest_pages(df).withColumn("j", F.to_json("blocks"))
    back = shred_pages(pages, "j")
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.distinct().collect()))
    assert shred_pages(pages.withColumn("j", F.lit("{")), "j").count() == 0
    write_lines(df, str(tmp_path / "l"))
    write_csv(df.select("block_id", "text"), str(tmp_path / "c"))
    assert read_lines(spark, str(tmp_path / "l"), "block_id string, text string").count() == 3
    with pytest.raises(Exception):
        (tmp_path / "bad.json").write_text('{"block_id": NaN}')
        read_lines(spark, str(tmp_path / "bad.json"), "block_id double").collect()
    text = F.lit("[Page 1] one [Page 2] two")
    r = one(spark, page_text(text, 2).alias("a"), page_text(text, 3).alias("b"), last_page(text).alias("c"), last_page(F.lit("x")).alias("d"), asset_uri(F.lit("p"), F.lit(1), "crop", F.lit("b")).alias("u"))
    assert (r.a, r.b, r.c, r.d, r.u) == ("two", None, 2, 1, "asset://p/1/crop/b@3x.png")
