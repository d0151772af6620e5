import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quirestack.llm.canon import alike_classes, alike_pairs, canonical_array, consistent_form


def form(*texts):
    return canonical_array(pa.array(list(texts), pa.string())).to_pylist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)) | st.sampled_from("eaoñȩ́́̈ͅ각각"), max_size=12), max_size=8))
def test_plain_composition_is_nfc(texts):
    assert canonical_array(pa.array(texts, pa.string()), fold=False).to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


def test_prints_alike():
    for a, b in [("ﬁrst", "first"), ("Ｚｅｌ－５", "Zel-5"), ("résumé", "résumé"), ("a b c", "a b c"), ("co­op​erate︎", "cooperate"), ("сорт", "copт".replace("т", "т")), ("low‑rank", "low-rank"), ("x \r\ny ", "x\ny"), ("Å", "Å"), ("νοte", "vote"), ("K", "K")]:
        assert len(set(form(a, b))) == 1, (a, b)


def test_prints_differently():
    for a, b in [("resume", "résumé"), ("Us", "us"), ("x2", "x²"), ("1", "①"), ("colour", "color"), ("a b", "ab"), ("a  b", "a b"), ("α", "a"), ("—", "-")]:
        assert len(set(form(a, b))) == 2, (a, b)


def test_edges():
    assert form(None, "", " ", "́a", "e" + "́" * 3000) [:4] == [None, "", "", "́a"]
    once = form("Ｅ́lan ﬃ", "x" * 200_000 + "́")
    assert form(*once) == once
    assert canonical_array(pa.array([], pa.string())).to_pylist() == []


def test_pairs(spark):
    rows = [(1, "p", "ﬁve"), (2, "p", "five"), (2, "p", "five"), (3, "p", "five"), (4, "q", "five"), (5, "p", None), (None, "p", "five"), (6, None, "five"), (7, "p", ""), (8, "p", "​"), (9, "p", "Five")]
    df = spark.createDataFrame(rows, "block_no long, paper_id string, text string")
    got = {tuple(r) for r in alike_pairs(df, "text", "paper_id", "block_no").collect()}
    assert got == {(1, 2), (1, 3), (7, 8)}
    assert alike_pairs(df.limit(0), "text", "paper_id", "block_no").count() == 0
    assert consistent_form(df.withColumnRenamed("block_no", "text_form"), "text", ["text_form"]).columns == ["in_text_form", "text_form"]


def test_classes_and_pairs_agree(spark):
    variants = ["five", "\ufb01ve", "f\u200bive", "\uff46ive"]
    rows = [(k, "p", variants[k % 7 % 4]) for k in range(60)] + [(100 + k, "q", "five") for k in range(9)]
    df = spark.createDataFrame(rows, "block_no long, paper_id string, text string")
    pairs = {tuple(r) for r in alike_pairs(df, "text", "paper_id", "block_no").collect()}
    assert pairs == {(a, b) for a, g, s in rows for b, h, t in rows if a < b and g == h and s != t}
    got = {r.block_no: (r.representative, r.variants, r.members) for r in alike_classes(df, "text", "paper_id", "block_no").collect()}
    assert got == {a: (min(b for b, h, t in rows if h == "p" and t == s), 4, 60) for a, g, s in rows if g == "p"}
