from hypothesis import given, settings
from hypothesis import strategies as st

from quirestack.llm.split import boundaries, code_points, cut_points, longest_run, split_texts


def pieces(text, limit, overlap):
    cuts, strength = cut_points(code_points(text), limit, overlap)
    return [text[a:z] for a, z in zip([0, *(c - overlap for c in cuts)], [*cuts, len(text)], strict=True)], cuts, strength


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdé漢. \n,!"), max_size=600), st.integers(20, 80), st.integers(0, 10))
def test_limits_overlap_and_pauses(text, limit, overlap):
    got, cuts, strength = pieces(text, limit, overlap)
    assert all(len(p) <= limit for p in got)
    back = got[0] + "".join(p[overlap:] for p in got[1:])
    assert back == text
    for a, b in zip(got, got[1:], strict=False):
        assert b[:overlap] == a[len(a) - overlap :]
    if len(text) <= limit:
        assert len(got) == 1
    prev = 0
    for i, c in enumerate(cuts):
        if strength[c] == 0:  # forced: no white space since the last cut within reach
            room = limit if i == 0 else limit - overlap
            assert not strength[max(prev + 1, overlap) : prev + room + 1].any()
        prev = c


def test_balance_and_strength():
    text = ("One sentence here. " * 20).strip() + "\n\n" + ("Another one there. " * 20).strip()
    got, cuts, strength = pieces(text, 450, 20)
    assert len(got) == 2 and strength[cuts[0]] == 5


def test_operator(spark):
    long = "word " * 1000
    rows = [(1, long, "k"), (2, "", None), (3, None, "x"), (4, "a" * 5000, "k"), (4, "a" * 5000, "k")]
    df = spark.createDataFrame(rows, "piece_no long, text string, extra string")
    got = split_texts(df, "text", ["piece_no"]).collect()
    assert {r.in_piece_no for r in got} == {1, 2, 4}
    assert max(len(r.piece_text) for r in got) <= 1600
    assert [r.piece_text for r in got if r.in_piece_no == 2] == [""]
    assert {r.cut_kind for r in got if r.in_piece_no == 4} == {"forced", "end"}
    assert split_texts(df.limit(0), "text", ["piece_no"]).count() == 0
    assert longest_run(code_points("ab cde f")) == 3


def least_pieces(text, limit, overlap):
    """The fewest pieces if every cut is at a boundary or, where a whole piece's length has none, anywhere."""
    strength = boundaries(code_points(text))
    n, room = len(text), limit - overlap
    best = {overlap: 1}
    for a in range(overlap, n):
        if a not in best or n - a <= room:
            continue
        reach = [c for c in range(a + 1, min(a + room, n - 1) + 1) if strength[c]]
        for c in reach or range(a + 1, a + room + 1):
            best[c] = min(best.get(c, n), best[a] + 1)
    return min(k for a, k in best.items() if n - a <= room)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abc \n."), min_size=60, max_size=400), st.integers(20, 60), st.integers(0, 10))
def test_no_more_pieces_than_needed(text, limit, overlap):
    if len(text) > limit and longest_run(code_points(text)) < limit - overlap:
        assert len(pieces(text, limit, overlap)[0]) == least_pieces(text, limit, overlap)


def test_many_extra_pieces():
    """Words just too long to share a piece: twice as many pieces as the length alone asks for, and no cut is forced."""
    text = " ".join(["a" * 60] * 40)
    got, cuts, strength = pieces(text, 100, 10)
    assert len(got) == 40 and all(strength[c] for c in cuts)


def test_line_ends_and_marks_stay_whole():
    text = "a\r\n" * 200
    assert all(not (text[c - 1] == "\r" and text[c] == "\n") for c in pieces(text, 50, 5)[1])
    text = "\r\n" * 200
    assert all(not (text[c - 1] == "\r" and text[c] == "\n") for c in pieces(text, 50, 5)[1])
    text = "e\u0301" * 300
    got, cuts, _ = pieces(text, 51, 5)
    assert all(text[c] == "e" for c in cuts) and max(map(len, got)) <= 51
    assert max(map(len, pieces("\u0301" * 300, 51, 5)[0])) <= 51
