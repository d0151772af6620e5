"""State, jobs, evaluation, order, expansion, running text and disturbance against small cases worked out by hand or by brute force."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quirestack.functions import flow as L
from quirestack.functions import geometry as G
from quirestack.functions import normal as N
from quirestack.functions import records as R
from quirestack.functions import repairs as Q
from quirestack.operators import evaluation as E
from quirestack.operators import expansion as P
from quirestack.operators import order as O
from quirestack.operators import perturb as D
from quirestack.operators import state as S
from quirestack.operators.jobs import job_log
from quirestack.sources.documents import keyed_answers, nest, shred, statements, without_nulls


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_state_against_a_dictionary(spark):
    r = random.Random(4)
    rows = [(f"k{r.randrange(6)}", n, r.choice(["insert", "update", "update", "delete", None]), r.choice([None, r.randrange(100)])) for n in range(200)]
    now, told = {}, {}
    for k, n, kind, v in rows:
        ok = (kind == "insert" and k not in now) or (kind in ("update", "delete") and k in now)
        if ok and kind == "insert":
            now[k] = [v, 1]
        elif ok and kind == "update":
            now[k] = [v if v is not None else now[k][0], now[k][1] + 1]
        elif ok:
            del now[k]
        told[n] = (kind if ok else "denied", now[k][1] if k in now else 0)
    df = S.judged(spark.createDataFrame(rows, "key string, n int, kind string, value int"), ["key"], ["n"], "kind")
    assert {x.key: [x.value, x.version] for x in S.state_after(df, ["key"], ["n"], "kind", ["value"]).collect()} == now
    audit = S.audit(df, ["key"], ["n"], "kind")
    assert {x.n: (x.outcome, x.version) for x in audit.collect()} == told
    assert S.audit_is_append_only(audit, audit.where("n < 150")).count() == 50
    assert S.state_after(df.limit(0), ["key"], ["n"], "kind", ["value"]).count() == 0


def test_keys_of_others(spark):
    up = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    down = spark.createDataFrame([("a", 1), ("c", 2), (None, 3), ("a", 1)], "k string, n int")
    assert sorted(r.n for r in S.cascade(down, up, ["k"]).collect()) == [1, 1]
    assert [r.n for r in S.dangling(down, up, ["k"]).collect()] == [2]
    assert {(r.n, r.wins) for r in S.first_of(spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, n int"), ["k"], ["n"]).collect()} == {(2, False), (1, True), (5, True)}


def test_leases(spark):
    log = [("j", 1, 0.0, "claim", 7), ("j", 2, 5.0, "claim", 8), ("j", 3, 9.0, "renew", 7), ("j", 3, 9.0, "renew", 7), ("j", 4, 15.0, "claim", 8), ("j", 5, 20.0, "claim", 8), ("j", 6, 21.0, "finish", 7), ("j", 7, 22.0, "fail", 8), ("j", 8, 23.0, "claim", 9), ("j", 9, 24.0, "fail", 9), ("j", 10, 25.0, "claim", 7), ("x", 1, 0.0, "finish", 1), (None, 1, 0.0, "claim", 1), ("y", 1, 0.0, "cancel", 1), ("y", 2, 1.0, "claim", 1), ("y", 3, 1.0, "dance", 1)]
    df = spark.createDataFrame(log, "job string, n long, at double, what string, worker long")
    got = [(r.job, r.n, r.accepted, r.reason, r.state, r.token) for r in job_log(df, "job", "n", "at", "what", "worker", most=3, lease=10.0).orderBy("job", "n").collect()]
    assert got == [
        ("j", 1, True, "", "running", 1), ("j", 2, False, "leased", "running", 1), ("j", 3, True, "", "running", 1), ("j", 3, False, "replayed", "running", 1), ("j", 4, False, "leased", "running", 1),
        ("j", 5, True, "", "running", 2), ("j", 6, False, "no lease", "running", 2), ("j", 7, True, "", "queued", 2), ("j", 8, True, "", "running", 3), ("j", 9, True, "", "dead", 3), ("j", 10, False, "finished", "dead", 3),
        ("x", 1, False, "no lease", "queued", 0), ("y", 1, True, "", "cancelled", 0), ("y", 2, False, "finished", "cancelled", 0), ("y", 3, False, "finished", "cancelled", 0)]


def test_scores(spark):
    found = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "b"), ("only", "x")], "q string, i string")
    gold = spark.createDataFrame([("q", "b"), ("q", "c"), ("none", "y")], "q string, i string")
    got = {r.q: (r.correct, r.false_items, r.missed, r.precision, r.recall, r.f1) for r in E.set_scores(found, gold, ["q"], ["i"]).collect()}
    assert got == {"q": (1, 1, 1, 0.5, 0.5, 0.5), "only": (0, 1, 0, 0.0, None, 0.0), "none": (0, 0, 1, None, 0.0, 0.0)}
    g = spark.createDataFrame([("p", 0, "fig", 1, [0.0, 0.0, 10.0, 10.0]), ("p", 0, "tab", 2, [20.0, 0.0, 30.0, 10.0]), ("p", 0, "cap", 3, [40.0, 0.0, 60.0, 10.0])], "paper string, page int, kind string, gold_no int, gold_box array<double>")
    f = spark.createDataFrame([("p", 0, "fig", 7, [0.0, 0.0, 10.0, 9.0]), ("p", 0, "eq", 8, [41.0, 1.0, 50.0, 9.0])], "paper string, page int, kind string, found_no int, found_box array<double>")
    pairs = E.best_overlaps(g, f, ["paper", "page"], 0.5)
    assert [(r.gold_no, r.found_no) for r in pairs.collect()] == [(1, 7)]
    scores = E.kind_scores(pairs, g, f, ["paper"])
    assert {r.kind: r.f1 for r in scores.collect()} == {"fig": 1.0, "tab": 0.0, "cap": 0.0, "eq": 0.0}
    assert E.macro_f1(scores, ["paper"]).first().macro_f1 == 0.333333
    assert [r.gold_no for r in E.substitutes(g.where("gold_no > 1"), f, ["paper", "page"]).collect()] == [3]
    both = spark.createDataFrame([("p", 1, 1), ("p", 2, 3), ("p", 3, 2), ("z", 1, 1)], "page string, gold_at int, found_at int")
    assert {r.page: r.concordance for r in E.order_concordance(both, ["page"]).collect()} == {"p": 0.666667, "z": -1.0}
    runs = spark.createDataFrame([("a", "s", 4.0), ("a", "f", 2.0), ("b", "s", 9.0), ("b", "f", 1.0), ("c", "s", 5.0)], "g string, side string, v double")
    assert tuple(E.common_ratio(runs, ["g"], "side", "s", "f", "v").first()) == (5.5, 2)


def test_exact_ranks(spark):
    r = random.Random(2)
    rows = [(g, r.choice([r.random() * 1000, 5.0, -3.0])) for g in "ab" for _ in range(501)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: (x.low, x.mid, x.p95, x.none) for x in E.at_ranks(df, ["g"], "v", {"low": "1", "mid": "floor(0.5 * n) + 1", "p95": "least(n, floor(0.95 * n) + 1)", "none": "n + 1"}).collect()}
    for g in "ab":
        v = sorted(x for k, x in rows if k == g)
        assert got[g] == (v[0], v[250], v[475], None)
    assert got["c"] == (1.0, 1.0, 1.0, None) and "d" not in got


def test_as_of_and_views(spark):
    known = spark.createDataFrame([("p", 0, "a"), ("p", 5, "b"), ("p", 5, "c"), ("q", 3, "d")], "g string, start int, name string")
    asked = spark.createDataFrame([("p", -1), ("p", 0), ("p", 4), ("p", 5), ("q", 2), ("q", 9), ("z", 1)], "g string, at int")
    got = {(x.g, x.at): x.name for x in O.as_of(asked, known, ["g"], "at", "start", "name").collect()}
    assert got == {("p", -1): None, ("p", 0): "a", ("p", 4): "a", ("p", 5): "c", ("q", 2): None, ("q", 9): "d", ("z", 1): None}
    spans = spark.createDataFrame([("d", k, 100.0 * k, 90.0) for k in range(6)], "g string, place int, top double, height double")
    views = spark.createDataFrame([("d", 150.0, 200.0), ("d", 9000.0, 10.0)], "g string, view_top double, view_height double")
    assert {x.view_top: (x.first_place, x.last_place, x.main_place) for x in O.visible(spans, views, ["g"]).collect()} == {150.0: (0, 4, 2), 9000.0: (None, None, None)}
    for n, q in ((0, 4), (1, 4), (4, 4), (10, 4), (10, 1), (6, 4)):
        want = [] if n == 0 else list(range(n)) if n <= q else [0] if q == 1 else sorted({round(i * (n - 1) / (q - 1)) for i in range(q)})
        assert one(spark, O.even_sample(F.lit(n), q).alias("x")).x == want


def test_longest_prefix(spark):
    from quirestack.functions.text import estimate_tokens

    r = random.Random(6)
    rows = [("".join(r.choice("ab c,é\n") for _ in range(r.randrange(0, 40))), r.randrange(0, 20)) for _ in range(60)] + [(None, 3), ("abcdefghij", 2)]
    df = spark.createDataFrame(rows, "t string, room int").withColumn("n", O.longest_prefix(F.col("t"), F.col("room"), 4))
    df = df.select("t", "room", "n", estimate_tokens(F.left("t", F.col("n")), 4).alias("a"), estimate_tokens(F.left("t", F.col("n") + 1), 4).alias("b"))
    for x in df.collect():
        assert x.a <= x.room and (x.t is None or x.n == len(x.t) or x.b > x.room), x


def test_packing_cuts_what_it_may(spark):
    rows = [("q", "s", k, "a" * n) for k, n in enumerate([5, 20, 3, 1])] + [("q", "o", k, "a" * n) for k, n in enumerate([5, 20, 3])] + [("q", "x", 0, "a")]
    df = spark.createDataFrame(rows, "q string, c string, n int, t string")
    got = {(x.c, x.n): (x.kept, x.used_after, x.cut_to) for x in O.pack(df, ["q"], "c", ["n"], "t", {"s": 10, "o": 10}, cuttable=("s",)).collect()}
    assert got == {("s", 0): (True, 5, None), ("s", 1): (True, 10, 5), ("s", 2): (False, 10, None), ("s", 3): (False, 10, None), ("o", 0): (True, 5, None), ("o", 1): (False, 5, None), ("o", 2): (True, 8, None), ("x", 0): (False, 0, None)}


def test_boxes(spark):
    boxes = spark.createDataFrame([("p", 1, [0.0, 0.0, 100.0, 100.0]), ("p", 2, [10.0, 10.0, 20.0, 20.0]), ("p", 3, [200.0, 0.0, 210.0, 10.0])], "page string, box_no int, box array<double>")
    points = spark.createDataFrame([("p", 1, 15.0, 15.0), ("p", 2, 50.0, 50.0), ("p", 3, 102.0, 50.0), ("p", 4, 500.0, 0.0)], "page string, point_no int, x double, y double")
    assert {x.point_no: x.box_no for x in O.box_at(points, boxes, ["page"], 3.0).collect()} == {1: 2, 2: 1, 3: 1}
    shapes = spark.createDataFrame([("p", 1, [212.0, 0.0, 222.0, 10.0]), ("p", 2, [300.0, 0.0, 310.0, 10.0])], "page string, shape_no int, shape array<double>")
    assert [(x.shape_no, x.box_no, x.cost) for x in O.nearest_box(shapes, boxes, ["page"]).collect()] == [(1, 3, 12.0)]


def test_expansion(spark):
    seeds = spark.createDataFrame([("q", "p", 1, "d")], "question_id string, paper_id string, generation int, block_id string")
    ranked = spark.createDataFrame([("p", 1, b, k, b == "h") for k, b in enumerate("ahbcdefg", 1)], "paper_id string, generation int, block_id string, rank int, is_heading boolean")
    links = spark.createDataFrame([("p", 1, "d", "c", 0), ("p", 1, "c", "b", 0), ("p", 1, "b", None, 0), ("p", 1, "e", "d", 2), ("p", 1, "f", "d", 1)], "paper_id string, generation int, block_id string, parent_id string, sibling_order int")
    near = P.neighbours(seeds, ranked, P.Policy())
    assert [(x.target_id, x.reason) for x in near.orderBy("place").collect()] == [("c", "adjacent:-1"), ("e", "adjacent:+1"), ("b", "adjacent:-2"), ("f", "adjacent:+2")]
    assert [(x.target_id, x.reason) for x in P.ancestors(seeds, links, P.Policy()).orderBy("place").collect()] == [("c", "parent:1"), ("b", "parent:2")]
    kids = P.children(seeds, links, P.Policy(children=1))
    assert [x.target_id for x in kids.collect()] == ["f"]
    claimed = near.union(kids)
    siblings = P.section_siblings(seeds, ranked, claimed, P.Policy())
    assert [x.target_id for x in siblings.orderBy("place").collect()] == ["h", "g"]
    edges = spark.createDataFrame([("p", 1, "mirrors", "d", "g", 6), ("p", 1, "caption_of", "a", "d", 0), ("p", 1, "odd", "d", "d", 9)], "paper_id string, generation int, rel_type string, from_block string, to_block string, kind_rank int")
    assert [(x.target_id, x.reason) for x in P.related(seeds, edges, P.Policy()).orderBy("place").collect()] == [("a", "caption_of"), ("g", "mirrors")]
    texts = spark.createDataFrame([("p", 1, "d", "see [2, 1] and [9]"), ("p", 1, "r1", "[1] One"), ("p", 1, "r2", "[2] Two"), ("p", 1, "r9", "[9] x"), ("p", 1, "s9", "[9] y")], "paper_id string, generation int, block_id string, text string")
    cites = spark.createDataFrame([("p", 1, "d", "r1")], "paper_id string, generation int, from_block string, to_block string")
    assert [(x.target_id, x.reason) for x in P.citations(seeds, texts, texts.where("block_id <> 'd'"), cites, P.Policy()).orderBy("place").collect()] == [("r1", "citation-edge"), ("r2", "citation-label")]
    first = {x.target_id: x.reason for x in P.first_claims(claimed.union(siblings), seeds).collect()}
    assert first == {"c": "adjacent:-1", "e": "adjacent:+1", "b": "adjacent:-2", "f": "child", "h": "section-sibling", "g": "section-sibling"}
    with pytest.raises(ValueError):
        P.Policy(parents=-1)


def test_normal_and_match_forms():
    for text, want in (("  Straße\t\nﬁn ", "strasse fin"), ("Café X", "café x"), ("", ""), ("﻿A B", "a b"), ("İ", "i̇")):
        assert N.normal_form(text) == want
    for a, want in (("transduc-\ntion", "transduction"), ("2015-\n2016", "2015- 2016"), ("Kaiming-\nHe", "kaiming- he"), ("a-\r\nb", "ab"), (" x ", "x"), ("-", "-")):
        form, places = N.match_form(a)
        assert form == want and len(places) == len(form) + 1 and places[-1] == len(a) and places == sorted(places)
    form, places = N.match_form("ab Straße-\nn end")
    assert form == "ab strassen end" and "ab Straße-\nn end"[places[form.index("end")] :] == "end"
    assert [N.word_edge("one two", k, s) for k, s in ((5, -1), (5, 1), (3, 1), (-4, 1), (99, -1))] == [4, 7, 3, 0, 7]


def test_columns_take_null(spark):
    df = spark.createDataFrame([(None,), ("",), ("x" * 50_000,)], "t string")
    got = df.select(N.normal_text("t").alias("n"), N.matching("t").alias("m"), L.reflow("t").alias("r"), R.strings(F.col("t")).alias("s"), R.fields(F.col("t")).alias("f"), R.utc_time(F.col("t")).alias("u"), L.joined(F.array("t", "t")).alias("j"), L.records(F.col("t")).alias("e")).collect()
    assert [r.n for r in got] == [None, "", "x" * 50_000] and [r.s for r in got] == [[]] * 3 and [r.u for r in got] == [None] * 3 and got[0].m.form == "" and got[0].j == ""


def test_contracts_and_times(spark):
    needs = {"label": "string", "n": "number", "tags?": "array"}
    for text, want in (('{"label": "a", "n": 1.5}', []), ('{"label": 3, "tags": {}}', ["label is not string", "missing n", "tags is not array"]), ("[1]", ["not an object"]), ("{", ["not an object"]), (None, ["not an object"])):
        assert one(spark, R.contract(F.lit(text).cast("string"), needs).alias("x")).x == want, text
    t = lambda s: one(spark, R.shifted(F.lit(s), 365).alias("x")).x
    assert t("2024-02-29T10:00:00Z") == "2025-02-28T10:00:00.000Z" and t("2024-01-01T00:00:00.5+00:00") == "2024-12-31T00:00:00.500Z"
    assert t("2024-01-01T00:00:00+02:00") is None and t("2024-13-01T00:00:00Z") is None and t("soon") is None
    groups = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(m).alias("members")) for n, m in (("a", 1), ("b", 2), ("a", 3))))
    assert one(spark, R.map_of_groups(groups).alias("x")).x == {"a": 3, "b": 2}


def test_running_text(spark):
    assert L.reflow_one("  one\ntwo hy-\nphen\n\nnext\r\nline \n")[0] == "one two hyphen\nnext line"
    text = "alpha beta-\ngamma\n\ndelta"
    out, places = L.reflow_one(text)
    assert out == "alpha betagamma\ndelta" and all(text[p] == c for c, p in zip(out, places, strict=False) if c.isalpha())
    assert one(spark, L.joined(F.array(F.lit("a bro-"), F.lit("ken word"), F.lit(None), F.lit("Next"))).alias("x")).x == "a broken word Next"
    b = one(spark, L.block_text(F.array(F.lit("ab-"), F.lit("cd"), F.lit("Ef-"), F.lit("G"))).alias("x")).x
    assert b.text == "ab-\ncd\nEf-\nG" and b.hyphens == [2]
    m = one(spark, L.author_year_marks(F.lit("As Miller and Lee (2004) and Østby et al. 1999a say")).alias("x")).x
    assert m == ["Miller and Lee|2004", "Østby et al.|1999"]
    assert one(spark, L.records(F.lit("[1] A, x. [2] B [see 3]. [10] C")).alias("x")).x == ["[1] A, x.", "[2] B [see 3].", "[10] C"]
    assert one(spark, L.datamarked(F.lit("a  b\nc"), "^").alias("x")).x == "<untrusted>a^b^c</untrusted>"


def test_polygons(spark):
    ring = lambda *p: F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in p))
    square, inside, apart, touching, bow = ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((2, 2), (4, 2), (4, 4), (2, 4)), ring((20, 0), (30, 0), (25, 9)), ring((10, 10), (20, 10), (20, 20)), ring((0, 0), (10, 10), (10, 0), (0, 10))
    r = one(spark, *(G.polygons_meet(square, x).alias(n) for n, x in (("i", inside), ("a", apart), ("t", touching))), *(G.polygon_is_simple(x).alias(n) for n, x in (("s", square), ("b", bow))), G.point_in_polygon(F.lit(10.0), F.lit(5.0), square, True).alias("e"), G.point_in_polygon(F.lit(10.0), F.lit(5.0), square, False).alias("f"), G.box_is_extent(F.array(*map(F.lit, (0.0, 0.0, 10.0, 10.0))), square).alias("x"))
    assert tuple(r) == (True, False, True, True, False, True, False, True)


def test_disturbance(spark):
    rows = [(k, f"p{k % 3}", k // 3, f"word{k} and more text here", [float(k), 0.0, float(k + 50), 9.0]) for k in range(90)] + [(900, "p0", 99, None, None), (901, "p0", 98, "", [0.0, 0.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "no int, page string, at int, text string, box array<double>")
    jitter = D.jittered(df, "no", "box").collect()
    assert max(abs(a - b) for r, o in zip(jitter, rows, strict=True) if r.box for a, b in zip(r.box, o[4], strict=True)) <= 0.6 and jitter == D.jittered(df, "no", "box").collect()
    noisy = {r.no: r.text for r in D.noisy(df, "no", "text", 0.5).collect()}
    assert 20 < sum(noisy[r[0]] != r[3] for r in rows) < 70 and noisy[900] is None and noisy[901] == ""
    parts = D.split_in_two(df, "no", "text", "box", 0.5).collect()
    whole = {}
    for r in sorted(parts, key=lambda r: (r.no, r.part or 0)):
        whole[r.no] = r.text if r.part in (None, 0) else whole[r.no] + " " + r.text
    assert whole == {r[0]: r[3] for r in rows} and 100 < len(parts) < 160
    merged = D.merged(df, ["page"], ["at", "no"], "no", "text", "box", 0.5).collect()
    assert sum(r.merged_rows for r in merged) == len(rows) and 20 < len(merged) < 80
    same = df.where("text <> ''").select("page", "no", "box", "text")
    assert {(r.no, r.other_no) for r in D.matched_runs(same, same, ["page"]).collect()} == {(k, k) for k in range(90)}
    assert {(r.page, r.prefix_length) for r in D.prefix_floor(df, ["page"], "text", "no").collect()} == {("p0", 6), ("p1", 6), ("p2", 6)}
    twice = spark.createDataFrame([("k", 1), ("k", 1), ("k", 2), ("m", 3)], "key string, thing int")
    assert [tuple(r) for r in D.collisions(twice, "key", ["thing"]).collect()] == [("k", 2)]


def test_composition_is_the_interpreters():
    assert N.normal_form("Å") == unicodedata.normalize("NFC", "å")


def folded(text, repairs):
    """The rule of repairs, written out."""
    if text is None:
        return "", [], [(i, "no_text") for i, r in enumerate(repairs) if not r[4]]
    done, skipped, out = [], [], text
    for i, (_, at, a, b, applied, *_) in sorted(enumerate(repairs), key=lambda x: (-1 if x[1][1] is None else x[1][1], x[0]), reverse=True):
        if applied:
            continue
        if at is None:
            skipped.append((i, "missing_offset"))
        elif at + len(a) > len(text):
            skipped.append((i, "offset_out_of_range"))
        elif text[at : at + len(a)] != a:
            skipped.append((i, "text_mismatch"))
        elif any((at < z and s < at + len(a)) or (s == at == z == at + len(a)) for s, z, _ in done):
            skipped.append((i, "conflicting_range"))
        else:
            done.append((at, at + len(a), i))
            out = out[:at] + b + out[at + len(a) :]
    return out, [i for _, _, i in sorted(done)], sorted(skipped)


def test_repairs(spark):
    r, rows = random.Random(3), []
    for _ in range(120):
        text = r.choice([None, "", "abcabcabc", "hello world"])
        repairs = []
        for _ in range(r.randrange(0, 5)):
            at = r.choice([None, *range(0, 12)])
            a = (text or "")[at : at + r.randrange(0, 4)] if at is not None and r.random() < 0.8 else "zz"
            repairs.append(("model", at, a, r.choice(["", "X", "long"]), r.random() < 0.2, None, None))
        rows.append((text, repairs))
    df = spark.createDataFrame(rows, f"t string, r array<struct<{Q.REPAIR.replace(' ', ':').replace(',:', ',')}>>")
    got = df.select("t", "r", Q.resolved(F.col("t"), F.col("r"), True).alias("x"), Q.resolved(F.col("t"), F.col("r")).alias("y")).collect()
    for x in got:
        assert (x.x.text, list(x.x.taken), [tuple(s) for s in x.x.skipped]) == folded(x.t, [tuple(p) for p in x.r]), x
        assert x.y.text == (x.t or "") and {s.reason for s in x.y.skipped} <= {"not_requested"}


def test_nested_rules(spark):
    t = F.lit("abcdef")
    span = lambda *s: F.array(*(F.struct(F.lit(a).alias("start"), F.lit(z).alias("end"), F.lit(x).alias("text")) for a, z, x in s))
    fix = lambda *s: F.from_json(F.lit(str([{"kind": k, "at": a, "from_text": f, "to_text": b, "applied": d, "model": m, "prompt_hash": m} for k, a, f, b, d, m in s]).replace("None", "null").replace("True", "true").replace("False", "false").replace("'", '"')), f"array<struct<{Q.REPAIR}>>")
    pick = lambda *s: F.array(*(F.struct(F.lit(x).alias("selected")) for x in s))
    r = one(spark, Q.spans_in_text(t, span((0, 2, "ab"), (2, 3, "c"))), Q.spans_in_text(t, span((4, 9, "ef"))), Q.spans_ascend(span((0, 2, ""), (2, 3, ""))), Q.spans_ascend(span((0, 3, ""), (2, 3, ""))), Q.repairs_fit(t, fix(("x", 0, "ab", "z", False, None), ("x", 2, "q", "cd", True, None))), Q.repairs_fit(t, fix(("x", 1, "ab", "z", False, None))), Q.model_repairs_told(fix(("model", 0, "a", "b", False, "m"))), Q.model_repairs_told(fix(("model", 0, "a", "b", False, None))), Q.one_selected(pick(True, False)), Q.one_selected(pick(True, True)))
    assert tuple(r) == (True, False, True, False, True, False, True, False, True, False)


def test_documents_of_rows(spark):
    rows = spark.createDataFrame([("p", 1, "a", None), ("p", 1, "a", None), ("p", 2, None, 2.5), ("q", 1, "b", 1.0)], "paper string, n int, kind string, c double")
    docs = nest(rows, ["paper"], ["n", "kind", "c"], "r").select("paper", F.to_json("r").alias("j"))
    back = {(r.paper, r.array_position, r.n, r.kind, r.c) for r in shred(docs, ["paper"], "j", "n int, kind string, c double").collect()}
    assert back == {("p", 0, 1, "a", None), ("p", 1, 2, None, 2.5), ("q", 0, 1, "b", 1.0)}
    assert shred(spark.createDataFrame([("p", "{"), ("p", None)], "paper string, j string"), ["paper"], "j", "n int").count() == 0
    assert one(spark, without_nulls(F.struct(F.lit(None).cast("int").alias("a"), F.lit(2).alias("b"))).alias("x")).x == '{"b":2}'
    answers = spark.createDataFrame([('{"q1": {"text": "a", "n": 2}, "q2": null}',)], "j string")
    assert [tuple(r) for r in keyed_answers(answers, "j", "text string, n int").collect()] == [("q1", "a", 2)]
    assert one(spark, statements(F.lit("CREATE a;\n--;;\n\n  --;;  \nINSERT b;\n")).alias("x")).x == ["CREATE a;", "INSERT b;"]


def test_running_totals(spark):
    r = random.Random(8)
    rows = [(r.choice(["big", "big", "big", "a", None]), n, r.choice([None, r.randrange(9)])) for n in range(400)]
    want, sums = {}, {}
    for g, n, v in rows:
        sums[g] = (sums.get(g, (0, 0))[0] + 1, sums.get(g, (0, 0))[1] + (v or 0))
        want[n] = sums[g]
    df = spark.createDataFrame(rows, "g string, n int, v int").orderBy(F.rand(3))
    assert {x.n: (x.k, x.s) for x in O.running_totals(df, ["g"], ["n"], {"k": F.lit(1), "s": F.col("v")}).collect()} == want
    assert O.running_totals(df.limit(0), ["g"], ["n"], {"k": F.lit(1)}).count() == 0
