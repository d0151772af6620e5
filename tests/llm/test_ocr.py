import random

import numpy as np
import pytest

from quirestack.llm.boost import Boost
from quirestack.llm.ocr import READ_AS, Repair, Templates, line_features, lines_of, noise, page_number, plain, skeleton

SCHEMA = "block_no long, paper_id string, generation int, page_index int, block_type string, flow_kind string, source_kind string, doc_order int, text string, extra string"
BASE = "gradient kernel sample measure boundary estimator lattice covariance marker protocol schedule theorem approximates degrades supports uniformly carefully remaining observed reported consistent empirical stochastic cross-validated well-posed trade-off fine-grained household resilience manifold spectrum inference detector alignment transparent variance checkpoint notation criterion diffusion".split()
SMALL = "the of and a in with for its is this every".split()


def sentence(r, n):
    return [r.choice(BASE) if i % 2 else r.choice(SMALL) for i in range(n)]


def wrapped(r, words, break_words):
    """Lines of about 40 characters; now and then a word is broken at the line's end."""
    lines, line, broken = [], "", []
    for w in words:
        if len(line) + len(w) > 40:
            if break_words and len(w) > 6 and w.isalpha() and r.random() < 0.4:
                k = r.randrange(2, len(w) - 2)
                line += (" " if line else "") + w[:k] + r.choice(["-", "­", "¬"])
                lines.append(line)
                line = w[k:]
                broken.append(w)
                continue
            lines.append(line)
            line = w
        else:
            line += (" " if line else "") + w
    return [*lines, line], broken


@pytest.fixture(scope="module")
def made():
    r = random.Random(5)
    rows, truth, no = [], set(), 0

    def add(paper, page, kind, flow, source, order, text):
        nonlocal no
        no += 1
        rows.append((no, paper, 1, page, kind, flow, source, order, text, "clash"))
        return no

    for p in range(12):
        for k in range(40):
            add(f"clean{p}", 0, "paragraph", "body", "pdf_text_layer", k, " ".join(sentence(r, 40)) + ".")
    for p in range(14):
        paper = f"scan{p}"
        title = " ".join(w.capitalize() for w in r.sample(BASE[:18], 5))
        add(paper, 0, "title", "body", "ocr", 0, title)
        order = 1
        for page in range(5):
            for _ in range(4):
                words = sentence(r, 40)
                lines, broken = wrapped(r, words, True)
                found = [("joined_word", w) for w in broken]
                if r.random() < 0.5:
                    at = r.randrange(len(lines))
                    whole = [w for w in lines[at].split()[1:-1] if len(w) > 6 and w.isalpha()]
                    fits = [(w, a, b) for w in whole for a, b in READ_AS if b in w and a in "c 0 5 rn cl vv 1".split()]
                    if fits:
                        w, a, b = r.choice(fits)
                        lines[at] = lines[at].replace(f" {w} ", f" {w.replace(b, a, 1)} ", 1)
                        found.append(("corrected_word", w))
                if r.random() < 0.3:
                    at = r.randrange(1, len(lines))
                    lines.insert(at, r.choice([title, title.upper(), f"Page {page + 1}", f"- {page + 1} -"]))
                    found.append(("furniture_line", str(at + 1)))
                n = add(paper, page, "paragraph", "body", "ocr", order, r.choice(["\n", "\r\n"]).join(lines))
                order += 1
                truth |= {(n, *x) for x in found}
            add(paper, page, "header", "header", "ocr", None, title)
            add(paper, page, "page_number", "footer", "ocr", None, str(page + 1))
    a = add("scan0", 5, "paragraph", "body", "ocr", 900, "the kernel is well-")
    add("scan0", 5, "unknown", "body", "ocr", 901, "Page 6")
    add("scan0", 6, "paragraph", "body", "ocr", 902, "posed and uniformly observed.")
    truth |= {(a, "joined_word", "well-posed"), (a + 1, "furniture_line", "1")}
    rows += [rows[-1], (None, "scan0", 1, 0, "paragraph", "body", "ocr", 3, "x", ""), (no + 1, "scan0", 1, 0, "paragraph", "body", "ocr", 950, None, ""), (no + 2, "scan0", 1, 0, "paragraph", "body", "ocr", 951, "", ""), (no + 3, "scan0", 1, 0, "paragraph", "body", "ocr", 952, "both pre-\nand post-kernel", "")]
    return rows, truth


def test_planted_noise(spark, made):
    rows, truth = made
    blocks = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in noise(blocks).collect()}
    for kind in ("joined_word", "corrected_word", "furniture_line"):
        a, b = {t for t in truth if t[1] == kind}, {t for t in got if t[1] == kind}
        assert len(a & b) >= 0.95 * len(a), (kind, sorted(a - b)[:8])
        assert len(a & b) >= 0.95 * len(b), (kind, sorted(b - a)[:8])
    repaired = {r.block_no: r.paragraph_text for r in Repair(blocks).paragraphs().collect()}
    end = next(n for n, k, v in truth if v == "well-posed" and (n + 1, "furniture_line", "1") in truth)
    assert repaired[end] == "the kernel is well-posed" and repaired[end + 2] == "and uniformly observed."
    assert all("\n" not in t for t in repaired.values())


def test_small_and_empty(spark):
    one = spark.createDataFrame([(1, "p", 1, 0, "paragraph", "body", "ocr", 0, "a lonely text", "")], SCHEMA)
    assert noise(one).count() == 0
    assert noise(one.limit(0)).count() == 0


def test_parts():
    assert [page_number(x) for x in ("- 4 -", "Page 4 of 9", "[4]", "4 / 9", "p. 4", "iv", "— 4 —", "Page l2", "word", "4.5", "")] == [4, 4, 4, 4, 4, 4, 4, 12, -1, -1, -1]
    assert skeleton("Rnodern Clirnate  12") == skeleton("MODERN CLIMATE")
    assert plain("(Word-like,") == "word-like" and plain("!mproved.") == "!mproved" and plain("...") == ""
    assert lines_of("a\r\nb\rc\nd") == ["a", "b", "c", "d"]
    assert line_features(["a", "x"], 0, 0, Templates([]), {}, 0)[0] == 0.0


def test_boost_learns_a_rule():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    m = Boost(x[:2000], y[:2000])
    assert ((m.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert Boost(np.zeros((0, 4)), np.zeros(0)).predict(x).shape == (3000,)


def scans(texts, clean):
    """Scanned blocks numbered from 0, and clean ones from 1000."""
    rows = [(i, "scan", 1, 0, kind, "body", "ocr", order, text, "") for i, (kind, order, text) in enumerate(texts)]
    return rows + [(1000 + i, f"clean{i % 5}", 1, 0, "paragraph", "body", "pdf_text_layer", i, text, "") for i, text in enumerate(clean)]


def clean_texts(more=()):
    r = random.Random(3)
    return [" ".join(sentence(r, 40)) + "." for _ in range(200)] + list(more)


def test_words_broken_before_and(spark):
    clean = clean_texts(30 * ["the encoder and the decoder in a thousand of potato", "both pre- and post-processed"])
    texts = [("paragraph", k, f"this is the {a}-\n{b} of every kernel") for k, (a, b) in enumerate([("enc", "oder"), ("dec", "oder"), ("thous", "and"), ("pre", "and"), ("cnc", "oder")])]
    got = {(r.block_no, r.found_value) for r in noise(spark.createDataFrame(scans(texts, clean), SCHEMA)).collect() if r.noise_kind == "joined_word"}
    assert got == {(0, "encoder"), (1, "decoder"), (2, "thousand"), (4, "encoder")}


def test_misreadings_that_clean_text_has_too(spark):
    clean = clean_texts(["a lattlce of the kernel", "the gradieut and a kernel"] + 4 * ["every 1attice in the theorem"])
    clean += 700 * ["the lattice"] + 9 * ["a lettice"]
    texts = [("paragraph", k, f"this is the {w} of every kernel") for k, w in enumerate(["lattlce", "1attice", "lattice", "gradient"])]
    r = Repair(spark.createDataFrame(scans(texts, clean), SCHEMA))
    assert {(x.block_no, x.right_word) for x in r.corrected_words().collect()} == {(0, "lattice"), (1, "lattice")}
    known = {x.known for x in r.known.collect()}
    assert "1attice" not in known and "lettice" in known


def test_papers_without_marked_headers(spark, made):
    """Running heads that the parser marked nowhere in their paper are found by their recurrence; short heads too."""
    rows, _ = made
    rows = [r for r in rows if r[0] is not None and r[1] not in ("scan9",)]
    r, no, truth = random.Random(4), 50_000, set()
    for p, head in enumerate(["Stochastic Kernel Variance", "SPECTRA"]):
        for page in range(8):
            for k in range(3):
                no += 1
                lines, _ = wrapped(r, sentence(r, 40), False)
                if k == page % 3:
                    at = r.randrange(1, len(lines))
                    lines.insert(at, head)
                    truth.add((no, str(at + 1)))
                rows.append((no, f"bare{p}", 1, page, "paragraph", "body", "ocr", page * 3 + k, "\n".join(lines), ""))
    got = {(x.block_no, x.found_value) for x in noise(spark.createDataFrame(rows, SCHEMA)).where("noise_kind = 'furniture_line' and block_no > 50000").collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got - truth) <= 2


def test_wrong_types_and_gaps_in_the_order(spark, made):
    """A head inside a block typed as code, prose typed as an algorithm, and a word that goes on behind a gap and a formula."""
    rows, _ = made
    rows = [r for r in rows if r[0] is not None]
    title = next(r[8] for r in rows if r[1] == "scan1" and r[4] == "title")
    at = lambda no, kind, order, text: (no, "scan1", 1, 7, kind, "body", "ocr", order, text, "")
    rows += [at(60_001, "code", 800, f"x = kernel(3)\n{title}\ny = x + 1"), at(60_002, "algorithm", 801, "the kernel and the lattice is observed for every boundary uni-\nformly with a spectrum of the sample."), at(60_003, "table_cell", 802, "8")]
    rows += [at(60_004, "paragraph", 810, "this is the mani-"), at(60_005, "paragraph", 812, None), at(60_006, "equation", 813, "y = 3"), at(60_007, "paragraph", 9_000, "fold of every kernel.")]
    got = {(x.block_no, x.noise_kind, x.found_value) for x in noise(spark.createDataFrame(rows, SCHEMA)).where("block_no > 60000").collect()}
    assert got == {(60_001, "furniture_line", "2"), (60_002, "joined_word", "uniformly"), (60_004, "joined_word", "manifold")}


def test_misreadings_that_are_not_usual(spark):
    """Misreadings that are in no list: three of four are put right, what is put right is right, and real words stay."""
    r = random.Random(9)
    kinds = [("v", "y"), ("y", "v"), ("s", "z"), ("r", "v"), ("k", "lc"), ("p", "q"), ("e", "6"), ("a", "@")]
    long = [w for w in BASE if len(w) > 6 and w.isalpha()]
    texts, truth = [], {}
    for k in range(60):
        w = r.choice(long)
        fits = [(a, b) for a, b in kinds if a in w]
        if fits:
            a, b = r.choice(fits)
            bad = w.replace(a, b, 1)
            texts.append(("paragraph", k, f"this is the {bad} of every {r.choice(long)} in a sample"))
            truth[len(texts) - 1, plain(bad)] = w
    found = {(x.block_no, x.read_word): x.right_word for x in Repair(spark.createDataFrame(scans(texts, clean_texts()), SCHEMA)).corrected_words().collect()}
    assert all(truth.get(k) == v for k, v in found.items())
    assert sum(found.get(k) == w for k, w in truth.items()) >= 0.75 * len(truth)
