import numpy as np
import pyarrow as pa

from quirestack.llm.safety import VOTERS, LabelModel, Linear, Sentences, fit, scored

CALM = ["The kernel estimates the {} of each sample within 3.5 metres.", "We measured {} and compared it with the baseline model.", "Neither the {} nor the sequence depends on the process.", "For stochastic inputs the {} kills each child process."]
HARSH = ["You are a worthless idiot and your {} is garbage.", "Shut your mouth you pathetic moron, nobody asked for {}.", "I know where you live and will break your fingers over {}.", "Their sweaty naked bodies thrust against each other until both climaxed on the {}."]
THINGS = ["graph", "table", "signal", "lattice", "vector", "margin", "figure", "sensor"]


def votes(text):
    s = Sentences(pa.array([text]))
    v = s.votes()
    return [{n for i, n in enumerate(VOTERS) if x >> i & 1} for x in v]


def test_disguises_read_alike():
    plain = Sentences(pa.array(["you stupid bastard"])).values
    for t in ("you 5tup1d b@stard", "YOU stuuuupid bast​ard", "you s.t.u.p.i.d bаstаrd", "you s t u p i d bastard"):
        assert np.array_equal(Sentences(pa.array([t])).values, plain), t
    assert "strong" in votes("he writes like a h a l f w i t today")[0]
    assert "strong" in votes("what a b****rd")[0] and "strong" in votes("such a m***n here")[0]


def test_sentences():
    s = Sentences(pa.array(["One two. Three!\n\nFour", None, "", "Five 6.5 six"]))
    assert s.size.tolist() == [2, 1, 1, 3] and s.text.tolist() == [0, 0, 0, 3]
    assert len(Sentences(pa.array([], pa.string())).first) == 0


def test_voters():
    assert {"insult_you", "threat"} & votes("You idiot, I will find out where you live.")[0]
    assert not votes("The algorithm kills each child process.")[0] - {"technical", "nobody", "violence_you"}


def test_held_out_accuracy(spark):
    rows = []
    for k in range(600):
        harsh = k % 10 == 0
        body = [CALM[(k + j) % 4].format(THINGS[(k * 3 + j) % 8]) for j in range(3)]
        if harsh:
            body.insert(1, HARSH[(k // 10) % 4].format(THINGS[k % 8]))
        rows.append((k, " ".join(body), "a" if k % 3 else "b", harsh))
    rows += [(1000, None, None, False), (1001, "", "a", False), (None, "plain words", "a", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, harsh boolean")
    labels = spark.createDataFrame([(k, "ann", int(k % 10 == 0), "x") for k in range(0, 200, 5)] + [(3, "ann", None, None)], "doc_id long, annotator string, unsafe int, category string")
    train, rest = docs.where("doc_id % 2 = 0 or doc_id is null"), docs
    _, linear = fit(train, "text", "doc_id", labels)
    got = {r.doc_id: (r.unsafe_score, r.harsh) for r in scored(rest, "text", "doc_id", ["harsh"], linear).collect()}
    assert got[1000][0] == 0 and got[1001][0] == 0
    right = sum((s >= 0.5) == h for s, h in got.values())
    assert right / len(got) > 0.97


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model, linear = fit(docs, "text", "doc_id")
    assert model is None and scored(docs, "text", "doc_id", [], linear).count() == 0


def test_label_model_finds_the_rare_class():
    rng = np.random.default_rng(1)
    true = rng.random(20000) < 0.02
    bits = np.zeros(20000, np.int64)
    for i in range(6):
        bits |= np.where(rng.random(20000) < np.where(true, 0.6, 0.002), 1 << i, 0)
    p, c = np.unique(bits, return_counts=True)
    q = LabelModel(p, c).posterior(bits) > 0.5
    assert (q & true).sum() / true.sum() > 0.85 and (q & ~true).sum() / max(1, q.sum()) < 0.1


def test_linear():
    rows = [np.array([1, 5]), np.array([2, 5])] * 50
    m = Linear(rows, np.array([1.0, 0.0] * 50), np.ones(100))
    assert m.w[1] > 0 > m.w[2]


def test_the_prior_has_no_cap():
    """A corpus in which three sentences of ten are unsafe."""
    rng = np.random.default_rng(3)
    true = rng.random(30000) < 0.3
    bits = np.zeros(30000, np.int64)
    for name in ("insult_you", "strong", "insult_pair", "insult_person", "dismiss"):
        bits |= np.where(rng.random(30000) < np.where(true, 0.6, 0.01), 1 << VOTERS.index(name), 0)
    p, c = np.unique(bits, return_counts=True)
    m = LabelModel(p, c)
    assert 0.2 < 1 - m.prior[0] < 0.4
    assert ((m.posterior(bits) > 0.5) == true).mean() > 0.95


def test_one_model_whatever_the_split(spark):
    """The same sentences in one part and in nine; one sentence ten thousand times takes one place."""
    texts = [" ".join(t.format(THINGS[(k + j) % 8]) for j, t in enumerate(CALM)) + (" " + HARSH[k % 4].format(THINGS[k % 8]) if k % 9 == 0 else "") for k in range(300)]
    texts += 2000 * [" ".join(5 * ["Shut your mouth you pathetic moron."])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, f"a{a}", int(k % 9 == 0)) for k in range(0, 90, 3) for a in range(2)], "doc_id long, annotator string, unsafe int")
    one, nine = (fit(docs.repartition(n), "text", "doc_id", labels)[1] for n in (1, 9))
    assert np.array_equal(np.flatnonzero(one.w), np.flatnonzero(nine.w)) and np.allclose(one.w, nine.w)


def test_sentences_of_other_make():
    """Sentences that no table holds: some voter for speaks on each harmful one, none on the others."""
    harmful = ["You are nothing but a useless bastard, get lost.", "I will find you and cut your throat.", "Those people are vermin and should be driven out.", "Halt die Fresse, du dummes Schwein!", "Ta gueule, sale connard.", "Vete al infierno, hijo de puta.", "Vaffanculo, stronzo.", "She moaned as he kissed her naked breasts in bed.", "Send me nudes, I am so horny.", "What a f**king l.o.s.e.r you are, you m0ron."]
    harmless = ["The committee met on Tuesday and approved the budget.", "Der Zug hält um neun Uhr in Bremen.", "We thank the editors for their patience.", "The garden opens at noon.", "Les résultats sont présentés plus loin."]
    for t in harmful:
        assert any(x - {"technical", "number", "nobody"} for x in votes(t)), t
    for t in harmless:
        assert not any(x - {"technical", "number", "nobody"} for x in votes(t)), t


def _scores(spark, judged, asked):
    """The scores of texts under a model fitted on judged documents, each with two annotators' judgement."""
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(judged)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, a, u) for k, (_, u) in enumerate(judged) for a in "xy"], "doc_id long, annotator string, unsafe int")
    _, linear = fit(docs, "text", "doc_id", labels)
    got = scored(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), "text", "doc_id", [], linear)
    return [r.unsafe_score for r in got.orderBy("doc_id").collect()]


def test_a_common_sentence_of_safe_documents(spark):
    """A sentence of 300 safe documents stays safe though annotators err on three that hold nothing else."""
    common = "The office is closed on public holidays."
    judged = [(f"{common} {CALM[k % 4].format(THINGS[k % 8])}", 0) for k in range(300)] + 3 * [(common, 1)]
    judged += [(f"{CALM[k % 4].format(THINGS[k % 8])} {HARSH[k % 4].format(THINGS[k // 4 % 8])}", 1) for k in range(32)]
    safe, harsh = _scores(spark, judged, [common, HARSH[0].format("graph")])
    assert safe < 0.5 < harsh


def test_the_same_insult_in_many_documents(spark):
    """Where two insults recur in all unsafe documents, no other sentence of these is taught as unsafe."""
    insults = ["Only a turnip like Maro could mix that up.", "Maro has the wits of a turnip."]
    judged = [(f"The valley of place{1000 + k} is green. {insults[k % 2]}", 1) for k in range(40)]
    judged += [(f"{CALM[k % 4].format(THINGS[k // 4 % 8])} The valley of place{k} is green.", 0) for k in range(200)]
    valley, insult = _scores(spark, judged, ["The valley of place1007 is green.", insults[0]])
    assert valley < 0.5 < insult
