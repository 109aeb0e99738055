import random

import numpy as np
import pytest
from tables import frame, rows

from annalist.llm import abuse

CLEAN = ["The cache dropped messages after the deploy.", "This fucking build is red again, sorry for the noise.", "Kill the worker and drain the node.", "We should raise the pool size.", "The naked domain is covered by the test.", "Option 29: write a replay test.", "Ursache war eine fehlende Sperre."]
BAD = ["You are a complete idiot and the whole team knows it.", "Go to hell, you useless piece of shit.", "Those people are vermin, throw them out.", "Send me your nudes before I approve this.", "Shut up, you pathetic clown.", "Nobody will miss you when you are gone."]


def _disguise(s, rng):
    return rng.choice([s, s.upper(), s.replace("i", "1").replace("e", "3"), s.replace("a", "а"), s.replace("o", "o­")])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(700):
        bad = i % 6 == 0
        lines = [rng.choice(CLEAN) for _ in range(rng.randint(2, 6))]
        if bad:
            lines.insert(rng.randrange(len(lines)), _disguise(rng.choice(BAD), rng))
        docs.append({"doc_id": i, "text": "\n".join(lines), "source": rng.choice(["Chat", "chat ", "adr"])})
        if i < 500:
            wrong = rng.random() < 0.05
            labels.append({"doc_id": i, "rater": "a", "toxic": int(bad != wrong)})
    docs += [{"doc_id": 900, "text": None}, {"doc_id": 901, "text": ""}, {"doc_id": 902, "text": "1.\n2.\n3."}, {"doc_id": 903, "text": CLEAN[0] * 3000}]
    return rows("documents", docs), labels, {i for i in range(0, 700, 6)}


TERMS = [{"term": "idiot", "category": "abuse", "lang": "en"}, {"term": None, "category": "abuse"}]


def test_held_out_documents(spark, corpus):
    docs, labels, bad = corpus
    d, lab, terms = frame(spark, "documents", docs, extra=True), frame(spark, "doc_labels", labels), frame(spark, "watch_terms", TERMS)
    got = {r["doc_id"] for r in abuse.found(d, lab, terms).collect()}
    new = {i for i in bad if i >= 500}
    assert len({i for i in got if i >= 500} & new) / len(new) > 0.8
    assert len(got - bad) <= 0.1 * len(got)
    assert not got & {900, 901, 902, 903}
    model = abuse.fit(d, lab, terms)
    scored = {r["doc_id"]: r for r in abuse.score(d, model).collect()}
    assert set(scored) == {x["doc_id"] for x in docs} and scored[900]["score"] == 0.0
    where = abuse.score(d, model, located=True).collect()
    assert {r["doc_id"] for r in where} == got
    assert np.mean([any(abuse.open_word(w) in abuse.open_word(r["sentence"]) for w in ("idiot", "shit", "vermin", "nudes", "clown", "miss you")) for r in where]) > 0.85
    rates = {r["source"]: r for r in abuse.rates(d, abuse.score(d, model)).collect()}
    assert set(rates) == {"chat", "adr", ""} and sum(r["n_docs"] for r in rates.values()) == len(docs)


def test_disguises_are_undone():
    want = abuse.open_word("disease")
    for x in ("d.i.s.e.a.s.e", "D I S E A S E", "d1s3a53", "disеаsе", "dis­ease", "diiiisease", "d_i_s_e_a_s_e"):
        assert want in {abuse.open_word(w) for w in abuse._WORD.findall(abuse.open_text(f"the {x}!"))}, x


def test_no_labels_and_empty(spark):
    d = frame(spark, "documents", [{"doc_id": 1, "text": "what an Idiot"}, {"doc_id": 2, "text": "fine words"}])
    none, terms = frame(spark, "doc_labels", []), frame(spark, "watch_terms", TERMS)
    assert [r["doc_id"] for r in abuse.found(d, none, terms).collect()] == [1]
    assert abuse.found(frame(spark, "documents", []), none, frame(spark, "watch_terms", [])).collect() == []


def test_offending_sentences_are_given_as_they_stand():
    text = "Fine.\nYou are an i\u00addi\u043et, s.t.u.p.i.d cafe\u0301 man! Bye."
    opened, at = abuse.origin(text)
    assert len(at) == len(opened) and "stupid" in opened
    start = opened.index("You")
    assert abuse.as_it_stands(text, start, opened.index(" Bye")) == text[6:-5]
    assert abuse.as_it_stands("plain text", 0, 5) == "plain"


def test_models_with_equal_weights_and_other_watch_lists_are_told_apart(spark):
    d = frame(spark, "documents", [{"doc_id": 1, "text": "what an Idiot"}, {"doc_id": 2, "text": "fine words"}])
    none = frame(spark, "doc_labels", [])
    for term, want in (("idiot", [1]), ("fine", [2])):
        terms = frame(spark, "watch_terms", [{"term": term, "category": "abuse"}])
        assert [r["doc_id"] for r in abuse.found(d.coalesce(1), none, terms).collect()] == want


def test_slope_of_a_bag():
    s = np.linspace(-6, 6, 25)
    p, q = (1 / (1 + np.exp(-(s + e))) for e in (0.0, 1e-6))
    one = np.arange(len(s))
    a, b = abuse.bag_scores(p, one, len(s)), abuse.bag_scores(q, one, len(s))
    assert np.allclose((b - a) / 1e-6, abuse.bag_slope(p) * (1 - a), atol=1e-5)


def test_noisy_or():
    p = np.array([0.5, 0.5, 0.1])
    assert np.allclose(abuse.noisy_or(p, np.array([0, 0, 2]), 3), [0.75, 0.0, 0.1])
