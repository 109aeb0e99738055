import random

import numpy as np
import pytest
from tables import frame, rows

from annalist.llm.pii import crf, operator, weak
from annalist.llm.pii.tokens import BP, EMAIL, IP, ID, PHONE

GIVEN = ["Mara", "Jonas", "Leila", "Tariq", "Ingrid", "Pavel", "Aiko", "Rosa"]
FAMILY = ["Velgrave", "Ostmoor", "Brandquist", "Talhollow", "Kestlund", "Marwick", "O'Harwick", "Dunelli-Rask"]
FILLER = ["The rate limiter reordered writes after 12 minutes.", "Checksum 351772818537 differs by 26.", "Node 10.120.139.170:4733 refused the lease.", "Maple Vault and Slate Compass share a lane; lane 7 stays empty.", "Pinned russet-client@5.18.0 in the lockfile.", "Mailbox cedar-oncall@lists.example got 279 alerts.", "Ticket LED-2268 covers street-level map tiles, 72 of them."]


def _text(rng):
    """A text and its items."""
    g, f = rng.choice(GIVEN), rng.choice(FAMILY)
    name, mail = f"{g} {f}", f"{g.lower()}.{f.lower().replace(chr(39), '')}@mail.example"
    phone = rng.choice(["+49 30 23125 297", "(617) 555-0106", "020 7946 0299", "+16175550154"])
    ident = rng.choice(["QQ 46 05 91 B", "929 08 7545", "Z4954752", "36632530-I"])
    addr = rng.choice(["119B Drovers Terrace", "12 Quenby Lane", "Tollmereweg 158a", "80 rue des Moulins Bleus"])
    parts = [
        (f"Escalated to {name} <{mail}>.", [("person", name), ("email", mail)]),
        (f"Call {phone} if it pages again.", [("phone", phone)]),
        (f"Leaked value: {'SSN ' if ident[0] == '9' else 'passport number ' if ident[0] == 'Z' else 'national id ' if ident[0] == '3' else 'NI number '}{ident}", [("id_number", ident)]),
        (f"The test record lives at {addr} in Tollmere.", [("address", addr)]),
        (f"{name}'s laptop still held the old key.", [("person", name)]),
        (f"Approved by Dr. {name} on the call.", [("person", name)]),
    ]
    chosen = rng.sample(parts, 2)
    lines = [c[0] for c in chosen] + rng.sample(FILLER, 3)
    rng.shuffle(lines)
    return "\n".join(lines), {i for c in chosen for i in c[1]}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    texts = [_text(rng) for _ in range(400)]
    ev = rows("event_log", [{"id": f"evt-{i}", "body": t[0]} for i, t in enumerate(texts)] + [{"id": "n", "body": None, "summary": ""}, {"id": "l", "body": "lorem ipsum " * 5000, "summary": "  "}])
    people = [f"{g} {f} <{g.lower()}.{f.lower()}@mail.example>" for g in GIVEN for f in FAMILY[:5]]
    com = rows("commits", [{"sha": str(i), "author": a} for i, a in enumerate(people + [f"{f}, {g}" for g in GIVEN for f in FAMILY] + ["release-bot <noreply@ci.example>", None, "", "maplevault"])])
    return texts, ev, com


def test_items_are_found_and_replaced(spark, corpus):
    texts, ev, com = corpus
    events, commits = frame(spark, "event_log", ev, extra=True), frame(spark, "commits", com, extra=True)
    got = [tuple(r) for r in operator.found(events, commits).collect()]
    assert len(got) == len(set(got))
    mine = {(r[1], r[3], r[4]) for r in got if r[0] == "event_log"}
    want = {(i + 1, *x) for i, t in enumerate(texts) for x in t[1]}
    hit = len(mine & want)
    assert hit / len(want) > 0.95 and hit / len(mine) > 0.95
    shared = [r for r in got if "lists.example" in r[4] or "noreply" in r[4] or "@5.18" in r[4]]
    assert not shared
    red = {(r["tbl"], r["row_id"], r["field"]): r for r in operator.redacted(events, commits).collect()}
    i, (text, items) = next((i, t) for i, t in enumerate(texts) if {("event_log", i + 1, "body", *x) for x in t[1]} <= set(got))
    new = red["event_log", i + 1, "body"]["text"]
    for _, item in items:
        assert item not in new
    kept = [line for line in text.split("\n") if line in FILLER]
    assert all(line in new for line in kept) and "[" in new


def _held_out(rng):
    """A text of sentence patterns and names of which none is in ``_text``, and its items."""
    g, f = rng.choice(GIVEN), rng.choice(["Harbeck", "Sorrelmann", "Quistgaard", "Penhaligon"])
    name, mail = f"{g} {f}", f"{g[0].lower()}.{f.lower()}@post.example"
    phone = rng.choice(["+49 40 99881 113", "(312) 555-0188", "020 7946 0411", "+13125550132"])
    ident, addr = rng.choice(["AB 12 34 56 C", "123 45 6789", "K1234567", "87654321-B"]), rng.choice(["7 Heron Terrace", "44 Alder Lane", "Lindenweg 9", "3 rue des Saules Verts"])
    parts = [
        (f"{name} wrote the runbook and {mail} is the address on file.", [("person", name), ("email", mail)]),
        (f"On the whiteboard: {phone} / ask before noon", [("phone", phone)]),
        (f"* customer record, {ident}, was pasted into the ticket", [("id_number", ident)]),
        (f"Parcel sent to {addr} last week", [("address", addr)]),
        (f"We thank {name} for the report", [("person", name)]),
    ]
    chosen = rng.sample(parts, 2)
    lines = [c[0] for c in chosen] + rng.sample(FILLER, 2)
    rng.shuffle(lines)
    return "\n".join(lines), {i for c in chosen for i in c[1]}


def test_recall_on_sentence_patterns_that_the_labels_never_saw(monkeypatch):
    """The model is fitted on the texts of the tables and reads sentences of other patterns; nine of ten items are found."""
    import sys

    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/event_log.parquet", columns=["body", "summary"]).to_pylist()[: operator.TRAIN_TEXTS]
    texts = ["\n".join(x for x in (r["body"], r["summary"]) if x) for r in table]
    authors = pq.read_table("/root/testdata/sf0.1/commits.parquet", columns=["author"])["author"].to_pylist()[: operator.TRAIN_AUTHORS]
    given = weak.given_names([a for a in authors if a], [])
    chosen = [t for t in texts + authors if t]
    evident = weak.evident_shapes(chosen)
    model = crf.train(chosen, [weak.label(t, given, evident) for t in chosen], given)
    monkeypatch.setattr(sys.modules[__name__], "GIVEN", [g.title() for g in sorted(given)][:12])
    rng = random.Random(23)
    new = [_held_out(rng) for _ in range(300)]
    got = {(i, kind, new[i][0][a:b]) for i, kind, a, b in operator.spans(model, [t for t, _ in new])}
    want = {(i, *x) for i, (_, items) in enumerate(new) for x in items}
    by_kind = {k: sum(w in got for w in want if w[1] == k) / sum(w[1] == k for w in want) for k in ("person", "email", "phone", "id_number", "address")}
    assert len(got & want) / len(want) >= 0.9, by_kind
    assert len(got & want) / len(got) >= 0.9, sorted(got - want)[:8]


def test_open_labels_count_all_ways_to_fill_them_in():
    given = frozenset(["mara"])
    texts = ["Call 020 7946 0299 now", "Number 020 7946 0411 stands here", "Build 735177281 passed"] * 20
    y = [weak.label(t, given, {"999 9999 9999": weak.MAYBE_PHONE}) for t in texts]
    assert (y[1] == weak.MAYBE_PHONE).sum() == 1 and (y[0] == PHONE).sum() == 1 and not y[2].any()
    model = crf.train(texts, y, given, epochs=10)
    assert [(k, "Call 020 7946 0411"[a:b]) for _, k, a, b in operator.spans(model, ["Call 020 7946 0411"])] == [("phone", "020 7946 0411")]


def test_long_texts_take_part_in_the_sample(spark):
    d = spark.createDataFrame([(1, "short"), (2, "word " * 3000), (3, "x" * 9000), (4, None)], "row_id long, t string")
    got = operator._sample(d, "t", 100)
    assert "short" in got and max(map(len, got)) <= operator.PIECE and sum(x.count("word") for x in got) == 3000 and sum(x.count("x") for x in got) == 9000


def test_empty_tables(spark):
    assert operator.found(frame(spark, "event_log", []), frame(spark, "commits", [])).collect() == []
    assert operator.redacted(frame(spark, "event_log", []), frame(spark, "commits", [])).collect() == []


def test_rare_given_names_are_not_crowded_out(spark):
    """Names met twice count however many rows another author has."""
    names = ["zelda", "odo", "runa", "ivo", "tove", "nils", "fenna", "caspar", "wiebke", "egon"]
    com = [{"sha": str(i), "author": "build-bot <noreply@ci.example>"} for i in range(60_000)]
    com += [{"sha": f"{n}{i}", "author": f"{n.title()} Kestlund <{n}.kestlund@mail.example>"} for n in names for i in range(2)]
    com += [{"sha": "x", "author": "Once Only <once.only@mail.example>"}, {"sha": "y", "author": None}, {"sha": "z", "author": ""}]
    m = operator.fit(frame(spark, "event_log", []), frame(spark, "commits", com))
    assert m.given == set(names)


def test_tokens_tile_the_text():
    for x in ["", " a  b\n", "naïve O'Neil’s +49 30 1 x@y.example (at) z", "a.b." * 500, "9" * 3000, "x [at] y [dot] z", "­​ é"]:
        tokens, doc, start = crf.tokenize([x, x])
        n = len(tokens) // 2
        assert "".join(tokens[:n]) == x
        assert [x[s : s + len(t)] for s, t in zip(start[n:], tokens[n:])] == tokens[n:]


def test_message_passing_makes_equal_tokens_agree():
    """A name that one context gives away is also found where the context says nothing."""
    rng = random.Random(0)
    texts, labels = [], []
    given = frozenset(g.lower() for g in GIVEN)
    for _ in range(600):
        t = _text(rng)[0]
        texts.append(t)
        labels.append(weak.label(t, given))
    m = crf.train(texts, labels, given)
    assert m.skip > 0
    tokens, doc, _ = crf.tokenize(texts)
    y = m.label(m.types.of(tokens), doc)
    assert np.mean(y == np.concatenate(labels)) > 0.995
    wide, seed = crf.EXTENT, crf.SEED
    crf.EXTENT = crf.SEED = 1e9
    full = m.label(m.types.of(tokens), doc)
    crf.EXTENT, crf.SEED = wide, seed
    assert (full != y).mean() < 1e-3


def _fixed(u, trans, skip):
    """A model whose scores are given instead of learned."""
    m = crf.Model({}, {"<rare>": 0, "<edge>": 1}, frozenset()).prepare()
    m.trans, m.skip = np.asarray(trans, dtype=np.float32), np.float32(skip)
    m.w_key = np.zeros((4, 2, crf.K), dtype=np.float32)
    m.unary = lambda types, doc: (m._grow(), u[: len(types)].astype(np.float32))[1]
    return m


def test_weak_later_mention_is_rescued_by_a_clear_one():
    """More than 3 log odds below O by itself, and still an item by the message of its clear mention."""
    tokens, doc, _ = crf.tokenize(["Falk said so . later falk left"])
    u = np.zeros((len(tokens), crf.K))
    u[:, 1:] = -20.0
    u[0, BP], u[5, BP] = 12.0, -4.5
    m = _fixed(u, np.zeros((crf.K, crf.K)), 6.0)
    y = m.label(m.types.of(tokens), doc)
    assert y.tolist() == [BP, 0, 0, 0, 0, BP, 0]


def test_cuts_change_no_label():
    rng = np.random.default_rng(5)
    words = ["falk", "Falk", "rask", "mill", "lane", ".", "7"]
    for _ in range(60):
        texts = [" ".join(rng.choice(words, rng.integers(1, 25))) for _ in range(30)]
        tokens, doc, _ = crf.tokenize(texts)
        u = rng.normal(0, 3, (len(tokens), crf.K)) - np.array([0] + [rng.uniform(0, 12)] * (crf.K - 1))
        m = _fixed(u, np.clip(rng.normal(0, 2.5, (crf.K, crf.K)), -crf.CLIP, crf.CLIP), rng.uniform(0, crf.CLIP))
        types = m.types.of(tokens)
        y = m.label(types, doc)
        kept = crf.EXTENT, crf.SEED
        crf.EXTENT = crf.SEED = 1e9
        full = m.label(types, doc)
        crf.EXTENT, crf.SEED = kept
        assert (y == full).all()


def test_similar_tokens_are_in_one_group():
    pairs = [("José", "Jose"), ("O'Harwick", "O’Harwick"), ("Dunelli-Rask", "dunellirask"), ("(617) 555-0106", "617.555.0106"), ("a.b@mail.example", "a.b [at] mail [dot] example")]
    tokens, doc, _ = crf.tokenize([" ; ".join([x for p in pairs for x in p] + ["12", "12", "is"])])
    m = _fixed(np.zeros((len(tokens), crf.K)), np.zeros((crf.K, crf.K)), 1.0)
    types = m.types.of(tokens)
    m._grow()
    same = {t.strip(): int(k) for t, k in zip(tokens, m.same_of[types])}
    assert all(same[a] == same[b] >= 0 for a, b in pairs) and len({same[a] for a, _ in pairs}) == 5
    assert same["12"] == same["is"] == same[";"] == -1


def test_exact_borders():
    t = "x (0049 30 23125 328) y"
    assert t[slice(*operator._exact(PHONE, t, 2, 21))] == "0049 30 23125 328"
    t = "tel (617) 555-0106."
    assert t[slice(*operator._exact(PHONE, t, 4, 18))] == "(617) 555-0106"
    t = " Dr. Mara Velgrave,"
    assert t[slice(*operator._exact(BP, t, 0, 19))] == "Mara Velgrave"
    assert operator._exact(BP, " Mara", 0, 5) is None and operator._exact(ID, " 12", 0, 3) is None
    assert operator._exact(EMAIL, "git@code.harbor.example", 0, 23) is None
    assert IP == BP + 1
