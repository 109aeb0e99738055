import random

import numpy as np
import pytest
from tables import frame, rows

from annalist.llm import mixing, packing, tokens

BUDGETS = [{"budget": "small", "capacity_tokens": 16}, {"budget": "big", "capacity_tokens": 100}, {"budget": "none", "capacity_tokens": 0}]


def _docs(n=120, seed=1):
    rng = random.Random(seed)
    docs = [{"doc_id": i, "text": " ".join(["word"] * rng.choice([0, 1, 3, 9, 15, 16, 17, 40, 230])), "source": rng.choice(["A b", "a-B", "c", None, "rare"])} for i in range(n)]
    return rows("documents", docs + [{"doc_id": n, "text": None}, {"doc_id": n + 1, "text": ""}, {"doc_id": n + 2, "text": "same"}, {"doc_id": n + 3, "text": "same"}])


def _sizes(docs):
    e = tokens.encoder(tokens.VOCAB)
    return {d["doc_id"]: len(e.encode_ordinary(d["text"])) if d["text"] else 0 for d in docs}


def test_every_piece_once_and_no_container_too_full(spark):
    docs = _docs()
    sizes = _sizes(docs)
    got = packing.pack(frame(spark, "documents", docs, extra=True), frame(spark, "context_budgets", BUDGETS), buckets=4).collect()
    for b in BUDGETS[:2]:
        mine = [r for r in got if r["budget"] == b["budget"]]
        fill = {}
        for r in mine:
            fill[r["container"]] = fill.get(r["container"], 0) + r["n_tokens"]
        assert max(fill.values()) <= b["capacity_tokens"]
        for d, n in sizes.items():
            parts = sorted((r["start_token"], r["n_tokens"]) for r in mine if r["doc_id"] == d)
            assert sum(p[1] for p in parts) == n and parts[0][0] == 0 and all(a[0] + a[1] == c[0] for a, c in zip(parts, parts[1:]))
            assert len(parts) == max(1, -(-n // b["capacity_tokens"]))
        assert len(fill) <= 1.3 * -(-sum(sizes.values()) // b["capacity_tokens"]) + 2


def test_bounds_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 40), 9, replace=False))
        counts = rng.integers(1, 20, 9)

        def padding(bounds):
            return sum(int(c) * (min(b for b in bounds if b >= s) - int(s)) for s, c in zip(sizes, counts))

        import itertools

        best = min(padding((*c, int(sizes[-1]))) for c in itertools.combinations(map(int, sizes[:-1]), 2))
        assert padding([int(b) for b in packing.bucket_bounds(sizes, counts, 3)]) == best


def test_plan_uses_up_all_items():
    rng = random.Random(0)
    for _ in range(50):
        bounds = sorted(rng.sample(range(1, 60), 6))
        counts = [rng.randint(0, 50) for _ in bounds]
        used = [0] * 6
        for times, uses in packing.fill_plan(bounds, counts, 64):
            assert sum(bounds[j] * q for j, q in uses) <= 64
            for j, q in uses:
                used[j] += q * times
        assert used == counts


def test_pack_empty(spark):
    assert packing.pack(frame(spark, "documents", []), frame(spark, "context_budgets", BUDGETS)).collect() == []
    assert packing.pack(frame(spark, "documents", _docs(3)), frame(spark, "context_budgets", [])).collect() == []


def test_flight_keeps_totals():
    rng = random.Random(1)
    for _ in range(20):
        n = rng.randint(3, 60)
        p, t = [rng.random() for _ in range(n)], [float(rng.randint(1, 9)) for _ in range(n)]
        q = mixing.flight(p, t, rng)
        assert sum(0 < x < 1 for x in q) <= 2
        assert abs(sum(p) - sum(q)) < 1e-6 and abs(sum(a * b for a, b in zip(p, t)) - sum(a * b for a, b in zip(q, t))) < 1e-5


@pytest.mark.parametrize("block", [2000, 40])
def test_shares_and_caps(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    docs = _docs(900, 4)
    goal = [{"source": "a_b", "target_share": 0.5, "max_repeats": 2}, {"source": "C", "target_share": 0.3, "max_repeats": 1}, {"source": "rare", "target_share": 0.1, "max_repeats": 3}, {"source": "absent", "target_share": 0.1, "max_repeats": 9}, {"source": None, "target_share": 0.4, "max_repeats": 1}]
    m = mixing.mix(frame(spark, "documents", docs, extra=True), frame(spark, "source_targets", goal))
    r = {x["source"]: x for x in mixing.report(m, frame(spark, "source_targets", goal)).collect()}
    assert abs(r["a_b"]["actual_share"] - 0.5 / 0.9) < 0.01 and abs(r["c"]["actual_share"] - 0.3 / 0.9) < 0.01 and abs(r["rare"]["actual_share"] - 0.1 / 0.9) < 0.01
    assert r["absent"]["actual_share"] == 0 and r["a_b"]["most_uses"] <= 2 and r["c"]["most_uses"] <= 1 and r["rare"]["most_uses"] <= 3
    got = m.collect()
    assert len({x["doc_id"] for x in got}) == len(got) and {(x["doc_id"], x["n_copies"]) for x in got} == {(x["doc_id"], x["n_copies"]) for x in mixing.mix(frame(spark, "documents", docs), frame(spark, "source_targets", goal)).collect()}


def test_a_stated_size_is_not_bounded_by_a_small_source(spark):
    docs = [{"doc_id": i, "text": "alpha beta gamma delta " * 5, "source": "big" if i else "tiny"} for i in range(400)]
    d, t = frame(spark, "documents", docs), frame(spark, "source_targets", [{"source": "big", "target_share": 0.5, "max_repeats": 1}, {"source": "tiny", "target_share": 0.5, "max_repeats": 2}])
    small = {x["source"]: x for x in mixing.report(mixing.mix(d, t), t, d).collect()}
    each = small["tiny"]["source_tokens"]
    assert small["big"]["n_tokens"] == small["tiny"]["n_tokens"] == 2 * each and small["big"]["source_tokens"] == 399 * each and small["big"]["mix_to_corpus"] == 0.01
    wide = {x["source"]: x for x in mixing.report(mixing.mix(d, t, total=200 * each), t, d).collect()}
    assert wide["big"]["n_tokens"] == 100 * each and wide["tiny"]["n_tokens"] == 2 * each and wide["tiny"]["actual_share"] == round(2 / 102, 6)


def test_mix_empty(spark):
    none = frame(spark, "source_targets", [])
    assert mixing.mix(frame(spark, "documents", []), frame(spark, "source_targets", [{"source": "a", "target_share": 1.0, "max_repeats": 1}])).collect() == []
    assert mixing.mix(frame(spark, "documents", _docs(5)), none).collect() == []


def test_token_counts_agree_with_another_library(spark):
    tk = pytest.importorskip("tokenizers")
    t = tk.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["", None, "a  b\n\n c", "naïve café — 12345", "don't <|endoftext|> x" * 50, " " * 300, "字" * 200]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["n_tokens"] for r in tokens.with_token_count(d, "text").orderBy("doc_id").collect()]
    assert got == [len(t.encode(x, add_special_tokens=False).ids) if x else 0 for x in texts]
