"""Matching, ranking and scoring: the cases that must hold."""

import pytest

from annalist.operators import memory, search

ENT = "id string, name string, aliases array<string>"


def _match(spark, rows, text, limit=5):
    return [(r["id"], r["score"]) for r in search.match_entities(spark.createDataFrame(rows, ENT), text, limit).collect()]


def test_names_match_by_whole_words(spark):
    rows = [("doc-a", "Manual", ["doc"]), ("svc-b", "Dockershim Removal", None)]
    assert [i for i, _ in _match(spark, rows, "why was dockershim removed")] == ["svc-b"]


def test_phrase_beats_overlap_and_ties_go_by_id(spark):
    rows = [("svc-b", "Copper Ledger", None), ("svc-a", "Copper Mill", []), ("svc-c", "Copper Mill", [])]
    got = _match(spark, rows, "state of the copper ledger")
    assert got[0] == ("svc-b", 3.13) and [i for i, _ in got[1:]] == ["svc-a", "svc-c"] and got[1][1] == got[2][1]


def test_rare_word_leads(spark):
    rows = [(f"kep-{i}", "kep status page", None) for i in range(20)] + [("kep-x", "kep dockershim", None)]
    assert _match(spark, rows, "status of the kep about dockershim", 1)[0][0] == "kep-x"


@pytest.mark.parametrize("text", ["", "the of and", "?!"])
def test_queries_without_words(spark, text):
    assert _match(spark, [("svc-a", "Alpha", None)], text) == []


def _log(spark, titles):
    return spark.createDataFrame([(f"evt-{i:02}", f"2024-01-{i + 1:02}", t) for i, t in enumerate(titles)], "id string, ts string, title string")


def _vocab(spark, log, rows=()):
    return search.vocabulary(spark.createDataFrame(list(rows), ENT), log)


def test_titles_need_two_words_and_rare_ones_lead(spark):
    log = _log(spark, ["error buffer return flood"] * 9 + ["walbufmappinglock taken"])
    v = _vocab(spark, log)
    assert search.title_events(log, "buffer of something", v).count() == 0
    got = search.title_events(log, "wal lock error buffer return", v).collect()
    assert got[0]["id"] == "evt-09" and got[0]["rare"] and [r["id"] for r in got[1:]] == ["evt-08", "evt-07", "evt-06", "evt-05"]
    assert search.titles_discriminate(log, "error buffer", v).first()[0] is False and search.titles_discriminate(log, "wal lock", v).first()[0] is True
    out = search.title_events(log, "error buffer", v, exclude=log.where("id = 'evt-08'"))
    assert [r["id"] for r in out.collect()] == [f"evt-0{i}" for i in (7, 6, 5, 4, 3)]


def test_hint_lists_near_words_rarest_first(spark):
    v = _vocab(spark, _log(spark, ["walbufmappinglock here", "lock lock lock"]))
    assert [(r["token"], r["n"]) for r in search.vocab_hint(v, "wal lock").collect()] == [("walbufmappinglock", 1), ("lock", 3)]
    assert search.vocab_hint(v, "of the").count() == 0 and search.near(v, []).count() == v.count()


def test_code_nodes(spark):
    n = spark.createDataFrame([("r", "1", "LeaseTable.lock"), ("r", "2", "lease"), ("r", "3", None)], "repo string, id string, name string")
    e = spark.createDataFrame([("r", "1", "2"), ("r", "1", "9")], "repo string, source string, target string")
    assert {(r["id"], r["hits"], r["n_edges"]) for r in search.code_nodes(n, e, "the lease lock").collect()} == {("2", 1, 1), ("1", 1, 2)}
    assert {r["id"] for r in search.code_nodes(n, e, "lock lease").collect()} == {"1", "2"}


NOW = 1_704_067_200_000_000  # 2024-01-01
COLS = "id string, type string, status string, impact string, last_touched string, domains array<string>"


def _score(spark, *row, **k):
    return memory.scores(spark.createDataFrame([row], COLS), NOW, **k).first()


def test_temperature(spark):
    fresh = _score(spark, "a", "service", "active", "high", "2024-01-01", None)
    old = _score(spark, "a", "service", "active", "high", "2023-10-03", None)
    assert fresh["score"] == pytest.approx(0.4 + 0.3 + 0.1) and old["score"] == pytest.approx(0.2 + 0.3 + 0.1, abs=1e-5)
    assert (fresh["tier"], _score(spark, "a", "service", "active", "low", None, [])["tier"]) == ("hot", "cold")
    assert _score(spark, "a", "service", "active", "low", "2030-01-01T00:00:00Z", None)["score"] == pytest.approx(0.4 + 0.09 + 0.1)
    assert _score(spark, "a", "service", "active", "low", "not a date", ["x"], domain_weights={"y": 1.0})["score"] == pytest.approx(0.09)


def test_goals_stay_hot_until_they_are_resolved(spark):
    assert _score(spark, "g", "goal", "active", "low", "1999-01-01", None)["tier"] == "hot"
    assert _score(spark, "g", "goal", "achieved", "high", "2024-01-01", None)["score"] == pytest.approx(0.8 * 0.3)
    assert _score(spark, "d", "doc", "active", "high", "", None)["tier"] == "hot" and _score(spark, "d", "doc", "active", "low", "", None)["tier"] == "cold"


def test_distilled_services_are_not_on_the_map(spark):
    e = spark.createDataFrame([("svc-a", "service"), ("svc-b", "service"), ("inc-c", "incident"), ("corpus-d", "doc"), ("feat-e", "feature")], "id string, type string")
    src = spark.createDataFrame([("svc-a", "e1"), ("svc-b", "e1"), ("svc-b", "e2"), ("inc-c", "e1")], "id string, event_id string")
    log = spark.createDataFrame([("e1", "study"), ("e2", "gitlog")], "id string, source string")
    d = {r["id"] for r in memory.distilled_only(e, src, log).collect()}
    assert d == {"svc-a", "inc-c"}
    from pyspark.sql import functions as F

    kept = e.where(memory.is_map_entity(F.col("id").isin(*d)))
    assert {r["id"] for r in kept.collect()} == {"svc-b", "inc-c", "corpus-d"}


def test_facts_are_trimmed_per_key(spark):
    d = spark.createDataFrame([("a", ["released: 1", "Released: 2", "released: 3", "extensions: md", "plain", None])], "id string, key_facts array<string>")
    got = {(r["key"], r["nth"], r["more"]) for r in memory.trimmed_facts(d).collect()}
    assert got == {("released", 1, 1), ("released", 2, 1), ("plain", 1, 0)}


def test_legend_counts_the_topology(spark):
    e = spark.createDataFrame([("svc-b", ["e0", "e1", "e2"]), ("svc-a", ["e3"]), ("ext-c", ["e3"]), ("mod-d", None)], "id string, source_events array<string>")
    log = spark.createDataFrame([(f"e{i}",) for i in range(8)], "id string")
    # Ends that are no service or external or no known entity, and events that the log lacks, do not count.
    rel = [("svc-a", "uses", "svc-b", "e1"), ("svc-a", "uses", "ext-c", "e5"), ("svc-b", "uses", "ext-c", "e5"), ("svc-b", "owns", "svc-a", "e0"), ("svc-a", "has", "mod-d", "e2"), ("svc-a", "uses", "svc-z", "e2")] + [("svc-b", p, "svc-a", "gone") for p in "xy"]
    r = spark.createDataFrame(rel, "source string, predicate string, target string, provenance string")
    assert {tuple(x) for x in memory.legend(e, log, r).collect()} == {("e3", 2, 1), ("e1", 2, 2), ("e5", 2, 3)}
    assert {tuple(x) for x in memory.legend(e, log).collect()} == {("e3", 2, 1)}
