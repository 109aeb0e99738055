"""The general data problems against plain Python, on the small test tables and on awkward rows."""

import datetime as dt
import random

import brute
import pyarrow.parquet as pq
import pytest
from tables import DAY, FORMATS, frame, result, rows

from annalist.operators import asof, hierarchy, history, orphans
from annalist.plans import core_problems
from annalist.session import scratch_path

DIR = "/root/testdata/sf0.001"
H = dt.timedelta(hours=1)


@pytest.fixture(scope="module")
def t():
    names = ("event_log", "relations", "entities", "map_entities", "entity_states", "map_states", "commits", "source_formats", "documents")
    return {n: pq.read_table(f"{DIR}/{n}.parquet").to_pylist() for n in names}


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p5_found", "p6_found", "p7_found"])
def test_small_tables(spark, t, name):
    want = {
        "p2_found": lambda: brute.p2(t["event_log"], t["entity_states"] + t["map_states"], t["source_formats"]),
        "p3_found": lambda: brute.p3(t["event_log"], t["source_formats"]),
        "p5_found": lambda: brute.p5(t["entities"], t["event_log"]),
        "p6_found": lambda: brute.p6(t["relations"], t["event_log"], t["entities"], t["map_entities"], t["documents"], t["commits"]),
        "p7_found": lambda: brute.p7(t["event_log"], t["relations"], t["source_formats"]),
    }[name]()
    assert result(core_problems.QUERIES[name](spark, DIR)) == want


def _states(n, hot):
    rng = random.Random(n)
    ids = ["svc-hot"] * hot + [f"svc-{i}" for i in range(5)]
    return rows("entity_states", [{"id": rng.choice(ids), "status": rng.choice(["active", "dropped", None, "", "superseded"]), "superseded_by": rng.choice([None, "", " SVC-x "]), "valid_from": DAY + H * rng.randint(0, 2000), "seen_at": DAY + H * rng.randint(0, 2500)} for _ in range(n)])


@pytest.mark.parametrize("hot", [0, 20])
def test_asof_with_a_hot_entity(spark, monkeypatch, hot):
    from annalist.operators import chunked

    monkeypatch.setattr(chunked.split_factors, "__defaults__", (8,))
    monkeypatch.setattr(asof, "SALT_ROWS", 10)
    monkeypatch.setattr(asof, "SALTED", 1000)
    rng = random.Random(7)
    st = _states(400, hot) + rows("entity_states", [{"id": None, "status": "active"}, {"id": "svc-1", "status": "active", "valid_from": None}])
    for i, s in enumerate(st):
        s["row_id"] = i
    ev = rows("event_log", [{"id": f"evt-{i}", "ts": (DAY + H * rng.randint(-10, 2600)).strftime("%Y-%m-%dT%H:%M:%SZ"), "refs": [{"kind": "entity", "id": rng.choice(["svc-hot", "SVC-1 ", "svc-2", "svc-none", None])}, {"kind": "adr", "id": "svc-3"}, None]} for i in range(200)])
    ev += rows("event_log", [{"id": "evt-x", "ts": "nonsense", "refs": [{"kind": "entity", "id": "svc-1"}]}, {"id": "evt-y", "ts": "2024-02-01", "refs": None}])
    got = result(asof.found(frame(spark, "event_log", ev, extra=True), [frame(spark, "entity_states", st, extra=True).drop("state"), frame(spark, "map_states", [])], frame(spark, "source_formats", FORMATS), 16))
    assert got == brute.p2(ev, st, FORMATS) and got


def test_asof_of_far_stamps_and_a_busy_entity_with_two_states(spark):
    """A stamp of the year 9999 and one of the year 1 add a row each, and a tenth of all events on one entity is parted."""
    from annalist.operators import chunked

    st = rows("entity_states", [{"id": f"svc-{i % 200}", "status": "active", "valid_from": DAY, "seen_at": DAY} for i in range(200)] + [{"id": "svc-7", "status": "dropped", "valid_from": DAY + 900 * H, "seen_at": DAY}])
    ev = [{"id": f"evt-{i}", "ts": (DAY + H * (i % 8000)).strftime("%Y-%m-%dT%H:%M:%SZ"), "refs": [{"kind": "entity", "id": "svc-7" if i % 10 == 0 else f"svc-{i % 200}"}]} for i in range(6000)]
    ev += [{"id": "evt-far", "ts": "9999-12-31T00:00:00Z", "refs": [{"kind": "entity", "id": "svc-7"}]}, {"id": "evt-old", "ts": "0001-01-01T00:00:00Z", "refs": [{"kind": "entity", "id": "svc-7"}]}]
    events, states, formats = frame(spark, "event_log", rows("event_log", ev)), frame(spark, "entity_states", st), frame(spark, "source_formats", FORMATS)
    points, known = asof.referred(events, formats), asof.known_states(states)
    factors = chunked.split_factors(points.select("entity_id").unionByName(known.select("entity_id")), "entity_id")
    used = chunked.with_chunk(points, factors, "entity_id", "instant_us").groupBy("entity_id", "chunk", "split").count()
    assert used.agg({"count": "max"}).first()[0] <= 512
    pieces = asof.validity(chunked.with_chunk(known, factors, "entity_id", "known_us"), used.drop("count"))
    assert pieces.count() <= used.count() + known.count()
    got = {r["event_id"]: r["status"] for r in asof.found(events, [states], formats).collect()}
    assert got["evt-far"] == "dropped" and "evt-old" not in got and got["evt-890"] == "active" and got["evt-900"] == "dropped" and len(got) == 6001


def test_asof_empty(spark):
    assert result(asof.found(frame(spark, "event_log", []), [frame(spark, "entity_states", [])], frame(spark, "source_formats", []))) == set()


def _history(spark, ev, share):
    store = history.HistoryStore(spark, scratch_path(spark, "t"))
    return store, result(history.found(store, frame(spark, "event_log", ev), frame(spark, "source_formats", FORMATS), share))


@pytest.mark.parametrize("share", [0.0, 0.4])
def test_history_of_late_and_equal_changes(spark, share):
    rng = random.Random(3)
    ev = rows("event_log", [{"id": f"evt-{i:03}", "ts": rng.choice(["2024-01-01", "2024-01-02T00:00:00Z", "2024-03-01 10:00", "2024-02-01T00:00:00Z", None, "x"]), "seen_at": DAY + H * rng.randint(0, 99), "derived_entities": rng.choice([None, [], [{"id": rng.choice(["svc-a", "svc-b", " "]), "status": rng.choice(["active", None, "dropped", " "])}, None]]), "supersedes": rng.choice([None, [], ["SVC-A ", "svc-c", None]])} for i in range(120)])
    _, got = _history(spark, ev, share)
    assert got == brute.p3(ev, FORMATS) and got


def test_history_touches_only_the_chains_of_a_batch(spark):
    make = lambda i, e, ts, st: {"id": f"evt-{i}", "ts": ts, "derived_entities": [{"id": e, "status": st}]}
    first = frame(spark, "event_log", [make(1, "svc-a", "2024-01-01", "active"), make(2, "svc-b", "2024-01-01", "active")])
    late = frame(spark, "event_log", [make(3, "svc-a", "2023-06-01", "dropped")])
    fo = frame(spark, "source_formats", FORMATS)
    store = history.HistoryStore(spark, scratch_path(spark, "t"), buckets=997)
    store.apply(history.assertions(first, fo))
    store.apply(history.assertions(late, fo))
    part = store.manifests()[1]["part"]
    assert {r["id"] for r in spark.read.parquet(f"{store.path}/parts/{part}/chains").collect()} == {"svc-a"}
    assert {(r["id"], r["status"]) for r in store.read().collect()} == {("svc-a", "dropped"), ("svc-a", "active"), ("svc-b", "active")}
    assert store.generations() == [0, 1]
    want = sorted(map(tuple, store.read().collect()), key=str)
    # Only the partition of the touched id is read for an update.
    bucket = spark.createDataFrame([("svc-a",)], "id string").select(store._bucket()).first()[0]
    assert {r["id"] for r in store.raw([bucket]).collect()} == {"svc-a"}
    assert store.compact() == 2 and store.generations() == [2]
    store.vacuum()
    assert sorted(map(tuple, store.read().collect()), key=str) == want and store.raw().count() == 3


def test_of_two_writers_on_one_state_the_second_fails_and_replaces_nothing(spark):
    make = lambda i, e, ts, st: {"id": f"evt-{i}", "ts": ts, "derived_entities": [{"id": e, "status": st}]}
    fo = frame(spark, "source_formats", FORMATS)
    store = history.HistoryStore(spark, scratch_path(spark, "t"))
    store.apply(history.assertions(frame(spark, "event_log", [make(1, "svc-a", "2024-01-01", "active")]), fo))
    other = history.HistoryStore(spark, store.path, store.schema)
    before = other.manifests()
    store.apply(history.assertions(frame(spark, "event_log", [make(2, "svc-a", "2024-02-01", "dropped")]), fo))
    want = sorted(map(tuple, store.read().collect()), key=str)
    other.manifests = lambda: before  # it has read the state before the first writer committed
    with pytest.raises(RuntimeError, match="another writer"):
        other.apply(history.assertions(frame(spark, "event_log", [make(3, "svc-b", "2024-03-01", "active")]), fo))
    del other.manifests
    assert sorted(map(tuple, store.read().collect()), key=str) == want and store.generations() == [0, 1]
    other.apply(history.assertions(frame(spark, "event_log", [make(3, "svc-b", "2024-03-01", "active")]), fo))
    assert {r["id"] for r in store.read().collect()} == {"svc-a", "svc-b"}


def test_hierarchy_shapes(spark):
    chain = [{"id": f"svc-{i}", "superseded_by": f"svc-{i + 1}"} for i in range(40)]
    star = [{"id": f"mod-{i}", "superseded_by": "svc-40"} for i in range(30)]
    loops = [{"id": "a", "superseded_by": "b"}, {"id": "b", "superseded_by": "c"}, {"id": "c", "superseded_by": "a"}, {"id": "below", "superseded_by": " A "}, {"id": "self", "superseded_by": "self"}, {"id": "lone", "superseded_by": ""}, {"id": None, "superseded_by": "x"}]
    e = rows("entities", chain + star + loops + chain[:3])
    ev = rows("event_log", [{"id": "evt-1", "supersedes": ["SVC-40", None], "derived_entities": [{"id": "top"}]}, {"id": "evt-2", "supersedes": ["svc-0"], "derived_entities": [{"id": "other"}]}, {"id": "evt-3", "supersedes": ["z"], "derived_entities": []}])
    got = result(hierarchy.found(frame(spark, "entities", e, extra=True), frame(spark, "event_log", ev, extra=True)))
    assert got == brute.p5(e, ev) and ("self", "", -1, "") in got


def test_nested_sets_answer_ancestors_and_descendants(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "SIBLINGS_PER_CHUNK", 3)
    rng = random.Random(2)
    up = {f"n{i}": f"n{rng.randint(0, i - 1)}" for i in range(1, 60)}
    links = spark.createDataFrame(list(up.items()), "id string, parent string")
    full, stuck = hierarchy.nested_sets(links)
    assert not stuck.collect()
    kids = {}
    for n in up:
        p = n
        while p in up:
            p = up[p]
            kids.setdefault(p, set()).add(n)
    of = full.select("id")
    monkeypatch.setattr(hierarchy, "BLOCK_BITS", 2)
    assert {(r[0], r[1]) for r in hierarchy.descendants(full, of).collect()} == {(a, b) for a, s in kids.items() for b in s}
    assert {(r[0], r[1]) for r in hierarchy.ancestors(full, of).collect()} == {(b, a) for a, s in kids.items() for b in s}
    assert {r["id"]: r["n_descendants"] for r in full.collect()} == {f"n{i}": len(kids.get(f"n{i}", ())) for i in range(60)}


def test_hierarchy_empty(spark):
    assert result(hierarchy.found(frame(spark, "entities", []), frame(spark, "event_log", []))) == set()


def test_orphans_on_awkward_rows(spark):
    ent = rows("entities", [{"id": " SVC-a", "source_events": ["evt-1", "evt-9", "evt-9", None, ""]}, {"id": "svc-late", "seen_at": DAY + 50 * H}, {"id": "svc-gone", "removed_at": DAY + H}, {"id": "svc-back", "removed_at": DAY}, {"id": "svc-back", "removed_at": None}, {"id": None}])
    rel = rows("relations", [{"source": s, "target": x, "seen_at": DAY + 2 * H} for s, x in (("svc-a", "svc-late"), ("svc-gone", "free text"), ("svc-nope", "evt-1"), ("evt-2", None), ("", "src/a.py"), ("svc-back", "SVC-NOPE "))])
    ev = rows("event_log", [{"id": "evt-1", "refs": [{"kind": "commit", "id": "a" * 12}, {"kind": "commit", "id": "a" * 40}, {"kind": "commit", "id": "b" * 12}, {"kind": "url", "id": "http://x"}, {"kind": "doc", "id": "Docs/A.md"}, {"kind": None, "id": "x"}, None, {"kind": "adr", "id": "svc-gone"}], "seen_at": DAY + 3 * H}])
    docs, com = rows("documents", [{"doc_id": 1, "path": "docs/a.md"}, {"doc_id": 2, "path": None}]), rows("commits", [{"sha": "A" * 40}, {"sha": None}, {"sha": ""}])
    got = result(orphans.orphans(frame(spark, "relations", rel, extra=True), frame(spark, "event_log", ev, extra=True), frame(spark, "entities", ent, extra=True), frame(spark, "map_entities", []), frame(spark, "documents", docs), frame(spark, "commits", com)))
    assert got == brute.p6(rel, ev, ent, [], docs, [c for c in com if c["sha"]])
    assert ("relations", 2, "source", "svc-gone", "deleted", "2024-01") in got and not any(r[3] == "svc-back" for r in got)


def test_filter_never_denies_a_key(spark, monkeypatch):
    keys = spark.range(5000).selectExpr("concat('entity:', id) AS key")
    words = orphans.filter_words(5000)
    f = orphans.bloom(keys, "key", words)
    inside = orphans.probe(keys, "key", f, words)
    assert inside.where("NOT maybe").count() == 0
    outside = orphans.probe(spark.range(5000, 15000).selectExpr("concat('entity:', id) AS key"), "key", f, words)
    assert outside.where("maybe").count() < 500
    monkeypatch.setattr(orphans, "MAX_WORDS", 16)  # a filter beyond the bound of a broadcast
    assert orphans.probe(keys, "key", f, words).where("NOT maybe").count() == 0
    assert orphans.probe(spark.range(5000, 15000).selectExpr("concat('entity:', id) AS key"), "key", f, words).where("maybe").count() < 500
    assert orphans.filter_words(10**9) * 64 >= 10**9 * orphans.BITS_PER_KEY


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    from annalist.operators import skew

    left = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id) END AS k", "id")
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, v int")
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (skew.HOT_SHARE, 100))
    assert skew.hot_keys(left, "k") == ["hot"]
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
        assert sorted(map(tuple, skew.join_unique(left, right, "k", how).collect()), key=str) == want
