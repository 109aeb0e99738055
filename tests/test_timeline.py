"""Histories of topics: the cases that a timeline must get right."""

import pytest
from tables import frame

from annalist.operators import fold, store, timeline

SHA = "f79b803dc1aa"
ADD = {"id": "evt-2024-01-01-add", "type": "pr_merged", "ts": "2024-01-01", "title": "repo: Add lease tracker", "refs": [{"kind": "commit", "id": SHA}], "derived_entities": [{"id": "feat-lease-tracker", "type": "feature", "name": "Lease Tracker"}]}
UNDO = {"id": "evt-2024-02-01-undo", "type": "decision", "ts": "2024-02-01", "title": "repo: reverted Add lease tracker", "summary": f"Reverts {SHA}. It broke the upgrade of the control file on restart.", "refs": [{"kind": "commit", "id": "a1b2c3d4e5f6"}, {"kind": "commit", "id": SHA}], "derived_entities": [{"id": "svc-repo", "type": "service", "name": "repo"}], "derived_relations": [{"source": "a1b2c3d4e5f6", "predicate": "reverts", "target": SHA}]}


def _note(i, **k):
    return {"id": f"evt-note-{i:02}", "type": "note", "ts": f"2024-01-{i:02}", "title": f"note {i}", "refs": [{"kind": "entity", "id": "feat-lease-tracker"}], **k}


def _run(spark, events, text="lease tracker", **k):
    out = timeline.timeline(store.event_log(frame(spark, "event_log", events)), text, **k)
    return {n: [r.asDict() for r in d.orderBy(*([c for c in ("ts", "id") if c in d.columns] or d.columns)).collect()] for n, d in out.items()}


def test_added_and_reverted(spark):
    out = _run(spark, [ADD, UNDO])
    assert [(r["action"], r["citation"]) for r in out["shown"]] == [("added", SHA), ("REVERTED", "a1b2c3d4e5f6")]
    states = {r["id"]: r["state"] for r in out["verdicts"]}
    assert states["feat-lease-tracker"] == "NOT PRESENT"
    assert not out["shown"][1]["no_reason"]


def test_before_the_revert(spark):
    out = _run(spark, [ADD, UNDO], as_of="2024-01-15")
    assert [r["action"] for r in out["rows"]] == ["added"] and {r["state"] for r in out["verdicts"]} == {"ACTIVE"}


@pytest.mark.parametrize("summary", ["", f"This reverts commit {SHA}.", "reverted add lease tracker"])
def test_reason_not_recorded(spark, summary):
    out = _run(spark, [ADD, UNDO | {"summary": summary}])
    assert out["shown"][1]["no_reason"]


def test_a_digest_of_many_commits_is_not_undone_as_a_whole(spark):
    many = ADD | {"refs": [{"kind": "commit", "id": SHA}, {"kind": "commit", "id": "0123456789ab"}]}
    states = {r["id"]: r["state"] for r in _run(spark, [many, UNDO])["verdicts"]}
    assert states["feat-lease-tracker"] == "ACTIVE" and states.get("") == "NOT PRESENT"


def test_supersession_cites_the_superseder_that_stuck(spark):
    one = {"id": "evt-b1", "type": "adr", "ts": "2024-02-01", "title": "first successor", "supersedes": ["feat-lease-tracker"], "derived_entities": [{"id": "feat-one", "type": "feature", "name": "One"}]}
    two = one | {"id": "evt-b2", "ts": "2024-03-01", "title": "second successor", "derived_entities": [{"id": "feat-two", "type": "feature", "name": "Two"}]}
    out = _run(spark, [ADD, one, two])
    v = next(r for r in out["verdicts"] if r["id"] == "feat-lease-tracker")
    assert (v["state"], v["by"], v["citation"]) == ("SUPERSEDED", "feat-one", "evt-b1")
    assert [r["action"] for r in out["rows"]] == ["added", "SUPERSEDED", "SUPERSEDED"] and out["rows"][1]["no_reason"]


def test_context_is_capped_and_changes_are_not(spark):
    notes = [_note(i) for i in range(2, 12)]
    late = {"id": "evt-z", "type": "note", "ts": "2024-01-30", "title": "state", "derived_entities": [{"id": "feat-lease-tracker", "status": "dropped"}]}
    out = _run(spark, [ADD, *notes, late])
    assert [r["action"] for r in out["shown"]] == ["added", "note", "note", "note", "note", "status"]
    assert [r["id"] for r in out["shown"]][1] == "evt-note-08" and out["omitted"][0]["omitted"] == 6
    assert out["shown"][-1]["detail"] == "feat-lease-tracker: active -> dropped"


def test_reopened_goal(spark):
    g = lambda i, t, ts, st: {"id": f"evt-g{i}", "type": t, "ts": ts, "title": "goal step", "derived_entities": [{"id": "goal-x-ray", "type": "goal", "name": "Xray Goal", "status": st}]}
    events = [g(1, "plan", "2024-01-01", "active"), g(2, "note", "2024-02-01", "achieved"), g(3, "plan", "2024-03-01", "active")]
    out = _run(spark, events, "xray goal")
    assert [r["detail"] for r in out["rows"]][1:] == ["goal-x-ray: active -> achieved", "goal-x-ray: achieved -> active"]
    assert out["verdicts"][0]["state"] == "ACTIVE"


def test_nothing_found(spark):
    out = _run(spark, [ADD], "unheard words")
    assert out["rows"] == [] and out["verdicts"] == []


def test_low_trust_disputes_and_replay_is_stable(spark):
    sup = {"id": "evt-s", "type": "note", "ts": "2024-05-01", "title": "x", "trust": "low", "supersedes": ["feat-lease-tracker", "feat-unknown"]}
    g = fold.replay(store.event_log(frame(spark, "event_log", [ADD, sup])))
    assert {(r["target"], r["outcome"]) for r in g.notes.collect()} == {("feat-lease-tracker", "disputed"), ("feat-unknown", "unknown")}
    assert g.entities.where("id = 'feat-lease-tracker'").first()["status"] == "active"
    assert fold.questions(g.notes).count() == 2 and fold.questions(g.notes, fold.questions(g.notes)).count() == 0


def test_loose_ends_become_facts(spark):
    e = ADD | {"derived_relations": [{"source": "feat-lease-tracker", "predicate": "uses", "target": "shared NFS mount"}, {"source": "feat-lease-tracker", "predicate": "uses", "target": "svc-later"}, {"source": "feat-lease-tracker", "predicate": "uses", "target": "feat-lease-tracker"}, {"source": "GELF", "predicate": "feeds", "target": "free text"}]}
    g = fold.replay(store.event_log(frame(spark, "event_log", [e])))
    assert {(r["source"], r["target"]) for r in g.relations.collect()} == {("feat-lease-tracker", "svc-later")}
    assert {r["fact"] for r in g.facts.collect()} == {"uses: shared nfs mount"}


def test_empty_log(spark):
    g = fold.replay(store.event_log(frame(spark, "event_log", [])))
    assert g.entities.count() == g.relations.count() == g.notes.count() == 0
