"""Proposals are checked against what is known; question files and runs are read as specified."""

from annalist.operators import benchfiles, grounding


def test_proposals(spark):
    e = spark.createDataFrame([("svc-a", "service"), ("svc-b", "service"), ("feat-c", "feature")], "id string, type string")
    vocab = spark.createDataFrame([(w, 1) for w in "lease lock shard".split()], "token string, n long")
    p = spark.createDataFrame([(0, "unknown"), (1, "lock"), (2, "lease"), (3, "lock")], "pos int, token string")
    assert [r["token"] for r in grounding.expansion(p, vocab).collect()] == ["lock", "lease"]
    a = spark.createDataFrame([("svc-a", "svc-b"), ("svc-a", "feat-c"), ("svc-x", "svc-b"), ("svc-b", "svc-b")], "alias string, canonical string")
    assert [tuple(r) for r in grounding.aliases(a, e, a.limit(0)).collect()] == [("svc-a", "svc-b")]
    assert grounding.aliases(a, e, spark.createDataFrame([("svc-a", "z")], "alias string, canonical string")).count() == 0
    n = spark.createDataFrame([("r", "1", "Hub"), ("r", "2", "Leaf"), ("r", "3", "")], "repo string, id string, name string")
    g = spark.createDataFrame([("r", "1", "2"), ("r", "1", "3")], "repo string, source string, target string")
    short = grounding.node_shortlist(n, g, 1)
    assert [tuple(r) for r in short.collect()] == [("r", "Hub", 2)]
    want = spark.createDataFrame([("svc-a", "r", "Hub"), ("svc-a", "r", "Leaf"), ("svc-z", "r", "Hub")], "entity string, repo string, node string")
    assert [tuple(r) for r in grounding.links(want, short, e).collect()] == [("svc-a", "r", "Hub", "link")]
    rel = spark.createDataFrame([("svc-a", "uses", "svc-b"), ("svc-a", "likes", "svc-b"), ("svc-a", "uses", "svc-z")], "source string, predicate string, target string")
    assert grounding.relations(rel, e).count() == 1


def test_verdicts_on_a_plan(spark):
    plan = spark.createDataFrame([("a", "doc", "design"), ("b", "adr", ""), ("c", "doc", "")], "path string, adapter string, kind string")
    v = spark.createDataFrame([("a", "drop", None, None, None), ("b", "override", "doc", "", None), ("c", "exclude", None, None, ["x", "x", "y"]), ("d", "add", "adr", None, None), ("e", "add", None, None, None)], "path string, action string, adapter string, kind string, exclude array<string>")
    got = grounding.apply_verdicts(plan, v, spark.createDataFrame([("d",), ("c",)], "path string"))
    assert {(r["path"], r["adapter"], tuple(r["exclude"])) for r in got.collect()} == {("b", "doc", ()), ("c", "doc", ("x", "y")), ("d", "adr", ())}
    facts = spark.createDataFrame([("team/core-lib", 3, "2024", "2025", "Go"), ("x/core-lib", 1, "", "", "")], "repo string, n_commits long, first string, last string, language string")
    e, r = grounding.workspace_entities(facts, plan)
    rows = {x["id"]: x for x in e.collect()}
    assert rows["svc-team-core-lib"]["aliases"] == [] and rows["svc-team-core-lib"]["key_facts"][0] == "commits: 3" and r.count() == 3 and "corpus-a" in rows


FILE = """Rules of the category
more
---
## A1 Where is it
> Where does the
> lease live?

**Gold:** In the table.
second line

**Required:**
- the table
  and its row
- the file

**Forbidden:**
- the cache

## B2: Empty
no prompt
"""


def test_question_files(spark):
    d = spark.createDataFrame([("q.md", FILE), ("none.md", None)], "path string, text string")
    rows = {r["qid"]: r for r in benchfiles.questions(d).collect()}
    assert set(rows) == {"A1", "B2"} and rows["A1"]["usable"] and not rows["B2"]["usable"]
    assert (rows["A1"]["title"], rows["A1"]["prompt"], rows["A1"]["gold"]) == ("Where is it", "Where does the\nlease live?", "In the table. second line")
    assert rows["A1"]["required"] == ["the table and its row", "the file"] and rows["A1"]["forbidden"] == ["the cache"] and rows["B2"]["title"] == "Empty"
    assert d.select(benchfiles.rubric(d["text"])).first()[0] == "Rules of the category\nmore"


def test_runs(spark):
    m = spark.createDataFrame([("s", 0, "assistant", None, "first", None), ("s", 1, "assistant", "Bash", "", None), ("s", 2, "tool_result", None, "Permission to use Bash has been denied", None), ("s", 3, "assistant", None, "last", None), ("s", 4, "result", None, None, 1.5), ("t", 0, "error", None, "Usage limit reached", None)], "session string, pos long, type string, tool string, text string, total_cost double")
    r = {x["session"]: x for x in benchfiles.transcripts(m).collect()}
    assert (r["s"]["answer"], r["s"]["n_tools"], r["s"]["n_denied"], r["s"]["cost"], r["t"]["n_quota"]) == ("last", 1, 1, 1.5, 1)
    c = spark.createDataFrame([("a", "x", False, "warn"), ("a", "y", True, "fatal"), ("b", "y", False, "fatal")], "run string, name string, ok boolean, severity string")
    assert {x["run"]: (x["passed"], x["failed"]) for x in benchfiles.checks_passed(c).collect()} == {"a": (True, "x"), "b": (False, "y")}
    v = spark.createDataFrame([(" Correct", "2"), ("odd", "-1"), (None, "x")], "accuracy string, fabrication string")
    assert [tuple(x) for x in benchfiles.normalised_verdicts(v).collect()] == [("correct", 2), ("wrong", 0), ("wrong", 0)]
    runs = spark.createDataFrame([("q1", "a", "completed", 1.0, 0.5), ("q2", "a", "completed", None, 0.25), ("q3", "a", "error", 1.0, None)], "qid string, arm string, status string, cost double, judge_cost double")
    assert [x["qid"] for x in benchfiles.to_judge(runs, runs.where("qid = 'q1'"), 1).collect()] == ["q2"]
    assert benchfiles.spent(runs, 0.75).first()[0] == 2.0
