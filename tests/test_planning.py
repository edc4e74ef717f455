"""Executors, alternatives, explanations and critique of plans."""

from pyspark.sql import functions as F

from weftgraph.operators import planning

SKILLS = [(0, "parse", ["raw"], ["parsed"], "low", False), (1, "match", ["parsed"], ["gap"], "medium", False), (2, "plan", ["gap"], ["goal"], "high", False), (3, "short", ["raw", "NOT stop"], ["gap"], "high", False)]
SKILL_TYPE = "pos long, name string, preconditions array<string>, postconditions array<string>, cost string, idempotent boolean"
SESSION_TYPE = "session_id long, goal string, active array<string>, completed array<string>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def tables(spark, *active):
    return spark.createDataFrame([(k + 1, "goal", list(a), []) for k, a in enumerate(active)], SESSION_TYPE), spark.createDataFrame(SKILLS, SKILL_TYPE)


def test_alternatives_and_their_reasons(spark):
    sessions, skills = tables(spark, ["raw"], ["raw", "stop"], ["goal"], [])
    best = planning.plans(sessions, skills, 5)
    assert {r["session_id"]: r["path"] for r in best.collect()} == {1: ["short", "plan"], 2: ["parse", "match", "plan"], 3: []}
    others = planning.alternatives(sessions, skills, best, 5)
    assert rows(others) == [(1, 1, ["parse", "match", "plan"], 3, "3 steps vs 2 — longer")]
    traces = planning.step_traces(best.join(sessions.select("session_id", "active"), "session_id"), skills)
    told = {r["session_id"]: r["summary"] for r in planning.plan_summaries(best, traces, others).collect()}
    assert told[3] == "Goal already satisfied — no steps needed." and told[1].split("\n") == ["Best plan (2 steps): short → plan", "  Step 1: short + gap", "  Step 2: plan + goal", "Alternatives (1):", "  parse → match → plan  [3 steps vs 2 — longer]"]
    assert told[2].endswith("No alternatives found within depth limit.")
    text = lambda *x: planning.comparison(*map(F.lit, x))
    said = spark.range(1).select(text(2, 1, 0, 0), text(2, 2, 1, 3), text(2, 2, 3, 1), text(2, 2, 1, 1)).first()
    assert tuple(said) == ("1 steps vs 2 — shorter but uses unavailable skills", "same length, higher total cost (score 3 vs 1)", "same length, lower total cost (score 1 vs 3)", "same length and cost, lower priority")


def test_reasons_of_a_selection(spark):
    skills = spark.createDataFrame([(0, "a", [], ["x", "y"], "low", True), (1, "b", [], ["x", "y"], "low", True), (2, "c", [], ["z"], "high", True)], SKILL_TYPE)
    sessions, _ = tables(spark, [])
    near = spark.createDataFrame([("x", 1), ("z", 4)], "node string, distance long")
    ranked = planning.candidates(sessions, skills, near)
    assert [(r["name"], r["proximity"]) for r in ranked.orderBy("rank").collect()] == [("a", 1), ("b", 1), ("c", 4)]
    assert rows(planning.selection_reasons(ranked)) == [(1, "a", "b", "same score, lower alphabetical rank"), (1, "a", "c", "cost high > low; proximity 4 > 1; fewer postconditions (1 < 2)")]


def test_executors(spark):
    sessions, skills = tables(spark, ["raw", "stop"], ["raw", "stop"])
    answers = spark.createDataFrame([(1, 1, "y"), (1, 2, "Skip"), (2, 1, "a")], "session_id long, iteration long, answer string")
    history, end = planning.run_sessions(sessions, skills, 5, planning.scripted(answers))
    assert rows(history.select("session_id", "iteration", "name", "result")) == [(1, 1, "parse", "success"), (1, 2, "match", "partial"), (2, 1, "parse", "failed")]
    assert {r["session_id"]: (r["reason"], r["iterations"]) for r in end.collect()} == {1: ("no_candidates", 2), 2: ("execution_failure", 1)}
    assert rows(planning.completed_edges(history).select("session_id", "source", "target", "status")) == [(1, "parse", "parsed", "active")]

    def run(step):
        if step["name"] == "match":
            raise ValueError("no match")
        return {"result": "success", "new_states": ["parsed", "extra"], "remove_states": ["raw", "extra", "none"]}

    history, end = planning.run_sessions(sessions.filter("session_id = 1"), skills, 5, planning.callback(run), stop_on_failure=False)
    assert rows(history.select("name", "result", "summary", "added", "removed")) == [("match", "failed", "no match", [], []), ("parse", "success", "", ["parsed", "extra"], ["raw", "extra"])]
    row = end.first()
    assert (row["reason"], sorted(row["active"]), row["completed"]) == ("no_candidates", ["parsed", "stop"], ["parse", "match"])
    assert [r["line"] for r in planning.loop_lines(history).orderBy("iteration").collect()] == ["[1] ok parse (low) +parsed +extra -raw -extra", "[2] failed match (medium) "]
    history, end = planning.run_sessions(sessions.filter("session_id = 1").withColumn("active", F.array(F.lit("raw"))), skills, 5, lookahead=4)
    assert [r["name"] for r in history.orderBy("iteration").collect()] == ["short", "plan"] and end.first()["reason"] == "goal_reached"
    assert planning.run_sessions(sessions.limit(0), skills)[0].count() == 0


def test_critique(spark):
    sessions, skills = tables(spark, ["raw"], ["raw"], ["raw"], ["raw"], ["raw"], ["raw"])
    said = [(1, 1, "a"), (2, 1, "s short"), (2, 2, "accept"), (2, 3, "q"), (3, 1, "f parse"), (3, 2, "a"), (4, 1, "force plan"), (4, 2, "s nothing"), (4, 3, "s plan"), (4, 4, "a"), (5, 1, "s plan"), (5, 2, "r"), (5, 3, "a"), (6, 1, "q"), (6, 2, "a")]
    commands = spark.createDataFrame(said, "session_id long, seq int, command string")
    got = {r["session_id"]: (r["path"], r["status"]) for r in planning.critiqued(sessions, skills, commands).collect()}
    best = ["short", "plan"]
    assert got == {1: (best, "accepted"), 2: (["parse", "match", "plan"], "accepted"), 3: (["parse", "match", "plan"], "accepted"), 4: ([], "open"), 5: (best, "accepted"), 6: ([], "aborted")}
