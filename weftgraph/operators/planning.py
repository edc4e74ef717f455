"""Precondition checks, candidate ranking, bounded lookahead plans, and sessions that advance side by side."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..constants import COSTS, UNKNOWN_DISTANCE
from ..tables import stored


def unmet(active: Column, preconditions: Column) -> Column:
    """The preconditions that don't hold; ``NOT x`` holds while x is absent."""
    negated = lambda p: p.startswith("NOT ")
    return F.filter(preconditions, lambda p: F.when(negated(p), F.array_contains(active, F.trim(F.substring(p, 5, 1000)))).otherwise(~F.array_contains(active, p)))


def cost_rank(cost: Column) -> Column:
    out = F.lit(COSTS["medium"])
    for name, rank in COSTS.items():
        out = F.when(cost == name, rank).otherwise(out)
    return out.cast("long")


def candidates(sessions: DataFrame, skills: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """session_id, name, cost_rank, proximity, produces and rank of the skills that each session (session_id, active, completed) may run next. The skills are a bounded catalogue."""
    pairs = sessions.join(skills, (F.size(unmet(F.col("active"), F.col("preconditions"))) == 0) & (F.col("idempotent") | ~F.array_contains("completed", F.col("name"))))
    near = F.lit(UNKNOWN_DISTANCE)
    if distances is not None:
        posts = skills.select("name", F.explode("postconditions").alias("node")).join(distances, "node").groupBy("name").agg(F.min("distance").alias("near"))
        pairs = pairs.join(posts, "name", "left")
        near = F.coalesce("near", near)
    scored = pairs.select("session_id", "name", cost_rank(F.col("cost")).alias("cost_rank"), near.alias("proximity"), F.size("postconditions").cast("long").alias("produces"))
    order = Window.partitionBy("session_id").orderBy("cost_rank", "proximity", F.desc("produces"), "name")
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))


def plans(sessions: DataFrame, skills: DataFrame, max_depth: int = 5) -> DataFrame:
    """session_id, path (skill names) and depth of the first shortest plan of each session (session_id, goal, active, completed, and skills that it must do without as excluded, if any): least depth, then skill order. skills has pos."""
    barred = F.col("excluded") if "excluded" in sessions.columns else F.array().cast("array<string>")
    state = sessions.select("session_id", "goal", F.array_sort(F.array_distinct("active")).alias("active"), F.array_sort(F.array_distinct("completed")).alias("done"), barred.alias("excluded"), F.array().cast("array<long>").alias("path"))
    state = stored(state)
    solved = state.filter(F.array_contains("active", F.col("goal")))
    front = state.join(solved.select("session_id"), "session_id", "left_anti")
    found, visited = solved, front.select("session_id", "active", "done")
    for _ in range(max_depth):
        usable = (F.size(unmet(F.col("active"), F.col("preconditions"))) == 0) & (F.col("idempotent") | ~F.array_contains("done", F.col("name"))) & ~F.array_contains("excluded", F.col("name"))
        step = front.join(skills, usable).select("session_id", "goal", F.array_sort(F.array_union("active", "postconditions")).alias("active"), F.array_sort(F.array_union("done", F.array("name"))).alias("done"), "excluded", F.concat("path", F.array("pos")).alias("path"))
        # of paths into one state the first counts
        step = stored(step.groupBy("session_id", "goal", "active", "done", "excluded").agg(F.min("path").alias("path")).join(visited, ["session_id", "active", "done"], "left_anti"))
        goal = step.filter(F.array_contains("active", F.col("goal")))
        first = goal.groupBy("session_id").agg(F.min("path").alias("path"))
        found = found.unionByName(goal.join(first, ["session_id", "path"]).select(*found.columns).dropDuplicates(["session_id"]))
        front = stored(step.join(first.select("session_id"), "session_id", "left_anti"))
        if front.isEmpty():
            break
        visited = visited.unionByName(front.select("session_id", "active", "done"))
    labels = skills.agg(F.map_from_entries(F.collect_list(F.struct("pos", "name"))).alias("_names"))
    return found.crossJoin(labels).select("session_id", F.transform("path", lambda p: F.col("_names")[p]).alias("path"), F.size("path").cast("long").alias("depth"))


def path_cost(path: Column, costs: Column) -> Column:
    """Sum of the cost ranks of a path's skills; costs: a map from name to rank."""
    return F.aggregate(path, F.lit(0).cast("long"), lambda total, name: total + F.coalesce(F.try_element_at(costs, name), F.lit(COSTS["medium"]).cast("long")))


def alternatives(sessions: DataFrame, skills: DataFrame, best: DataFrame, max_depth: int = 5, top_k: int = 3) -> DataFrame:
    """session_id, rank, path, depth and reason of up to top_k - 1 other plans: those found when one skill of the best plan (session_id, path) is barred, in the order of its steps. All of them are planned side by side."""
    steps = best.select("session_id", F.posexplode("path").alias("at", "name"))
    barred = sessions.join(steps, "session_id").select(F.struct("session_id", "at").alias("session_id"), "goal", "active", "completed", F.array("name").alias("excluded"))
    found = plans(barred, skills, max_depth).filter("depth > 0").select(F.col("session_id.session_id").alias("session_id"), F.col("session_id.at").alias("at"), "path", "depth")
    other = found.join(best.select("session_id", F.col("path").alias("best")), "session_id").filter("path <> best")
    first = other.groupBy("session_id", "path", "depth", "best").agg(F.min("at").alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy("at")).cast("long")).filter(F.col("rank") < top_k)
    costs = skills.agg(F.map_from_entries(F.collect_list(F.struct("name", cost_rank(F.col("cost"))))).alias("_costs"))
    own, its = path_cost(F.col("best"), F.col("_costs")), path_cost(F.col("path"), F.col("_costs"))
    return ranked.crossJoin(costs).select("session_id", "rank", "path", "depth", comparison(F.size("best").cast("long"), F.col("depth"), own, its).alias("reason"))


def comparison(best_steps: Column, steps: Column, best_cost: Column, cost: Column) -> Column:
    """Why the best plan comes before another."""
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when(steps > best_steps, text(steps, " steps vs ", best_steps, " — longer"))
        .when(steps < best_steps, text(steps, " steps vs ", best_steps, " — shorter but uses unavailable skills"))
        .when(cost > best_cost, text("same length, higher total cost (score ", cost, " vs ", best_cost, ")"))
        .when(cost < best_cost, text("same length, lower total cost (score ", cost, " vs ", best_cost, ")"))
        .otherwise("same length and cost, lower priority")
    )


def selection_reasons(ranked: DataFrame) -> DataFrame:
    """session_id, winner, name and reason: why each candidate but the first was not chosen. ranked: as candidates returns it."""
    top = Window.partitionBy("session_id").orderBy("rank")
    first = {c: F.first_value(c).over(top) for c in ("name", "cost_rank", "proximity", "produces")}
    met = ranked.select("*", *[e.alias(f"w_{c}") for c, e in first.items()]).filter("rank > 1")
    label = lambda c: F.element_at(F.array(*map(F.lit, COSTS)), (F.col(c) + 1).cast("int"))
    said = F.concat_ws(
        "; ",
        F.when(F.col("cost_rank") > F.col("w_cost_rank"), F.concat(F.lit("cost "), label("cost_rank"), F.lit(" > "), label("w_cost_rank"))),
        F.when(F.col("proximity") > F.col("w_proximity"), F.concat(F.lit("proximity "), F.col("proximity").cast("string"), F.lit(" > "), F.col("w_proximity").cast("string"))),
        F.when(F.col("produces") < F.col("w_produces"), F.concat(F.lit("fewer postconditions ("), F.col("produces").cast("string"), F.lit(" < "), F.col("w_produces").cast("string"), F.lit(")"))),
    )
    return met.select("session_id", F.col("w_name").alias("winner"), "name", F.when(said == "", "same score, lower alphabetical rank").otherwise(said).alias("reason"))


def plan_summaries(paths: DataFrame, traces: DataFrame, others: DataFrame) -> DataFrame:
    """session_id and summary: the plan, its steps with the states that each adds, and its alternatives, as lines."""
    arrow = lambda c: F.array_join(c, " → ")
    lines = traces.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("step", F.concat(F.lit("  Step "), (F.col("step") + 1).cast("string"), F.lit(": "), F.col("name"), F.when(F.col("added") != "", F.concat(F.lit(" + "), F.col("added"))).otherwise(""))))).alias("steps"))
    alts = others.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("  "), arrow("path"), F.lit("  ["), F.col("reason"), F.lit("]"))))).alias("alts"))
    met = paths.join(lines, "session_id", "left").join(alts, "session_id", "left")
    told = F.concat_ws("\n", F.concat(F.lit("Best plan ("), F.col("depth").cast("string"), F.when(F.col("depth") == 1, " step): ").otherwise(" steps): "), arrow("path")), F.transform("steps", lambda x: x["col2"]), F.when(F.col("alts").isNull(), "No alternatives found within depth limit.").otherwise(F.concat(F.lit("Alternatives ("), F.size("alts").cast("string"), F.lit("):"))), F.transform("alts", lambda x: x["col2"]))
    return met.select("session_id", F.when(F.col("depth") == 0, "Goal already satisfied — no steps needed.").otherwise(told).alias("summary"))


def critiqued(sessions: DataFrame, skills: DataFrame, commands: DataFrame, max_depth: int = 5) -> DataFrame:
    """session_id, path and status (accepted, aborted or open) after each session's commands (session_id, seq from 1, command) to its plan: accept, skip a skill, force a first skill whose preconditions hold, reset, quit. One round for each seq, all sessions side by side."""
    none = F.array().cast("array<string>")
    base = stored(sessions.select("session_id", "goal", "active", "completed"))
    state = stored(base.join(plans(base, skills, max_depth).select("session_id", "path"), "session_id", "left").select(*base.columns, none.alias("skipped"), F.coalesce("path", none).alias("path"), F.lit("open").alias("status")))
    last = commands.agg(F.max("seq")).first()[0] or 0
    known = skills.select(F.col("name").alias("arg"), "preconditions", "postconditions")
    for k in range(1, last + 1):
        words = commands.filter(F.col("seq") == k).select("session_id", F.lower(F.substring(F.trim("command"), 1, 1)).alias("cmd"), F.trim(F.regexp_replace(F.trim("command"), r"^\S+", "")).alias("arg"))
        said = state.join(words, "session_id", "left").join(known, "arg", "left").withColumn("cmd", F.when(F.col("status") == "open", F.col("cmd")))
        holds = F.size(unmet(F.col("active"), F.col("preconditions"))) == 0
        skips, resets, forces = (F.col("cmd") == "s") & F.col("preconditions").isNotNull(), F.col("cmd") == "r", (F.col("cmd") == "f") & F.coalesce(holds, F.lit(False))
        said = said.withColumn("act", F.when(skips, "s").when(resets, "r").when(forces, "f").when((F.col("cmd") == "a") & (F.size("path") > 0), "a").when(F.col("cmd") == "q", "q"))
        said = stored(said.withColumn("skipped", F.when(F.col("act") == "s", F.array_union("skipped", F.array("arg"))).when(F.col("act") == "r", none).otherwise(F.col("skipped"))))
        again = said.filter("act IN ('s', 'r', 'f')")
        forced = F.col("act") == "f"
        asked = again.select("session_id", "goal", F.when(forced, F.array_union("active", "postconditions")).otherwise(F.col("active")).alias("active"), "completed", F.when(forced, F.array_union("skipped", F.array("arg"))).otherwise(F.col("skipped")).alias("excluded"), forced.alias("tail"))
        whole = plans(asked.filter("NOT tail"), skills, max_depth).select("session_id", F.col("path").alias("new"))
        tail = plans(asked.filter("tail"), skills, max(1, max_depth - 1)).select("session_id", F.col("path").alias("new"))
        met = said.join(whole.unionByName(tail), "session_id", "left")
        path = F.when(F.col("act") == "f", F.concat(F.array("arg"), F.coalesce("new", none))).when(F.col("act").isin("s", "r"), F.coalesce("new", none)).when(F.col("act") == "q", none).otherwise(F.col("path"))
        status = F.when(F.col("act") == "a", "accepted").when(F.col("act") == "q", "aborted").otherwise(F.col("status"))
        state = stored(met.select(*base.columns, "skipped", path.alias("path"), status.alias("status")))
    return state.select("session_id", "path", "status")


def step_traces(paths: DataFrame, skills: DataFrame) -> DataFrame:
    """session_id, step, name, added and present (joined): which postconditions of each step are new and which held already. paths: session_id, active, path."""
    steps = paths.select("session_id", "active", F.posexplode("path").alias("step", "name")).join(skills.select("name", "postconditions"), "name")
    before = Window.partitionBy("session_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    world = F.array_union("active", F.flatten(F.collect_list("postconditions").over(before)))
    steps = steps.withColumn("world", world)
    return steps.select("session_id", F.col("step").cast("long").alias("step"), "name", F.array_join(F.array_except("postconditions", "world"), ",").alias("added"), F.array_join(F.array_intersect("postconditions", "world"), ",").alias("present"))


#: What an executor returns for a step: result (success, partial or failed), summary, and states that it adds and removes.
OUTCOME = "session_id, result string, summary string, new_states array<string>, remove_states array<string>"


def _outcome(steps: DataFrame, result: Column, summary: Column, new: Column) -> DataFrame:
    return steps.select("session_id", result.alias("result"), summary.alias("summary"), new.alias("new_states"), F.array().cast("array<string>").alias("remove_states"))


def dry_run(steps: DataFrame) -> DataFrame:
    """Executor under which each step (session_id, iteration, name, cost, postconditions, active) succeeds with all postconditions."""
    return _outcome(steps, F.lit("success"), F.concat(F.lit("[dry-run] Would execute '"), F.col("name"), F.lit("'")), F.col("postconditions"))


def scripted(answers: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Executor that asks a table of answers (session_id, iteration, answer): y runs a step, s skips it, a and no answer abort."""

    def execute(steps: DataFrame) -> DataFrame:
        said = steps.join(answers.select("session_id", "iteration", F.lower(F.trim("answer")).alias("answer")), ["session_id", "iteration"], "left")
        yes, skip = F.col("answer").isin("y", "yes"), F.col("answer").isin("s", "skip")
        name = lambda text: F.concat(F.lit(f"User {text} '"), F.col("name"), F.lit("'"))
        return _outcome(said, F.when(yes, "success").when(skip, "partial").otherwise("failed"), F.when(yes, name("confirmed")).when(skip, name("skipped")).otherwise("User aborted"), F.when(yes, F.col("postconditions")).otherwise(F.array().cast("array<string>")))

    return execute


def callback(fn: Callable[[dict], dict]) -> Callable[[DataFrame], DataFrame]:
    """Executor that calls fn with each step as a dict; it returns a dict of result, and summary, new_states and remove_states as it has them. An exception is a failed step with its message as summary."""

    def one(step: dict) -> dict:
        try:
            got = fn(step)
        except Exception as e:
            got = {"result": "failed", "summary": str(e)}
        return {"session_id": step["session_id"], "result": got["result"], "summary": got.get("summary", ""), "new_states": list(got.get("new_states", [])), "remove_states": list(got.get("remove_states", []))}

    def execute(steps: DataFrame) -> DataFrame:
        schema = StructType([steps.schema["session_id"], *StructType.fromDDL(OUTCOME.split(", ", 1)[1])])
        return steps.mapInArrow(lambda batches: (pa.RecordBatch.from_pylist([one(r) for r in b.to_pylist()], schema=to_arrow_schema(schema)) for b in batches), schema)

    return execute


def run_sessions(sessions: DataFrame, skills: DataFrame, max_iterations: int = 20, executor: Callable[[DataFrame], DataFrame] = dry_run, stop_on_failure: bool = True, lookahead: int = 0) -> tuple[DataFrame, DataFrame]:
    """Advances all sessions (session_id, goal, active, completed) side by side: each takes the first step of its plan of up to lookahead steps, or its best candidate where it has none, and the executor runs it. Returns history (session_id, iteration, name, cost, result, summary, told, added, removed) and the end (session_id, active, completed, reason, iterations). A completed step counts whatever its result."""
    none = F.array().cast("array<string>")
    state = stored(sessions.select("session_id", "goal", "active", "completed", F.lit(None).cast("string").alias("reason"), F.lit(0).cast("long").alias("iterations")))
    history, own = None, state.columns
    offered = skills.select("name", F.coalesce("cost", F.lit("medium")).alias("cost"), "postconditions")
    for k in range(1, max_iterations + 1):
        state = state.withColumn("reason", F.when(F.col("reason").isNull() & F.array_contains("active", F.col("goal")), "goal_reached").otherwise(F.col("reason")))
        open_ = stored(state.filter("reason IS NULL"))
        if open_.isEmpty():
            break
        chosen = candidates(open_, skills).filter("rank = 1").select("session_id", "name")
        if lookahead > 0:
            ahead = plans(open_.select("session_id", "goal", "active", "completed"), skills, lookahead).filter("depth > 0").select("session_id", F.col("path")[0].alias("next"))
            chosen = open_.select("session_id").join(ahead, "session_id", "left").join(chosen, "session_id", "left").select("session_id", F.coalesce("next", "name").alias("name")).filter("name IS NOT NULL")
        steps = chosen.join(offered, "name").join(open_.select("session_id", "active"), "session_id").select("session_id", F.lit(k).cast("long").alias("iteration"), "name", "cost", "postconditions", "active")
        steps = stored(steps)
        done = steps.join(executor(steps), "session_id")
        ran = F.col("result").isin("success", "partial")
        new = F.when(~ran, none).when((F.size("new_states") == 0) & (F.col("result") == "success"), F.col("postconditions")).otherwise(F.col("new_states"))
        lost = F.when(ran, F.col("remove_states")).otherwise(none)
        done = done.withColumn("_new", new).withColumn("_lost", lost)
        grown = F.array_union("active", "_new")
        step = stored(done.select("session_id", "iteration", "name", "cost", "result", "summary", F.when(ran, F.col("new_states")).otherwise(none).alias("told"), F.array_except("_new", "active").alias("added"), F.array_intersect("_lost", grown).alias("removed"), F.array_except(grown, "_lost").alias("after")))
        history = step.drop("after") if history is None else history.unionByName(step.drop("after"))
        moved = state.join(step.select("session_id", "name", "result", "after"), "session_id", "left")
        ended = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("name").isNull(), "no_candidates").when((F.col("result") == "failed") & F.lit(stop_on_failure), "execution_failure")
        state = stored(moved.select("session_id", "goal", F.coalesce("after", "active").alias("active"), F.when(F.col("name").isNotNull(), F.array_append("completed", F.col("name"))).otherwise(F.col("completed")).alias("completed"), ended.alias("reason"), F.when(F.col("name").isNotNull(), F.lit(k).cast("long")).otherwise(F.col("iterations")).alias("iterations")).select(*own))
    end = state.withColumn("reason", F.coalesce("reason", F.when(F.array_contains("active", F.col("goal")), "goal_reached").otherwise("max_iterations")))
    if history is None:
        text, states = (F.lit(None).cast(t) for t in ("string", "array<string>"))
        history = state.select("session_id", F.lit(0).cast("long").alias("iteration"), *[text.alias(c) for c in ("name", "cost", "result", "summary")], *[states.alias(c) for c in ("told", "added", "removed")]).limit(0)
    return history, end.select("session_id", "active", "completed", "reason", "iterations")


def completed_edges(history: DataFrame) -> DataFrame:
    """COMPLETED edges from each executed skill to the states that its executor told, for a graph's edges to be united with."""
    status = F.when(F.col("result") == "success", "active").otherwise(F.col("result"))
    return history.select("session_id", F.col("name").alias("source"), F.explode("told").alias("target"), F.lit("COMPLETED").alias("relation"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("shared_chunk_count"), status.alias("status"), F.col("summary").alias("result_summary"))


def loop_lines(history: DataFrame) -> DataFrame:
    """session_id, iteration and line: the steps of a run as text."""
    mark = F.when(F.col("result") == "success", "ok").when(F.col("result") == "partial", "partial").otherwise("failed")
    gained = F.transform("added", lambda x: F.concat(F.lit("+"), x))
    gone = F.transform("removed", lambda x: F.concat(F.lit("-"), x))
    return history.select("session_id", "iteration", F.concat_ws(" ", F.concat(F.lit("["), F.col("iteration").cast("string"), F.lit("]")), mark, "name", F.concat(F.lit("("), F.col("cost"), F.lit(")")), F.array_join(F.concat(gained, gone), " ")).alias("line"))
