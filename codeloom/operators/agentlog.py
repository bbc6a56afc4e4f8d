"""Agent action logs: steps, guards, token use, statuses. Running state is window-shaped and keyed by instance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import commands


def message_steps(messages: DataFrame) -> DataFrame:
    """messages with `step`: a new step at each assistant message; what comes before the first is step 0. (instance, ord, role)."""
    so_far = Window.partitionBy("instance").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("step", F.sum((F.col("role") == "assistant").cast("int")).over(so_far))


def guard_replay(actions: DataFrame, interval: int = 10, grace: int = 5) -> DataFrame:
    """actions with step, notice, tool_step, blocked. actions: (instance, ord, kind, located).

    kind: edit, test, diff, submit, small_read, broad or inspect. located marks the action that shows the error's place.
    Blocks: after step 45 all but edit, test, diff and submit; after 40 small reads are allowed too; after 30 no broad search;
    and at most `grace` inspections once the place is known.
    """
    by = Window.partitionBy("instance").orderBy("ord")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    step, final = F.row_number().over(by), F.col("kind").isin("edit", "test", "diff", "submit")
    known = F.coalesce(F.max(F.col("located").cast("int")).over(before), F.lit(0)) == 1
    stepped = actions.withColumns({"step": step, "known": known, "tool_step": F.row_number().over(Window.partitionBy("instance", "kind").orderBy("ord")) - 1})
    late = (F.col("step") >= 45) & ~final | (F.col("step") >= 40) & ~final & (F.col("kind") != "small_read") | (F.col("step") >= 30) & (F.col("kind") == "broad")
    looks = F.col("known") & ~final & ~F.col("late")
    seen = stepped.withColumn("late", late).withColumn("looks", looks.cast("int")).withColumn("looked", F.coalesce(F.sum("looks").over(before), F.lit(0)))
    notice = F.col("step").isin(30, 40, 57) | ((F.col("step") >= 45) & ((F.col("step") - 45) % interval == 0))
    return seen.select("instance", "ord", "step", notice.alias("notice"), "tool_step", (F.col("late") | ((F.col("looks") == 1) & (F.col("looked") >= grace))).alias("blocked"))


def usage_totals(calls: DataFrame, *keys: str) -> DataFrame:
    """prompt, completion, total and calls without usage; a total of 0 or less counts as prompt + completion."""
    total = F.when(F.coalesce("total", F.lit(0)) <= 0, F.coalesce("prompt", F.lit(0)) + F.coalesce("completion", F.lit(0))).otherwise(F.col("total"))
    added = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return calls.groupBy(*keys).agg(added("prompt").alias("prompt"), added("completion").alias("completion"), added(total).alias("total"), F.count_if(F.col("prompt").isNull()).alias("missing"), F.count("*").alias("calls"))


def eval_status(empty: Column, resolved: Column, failed: Column, errored: Column, inferred: Column) -> Column:
    """By precedence."""
    return F.when(empty, "EMPTY_PATCH").when(resolved, "RESOLVED").when(failed, "FAILED").when(errored, "ERROR").otherwise(F.coalesce(inferred, F.lit("UNKNOWN")))


def status_summary(runs: DataFrame) -> DataFrame:
    """status, n, share, avg_calls. runs: (status, calls)."""
    every = F.sum("n").over(Window.partitionBy())
    return runs.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("calls"), 6).alias("avg_calls")).withColumn("share", F.round(F.col("n") / F.greatest(every, F.lit(1)), 6))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: the last row of each key."""
    value = F.max_by(F.struct(*(F.col(c) for c in rows.columns if c != key)), order).alias("v")
    return rows.groupBy(key).agg(value).select(key, "v.*")


def unanswered(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """calls that no answer names, each with a synthetic answer. calls: (instance, call_id); answers: (instance, call_id)."""
    return calls.join(answers, ["instance", "call_id"], "left_anti").withColumn("content", F.lit("[no output was recorded]"))


def located(actions: DataFrame) -> DataFrame:
    """actions with located (the action shows the error's place) and since (the step of the first that does). (instance, ord, step, command, output)."""
    marked = actions.withColumn("located", commands.shows_error_place(F.col("command"), F.col("output")))
    return marked.withColumn("since", F.min(F.when(F.col("located"), F.col("step"))).over(Window.partitionBy("instance")))


def one_tool_call(messages: DataFrame) -> DataFrame:
    """messages with raw (most calls that a shape of the message holds), refused, and answers: how many refusals go back.

    (calls, response_calls, actions): sizes of the message's calls, of its response's, and of the parsed actions; null counts as none.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    raw = F.greatest(n("calls"), n("response_calls"))
    refused = (raw > 1) | (n("actions") > 1)
    return messages.withColumns({"raw": raw, "refused": refused, "answers": F.when(refused, F.greatest(F.lit(1), n("actions"))).otherwise(0)})


def action_outcomes(actions: DataFrame) -> DataFrame:
    """actions with block, warnings, edits and diff_empty. (instance, ord, command, output, returncode).

    block: the first rule that keeps the command from running (submit_form, submit_no_diff, submit_empty_diff, sed_in_place, lost_status), else null.
    warnings: of a command that runs: wrong_root, quiet_failure, destructive_diff. edits: successful source edits so far.
    diff_empty: whether the last seen diff was empty; null before any.
    """
    by = Window.partitionBy("instance").orderBy("ord")
    command, output = F.trim(F.coalesce("command", F.lit(""))), F.coalesce("output", F.lit(""))
    asked = actions.withColumn("_c", command)
    c = F.col("_c")
    blocked = F.when(commands.edits_in_place(c), "sed_in_place").when(commands.loses_status(c), "lost_status")
    submits, seen = F.contains(c, F.lit(commands.SUBMIT_MARK)), commands.shows_diff(c)
    asked = asked.withColumns({"_blocked": blocked, "_submits": submits, "_diff": seen & blocked.isNull() & ~submits})
    empty = F.when(F.col("_diff"), F.trim(output) == "")
    before = F.last(empty, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    refused = F.when(F.col("_submits"), F.when(c != commands.SUBMIT_COMMAND, "submit_form").when(F.col("_before").isNull(), "submit_no_diff").when(F.col("_before"), "submit_empty_diff"))
    judged = asked.withColumn("_before", before).withColumn("block", F.coalesce(refused, F.col("_blocked")))
    runs = F.col("block").isNull()
    kept = F.array_compact(F.array(
        F.when(commands.wrong_root(c), "wrong_root"), F.when(commands.failed_quietly(c, output, F.col("returncode")), "quiet_failure"), F.when(F.col("_diff") & commands.destructive(output), "destructive_diff")
    ))
    edited = (runs & commands.edits(c) & (F.coalesce("returncode", F.lit(0)) == 0)).cast("int")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    told = judged.withColumns({"warnings": F.when(runs, kept).otherwise(F.array().cast("array<string>")), "edits": F.sum(edited).over(so_far), "diff_empty": F.last(empty, ignorenulls=True).over(so_far)})
    return told.drop("_c", "_blocked", "_submits", "_diff", "_before")


def within_limits(calls: DataFrame, step_limit: int = 0, cost_limit: float = 0.0) -> DataFrame:
    """calls with steps and spent before each, and limited: whether a limit above 0 is reached and the call isn't made. (instance, ord, cost)."""
    before = Window.partitionBy("instance").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    counted = calls.withColumns({"steps": F.count("*").over(before), "spent": F.coalesce(F.sum("cost").over(before), F.lit(0.0))})
    return counted.withColumn("limited", (F.lit(step_limit > 0) & (F.col("steps") >= step_limit)) | (F.lit(cost_limit > 0) & (F.col("spent") >= cost_limit)))


def global_totals(calls: DataFrame, call_limit: int = 0, cost_limit: float = 0.0) -> DataFrame:
    """cost, calls, exceeded over all instances. (cost)."""
    made = calls.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.count("*").alias("calls"))
    return made.withColumn("exceeded", (F.lit(call_limit > 0) & (F.col("calls") > call_limit)) | (F.lit(cost_limit > 0) & (F.col("cost") > cost_limit)))


def tool_counts(actions: DataFrame) -> DataFrame:
    """instance, tool, calls, failures: a failed call counts too. (instance, tool, returncode); tool is null for shell commands."""
    return actions.where("tool IS NOT NULL").groupBy("instance", "tool").agg(F.count("*").alias("calls"), F.count_if(F.col("returncode") != 0).alias("failures"))


def deepen_totals(results: DataFrame) -> DataFrame:
    """What an instance's deepenings did. (instance, file, neighbours, new_ids, updated_ids, new_edges, call_edges, methods, index_ok); a failed call has null new_ids."""
    ids = lambda *c: F.array_union(*(F.coalesce(x, F.array().cast("array<string>")) for x in c)) if len(c) == 2 else F.array_distinct(F.coalesce(c[0], F.array().cast("array<string>")))
    done = F.col("new_ids").isNotNull()
    each = results.withColumns({"_new": ids(F.col("new_ids")), "_updated": ids(F.col("updated_ids")), "_touched": ids(F.col("new_ids"), F.col("updated_ids")), "_files": ids(F.array("file"), F.col("neighbours"))})
    added = lambda c: F.coalesce(F.sum(F.when(done, c)), F.lit(0)).cast("bigint")
    totals = each.groupBy("instance").agg(
        F.count("*").alias("deepen_file_calls"), F.count_if(done).alias("successful_deepen_calls"), *(added(F.size(f"_{n}")).alias(f"total_{n}_nodes") for n in ("new", "updated", "touched")),
        added(F.col("new_edges")).alias("total_new_edges"), added(F.col("call_edges")).alias("total_call_edges"), added(F.col("methods")).alias("total_methods_added"), F.count_if(done & ~F.col("index_ok")).alias("index_update_failures"),
    )
    spread = each.where(done).select("instance", F.explode(F.array(*(F.struct(F.lit(n).alias("what"), F.col(f"_{n}").alias("ids")) for n in ("new", "updated", "touched", "files")))).alias("e"))
    unique = spread.select("instance", "e.what", F.explode("e.ids").alias("id")).distinct().groupBy("instance").agg(*(F.count_if(F.col("what") == n).alias(f"unique_{n}") for n in ("new", "updated", "touched", "files")))
    return totals.join(unique, "instance", "left").fillna(0)


def annotation_totals(results: DataFrame) -> DataFrame:
    """total, ok, failed, skipped, success_rate of (status)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.agg(F.count("*").alias("total"), n("ok"), n("failed"), n("skipped")).withColumn("success_rate", F.round(F.col("ok") / F.greatest("total", F.lit(1)), 6))


def exit_status(failed_stage: Column, raised: Column, agent_status: Column, submission: Column, diff: Column) -> Column:
    """Why an instance ended: the stage of preparation that failed, what the agent raised, or its status; an empty submission falls back on the diff."""
    stages = {"repo": "RepoPrepFailed", "prebuild": "PrebuildFailed", "env": "EnvPrepFailed", "agent": "AgentInitFailed"}
    found = F.when(failed_stage.isin(*stages), F.element_at(F.create_map(*(F.lit(x) for kv in stages.items() for x in kv)), failed_stage)).when(raised.isNotNull(), raised)
    nothing = (F.trim(F.coalesce(submission, F.lit(""))) == "") & (F.trim(F.coalesce(diff, F.lit(""))) == "")
    return found.when((agent_status == "Submitted") & nothing, "EmptyPatch").otherwise(agent_status)
