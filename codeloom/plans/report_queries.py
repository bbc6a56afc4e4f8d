"""Reports, predictions, run names and messages, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import messages
from codeloom.plans.catalogue import query
from codeloom.sources import reports
from codeloom.sources.tables import table


@query("""WITH i AS (SELECT event_id, 'a__' || event_id % 900 AS id, event_id % 6 AS k FROM events)
SELECT DISTINCT id AS instance, CASE WHEN k IN (0, 2) THEN 'resolved' WHEN k IN (1, 3) THEN 'failed' WHEN k = 4 THEN 'errored' END AS status FROM i WHERE k < 5""")
def report_statuses(spark, d):
    """Each event as a report of one of six shapes, the last broken."""
    e = F.col("event_id")
    ident = F.concat(F.lit("a__"), (e % 900).cast("string"))
    shapes = ['{"run": [{"Resolved_IDs": ["%s"]}]}', '{"x": {"unresolved": {"%s": 1}}}', '[[{"instance_id": "%s", "resolved": true}]]', '{"%s": {"resolved": false}}', '{"deep": {"deeper": [{"instance_id": "%s", "status": "Error"}]}}', '{"resolved": ["%s"]']
    text = F.when(F.lit(False), "")
    for k, shape in enumerate(shapes):
        text = text.when(e % 6 == k, F.format_string(shape, ident))
    return reports.reported(table(spark, d, "events").select(text.alias("text")))


@query("""WITH p AS (SELECT event_id, 'i' || event_id % 700 AS instance, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'patch' || event_id END AS patch FROM events),
l AS (SELECT instance, arg_max(patch, event_id) AS patch FROM p GROUP BY instance), r AS (SELECT DISTINCT 'i' || event_id % 700 AS instance, event_id % 700 % 3 AS s FROM events WHERE event_id % 700 % 5 > 0)
SELECT l.instance, CASE WHEN patch = '' THEN 'EMPTY' ELSE 'HAS_PATCH' END AS patch_status, CASE WHEN patch = '' THEN 'EMPTY_PATCH' WHEN s = 0 THEN 'RESOLVED' WHEN s = 1 THEN 'FAILED' WHEN s = 2 THEN 'ERROR' ELSE 'UNKNOWN' END AS eval_status FROM l LEFT JOIN r USING (instance)""")
def evaluation_table(spark, d):
    e = F.col("event_id")
    ident = F.concat(F.lit("i"), (e % 700).cast("string"))
    listed = table(spark, d, "events").select(F.struct(ident.alias("instance_id"), F.when(e % 4 == 0, "").otherwise(F.concat(F.lit("patch"), e.cast("string"))).alias("model_patch")).alias("e"), "event_id")
    preds = listed.groupBy("e.instance_id").agg(F.max_by("e", "event_id").alias("e")).select(F.to_json(F.array("e")).alias("text"))
    told = table(spark, d, "events").where(e % 700 % 5 > 0).select(ident.alias("instance"), F.element_at(F.array(*map(F.lit, ("resolved", "failed", "errored"))), (e % 700 % 3 + 1).cast("int")).alias("status"))
    return reports.evaluated(reports.predictions(preds), told)


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'RESOLVED_MAYBE' WHEN 1 THEN 'FAILED_OR_ERROR' WHEN 2 THEN 'RAN' WHEN 3 THEN 'FAILED_OR_ERROR' END AS inferred, 'out_' || user_id || '_' || CASE WHEN event_id % 2 = 0 THEN '10_30' ELSE 'unknown' END AS run_id FROM events""")
def log_inference(spark, d):
    e = F.col("event_id")
    text = F.when(e % 5 == 0, "All Resolved").when(e % 5 == 1, "Traceback").when(e % 5 == 2, "unresolved: error").when(e % 5 == 3, "2 FAILED, unresolved")
    named = reports.run_id(F.concat(F.lit("/r/out_"), F.col("user_id").cast("string"), F.lit("/")), F.when(e % 2 == 0, "10:30"))
    return table(spark, d, "events").select("event_id", reports.inferred(text).alias("inferred"), named.alias("run_id"))


@query("""SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderkey::VARCHAR, '^(?:1|2.)') ORDER BY o_orderkey::VARCHAR LIMIT 40 OFFSET 10""")
def instance_slice(spark, d):
    keyed = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("key"))
    return reports.chosen(keyed, "key", "1|2.", "10:50").select("o_orderkey")


@query("""SELECT count(*) FILTER (done) AS done, count(*) FILTER (NOT done) AS "left", count(*) AS total FROM (SELECT user_id, bool_or(event_id % 50 = 0) AS done FROM events GROUP BY user_id)""")
def progress_counts(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").alias("instance"), "event_id")
    return reports.still_to_do(users, users.where("event_id % 50 = 0"))


SHAPES = [
    ('{"content": "plain %s"}', "plain %s", 0), ('{"content": [{"type": "text", "text": "listed %s"}, 5, {"type": "text", "text": ""}]}', "listed %s", 0), ('{"content": [{"type": "tool_use", "input": {"command": "ls %s"}}]}', "```\nls %s\n```", 0),
    ('{"content": [{"type": "tool_result", "content": "{\\"returncode\\": 0, \\"output\\": \\"o%s\\"}"}]}', "<returncode>\n0\n<output>\no%s", 0), ('{"tool_calls": [{"function": {"name": "bash", "arguments": "{\\"command\\": \\"c%s\\"}"}}, {"function": {"arguments": "raw"}}]}', "```\nc%s\n```\n\n```\nraw\n```", 2),
    ('{"output": [{"type": "message", "content": [{"text": "a%s"}, {"text": "b"}]}, {"type": "function_call", "arguments": "{}"}]}', "a%s\n\nb\n\n```\n{}\n```", 0), ('{"content": null, "extra": {"response": {"choices": [{"message": {"tool_calls": [1, 2, 3]}}]}}}', "", 3), ("not JSON %s", "", 0),
]
TEXTS_SQL = ", ".join("'" + t.replace("'", "''") + "'" for _, t, _ in SHAPES)


@query(f"SELECT event_id, replace(([{TEXTS_SQL}])[event_id % {len(SHAPES)} + 1], '%s', event_id::VARCHAR) AS text, ({[n for _, _, n in SHAPES]})[event_id % {len(SHAPES)} + 1] AS calls FROM events")
def message_texts(spark, d):
    """Each event as a message of one of the shapes."""
    e = F.col("event_id")
    shape = F.element_at(F.array(*(F.lit(s) for s, _, _ in SHAPES)), (e % len(SHAPES) + 1).cast("int"))
    message = F.replace(shape, F.lit("%s"), e.cast("string"))
    return table(spark, d, "events").select("event_id", messages.message_text(message).alias("text"), F.coalesce(messages.raw_calls(message), F.lit(0)).alias("calls"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'ls ' || event_id END AS action, event_id % 3 AS n, CASE event_id % 4 WHEN 1 THEN 'unknown tool x' WHEN 2 THEN 'arguments are not JSON no command' WHEN 3 THEN 'no command' END AS error FROM events""")
def action_parsing(spark, d):
    e = F.col("event_id")
    action, n = messages.one_action(F.repeat(F.concat(F.lit("say\n```bash\nls "), e.cast("string"), F.lit("\n```\n")), (e % 3).cast("int")))
    wrong = messages.call_error(F.when(e % 4 == 1, "x").otherwise("bash"), F.when(e % 4 == 2, "{").when(e % 4 == 3, "{}").otherwise('{"command": "ls"}'))
    return table(spark, d, "events").select("event_id", action.alias("action"), n.alias("n"), wrong.alias("error"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a=' || event_id % 3 || ',b=2,c=' || event_id ELSE 'a=0,b=2,c=' || event_id END AS merged FROM events""")
def settings_merge(spark, d):
    e = F.col("event_id")
    first = F.create_map(F.lit("a"), F.lit("0"), F.lit("b"), F.lit("1"))
    second = F.create_map(F.lit("a"), F.when(e % 2 == 0, (e % 3).cast("string")), F.lit("b"), F.lit("2"), F.lit("c"), e.cast("string"))
    entries = F.array_sort(F.map_entries(messages.merged(first, F.lit(None).cast("map<string,string>"), second)))
    return table(spark, d, "events").select("event_id", F.array_join(F.transform(entries, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("merged"))
