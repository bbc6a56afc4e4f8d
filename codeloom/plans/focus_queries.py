"""What rules find in texts, the bundles of queries that come of it, and the rules about an agent's commands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.functions import commands, focus
from codeloom.operators import agentlog
from codeloom.plans.catalogue import query
from codeloom.sources.tables import table

STOP_SQL = ", ".join(f"'{w}'" for w in (
    "the a an and or to of in on for with is are was were be been being this that these those it its as by from at not "
    "should would could can cannot when while if then than into using use used"
).split())


@query(rf"""WITH words AS (SELECT doc_id, unnest(l) AS v, generate_subscripts(l, 1) AS pos FROM
  (SELECT doc_id, list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[_a-zA-Z][a-zA-Z0-9_]*')) AS l FROM documents)),
parts AS (SELECT doc_id, unnest(p[1:len(p) - 1]) AS part, generate_subscripts(p[1:len(p) - 1], 1) AS pos FROM (SELECT doc_id, string_split(text, '(') AS p FROM documents)),
calls AS (SELECT doc_id, v, pos FROM (SELECT doc_id, regexp_extract(part, '([\p{{L}}\p{{N}}_]+)\s*$', 1) AS v, pos FROM parts) WHERE regexp_full_match(v, '[_a-zA-Z][a-zA-Z0-9_]*')),
spans AS (SELECT doc_id, unnest(l) AS v, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '`([^`]+)`', 1) AS l FROM documents)),
files AS (SELECT doc_id, unnest(l) AS v, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_./\\-]+\.py') AS l FROM documents)),
camel AS (SELECT * FROM words WHERE regexp_matches(v, '[A-Z]') AND len(v) >= 3),
functions AS (SELECT * FROM calls WHERE NOT regexp_matches(v, '^[A-Z]')),
exact AS (SELECT doc_id, v, 0 AS k, pos FROM spans UNION ALL SELECT doc_id, v, 1, pos FROM calls UNION ALL SELECT doc_id, v, 2, pos FROM words WHERE contains(v, '_') UNION ALL SELECT doc_id, v, 3, pos FROM camel),
toks AS (SELECT doc_id, unnest(l) AS v, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+|[一-鿿]+') AS l FROM documents)),
firsts AS (SELECT doc_id, v, min(pos) AS pos FROM toks WHERE len(v) >= 2 AND v NOT IN ({STOP_SQL}, 'none', 'null', 'unknown') GROUP BY doc_id, v),
raw AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos FROM firsts),
every AS (SELECT doc_id, 'exact_symbols' AS field, v, k, pos FROM exact UNION ALL SELECT doc_id, 'file_hints', v, 0, pos FROM files UNION ALL SELECT doc_id, 'class_hints', v, 0, pos FROM camel WHERE regexp_matches(v, '^[A-Z]')
  UNION ALL SELECT doc_id, 'function_hints', v, 0, pos FROM functions
  UNION ALL SELECT doc_id, 'method_hints', v, k, pos FROM exact WHERE v IN ('__init__', '__str__', '__repr__', 'deconstruct', 'formfield', 'clean', 'save')
  UNION ALL SELECT doc_id, 'parameter_hints', v, 0, pos FROM words w WHERE contains(v, '_') AND NOT EXISTS (SELECT 1 FROM functions f WHERE f.doc_id = w.doc_id AND f.v = w.v)
  UNION ALL SELECT doc_id, 'error_terms', v, 0, pos FROM words WHERE regexp_full_match(v, '[A-Z][A-Za-z0-9_]*(Error|Exception|Warning)')
  UNION ALL SELECT doc_id, 'behavior_terms', v, 0, pos FROM raw WHERE pos <= 8 UNION ALL SELECT doc_id, 'raw_keywords', v, 0, pos FROM raw WHERE pos <= 30),
clean AS (SELECT doc_id, field, trim(v) AS v, k, pos FROM every WHERE trim(v) <> '' AND lower(trim(v)) NOT IN ('none', 'null', 'n/a', 'unknown')),
once AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY doc_id, field, lower(v) ORDER BY k, pos) = 1)
SELECT doc_id, field, string_agg(v, '|' ORDER BY k, pos) AS items FROM once GROUP BY doc_id, field""")  # fmt: skip
def focus_rules(spark, d):
    found = focus.with_focus(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "focus")
    fields = [n for n in focus.FIELDS if n != "bm25_queries"]
    listed = found.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.array_join(F.col("focus")[n], "|").alias("items")) for n in fields))).alias("e"))
    return listed.select("doc_id", "e.*").where("items <> ''")


@query()
def focus_bundle(spark, d):
    """Conversations as instances: the first message is the issue, the last the current query."""
    turns = table(spark, d, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("instance"), F.col("turn").alias("ord"), F.when(F.col("turn") == 0, "initial_issue").otherwise("query").alias("source"), "text")
    cache = focus.focus_cache(focus.with_focus(turns, "text"))
    return focus.query_bundle(cache.withColumn("current", F.substring(F.col("query.source_text"), 1, 80)).withColumn("step", F.lit(2)))


#: Commands, outputs and what the rules say of them, by hand: the SQL looks the answers up.
CASES = [
    # command, output, returncode: shows diff, in place, loses status, wrong root, error place
    ("git diff", "--- a\n+++ b\n+x", 0, "10000"), ("git diff HEAD", "x", 0, "00000"), ("git diff --stat", "x", 0, "00000"), ("git diff | head", "x", 0, "00000"), ("git diff > f", "", 0, "00000"),
    ("cd /r && git diff", "", 0, "10000"), ("cd /r && git diff && ls", "", 0, "00000"), ("git diff a.py", "", 0, "10000"), ("bash -lc 'cd /r && git diff'", "+y", 0, "10000"), ("git diff abcdef1", "", 0, "00000"),
    ("git diff A..B", "", 0, "00000"), ("python -c 'git diff'", "", 0, "00000"), ("git show", "", 0, "00000"), ("sed -i 's/a/b/' f", "", 0, "01000"), ("sed -n 1p f", "", 0, "00000"), ("ls; sudo sed --in-place=b f", "", 0, "01000"),
    ("echo sed -i", "", 0, "00000"), ("pytest a | tail -5", "1 FAILED", 0, "00100"), ("set -o pipefail && pytest a | tail", "", 0, "00000"), ("grep x a | head", "", 0, "00000"), ("cat /workspace/django/a.py", "", 0, "00010"),
    ("ls /workspace", "", 0, "00000"), ("cd /workspace && pytest", "", 0, "00010"), ("cd /workspace && ls", "", 0, "00000"), ("grep E tests/a.py", "models.E028", 0, "00000"), ("grep E django/a.py", "models.E028", 0, "00001"),
    ("grep E a", "src/a.py:12: FAILED", 0, "00001"), ("pytest", "[policy error] src/a.py:12: FAILED", 1, "00000"), ("echo COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT", "", 0, "00000"), ("printf COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT", "", 0, "00000"),
    ("git apply p", "", 0, "00000"), ("git apply p", "", 1, "00000"), ("", None, None, "00000"),
]
N = len(CASES)


def sql_text(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def sql_list(k: int) -> str:
    return "[" + ", ".join(str(c[k]) if isinstance(c[k], int) else sql_text(c[k]) for c in CASES) + "]"


def cases(spark, d):
    """Events as actions of users: the case of each is its number modulo N."""
    at = (F.col("event_id") % N + 1).cast("int")
    of = lambda k, kind: F.element_at(F.array(*(F.lit(c[k]).cast(kind) for c in CASES)), at)
    return table(spark, d, "events").select("event_id", (F.col("user_id") % 40).alias("instance"), F.col("event_id").alias("ord"), of(0, "string").alias("command"), of(1, "string").alias("output"), of(2, "int").alias("returncode"))


@query(f"SELECT event_id, substr(f, 1, 1) = '1' AS shows_diff, substr(f, 2, 1) = '1' AS in_place, substr(f, 3, 1) = '1' AS loses_status, substr(f, 4, 1) = '1' AS wrong_root, substr(f, 5, 1) = '1' AS error_place FROM (SELECT event_id, ({sql_list(3)})[event_id % {N} + 1] AS f FROM events)")
def command_rules(spark, d):
    c = F.col("command")
    rules = {"shows_diff": commands.shows_diff(c), "in_place": commands.edits_in_place(c), "loses_status": commands.loses_status(c), "wrong_root": commands.wrong_root(c), "error_place": commands.shows_error_place(c, F.col("output"))}
    return cases(spark, d).select("event_id", *(r.alias(n) for n, r in rules.items()))


@query(f"""WITH a AS (SELECT event_id, user_id % 40 AS instance, ({sql_list(0)})[event_id % {N} + 1] AS command, ({sql_list(1)})[event_id % {N} + 1] AS output, ({sql_list(2)})[event_id % {N} + 1] AS rc, ({sql_list(3)})[event_id % {N} + 1] AS f FROM events),
b AS (SELECT *, contains(command, 'COMPLETE_TASK') AS submits, CASE WHEN f[1] = '1' THEN output = '' END AS seen FROM a),
c AS (SELECT *, last_value(seen IGNORE NULLS) OVER (PARTITION BY instance ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
e AS (SELECT *, CASE WHEN submits AND command LIKE 'printf%' THEN 'submit_form' WHEN submits AND before IS NULL THEN 'submit_no_diff' WHEN submits AND before THEN 'submit_empty_diff' WHEN f[2] = '1' THEN 'sed_in_place' WHEN f[3] = '1' THEN 'lost_status' END AS block FROM c)
SELECT event_id, block, CASE WHEN block IS NULL AND f[4] = '1' THEN 'wrong_root' ELSE '' END AS warnings, sum(CASE WHEN command = 'git apply p' AND rc = 0 THEN 1 ELSE 0 END) OVER w AS edits,
  last_value(seen IGNORE NULLS) OVER w AS diff_empty FROM e WINDOW w AS (PARTITION BY instance ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")  # fmt: skip
def action_pipeline(spark, d):
    return agentlog.action_outcomes(cases(spark, d)).select("event_id", "block", F.array_join("warnings", ",").alias("warnings"), "edits", "diff_empty")


@query(f"""WITH a AS (SELECT event_id, user_id % 40 AS instance, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS step, ({sql_list(3)})[event_id % {N} + 1][5] = '1' AS located FROM events)
SELECT event_id, located, min(CASE WHEN located THEN step END) OVER (PARTITION BY instance) AS since FROM a""")  # fmt: skip
def error_place_latch(spark, d):
    step = F.row_number().over(Window.partitionBy("instance").orderBy("ord"))
    return agentlog.located(cases(spark, d).withColumn("step", step)).select("event_id", "located", "since")


@query("SELECT event_id, greatest(event_id % 3, event_id % 2) AS raw, greatest(event_id % 3, event_id % 2) > 1 OR event_id % 4 > 1 AS refused, CASE WHEN greatest(event_id % 3, event_id % 2) > 1 OR event_id % 4 > 1 THEN greatest(1, event_id % 4) ELSE 0 END AS answers FROM events")
def one_tool_call(spark, d):
    e = F.col("event_id")
    return agentlog.one_tool_call(table(spark, d, "events").select("event_id", (e % 3).alias("calls"), (e % 2).alias("response_calls"), (e % 4).alias("actions"))).select("event_id", "raw", "refused", "answers")


@query("""SELECT event_id, row_number() OVER w - 1 AS steps, coalesce(sum(event_id % 5) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS spent,
  row_number() OVER w - 1 >= 20 OR coalesce(sum(event_id % 5) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 30 AS limited FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def step_and_cost_limits(spark, d):
    calls = table(spark, d, "events").select("event_id", F.col("user_id").alias("instance"), F.col("event_id").alias("ord"), (F.col("event_id") % 5).cast("double").alias("cost"))
    return agentlog.within_limits(calls, 20, 30.0).select("event_id", "steps", "spent", "limited")


@query("""SELECT sum(event_id % 5)::DOUBLE AS cost, count(*) AS calls, sum(event_id % 5) > 1000 AS exceeded FROM events""")
def cost_totals(spark, d):
    return agentlog.global_totals(table(spark, d, "events").select((F.col("event_id") % 5).cast("double").alias("cost")), cost_limit=1000.0)


@query("""SELECT user_id AS instance, (['bm25', 'hybrid', 'deepen'])[event_id % 3 + 1] AS tool, count(*) AS calls, count(*) FILTER (event_id % 7 = 0) AS failures FROM events WHERE event_id % 4 > 0 GROUP BY user_id, event_id % 3""")
def tool_call_counts(spark, d):
    e = F.col("event_id")
    tool = F.when(e % 4 > 0, F.element_at(F.array(*map(F.lit, ("bm25", "hybrid", "deepen"))), (e % 3 + 1).cast("int")))
    return agentlog.tool_counts(table(spark, d, "events").select(F.col("user_id").alias("instance"), tool.alias("tool"), (e % 7 == 0).cast("int").alias("returncode")))


@query("""WITH e AS (SELECT user_id % 50 AS instance, 'f' || event_id % 9 AS file, ['f' || event_id % 4] AS nb, list_distinct([event_id % 30, event_id % 31, event_id % 30]) AS n, [event_id % 30, event_id % 7] AS u, event_id FROM events WHERE event_id % 6 > 0),
x AS (SELECT *, list_distinct(u) AS ud, list_distinct(list_concat(n, u)) AS t FROM e),
s AS (SELECT instance, count(*) AS ok, sum(len(n)) AS total_new_nodes, sum(len(ud)) AS total_updated_nodes, sum(len(t)) AS total_touched_nodes, sum(event_id % 3) AS total_new_edges, sum(event_id % 2) AS total_call_edges, sum(event_id % 5) AS total_methods_added,
  count(*) FILTER (event_id % 10 = 0) AS index_update_failures FROM x GROUP BY instance),
u1 AS (SELECT instance, count(DISTINCT i) AS unique_new FROM (SELECT instance, unnest(n) AS i FROM x) GROUP BY instance), u2 AS (SELECT instance, count(DISTINCT i) AS unique_updated FROM (SELECT instance, unnest(ud) AS i FROM x) GROUP BY instance),
u3 AS (SELECT instance, count(DISTINCT i) AS unique_touched FROM (SELECT instance, unnest(t) AS i FROM x) GROUP BY instance), u4 AS (SELECT instance, count(DISTINCT i) AS unique_files FROM (SELECT instance, unnest(list_concat([file], nb)) AS i FROM x) GROUP BY instance),
c AS (SELECT user_id % 50 AS instance, count(*) AS deepen_file_calls FROM events GROUP BY 1)
SELECT instance, deepen_file_calls, coalesce(ok, 0) AS successful_deepen_calls, total_new_nodes, total_updated_nodes, total_touched_nodes, total_new_edges, total_call_edges, total_methods_added, index_update_failures, unique_new, unique_updated, unique_touched, unique_files
FROM c LEFT JOIN s USING (instance) LEFT JOIN u1 USING (instance) LEFT JOIN u2 USING (instance) LEFT JOIN u3 USING (instance) LEFT JOIN u4 USING (instance)""")  # fmt: skip
def deepen_stats(spark, d):
    e, text = F.col("event_id"), lambda c: c.cast("string")
    rows = table(spark, d, "events").select(
        (F.col("user_id") % 50).alias("instance"), F.concat(F.lit("f"), text(e % 9)).alias("file"), F.array(F.concat(F.lit("f"), text(e % 4))).alias("neighbours"), F.when(e % 6 > 0, F.array(text(e % 30), text(e % 31), text(e % 30))).alias("new_ids"),
        F.array(text(e % 30), text(e % 7)).alias("updated_ids"), (e % 3).alias("new_edges"), (e % 2).alias("call_edges"), (e % 5).alias("methods"), (e % 10 != 0).alias("index_ok"),
    )
    return agentlog.deepen_totals(rows)


@query("SELECT count(*) AS total, count(*) FILTER (event_id % 4 < 2) AS ok, count(*) FILTER (event_id % 4 = 2) AS failed, count(*) FILTER (event_id % 4 = 3) AS skipped, round(count(*) FILTER (event_id % 4 < 2) / count(*), 6) AS success_rate FROM events")
def annotation_stats(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("ok", "ok", "failed", "skipped"))), (F.col("event_id") % 4 + 1).cast("int"))
    return agentlog.annotation_totals(table(spark, d, "events").select(status.alias("status")))


@query("""SELECT event_id, CASE WHEN event_id % 11 < 4 THEN (['RepoPrepFailed', 'PrebuildFailed', 'EnvPrepFailed', 'AgentInitFailed'])[event_id % 11 + 1] WHEN event_id % 7 = 0 THEN 'ValueError'
  WHEN event_id % 2 = 0 AND event_id % 3 > 0 AND event_id % 5 > 0 THEN 'EmptyPatch' WHEN event_id % 2 = 0 THEN 'Submitted' ELSE 'LimitsExceeded' END AS status FROM events""")
def exit_statuses(spark, d):
    e = F.col("event_id")
    stage = F.get(F.array(*map(F.lit, ("repo", "prebuild", "env", "agent"))), (e % 11).cast("int"))
    status = agentlog.exit_status(stage, F.when(e % 7 == 0, "ValueError"), F.when(e % 2 == 0, "Submitted").otherwise("LimitsExceeded"), F.when(e % 3 == 0, "patch").otherwise(" "), F.when(e % 5 == 0, "diff"))
    return table(spark, d, "events").select("event_id", status.alias("status"))
