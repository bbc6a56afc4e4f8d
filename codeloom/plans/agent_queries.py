"""More of the catalogue: structural search on a tree of definitions, commands and diffs of agents, choice of queries and seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import commands
from codeloom.operators import latent, ranking, structure
from codeloom.plans.catalogue import BM25_SQL, QUERY, query
from codeloom.sources.tables import table

# Commands and what each is, by hand: the SQL looks the answer up.
COMMANDS = [
    ("grep -rn 'x' .", "broad"), ("grep -n foo a/b.py", "inspect"), ("cat src/a.py", "broad"), ("nl -ba src/a.py", "broad"),
    ("nl -ba src/a.py | sed -n '10,150p'", "small_read"), ("nl -ba src/a.py | sed -n '10,151p'", "inspect"), ("pytest tests/test_a.py", "test"), ("python -m pytest", "other"),
    ("python3 manage.py test app", "test"), ("git diff", "diff"), ("git apply fix.patch", "edit"), ("python <<'PY'\nPath('a').write_text('b')\nPY", "edit"),
    ("python <<'PY'\nprint(1)\nPY", "test"), ("echo COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT", "submit"), (" submit ", "submit"), ("ls", "other"), ("", "other"),
]
KINDS_SQL = ", ".join(f"'{k}'" for _, k in COMMANDS)


@query(f"SELECT event_id, ([{KINDS_SQL}])[event_id % {len(COMMANDS)} + 1] AS kind FROM events")
def command_kinds(spark, d):
    command = F.element_at(F.array(*(F.lit(c) for c, _ in COMMANDS)), (F.col("event_id") % len(COMMANDS) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", commands.kind(command).alias("kind"))


@query("""SELECT event_id, event_id % 3 > 0 AND event_id % 2 = 0 AND event_id % 5 = 0 AS failed,
  (user_id % 150 >= 80 AND event_id % 30 <= 5) OR (user_id % 150 >= 120 AND user_id % 150 >= 10 * greatest(event_id % 30, 1)) AS destructive FROM events""")
def command_outcomes(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    command = F.when(e % 3 == 0, "ls").when(e % 3 == 1, "pytest tests/a.py").otherwise("pip install x")
    output = F.when(e % 2 == 0, "1 FAILED").otherwise("1 passed")
    diff = F.concat(F.lit("--- a/x\n+++ b/x\n"), F.repeat(F.lit("-x\n"), (u % 150).cast("int")), F.repeat(F.lit("+y\n"), (e % 30).cast("int")))
    return table(spark, d, "events").select("event_id", commands.failed_quietly(command, output, (e % 5).cast("int")).alias("failed"), commands.destructive(diff).alias("destructive"))


GROUPS = ("initial_exact_symbols", "initial_behavior", "current_query", "query_error", "query_bm25_queries", "initial_method_class", "query_behavior", "initial_error")
CODE_SQL = r"""(contains(query, '/') OR contains(query, chr(92)) OR contains(query, '.py') OR regexp_matches(query, '\b_+[A-Za-z0-9_]+|[a-z]+_[a-zA-Z0-9_]+\b')
  OR regexp_matches(query, '\b[A-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\b') OR regexp_matches(query, '\b[a-zA-Z_][a-zA-Z0-9_]*(\.[a-zA-Z_][a-zA-Z0-9_]*)+\b'))"""


@query(rf"""WITH q AS (SELECT item_id % 2 AS instance, item_id AS ord, ([{", ".join(map(repr, GROUPS))}])[item_id // 2 % 8 + 1] AS grp,
  trim(array_to_string(string_split(text, ' ')[1:3 + item_id % 12], ' ')) || CASE WHEN item_id % 5 = 0 THEN ' a_b' ELSE '' END AS query FROM benchmark),
u AS (SELECT * FROM q WHERE query <> '' QUALIFY row_number() OVER (PARTITION BY instance, lower(query) ORDER BY ord) = 1),
s AS (SELECT *, round(1.0::DOUBLE + CASE WHEN grp = 'current_query' THEN 0.4 WHEN grp LIKE 'query\_%' ESCAPE '\' THEN 0.25 ELSE 0 END
  + CASE WHEN contains(grp, 'exact_symbols') THEN 0.35 ELSE 0 END + CASE WHEN contains(grp, 'method_class') THEN 0.25 ELSE 0 END + CASE WHEN contains(grp, 'error') THEN 0.15 ELSE 0 END
  - CASE WHEN contains(grp, 'behavior') THEN 0.2 ELSE 0 END - CASE WHEN contains(grp, 'bm25_queries') THEN 0.1 ELSE 0 END
  + CASE WHEN {CODE_SQL} THEN 0.3 ELSE 0 END - CASE WHEN len(regexp_split_to_array(query, '\s+')) > 12 THEN 0.15 ELSE 0 END, 6) AS score, starts_with(grp, 'initial_') AS early FROM u),
r AS (SELECT *, early AND row_number() OVER (PARTITION BY instance, early ORDER BY score DESC, ord) <= 2 AS sure FROM s),
c AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY instance ORDER BY sure DESC, score DESC, ord) <= 12)
SELECT instance, row_number() OVER (PARTITION BY instance ORDER BY score DESC, ord) AS place, query, score FROM c""")
def query_priority_select(spark, d):
    item = F.col("item_id")
    words = F.array_join(F.slice(F.split("text", " "), F.lit(1), (item % 12 + 3).cast("int")), " ")
    group = F.element_at(F.array(*map(F.lit, GROUPS)), (F.floor(item / 2) % 8 + 1).cast("int"))
    items = table(spark, d, "benchmark").select((item % 2).alias("instance"), item.alias("ord"), group.alias("group"), F.concat(F.trim(words), F.when(item % 5 == 0, " a_b").otherwise("")).alias("query"), F.lit(1.0).alias("weight"))
    return ranking.priority_queries(items)


@query(BM25_SQL + """, l AS (SELECT node, round(sum(w), 6) AS raw FROM w WHERE term IN ('the', 'der', 'schen', 'that_the', 'that', 'erverge', '12') GROUP BY node ORDER BY raw DESC, node LIMIT 20),
lexical AS (SELECT node, round(raw / (SELECT max(raw) FROM l), 6) AS b, row_number() OVER (ORDER BY raw DESC, node) - 1 AS b_rank FROM l),
sem AS (SELECT vec_id AS node, round(greatest(0, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))), 6) AS e FROM embeddings WHERE vec_id <> 0 ORDER BY e DESC, node LIMIT 20),
semantic AS (SELECT *, row_number() OVER (ORDER BY e DESC, node) - 1 AS e_rank FROM sem)
SELECT node, score FROM (SELECT node, e, b, round(coalesce(0.55::DOUBLE * e + 0.02::DOUBLE / (e_rank + 1), 0) + coalesce(0.2::DOUBLE * b + 0.02::DOUBLE / (b_rank + 1), 0)
  + CASE WHEN e IS NOT NULL AND b IS NOT NULL THEN 0.05 ELSE 0 END + ([0.04, 0.03, 0.01, 0.04])[node % 4 + 1]::DOUBLE, 8) AS score FROM semantic FULL JOIN lexical USING (node))
ORDER BY score DESC, CASE WHEN e IS NULL THEN b ELSE 0 END DESC, coalesce(e, 0) DESC, node LIMIT 3""")  # fmt: skip
def seed_selection(spark, d):
    from pyspark.sql import Window

    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))
    near = ranking.cosine_search(vectors, vectors.where("node = 0").withColumnRenamed("node", "query_id"), 20)
    lexical = ranking.bm25_search(table(spark, d, "documents"), QUERY, 20)
    ranked = lambda df, by: df.select("node", "score", (F.row_number().over(Window.orderBy(F.desc(by), "node")) - 1).alias("rank"))
    kinds = F.element_at(F.array(*map(F.lit, ("METHOD", "CLASS", "MODULE", "FUNCTION"))), (F.col("node") % 4 + 1).cast("int"))
    ids = vectors.select("node").unionByName(table(spark, d, "documents").select(F.col("doc_id").alias("node"))).distinct()
    return ranking.seeds(ranked(near, "score"), ranked(lexical, "raw"), ids.withColumn("type", kinds))


def definitions(spark, d):
    """nodes and edges: nations are classes, customers their methods, suppliers functions, two files in each region's package."""
    nation, customer, supplier = (table(spark, d, t) for t in ("nation", "customer", "supplier"))
    file = F.concat(F.lit("r"), F.col("n_regionkey"), F.lit("/f"), F.col("n_nationkey") % 2, F.lit(".py"))
    at = nation.select(F.col("n_nationkey").alias("key"), file.alias("file"))
    modules = at.select("file").distinct().select(F.concat("file", F.lit("::M")).alias("id"), F.lit("MODULE").alias("type"), F.col("file").alias("name"), "file", F.lit(-1).cast("bigint").alias("ord"))
    classes = at.select(F.concat(F.lit("n"), "key").alias("id"), F.lit("CLASS").alias("type"), F.concat(F.lit("N"), "key").alias("name"), "file", F.col("key").cast("bigint").alias("ord"))
    methods = customer.join(at, F.col("c_nationkey") == F.col("key")).select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("METHOD").alias("type"), F.concat(F.lit("m"), F.col("c_custkey") % 7).alias("name"), "file", (F.col("c_custkey") + 1000000).alias("ord"))
    functions = supplier.join(at, F.col("s_nationkey") == F.col("key")).select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("FUNCTION").alias("type"), F.concat(F.lit("f"), "s_suppkey").alias("name"), "file", F.col("s_suppkey").alias("ord"))
    edge = lambda df, src, dst, kind, ord_: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("relation_type"), ord_.cast("bigint").alias("ord"))
    key = F.col("n_nationkey")
    edges = edge(customer, F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey"), "PARENT_CHILD", F.col("c_custkey"))
    edges = edges.unionByName(edge(nation.where("n_nationkey >= 2"), F.concat(F.lit("n"), key), F.concat(F.lit("n"), F.floor(key / 2)), "INHERITS", key))
    edges = edges.unionByName(edge(customer, F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("s"), F.col("c_custkey") % 10 + 1), "CALLS", F.col("c_custkey")))
    other = F.concat(F.lit("r"), F.col("n_regionkey"), F.lit("/f"), 1 - F.col("n_nationkey") % 2, F.lit(".py::M"))
    edges = edges.unionByName(edge(nation, F.concat(file, F.lit("::M")), other, "IMPORTS", key))
    seeds = nation.select(F.concat(F.lit("n"), key).alias("seed")).unionByName(customer.where("c_custkey % 50 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("seed")))
    return seeds, modules.unionByName(classes).unionByName(methods).unionByName(functions), edges


DEFINED_SQL = """WITH a AS (SELECT n_nationkey AS key, 'r' || n_regionkey AS pkg, 'r' || n_regionkey || '/f' || n_nationkey % 2 || '.py' AS file, 'r' || n_regionkey || '/f' || (1 - n_nationkey % 2) || '.py' AS target FROM nation),
c AS (SELECT 'n' || key AS id, key, file, pkg FROM a), m AS (SELECT 'c' || c_custkey AS id, 'm' || c_custkey % 7 AS name, c_nationkey AS key, 's' || c_custkey % 10 + 1 AS callee, file, pkg, c_custkey AS k FROM customer JOIN a ON key = c_nationkey),
f AS (SELECT 's' || s_suppkey AS id, s_suppkey AS k, file, pkg FROM supplier JOIN a ON key = s_nationkey),
h AS (SELECT key AS child, key // 2 AS parent FROM a WHERE key >= 2),
inner_nodes AS (SELECT id, 'CLASS' AS type, key AS ord, file, pkg FROM c UNION ALL SELECT id, 'METHOD', k + 1000000, file, pkg FROM m UNION ALL SELECT id, 'FUNCTION', k, file, pkg FROM f),
shown AS (SELECT * FROM (SELECT * FROM inner_nodes QUALIFY row_number() OVER (PARTITION BY file ORDER BY ord, id) <= 5) WHERE type <> 'METHOD'),
sd AS (SELECT id AS seed, key, file, pkg, NULL AS name, NULL AS callee FROM c UNION ALL SELECT id, key, file, pkg, name, callee FROM m WHERE k % 50 = 0),
sib AS (SELECT seed, m.id AS node, 0.82 AS score, 'same class' AS reason FROM sd JOIN m USING (key) WHERE sd.name IS NOT NULL AND seed <> m.id
  UNION ALL SELECT seed, c.id, 0.70, 'same file' FROM sd JOIN c USING (file) WHERE sd.name IS NULL AND seed <> c.id
  UNION ALL SELECT seed, s.id, 0.45, 'same package' FROM sd JOIN shown s USING (pkg) WHERE sd.file <> s.file),
inh AS (SELECT seed, 'n' || parent AS node, 0.92 AS score, 'parent' AS reason FROM sd JOIN h ON key = child
  UNION ALL SELECT seed, m.id, 0.95, 'overridden' FROM sd JOIN h ON sd.key = child JOIN m ON m.key = parent AND m.name = sd.name
  UNION ALL SELECT seed, 'n' || g.child, 0.78, 'shared parent' FROM sd JOIN h ON key = h.child JOIN h g ON g.parent = h.parent AND g.child <> key
  UNION ALL SELECT seed, 'n' || child, 0.88, 'child' FROM sd JOIN h ON key = parent),
way AS (SELECT file, other, arg_min(way, (ord, way)) AS way FROM (SELECT target AS file, file AS other, key AS ord, 'importer' AS way FROM a UNION ALL SELECT file, target, key, 'importee' FROM a) GROUP BY file, other),
rep AS (SELECT file AS other, arg_min(id, (type <> 'CLASS', ord, id)) AS node FROM inner_nodes WHERE type <> 'METHOD' GROUP BY file),
dep AS (SELECT seed, callee AS node, 0.80 AS score, 'callee' AS reason FROM sd WHERE callee IS NOT NULL
  UNION ALL SELECT seed, node, CASE way WHEN 'importer' THEN 0.70 ELSE 0.65 END, way FROM sd JOIN way USING (file) JOIN rep USING (other))"""


def mode_query(cte: str, name: str, mode):
    def run(spark, d):
        return mode(*definitions(spark, d)).select("seed", "node", "score", "reason")

    run.__name__ = name
    return query(f"{DEFINED_SQL} SELECT seed, node, score::DOUBLE AS score, reason FROM {cte} WHERE seed <> node")(run)


structural_siblings = mode_query("sib", "structural_siblings", structure.siblings)
structural_inheritance = mode_query("inh", "structural_inheritance", structure.inheritance)
structural_dependencies = mode_query("dep", "structural_dependencies", structure.dependencies)


@query(DEFINED_SQL + """, every AS (SELECT * FROM sib UNION ALL SELECT * FROM inh UNION ALL SELECT * FROM dep),
best AS (SELECT seed, node, max(score)::DOUBLE AS score FROM every WHERE seed <> node GROUP BY seed, node)
SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY seed ORDER BY score DESC, node) <= 5""")
def structural_top(spark, d):
    return structure.related(*definitions(spark, d)).select("seed", "node", "score")


@query(r"""WITH c AS (SELECT doc_id AS node, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*')) AS term FROM documents) GROUP BY doc_id, term),
v AS (SELECT term, ln((1::DOUBLE + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5000),
w AS (SELECT node, term, tf * idf AS w FROM c JOIN v USING (term))
SELECT node, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY node)), 9) AS w FROM w""")
def tfidf_weights(spark, d):
    return latent.tfidf(table(spark, d, "documents")).select("node", "term", F.col("w").alias("w"))


@query()
def tfidf_svd(spark, d):
    return latent.embedded(table(spark, d, "documents"))
