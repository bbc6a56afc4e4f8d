"""Search from a text and from a node, node texts, positions and the look of a graph, over the driver's tables.

Documents are the nodes of a graph of files: every tenth is a class and the nine after it its methods, a hundred are a file.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import nodetext
from codeloom.operators import graph, positions, search
from codeloom.plans.agent_queries import DEFINED_SQL, definitions
from codeloom.plans.catalogue import BM25_SQL, QUERY, query
from codeloom.sources.tables import table


def index(spark, d) -> search.Index:
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    ids = docs.select(F.col("doc_id").alias("id")).unionByName(vectors.select(F.col("vec_id").alias("id"))).distinct()
    kind = F.when(F.col("id") % 10 == 0, "CLASS").otherwise("METHOD")
    nodes = ids.select("id", kind.alias("type"), F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("f"), F.floor(F.col("id") / 100).cast("string"), F.lit(".py")).alias("file"), F.col("id").alias("ord"))
    edges = ids.where("id % 10 <> 0").select((F.col("id") - F.col("id") % 10).alias("src"), F.col("id").alias("dst"), F.lit("PARENT_CHILD").alias("relation_type"), F.col("id").alias("ord"))
    return search.Index(docs.select(F.col("doc_id").alias("node"), "text"), vectors.select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec")), nodes, edges)


IDS_SQL = "ids AS (SELECT doc_id AS id FROM documents UNION SELECT vec_id FROM embeddings)"
NEAR_SQL = "SELECT vec_id AS node, round(greatest(0, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))), 6) AS e FROM embeddings"
# The structure around seeds: methods of the same class for a method, classes of the same file for a class.
AROUND_SQL = """around AS (SELECT nth, i.id AS node, 0.82 AS s FROM seeds JOIN ids i ON seeds.node % 10 <> 0 AND i.id % 10 <> 0 AND i.id // 10 = seeds.node // 10 AND i.id <> seeds.node
  UNION ALL SELECT nth, i.id, 0.70 FROM seeds JOIN ids i ON seeds.node % 10 = 0 AND i.id % 10 = 0 AND i.id // 100 = seeds.node // 100 AND i.id <> seeds.node),
few AS (SELECT * FROM around QUALIFY row_number() OVER (PARTITION BY nth ORDER BY s DESC, node) <= 15), st AS (SELECT node, arg_min(s, nth)::DOUBLE AS s FROM few GROUP BY node)"""
FUSED_SQL = """SELECT node, coalesce(s, 0) AS s, coalesce(e, 0) AS e, coalesce(b, 0) AS b, round(0.25::DOUBLE * coalesce(s, 0) + 0.55::DOUBLE * coalesce(e, 0) + 0.2::DOUBLE * coalesce(b, 0)
  + CASE WHEN e > 0 AND b > 0 THEN 0.05 ELSE 0 END, 8) AS score FROM st FULL JOIN {e} USING (node) FULL JOIN {b} USING (node) ORDER BY score DESC, node LIMIT 5"""
TERMS = "('the', 'der', 'schen', 'that_the', 'that', 'erverge', '12')"


@query(BM25_SQL + f""", {IDS_SQL}, l AS (SELECT node, round(sum(w), 6) AS raw FROM w WHERE term IN {TERMS} GROUP BY node ORDER BY raw DESC, node LIMIT 30),
lex AS (SELECT node, round(raw / (SELECT max(raw) FROM l), 6) AS b FROM l), lexical AS (SELECT *, row_number() OVER (ORDER BY b DESC, node) - 1 AS b_rank FROM lex),
sem AS ({NEAR_SQL} ORDER BY e DESC, node LIMIT 15), semantic AS (SELECT *, row_number() OVER (ORDER BY e DESC, node) - 1 AS e_rank FROM sem),
found AS (SELECT node, e, b, round(coalesce(0.55::DOUBLE * e + 0.02::DOUBLE / (e_rank + 1), 0) + coalesce(0.2::DOUBLE * b + 0.02::DOUBLE / (b_rank + 1), 0)
  + CASE WHEN e IS NOT NULL AND b IS NOT NULL THEN 0.05 ELSE 0 END + CASE WHEN node % 10 = 0 THEN 0.03 ELSE 0.04 END::DOUBLE, 8) AS score FROM semantic FULL JOIN lexical USING (node)),
best AS (SELECT node, row_number() OVER (ORDER BY score DESC, CASE WHEN e IS NULL THEN b ELSE 0 END DESC, coalesce(e, 0) DESC, node) AS nth FROM found), seeds AS (SELECT * FROM best WHERE nth <= 3),
{AROUND_SQL} {FUSED_SQL.format(e="semantic", b="lexical")}""")  # fmt: skip
def hybrid_search(spark, d):
    """The query's words, and the first vector as its meaning."""
    of = index(spark, d)
    return search.hybrid_search(of, QUERY, first_vector(of))


def first_vector(of: search.Index) -> list:
    return of.vectors.where("node = 0").first().vec


@query(BM25_SQL + f""", {IDS_SQL}, l AS (SELECT node, round(sum(w), 6) AS raw FROM w WHERE term IN {TERMS} GROUP BY node ORDER BY raw DESC, node LIMIT 15),
lexical AS (SELECT node, round(raw / (SELECT max(raw) FROM l), 6) AS b FROM l), lex AS (SELECT * FROM lexical WHERE node <> 0), sem AS (SELECT * FROM ({NEAR_SQL} ORDER BY e DESC, node LIMIT 15) WHERE node <> 0), seeds AS (SELECT 0 AS node, 1 AS nth),
{AROUND_SQL} {FUSED_SQL.format(e="sem", b="lex")}""")  # fmt: skip
def search_by_node(spark, d):
    of = index(spark, d)
    return search.search_by_node(of, 0, QUERY, first_vector(of))


def described(spark, d):
    """Parts as nodes with all columns of a node's text."""
    p = table(spark, d, "part")
    kind = F.element_at(F.array(*map(F.lit, ("CLASS", "METHOD", "FUNCTION", "MODULE"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    methods = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("getName"), F.lit("run"))).otherwise(F.array().cast("array<string>"))
    return p.select(
        "p_partkey", kind.alias("type"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.concat(F.lit("a/"), "p_type", F.lit(".py")).alias("file"),
        F.when(F.col("p_partkey") % 2 == 0, "(self, maxSize)").otherwise("").alias("signature"), F.when(F.col("p_partkey") % 5 == 0, "Gives a part.").otherwise("").alias("docstring"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit(None)).otherwise(F.repeat(F.lit("x = 1;"), (F.col("p_partkey") % 400).cast("int"))).alias("code"), F.when(F.col("p_partkey") % 6 == 0, " said ").alias("comment"), methods.alias("method_names"),
    )


DESCRIBED_SQL = """WITH d AS (SELECT p_partkey, (['CLASS', 'METHOD', 'FUNCTION', 'MODULE'])[p_partkey % 4 + 1] AS type, p_name AS name, p_brand || '.' || p_name AS q, 'a/' || p_type || '.py' AS file, CASE WHEN p_partkey % 2 = 0 THEN '(self, maxSize)' ELSE '' END AS sig,
  CASE WHEN p_partkey % 5 = 0 THEN 'Gives a part.' ELSE '' END AS doc, CASE WHEN p_partkey % 7 > 0 THEN repeat('x = 1;', (p_partkey % 400)::INT) ELSE '' END AS code, CASE WHEN p_partkey % 6 = 0 THEN 'said' END AS comment, p_partkey % 3 = 0 AS has FROM part),
s AS (SELECT *, CASE type WHEN 'CLASS' THEN 'class ' WHEN 'MODULE' THEN 'module ' ELSE 'def ' END || name || CASE WHEN type = 'MODULE' THEN '' ELSE sig END || CASE WHEN doc <> '' THEN ' : ' || doc ELSE '' END || CASE WHEN has AND type = 'CLASS' THEN ' . Methods: getName, run' ELSE '' END AS skel FROM d),
parts AS (SELECT *, nullif(concat_ws(chr(10), comment, skel, CASE WHEN sig <> '' THEN 'signature ' || sig END, CASE WHEN doc <> '' THEN 'docstring ' || doc END, CASE WHEN has THEN 'methods getName, run' END), '') AS lead FROM s)"""


@query(DESCRIBED_SQL + """SELECT p_partkey, concat_ws(chr(10), lead, nullif(trim(code[1:1200]), ''), q, 'file ' || file) AS searched, concat_ws(chr(10), lead, q, 'file ' || file, nullif(trim(code[1:800]), '')) AS asked,
  CASE WHEN type <> 'MODULE' THEN skel END AS prebuilt, trim('method ' || q || chr(10) || 'file ' || file || chr(10) || 'class C' || chr(10) || 'class_bases (B)' || CASE WHEN sig <> '' THEN chr(10) || 'signature ' || sig ELSE '' END
  || CASE WHEN doc <> '' THEN chr(10) || 'docstring ' || doc ELSE '' END || CASE WHEN code <> '' THEN chr(10) || 'code' || chr(10) || code[1:1600] ELSE '' END) AS method FROM parts""")  # fmt: skip
def node_texts(spark, d):
    texts = {"searched": nodetext.searched_text(), "asked": nodetext.query_text(), "prebuilt": nodetext.prebuilt_text(), "method": nodetext.method_text(F.lit("C"), F.lit("(B)"), F.lit(""))}
    return described(spark, d).select("p_partkey", *(t.alias(n) for n, t in texts.items()))


SPLIT_SQL = r"lower(trim(regexp_replace(replace(regexp_replace({0}, '[./\\:]+', ' ', 'g'), '_', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g')))"


@query(DESCRIBED_SQL + f"""SELECT p_partkey, concat_ws(chr(10), name, {SPLIT_SQL.format('name')}, q, {SPLIT_SQL.format('q')}, file, translate(file, '/', ' '), nullif(sig, ''), nullif({SPLIT_SQL.format('sig')}, ''), nullif(doc, ''), CASE WHEN has THEN 'getName run' END,
  CASE WHEN has THEN 'get name run' END, CASE WHEN comment IS NOT NULL THEN ' said ' END, nullif(code, ''), skel) AS text FROM s""")  # fmt: skip
def lexical_texts(spark, d):
    return described(spark, d).select("p_partkey", nodetext.lexical_text(extended=False).alias("text"))


@query(DEFINED_SQL + """, calls AS (SELECT DISTINCT id AS src, callee AS dst FROM m), every AS (SELECT id, 'CLASS' AS type FROM c UNION ALL SELECT id, 'METHOD' FROM m UNION ALL SELECT id, 'FUNCTION' FROM f),
names AS (SELECT id, 'N' || key AS name FROM c UNION ALL SELECT id, name FROM m UNION ALL SELECT id, 'f' || k FROM f),
i AS (SELECT dst AS id, count(*) AS n FROM calls GROUP BY dst), o AS (SELECT src AS id, count(*) AS n FROM calls GROUP BY src),
inn AS (SELECT dst AS id, string_agg(name, ' ' ORDER BY src) AS callers FROM (SELECT * FROM calls QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) <= 5) JOIN names ON names.id = src GROUP BY dst),
sub AS (SELECT 'n' || parent AS id, count(*) AS n FROM h GROUP BY parent), mt AS (SELECT 'n' || key AS id, count(*) AS n FROM m GROUP BY key)
SELECT e.id, coalesce(i.n, 0) AS n_callers, coalesce(o.n, 0) AS n_callees, coalesce(callers, '') AS callers, CASE WHEN type = 'CLASS' THEN coalesce(sub.n, 0) ELSE 0 END AS n_subclasses, CASE WHEN type = 'CLASS' THEN coalesce(mt.n, 0) ELSE 0 END AS n_methods
FROM every e LEFT JOIN i USING (id) LEFT JOIN o USING (id) LEFT JOIN inn USING (id) LEFT JOIN sub USING (id) LEFT JOIN mt USING (id)""")  # fmt: skip
def node_positions(spark, d):
    _, nodes, edges = definitions(spark, d)
    found = positions.positions(nodes.where("type <> 'MODULE'"), edges).where("depth = 0 AND NOT overrides")
    return found.select("id", "n_callers", "n_callees", F.array_join("callers", " ").alias("callers"), "n_subclasses", "n_methods")


@query(DEFINED_SQL + """, called AS (SELECT callee, count(*) AS n FROM m GROUP BY callee)
SELECT (SELECT count(*) FROM f WHERE id NOT IN (SELECT callee FROM m)) + (SELECT count(*) FROM c WHERE key < 2 AND key NOT IN (SELECT key FROM m) AND key NOT IN (SELECT parent FROM h)) AS isolated,
  (SELECT count(*) FROM f) AS without_code, 0.0::DOUBLE AS modules_with_children, 0 AS most_calls""")
def graph_robustness(spark, d):
    _, nodes, edges = definitions(spark, d)
    code = F.when(F.col("type") == "FUNCTION", "").otherwise("x")
    return positions.robustness(nodes.withColumn("code", code), edges).select("isolated", "without_code", "modules_with_children", "most_calls")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS child, CASE WHEN n_nationkey IN (3, 4) THEN 7 - n_nationkey ELSE (n_nationkey - 1) // 2 END AS parent FROM nation WHERE n_nationkey > 0),
up(id, cur, depth, path) AS (SELECT child, parent, 1, [child, parent] FROM e UNION ALL SELECT up.id, e.parent, up.depth + 1, list_append(path, e.parent) FROM up JOIN e ON e.child = up.cur WHERE NOT list_contains(path, e.parent))
SELECT id, max(depth) AS depth FROM up GROUP BY id UNION ALL SELECT 0, 0""")
def ancestors_recursive(spark, d):
    """A tree of nations in which two nations have each other for a parent."""
    key = F.col("n_nationkey")
    nation = table(spark, d, "nation")
    parent = F.when(key.isin(3, 4), 7 - key).otherwise(F.floor((key - 1) / 2))
    inherits = nation.where(key > 0).select(key.cast("long").alias("child"), parent.cast("long").alias("parent"), F.lit(0).alias("ord"))
    return graph.inherit_depth(nation.select(key.cast("long").alias("id")), inherits).select("id", "depth")
