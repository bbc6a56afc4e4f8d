"""The catalogue of queries over the driver's tables, each with SQL that gives the same rows in DuckDB.

The tables have no Python source, so graph operators run on analogues: nations and customers as a tree of
definitions, orders of customers for suppliers as call edges, parts of a type as files that share imports.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import agentlog, graph, ranking
from codeloom.sources.tables import table

QUERY = "The der schen that_the erverge 12"
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TOKENS_SQL = """
raw AS (SELECT {id} AS node, unnest(list_filter(regexp_extract_all(lower({text}), '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+|[一-鿿]+'), lambda t: len(t) >= 2)) AS t FROM {table}),
toks AS (SELECT node, t AS term FROM raw UNION ALL
         SELECT node, p AS term FROM (SELECT node, unnest(string_split(t, '_')) AS p FROM raw) WHERE len(p) >= 2)"""


@query(f"WITH {TOKENS_SQL.format(id='doc_id', text='text', table='documents')} SELECT term, count(*) AS tf, count(DISTINCT node) AS df FROM toks GROUP BY term")
def tokenize_df(spark, d):
    per = ranking.postings(table(spark, d, "documents"), "doc_id", "text")
    return per.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query(r"""SELECT p_partkey, lower(trim(regexp_replace(replace(regexp_replace(p_name || '.' || p_brand, '[./\\:]+', ' ', 'g'), '_', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g'))) AS words FROM part""")
def split_identifier(spark, d):
    return table(spark, d, "part").select("p_partkey", X.split_identifier(F.concat_ws(".", "p_name", "p_brand")).alias("words"))


BM25_SQL = """
WITH {tokens}, dl AS (SELECT doc_id AS node, (SELECT count(*) FROM toks WHERE toks.node = documents.doc_id) AS dl FROM documents),
dls AS (SELECT d.doc_id AS node, coalesce(c.n, 0) AS dl FROM documents d LEFT JOIN (SELECT node, count(*) AS n FROM toks GROUP BY node) c ON c.node = d.doc_id),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
tf AS (SELECT node, term, count(*) AS tf FROM toks GROUP BY node, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.node, tf.term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS w
      FROM tf JOIN df USING (term) JOIN dls USING (node), corpus)"""
BM25_SQL = BM25_SQL.replace(" dl AS (SELECT doc_id AS node, (SELECT count(*) FROM toks WHERE toks.node = documents.doc_id) AS dl FROM documents),\n", "\n").format(tokens=TOKENS_SQL.format(id="doc_id", text="text", table="documents"))


@query(BM25_SQL + """, s AS (SELECT node, round(sum(w), 6) AS raw FROM w WHERE term IN ('the', 'der', 'schen', 'that_the', 'that', 'erverge', '12') GROUP BY node ORDER BY raw DESC, node LIMIT 5)
SELECT node, raw, round(raw / (SELECT max(raw) FROM s), 6) AS score FROM s""")  # fmt: skip
def bm25_search(spark, d):
    return ranking.bm25_search(table(spark, d, "documents"), QUERY)


@query(BM25_SQL + """, btoks AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+|[一-鿿]+'), lambda t: len(t) >= 2)) AS term FROM benchmark),
q AS (SELECT item_id, term FROM btoks UNION SELECT item_id, p FROM (SELECT item_id, unnest(string_split(term, '_')) AS p FROM btoks) WHERE len(p) >= 2),
raws AS (SELECT item_id, node, round(sum(w), 6) AS raw FROM q JOIN w USING (term) GROUP BY item_id, node),
norm AS (SELECT *, raw / max(raw) OVER (PARTITION BY item_id) AS norm, row_number() OVER (PARTITION BY item_id ORDER BY raw DESC, node) AS place FROM raws),
f AS (SELECT node, max(norm * CASE WHEN item_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END) AS best, count(*) AS hits FROM norm WHERE place <= 50 GROUP BY node)
SELECT node, round(least(1.0::DOUBLE, best + 0.10::DOUBLE * (hits - 1) / greatest(1, max(hits) OVER () - 1)), 6) AS score, hits FROM f ORDER BY score DESC, node LIMIT 20""")  # fmt: skip
def bm25_search_many(spark, d):
    weight = F.when(F.col("item_id") % 2 == 0, 1.0).otherwise(0.9)
    return ranking.bm25_search_many(table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", weight.alias("weight")))


@query("""SELECT s AS step, 1.2::DOUBLE AS current_query, 1.2::DOUBLE AS query_exact_symbols, 1.1::DOUBLE AS query_method_class, 1.0::DOUBLE AS query_error, 1.0::DOUBLE AS query_bm25_queries,
0.9::DOUBLE AS query_behavior, round(greatest(0.5, 1.1 * b), 6) AS initial_exact_symbols, round(greatest(0.4, 0.95 * b), 6) AS initial_method_class, round(greatest(0.3, 0.85 * b), 6) AS initial_error,
round(greatest(0.3, 0.8 * b), 6) AS initial_bm25_queries, round(greatest(0.2, 0.6 * b), 6) AS initial_behavior
FROM (SELECT range - 3 AS s, 0.3::DOUBLE + 0.9::DOUBLE * exp(-0.25::DOUBLE * greatest(range - 3, 0)) AS b FROM range(0, 25))""")
def bm25_group_weights(spark, d):
    return spark.range(25).select((F.col("id") - 3).alias("step"), *(c.alias(n) for n, c in ranking.group_weights(F.col("id") - 3).items()))


@query("""SELECT a.vec_id AS query_id, b.vec_id AS node, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS place FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS node, round(greatest(0, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score
    FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)) r JOIN embeddings a ON a.vec_id = r.query_id JOIN embeddings b ON b.vec_id = r.node WHERE place <= 5""")
def cosine_knn(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))
    return ranking.cosine_search(vectors, vectors.where("node % 100 = 0").withColumnRenamed("node", "query_id"))


@query("""SELECT node, round(0.25 * coalesce(s, 0) + 0.55 * coalesce(e, 0) + 0.2 * coalesce(b, 0) + CASE WHEN coalesce(e, 0) > 0 AND coalesce(b, 0) > 0 THEN 0.05 ELSE 0 END, 8) AS score,
  coalesce(s, 0) AS s, coalesce(e, 0) AS e, coalesce(b, 0) AS b FROM
  (SELECT c_custkey AS node, round(c_acctbal / 10000, 6)::DOUBLE AS s FROM customer WHERE c_acctbal > 0) FULL JOIN
  (SELECT vec_id AS node, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS e FROM embeddings) USING (node) FULL JOIN
  (SELECT doc_id AS node, round(n_chars / 200000.0::DOUBLE, 6) AS b FROM documents) USING (node)""")
def hybrid_fusion(spark, d):
    vectors = table(spark, d, "embeddings")
    first = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))
    semantic = vectors.crossJoin(F.broadcast(first)).select(F.col("vec_id").alias("node"), F.round(X.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    structural = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("node"), F.round(F.col("c_acctbal") / 10000, 6).alias("score"))
    lexical = table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.round(F.col("n_chars") / 200000, 6).alias("score"))
    return ranking.fused(semantic, structural, lexical)


def tree(spark, d):
    region = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("MODULE").alias("type"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("CLASS").alias("type"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").alias("ord"))
    customer = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("METHOD").alias("type"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_custkey").alias("ord"))
    return region, nation, customer


def call_pairs(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))


CALLS_SQL = "SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query("""SELECT 'node' AS kind, type, count(*) AS n FROM (SELECT 'MODULE' AS type FROM region UNION ALL SELECT 'CLASS' FROM nation UNION ALL SELECT 'METHOD' FROM customer) GROUP BY ROLLUP (type)
UNION ALL SELECT 'edge', type, count(*) FROM (SELECT 'CONTAINS' AS type FROM nation UNION ALL SELECT 'PARENT_CHILD' FROM customer) GROUP BY ROLLUP (type)""")
def graph_stats(spark, d):
    region, nation, customer = tree(spark, d)
    nodes = region.select("type").unionByName(nation.select("type")).unionByName(customer.select("type"))
    edges = nation.select(F.lit("CONTAINS").alias("relation_type")).unionByName(customer.select(F.lit("PARENT_CHILD").alias("relation_type")))
    return graph.stats(nodes, edges)


@query("SELECT * FROM (SELECT 'c' || c_custkey AS src, 'c' || lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS dst FROM customer) WHERE dst IS NOT NULL")
def sibling_edges(spark, d):
    return graph.siblings(tree(spark, d)[2].select("parent", "id", "ord"))


@query(f"WITH e AS ({CALLS_SQL}) SELECT id, max(o) AS n_out, max(i) AS n_in FROM (SELECT src AS id, count(*) AS o, 0 AS i FROM e GROUP BY src UNION ALL SELECT dst, 0, count(*) FROM e GROUP BY dst) GROUP BY id")
def degrees_position(spark, d):
    return graph.degrees(call_pairs(spark, d))


@query("SELECT id, max(depth) AS depth FROM (SELECT 'c' || c_custkey AS id, 2 AS depth FROM customer UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'r' || r_regionkey, 0 FROM region) GROUP BY id")
def inherit_depth(spark, d):
    region, nation, customer = tree(spark, d)
    nodes = region.select("id").unionByName(nation.select("id")).unionByName(customer.select("id"))
    return graph.inherit_depth(nodes, nation.unionByName(customer).select(F.col("id").alias("child"), "parent", "ord"))


RESOLVE_SQL = """WITH f AS (SELECT c_custkey AS use, c_nationkey::VARCHAR AS name, s_suppkey AS definition, CASE WHEN (c_mktsegment[1] < 'F') = (s_suppkey % 2 = 0) THEN 1 ELSE 2 END AS tier
FROM customer JOIN supplier ON c_nationkey = s_nationkey), b AS (SELECT *, min(tier) OVER w AS best, count(*) FILTER (tier = 1) OVER w AS near_n, count(*) OVER w AS all_n FROM f WINDOW w AS (PARTITION BY use, name))"""


def uses_and_definitions(spark, d):
    uses = table(spark, d, "customer").select(F.col("c_custkey").alias("use"), F.col("c_nationkey").cast("string").alias("name"), (F.substring("c_mktsegment", 1, 1) < "F").alias("near"))
    return uses, table(spark, d, "supplier").select(F.col("s_suppkey").alias("definition"), F.col("s_nationkey").cast("string").alias("name"), (F.col("s_suppkey") % 2 == 0).alias("near"))


@query(RESOLVE_SQL + " SELECT use, name, definition, tier FROM b WHERE tier = best")
def resolve_same_scope_first(spark, d):
    return graph.ranked_resolution(*uses_and_definitions(spark, d), unique=False)


@query(RESOLVE_SQL + """ SELECT c_custkey AS use, c_nationkey::VARCHAR AS name, coalesce(definition::VARCHAR, 'unresolved') AS definition, coalesce(tier, 0) AS tier FROM customer
LEFT JOIN (SELECT * FROM b WHERE (tier = 1 AND near_n = 1) OR (near_n = 0 AND all_n = 1)) x ON x.use = c_custkey""")
def resolve_unique_tier(spark, d):
    found = graph.ranked_resolution(*uses_and_definitions(spark, d), unique=True)
    return found.select("use", "name", F.coalesce(F.col("definition").cast("string"), F.lit("unresolved")).alias("definition"), F.coalesce("tier", F.lit(0)).alias("tier"))


@query("""SELECT DISTINCT c.p_partkey AS src, p.s_suppkey AS dst FROM part c JOIN supplier p ON c.p_size % 25 = p.s_nationkey AND c.p_partkey % 100 = p.s_suppkey % 100""")
def overrides_join(spark, d):
    child = table(spark, d, "part").select(F.concat(F.lit("k"), F.col("p_size") % 25).alias("owner"), (F.col("p_partkey") % 100).alias("name"), F.col("p_partkey").alias("id"))
    parent = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("owner"), (F.col("s_suppkey") % 100).alias("name"), F.col("s_suppkey").alias("id"))
    inherits = table(spark, d, "nation").select(F.concat(F.lit("k"), "n_nationkey").alias("child"), F.concat(F.lit("n"), "n_nationkey").alias("parent"))
    return graph.overrides(inherits, child.unionByName(parent))


@query("""WITH i AS (SELECT DISTINCT p_brand || '/' || p_type AS file, p_size AS target FROM part), n AS (SELECT file, count(*) AS n FROM i GROUP BY file),
s AS (SELECT a.file AS a, b.file AS b, count(*) / sqrt(any_value(na.n) * any_value(nb.n)) AS sim FROM i a JOIN i b ON a.target = b.target AND a.file <> b.file JOIN n na ON na.file = a.file JOIN n nb ON nb.file = b.file GROUP BY a.file, b.file)
SELECT a, b, score FROM (SELECT a, b, round(sim * 0.85::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY a ORDER BY round(sim * 0.85::DOUBLE, 6) DESC, b) AS place FROM s WHERE round(sim, 9) > 0.3) WHERE place <= 10""")
def co_dependents(spark, d):
    return graph.co_dependents(table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("file"), F.col("p_size").cast("string").alias("target")))


@query("""WITH id AS (SELECT 's' || s_suppkey AS id, s_nationkey AS file FROM supplier), e AS (SELECT DISTINCT 's' || a.l_suppkey AS src, 's' || b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2),
f AS (SELECT a.id AS seed, b.id AS node, 0.70::DOUBLE AS score, 'same file' AS reason FROM id a JOIN id b ON a.file = b.file UNION ALL SELECT dst, src, 0.85, 'caller' FROM e UNION ALL SELECT src, dst, 0.8, 'callee' FROM e)
SELECT seed, node, max(score) AS score, arg_max(reason, score) AS reason FROM f WHERE seed <> node GROUP BY seed, node""")
def structural_related(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("s"), "l_suppkey").alias("id"))
    first, second = (line.where(f"l_linenumber = {k}").select("l_orderkey", F.col("id").alias(n)) for k, n in ((1, "src"), (2, "dst")))
    nodes = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("file"))
    return graph.structural(nodes, first.join(second, "l_orderkey").select("src", "dst").distinct())


@query("""SELECT src, dst, confidence, kind, confidence >= 0.75 AS high FROM (SELECT l_orderkey AS src, l_suppkey AS dst, round(1 - l_discount * 5, 6) AS confidence, l_returnflag AS kind,
row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY round(1 - l_discount * 5, 6) DESC, l_linenumber * 10000000 + l_partkey, l_returnflag DESC) AS place FROM lineitem WHERE l_orderkey <> l_suppkey) WHERE place = 1""")
def edge_best_confidence(spark, d):
    return graph.best_calls(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.round(1 - F.col("l_discount") * 5, 6).alias("confidence"), F.col("l_returnflag").alias("kind"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("ord")))


@query("SELECT conv_id, turn, role, (sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS step FROM conversations")
def conversation_steps(spark, d):
    return agentlog.message_steps(table(spark, d, "conversations").select(F.col("conv_id").alias("instance"), F.col("turn").alias("ord"), "role")).select(F.col("instance").alias("conv_id"), F.col("ord").alias("turn"), "role", "step")


@query("""WITH a AS (SELECT user_id, event_id, value, CASE event_type WHEN 'signup' THEN 'edit' WHEN 'purchase' THEN 'test' WHEN 'error' THEN 'small_read' WHEN 'view' THEN 'broad' ELSE 'inspect' END AS kind FROM events),
s AS (SELECT *, row_number() OVER w AS step, row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id) - 1 AS tool_step,
  coalesce(max((kind = 'small_read')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS known, kind IN ('edit', 'test', 'diff', 'submit') AS final FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
l AS (SELECT *, (step >= 45 AND NOT final) OR (step >= 40 AND NOT final AND kind <> 'small_read') OR (step >= 30 AND kind = 'broad') AS late FROM s),
k AS (SELECT *, known AND NOT final AND NOT late AS looks FROM l)
SELECT user_id AS instance, event_id AS ord, step, step IN (30, 40, 57) OR (step >= 45 AND (step - 45) % 10 = 0) AS notice, tool_step,
  late OR (looks AND coalesce(sum(looks::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 5) AS blocked FROM k""")
def guard_replay(spark, d):
    kind = F.when(F.col("event_type") == "signup", "edit").when(F.col("event_type") == "purchase", "test").when(F.col("event_type") == "error", "small_read").when(F.col("event_type") == "view", "broad").otherwise("inspect")
    return agentlog.guard_replay(table(spark, d, "events").select(F.col("user_id").alias("instance"), F.col("event_id").alias("ord"), kind.alias("kind"), (F.col("event_type") == "error").alias("located")))


@query("""SELECT event_type, coalesce(sum(p), 0)::BIGINT AS prompt, coalesce(sum(c), 0)::BIGINT AS completion, sum(coalesce(p, 0) + coalesce(c, 0))::BIGINT AS total, count(*) FILTER (p IS NULL) AS missing, count(*) AS calls
FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS p, floor(value)::BIGINT AS c FROM events) GROUP BY event_type""")
def token_usage_rollup(spark, d):
    return agentlog.usage_totals(table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("prompt"), F.floor("value").alias("completion"), F.lit(0).cast("bigint").alias("total")), "event_type")


@query("SELECT event_type AS status, count(*) AS n, round(avg(user_id), 6) AS avg_calls, round(count(*) / (sum(count(*)) OVER ()), 6) AS share FROM events GROUP BY event_type")
def exit_status_summary(spark, d):
    return agentlog.status_summary(table(spark, d, "events").select(F.col("event_type").alias("status"), F.col("user_id").alias("calls")))


@query("""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'EMPTY_PATCH' WHEN quality = 1 AND toxic = 0 THEN 'RESOLVED' WHEN quality = 0 THEN 'FAILED' WHEN toxic = 1 THEN 'ERROR'
WHEN regexp_matches(text, 'token = ') THEN 'FAILED' ELSE 'UNKNOWN' END AS status FROM documents LEFT JOIN labels USING (doc_id)""")
def eval_status_precedence(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    status = agentlog.eval_status(F.coalesce(F.col("text"), F.lit("")) == "", (F.col("quality") == 1) & (F.col("toxic") == 0), F.col("quality") == 0, F.col("toxic") == 1, F.when(F.col("text").rlike("token = "), "FAILED"))
    return joined.select("doc_id", status.alias("status"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_tolerant_parse(spark, d):
    fenced = F.concat(F.lit("```json"), "props", F.lit("```"))
    return table(spark, d, "events").select("event_id", X.tolerant_json(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(fenced), "k").alias("k"))


@query(r"SELECT doc_id, CASE WHEN len(text) <= 6000 THEN text ELSE text[1:2500] || chr(10) || '... ' || (len(text) - 5000) || ' characters elided ...' || chr(10) || right(text, 2500) END AS shown FROM documents")
def truncate_head_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", X.head_and_tail(F.col("text")).alias("shown"))


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+|[一-鿿]+') AS t FROM documents),
e AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM t),
f AS (SELECT doc_id, w, min(i) AS i FROM e WHERE len(w) >= 2 AND w NOT IN ({", ".join(repr(w) for w in X.STOPWORDS)}) GROUP BY doc_id, w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM f)
SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS keywords FROM documents d LEFT JOIN (SELECT * FROM r WHERE place <= 30) r USING (doc_id) GROUP BY d.doc_id""")
def keywords_top30(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.keywords(F.col("text")), " ").alias("keywords"))


@query(r"""SELECT url, host, target, count(*) AS n FROM (SELECT url, regexp_extract(url, '://([^/?#]*)', 1) AS host, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages) GROUP BY url, host, target""")
def link_targets(spark, d):
    links = table(spark, d, "pages").select("url", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("target"))
    return links.groupBy("url", "host", "target").agg(F.count("*").alias("n"))
