"""Scalar goldens, and each catalogue query against its SQL in DuckDB on the smallest tables."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import agentlog, graph, ranking
from codeloom.plans.catalogue import ORACLES, QUERIES
from codeloom.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("word", "expected"), [("foo", ["foo", "foo"]), ("parse_http_date", ["parse_http_date", "parse", "http", "date"]), ("__init__", ["__init__", "init"]), ("FilePathField", ["filepathfield"] * 2), ("a", []), ("x1", ["x1", "x1"]), (None, [])])
def test_tokens(spark, word, expected):
    assert spark.createDataFrame([(word,)], "t string").select(X.tokens(F.col("t"))).first()[0] == expected


def test_group_weights(spark):
    row = spark.createDataFrame([(5,)], "t int").select(*(c.alias(n) for n, c in ranking.group_weights(F.col("t")).items())).first()
    assert (row.initial_exact_symbols, row.initial_method_class, row.initial_error, row.initial_bm25_queries, row.initial_behavior) == (0.613640, 0.529962, 0.474176, 0.446283, 0.334713)


def test_dedup_clean_and_paths(spark):
    row = spark.sql("SELECT array(' A', 'a', '', 'b ', 'B') AS x, './a/b.py::f' AS p, 'a/b.py' AS f").select(X.dedup_clean(F.col("x")), X.tool_path(F.col("p")), X.dotted_module(F.col("f")), X.package(F.col("f"))).first()
    assert list(row) == [["A", "b"], "a/b.py", "a.b", "a"]


def test_upsert_and_unanswered(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in agentlog.last_wins(rows, "k", "o").collect()} == {("a", "y"), ("b", "z")}
    calls, answers = spark.createDataFrame([("i", "1"), ("i", "2")], "instance string, call_id string"), spark.createDataFrame([("i", "1")], "instance string, call_id string")
    assert [r.call_id for r in agentlog.unanswered(calls, answers).collect()] == ["2"]


def test_depth_stops_at_a_cycle(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    inherits = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("c", "a", 1)], "child string, parent string, ord int")
    assert {r.id: r.depth for r in graph.inherit_depth(nodes, inherits).collect()} == {"a": 1, "b": 1, "c": 2}


def test_depth_of_long_chains_and_cycles(spark):
    """More than 100 levels, tails of several lengths into cycles, a self-loop, a node without a name, a parent that is no node."""
    rng = random.Random(5)
    parents = {k: k - 1 for k in range(1, 300)} | {500 + k: 500 + (k + 1) % 7 for k in range(7)} | {600: 600, 700: 900, 601: 600}
    parents |= {1000 + k: rng.choice([*range(1000, 1000 + k), 503, 299, 600, 701]) for k in range(200)}
    nodes = spark.createDataFrame([(k,) for k in [*range(300), *(k for k in parents if k >= 300), 701, 299, None]], "id long")
    inherits = spark.createDataFrame([(c, p, o) for c, p in parents.items() for o, p in ((2, 0), (1, p))], "child long, parent long, ord int")

    def steps(k):
        way = [k]
        while (p := parents.get(way[-1])) is not None and p not in way:
            way.append(p)
        return len(way) - 1

    found = [(r.id, r.depth) for r in graph.inherit_depth(nodes, inherits).collect()]
    assert sorted(found, key=str) == sorted(((k, 0 if k is None else steps(k)) for k in {*range(300), *parents, 701, None}), key=str)
    assert max(r.depth for r in graph.inherit_depth(nodes, inherits, 100).collect()) == 100


@pytest.mark.parametrize("unique", [False, True])
def test_resolution_of_every_kind_of_row(spark, unique):
    """Repeated uses, nulls everywhere, names without definitions, against all pairs by hand."""
    rng = random.Random(3)
    uses = [(rng.choice([None, *range(40)]), rng.choice([None, *"abcdefgh"]), rng.choice([None, True, False])) for _ in range(120)]
    defined = [(rng.choice([None, *range(9)]), n, near) for n in (None, *"abcdef") for near in [rng.choice([None, True, False]) for _ in range(rng.randrange(4))]]
    found = {}
    for use, name, near in uses:
        found.setdefault((use, name), []).extend((d, 1 if near is not None and near == x else 2) for d, n, x in defined if name is not None and n == name)
    want = []
    for (use, name), all_ in found.items():
        near = [f for f in all_ if f[1] == 1]
        if not unique:
            want += [(use, name, *f) for f in near or all_]
        else:
            one = near if len(near) == 1 else all_ if not near and len(all_) == 1 else []
            want.append((use, name, *(one[0] if one and use is not None else (None, None))))
    frame = graph.ranked_resolution(spark.createDataFrame(uses, "use int, name string, near boolean"), spark.createDataFrame(defined, "definition int, name string, near boolean"), unique)
    assert sorted(map(tuple, frame.select("use", "name", "definition", "tier").collect()), key=str) == sorted(want, key=str)


def test_resolution_of_one_makes_no_pairs(spark):
    """A use of a name with many definitions doesn't meet each of them to be left unresolved."""
    uses = spark.range(3000).select(F.col("id").alias("use"), F.lit("a").alias("name"), F.lit(True).alias("near"))
    plan = graph.ranked_resolution(uses, uses.withColumnRenamed("use", "definition"), True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") >= 3


def rows(frame):
    clean = lambda v: None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else round(v, 9) if isinstance(v, float) else v
    return sorted(map(str, ([clean(v) for v in r] for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expected = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) == len(expected)
    fix = lambda f: f.apply(lambda c: c.map(lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and not math.isnan(v) else v))
    assert rows(fix(got)) == rows(fix(expected))


def test_latent_rows_have_length_one(spark):
    from codeloom.operators import latent

    docs = spark.createDataFrame([(1, "a cat sat"), (2, "a cat ran"), (3, "dogs bark loud"), (4, "dogs bark"), (5, None), (6, "")], "doc_id int, text string")
    rows = {r.node: r.vec for r in latent.embedded(docs, width=2).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    near = lambda a, b: sum(x * y for x, y in zip(rows[a], rows[b], strict=True))
    assert all(math.isclose(near(k, k), 1, abs_tol=1e-9) for k in rows)
    assert near(1, 2) > 0.9 and near(3, 4) > 0.9 and abs(near(1, 3)) < 0.2
    assert latent.embedded(docs.where("doc_id > 4")).count() == 0


def test_registered_vectors_have_every_text_of_the_whole_vocabulary(spark, monkeypatch):
    from codeloom.operators import latent
    from codeloom.plans import agent_queries

    rows = [(k, "common words all over " + " ".join(f"often{i}" for i in range(1000))) for k in range(3)] + [(9, "seldom rare")]
    monkeypatch.setattr(agent_queries, "table", lambda s, d, t: spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.node for r in agent_queries.tfidf_svd(spark, "").collect()) == [0, 1, 2, 9]
    r = np.random.default_rng(4).normal(size=(30, 12))
    weights = spark.createDataFrame([([(i, float(w)) for i, w in enumerate(row)],) for row in r], "row array<struct<place: int, w: double>>")
    monkeypatch.setattr(latent, "STRIPE", 5)
    axes = latent.largest_axes(latent.stripes(weights.repartition(3), 12), 12, 4)
    assert np.allclose(np.abs(axes.T @ np.linalg.eigh(r.T @ r)[1][:, ::-1][:, :4]), np.eye(4), atol=1e-8)


def test_priority_keeps_initial_queries(spark):
    rows = [(1, k, "current_query", f"a_{k}", 1.0) for k in range(20)] + [(1, 30, "initial_behavior", "slow words", 0.2), (1, 31, "initial_behavior", "A_1", 0.2)]
    found = ranking.priority_queries(spark.createDataFrame(rows, "instance int, ord int, `group` string, query string, weight double")).orderBy("place").collect()
    assert len(found) == 12 and found[-1].query == "slow words" and [r.query for r in found[:2]] == ["a_0", "a_1"]


def test_submission(spark):
    from codeloom.functions import commands

    mark = "COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT"
    rows = spark.createDataFrame([(f" {mark}\nx\ny", 0), (mark, 0), (f"{mark}\nx", 1), ("x", 0), (None, 0)], "o string, c int")
    assert [r[0] for r in rows.select(commands.submission(F.col("o"), F.col("c"))).collect()] == ["x\ny", "", None, None, None]


def test_destructive_diffs(spark):
    from codeloom.functions import commands

    many, few, more = "-x\n" * 90, "+y\n" * 5, "+y\n" * 20
    texts = [(many + few, True), (many + more, False), ("-x\n" * 200 + more, True), ("@@ -1,3 +0,0 @@", True), ("index 1..e69de29bb", True), ("", False), (None, False)]
    rows = spark.createDataFrame(texts, "d string, expected boolean")
    assert all(r[0] == r[1] for r in rows.select(commands.destructive(F.col("d")), "expected").collect())
