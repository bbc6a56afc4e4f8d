"""Searches, node texts, deepening as it is asked for, a graph as JSON, focus rules and reports, on small trees of our own."""

import json
import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import focus, nodetext
from codeloom.operators import positions, search, structure
from codeloom.sources import budget, reports, skeleton
from codeloom.sources.deepen import call_facts, deepened, resolved_calls, skeleton_graph
from codeloom.sources.repo import facts, full_graph, source_files
from tests.test_deepen import TREE, parsed


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    return parsed(spark, tmp_path_factory.mktemp("tree"), TREE)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.fixture(scope="module")
def index(spark, tree):
    nodes, edges = full_graph(tree[0])
    described = nodes.withColumn("comment", F.lit("")).withColumn("method_names", F.array().cast("array<string>"))
    texts = described.select(F.col("id").alias("node"), nodetext.searched_text().alias("text")).cache()
    vectors = texts.select("node", F.array(F.length("node").cast("double"), F.lit(1.0)).alias("vec"))
    return search.Index(texts, vectors, nodes.cache(), edges.withColumn("ord", F.monotonically_increasing_id()).cache())


def test_hybrid_search(index):
    found = search.hybrid_search(index, "split_path", None, 5).collect()
    assert found[0].node == "base.py::split_path" and found[0].b == 1.0 and found[0].e == 0.0
    assert any(r.s > 0 for r in found)
    assert search.hybrid_search(index, "", [1.0, 0.0], 3).count() == 3
    assert search.hybrid_search(index, "", None, 3).count() == 0
    with pytest.raises(ValueError):
        search.hybrid_search(index, "x", None, weights=(0, 0, 0))


def test_search_by_node(index):
    near = {r.node: r for r in search.search_by_node(index, "web.py::Web.run", "web step", None, 9, "siblings").collect()}
    assert near["web.py::Web.step"].s == 0.82 and "web.py::Web.run" not in near
    assert search.search_by_node(index, "gone", "", None).count() == 0


def test_tools(index):
    tools = search.Tools(index, lambda text: None)
    assert tools.dispatch("search_bm25", {"query": "split_path"}).first().node == "base.py::split_path"
    assert {r.node for r in tools.dispatch("search_structural", {"node_id": "web.py::Web", "mode": "inheritance"}).collect()} == {"base.py::Root"}
    with pytest.raises(ValueError):
        tools.dispatch("search_x", {})
    with pytest.raises(ValueError):
        tools.search_structural("web.py::Web", "x")


def test_co_dependents_join_the_related(index, spark):
    seeds = spark.createDataFrame([("web.py::Web",)], "seed string")
    assert rows(structure.co_dependents(seeds, index.nodes, index.edges), "node", "score") == [("tools.py::clean", 0.85)]
    assert "tools.py::clean" in {r.node for r in structure.related(seeds, index.nodes, index.edges, 50).collect()}


def test_positions(index):
    by = {r.id: r for r in positions.positions(index.nodes, index.edges).withColumn("text", positions.position_text()).collect()}
    push = by["web.py::push"]
    assert (push.n_callers, push.callers, push.n_callees) == (2, ["get", "step"], 0) and by["base.py::Root"].n_subclasses == 1
    assert by["web.py::Web.run"].overrides and by["web.py::Web"].n_methods == 3 and by["web.py::Web"].text.endswith("has 3 methods")
    odd = positions.robustness(index.nodes, index.edges).first()
    assert (odd.isolated, odd.without_code, odd.modules_with_children) == (0, 0, 1.0) and odd.most_calls >= 1


def test_described_skeleton(spark, tmp_path):
    source = 'import os.path\nimport numpy as np\nfrom .b import f as g\n\n\n@final\nclass A(Base, ext.Other):\n    """Says."""\n\n    @property\n    def x(self):\n        """Gives x."""\n\n    async def y(self, k=1): ...\n\n\nclass Base: ...\n\n\n@cached\nasync def run(a): ...\n'
    (tmp_path / "m.py").write_text(source)
    nodes, _ = skeleton.described_skeleton(facts(source_files(spark, str(tmp_path))))
    by = {r.name: r for r in nodes.collect()}
    assert by["A"].code == '@final\nclass A(Base, ext.Other):\n    """Says."""\n    # Methods:\n    # - def x(self) line=11 decorators=[\'property\']\n    # - async def y(self, k=1) line=14\n'
    assert by["Base"].code == "class Base:\n    ...\n" and by["run"].code == "@cached\nasync def run(a):\n    ...\n"
    assert by["m.py"].code == "# Import aliases: np -> numpy; os -> os.path\n# From-import aliases: g -> .b.f"
    assert by["A"].bases == ["Base", "Other"] and by["A"].unresolved_bases == ["Other"] and by["A"].method_names == ["x", "y"]
    text = nodes.where("name = 'A'").select(nodetext.lexical_text()).first()[0].split("\n")
    assert {"A", "Base Other", "final", "x", "Gives x.", "property", "y"} <= set(text)


def test_graph_json(spark, tmp_path, tree):
    nodes, edges = skeleton.described_skeleton(tree[0])
    depths = spark.createDataFrame([("web.py", "full")], "file string, depth string")
    skeleton.write_graph_json(nodes, edges, depths, str(tmp_path / "g"), "/r")
    again = skeleton.read_graph_json(spark, str(tmp_path / "g"))
    columns = [c for c in again[0].columns if c != "method_names"]
    assert sorted(rows(again[0], *columns)) == sorted(rows(nodes, *columns)) and sorted(rows(again[1], "src", "dst", "relation_type")) == sorted(rows(edges, "src", "dst", "relation_type"))
    (tmp_path / "one.json").write_text(json.dumps({"repo_root": "/r", "nodes": [{"id": "a", "type": "CLASS", "odd": 1}], "edges": [{"src": "a", "dst": "b", "relation_type": "CALLS"}], "file_depth": {"x.py": "full"}}))
    nodes, edges, depths = skeleton.read_graph_json(spark, str(tmp_path / "one.json"))
    assert rows(nodes, "id", "type", "name", "start_line", "method_names") == [("a", "CLASS", "", 0, [])] and rows(edges, "src", "dst") == [("a", "b")] and rows(depths, "file", "depth") == [("x.py", "full")]
    files = spark.createDataFrame([("x.py",), ("y.py",)], "file string")
    assert sorted(rows(skeleton.of_depth(files, skeleton.with_depths(depths, spark.createDataFrame([("x.py", "skeleton")], "file string, depth string"))), "file", "depth")) == [("x.py", "skeleton"), ("y.py", "")]


def test_comments(spark):
    nodes = spark.createDataFrame([("a", "CLASS", "x", "old"), ("b", "CLASS", "y", ""), ("c", "METHOD", "z", None), ("d", "CLASS", " ", None)], "id string, type string, code string, comment string")
    new = spark.createDataFrame([("a", "n"), ("b", "n"), ("c", "n"), ("d", " ")], "id string, comment string")
    assert sorted(rows(skeleton.with_comments(nodes, new), "id", "comment")) == [("a", "old"), ("b", "n"), ("c", "n"), ("d", None)]
    assert sorted(rows(skeleton.with_comments(nodes, new, ids=["a"], types=["CLASS"], skip_if_exists=False), "id", "comment")) == [("a", "n"), ("b", ""), ("c", None), ("d", None)]
    assert rows(skeleton.annotated(nodes, lambda codes: [c.upper() for c in codes], ["CLASS"]), "id", "comment", "status") == [("b", "Y", "ok")]

    def broken(codes):
        raise RuntimeError("no service")

    assert rows(skeleton.annotated(nodes, broken, ["METHOD"]), "id", "status") == [("c", "failed")]


def test_deepening_within_a_budget(spark, tree):
    found, calls = tree
    targets = spark.createDataFrame([(1, "web.py"), (2, "base.py"), (3, "web.py"), (4, "tools.py")], "ord int, file string")
    depths = spark.createDataFrame([("base.py", "full")], "file string, depth string")
    assert dict(rows(budget.within_budget(targets, depths, 2), "file", "decision")) == {"web.py": "deepen", "base.py": "done", "tools.py": "over_budget"}
    nodes, edges = full_graph(found)
    texts = dict(rows(budget.method_texts(nodes, edges, "web.py"), "node", "text"))
    assert texts["web.py::Web.step"].startswith("method Web.step\nfile web.py\nclass Web\nclass_bases (Root)\nsignature (self, x)\ncode\n")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [float("nan"), 1.0])], "node string, vec array<double>")
    assert rows(budget.ranked_methods(vectors, [1.0, 0.1], 2), "node") == [("a",), ("b",)]
    asked = spark.createDataFrame([(0, "web.py::Web.again"), (1, "session.py::Session.post")], "ord int, node string")
    assert rows(budget.neighbour_files(asked, nodes, edges), "file") == [("base.py",), ("web.py",)]
    skel, skel_edges = skeleton_graph(found)
    methods, added = deepened(found, calls, found.select("file"))
    answers = resolved_calls(calls, skel.unionByName(methods.drop("owner")), skel_edges.unionByName(added.where("relation_type = 'PARENT_CHILD'").select("src", "dst", "relation_type")))
    lost = budget.unresolved_calls(calls, answers)
    answered = set(rows(answers, "file", "ord"))
    assert {(c.file, c.ord) for c in calls.collect()} == answered | set(rows(lost, "file", "ord")) and not answered & set(rows(lost, "file", "ord"))
    report = budget.method_reports(methods.select(F.col("id").alias("node")), added.where("relation_type = 'CALLS'"), lost.select(F.concat_ws("::", "file", "caller").alias("node"), "name"))
    step = report.where("node = 'web.py::Web.step'").select("calls", "high", budget.relation_text("node")).first()
    assert "web.py::push (same_file_direct_function, 0.90)" in step.calls and "web.py::push" in step.high and step[2].startswith("web.py::Web.step\ncalls: ")
    plain = nodes.where("type <> 'METHOD'").withColumn("code", F.lit("..."))
    fresh = dict(rows(budget.refreshed(plain, nodes, spark.createDataFrame([("web.py",)], "file string")), "id", "code"))
    assert fresh["web.py::push"].startswith("def push") and fresh["tools.py::pack"] == "..."


def test_focus_rules(spark):
    text = "`Field.clean` fails: URL in f (x) and Http404Error, getName; see a/b.py, __init__ and max_size. none Unknown"
    f = focus.with_focus(spark.createDataFrame([(text,), (None,)], "text string"), "text").select("focus.*").collect()
    one = f[0]
    assert one.exact_symbols == ["Field.clean", "f", "__init__", "max_size", "Field", "URL", "Http404Error", "getName"]
    assert one.class_hints == ["Field", "URL", "Http404Error"] and one.function_hints == ["f"] and one.method_hints == ["__init__"]
    assert one.error_terms == ["Http404Error"] and one.file_hints == ["a/b.py"] and one.parameter_hints == ["__init__", "max_size"]
    assert "none" not in one.raw_keywords and one.bm25_queries[0] == " ".join(one.exact_symbols) and f[1].exact_symbols == []
    coerced = spark.sql("""SELECT explode(array('["a", "b"]', '"c"', 'd', 'null', NULL)) AS v""").select(focus.as_list(F.col("v")))
    assert [r[0] for r in coerced.collect()] == [["a", "b"], ["c"], ["d"], [], []]


def test_query_bundle_and_deepening_query(spark):
    said = [("i", 0, "initial_issue", "URL broken in `clean`"), ("i", 1, "initial_issue", "another"), ("i", 2, "query", "old"), ("i", 3, "query", "max_size now")]
    cache = focus.focus_cache(focus.with_focus(spark.createDataFrame(said, "instance string, ord int, source string, text string"), "text"))
    assert rows(cache, "initial.source_text", "query.source_text") == [("URL broken in `clean`", "max_size now")]
    bundle = focus.query_bundle(cache.withColumn("current", F.lit("where is URL")).withColumn("step", F.lit(0)))
    queries = [r.query for r in bundle.orderBy("place").collect()]
    assert queries[0] == "max_size" and "where is URL" in queries and len(queries) == len({q.lower() for q in queries}) <= 12
    query = cache.select(focus.deepen_query(F.lit(" "), F.col("query"), F.col("initial"))).first()[0]
    assert query == "max_size now\nURL broken in `clean`\nRelated code symbols: max_size, clean, URL\nRelated behavior/error terms: max_size, now, url, broken, clean"
    assert cache.select(focus.deepen_query(F.lit("asked"), F.col("query"), F.col("initial"))).first()[0] == "asked"


def test_reports_on_disk(spark, tmp_path):
    (tmp_path / "run_7" / "a").mkdir(parents=True)
    (tmp_path / "run_8").mkdir()
    (tmp_path / "run_7" / "a" / "r.json").write_text('{"resolved_ids": ["x__1"]}')
    (tmp_path / "run_8" / "r.json").write_text('{"resolved_ids": ["x__2"]}')
    assert rows(reports.reported(reports.files_of_run(spark, str(tmp_path), "run_7")), "instance", "status") == [("x__1", "resolved")]
    preds = reports.predictions(spark.createDataFrame([('{"x__1": {"model_patch": "p"}, "x__3": {"model_patch": " "}}',)], "text string"))
    table = reports.evaluated(preds, spark.createDataFrame([("x__1", "resolved")], "instance string, status string"), spark.createDataFrame([("x__1", "ran")], "instance string, text string"))
    assert sorted(rows(table, "instance", "patch_status", "eval_status")) == [("x__1", "HAS_PATCH", "RESOLVED"), ("x__3", "EMPTY", "EMPTY_PATCH")]
    reports.write_summary(table, str(tmp_path / "out"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "out/eval_summary.csv")), "instance_id", "eval_status") == [("x__1", "RESOLVED"), ("x__3", "EMPTY_PATCH")]
    assert "| `x__1` | HAS_PATCH | RESOLVED |" in {r.value for r in spark.read.text(str(tmp_path / "out/eval_summary.md")).collect()}
    assert reports.dataset("verified").endswith("Verified") and reports.dataset("a/b") == "a/b"
    with pytest.raises(ValueError):
        reports.dataset("x")


def test_call_facts_of_the_tree(spark, tree):
    assert call_facts(spark.createDataFrame([("x.py", b"def f():\n    g()\n")], "file string, content binary")).count() == 1


def test_best_of_all_modes_as_without_cuts(spark):
    """Many nodes of a class, file, package and parent, equal scores, nodes of several lists: the same as the best of the whole lists, from few rows."""
    rng = random.Random(2)
    nodes = [(f"p/f{k % 3}.py::C{k:02}", "CLASS", f"C{k:02}", f"p/f{k % 3}.py", k) for k in range(12)]
    nodes += [(f"{c[0]}.m{k:02}", "METHOD", f"m{k % 4}", c[3], 100 + k) for c in nodes[:12] for k in range(15)]
    nodes += [(f"p/f{k % 9}.py::g{k:02}", "FUNCTION", f"g{k:02}", f"p/f{k % 9}.py", k) for k in range(30)]
    nodes += [(f"p/f{k}.py::M", "MODULE", f"f{k}", f"p/f{k}.py", -1) for k in range(9)]
    classes, ids = [n[0] for n in nodes[:12]], [n[0] for n in nodes]
    edges = [(i.rsplit(".m", 1)[0], i, "PARENT_CHILD", 0) for i in ids if ".m" in i]
    edges += [(c, classes[rng.choice([0, 1, rng.randrange(12)])], "INHERITS", 0) for c in classes for _ in range(2)]
    edges += [(*rng.sample(ids, 2), "CALLS", k) for k in range(60)] + [(f"p/f{rng.randrange(9)}.py::M", f"p/f{rng.randrange(9)}.py::M", "IMPORTS", k) for k in range(40)]
    nodes = spark.createDataFrame(nodes, "id string, type string, name string, file string, ord long")
    edges = spark.createDataFrame(edges, "src string, dst string, relation_type string, ord long")
    seeds = nodes.select(F.col("id").alias("seed"))
    whole = [mode(seeds, nodes, edges) for mode in (structure.siblings, structure.inheritance, structure.dependencies, structure.co_dependents)]
    every = structure.best_per_node(structure.together(*whole), "seed").toPandas().sort_values(["seed", "score", "node"], ascending=[True, False, True])
    for k in (1, 5):
        want = every.groupby("seed").head(k)
        found = structure.related(seeds, nodes, edges, k).toPandas()
        assert sorted(map(tuple, found[["seed", "node", "score", "reason"]].values)) == sorted(map(tuple, want[["seed", "node", "score", "reason"]].values))
    most = structure.siblings(seeds, nodes, edges, 5).groupBy("seed", "reason").count().agg(F.max("count")).first()[0]
    assert most <= 5 + structure.PER_FILE + 1 < whole[0].groupBy("seed", "reason").count().agg(F.max("count")).first()[0]
