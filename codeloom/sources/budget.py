"""Deepening as it is asked for: within a budget of files, with the methods that fit a question and the files next to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import nodetext
from codeloom.functions.text import cosine
from codeloom.operators.structure import of_type

#: Fixed values.
BUDGET, CALLS_SHOWN, HIGH_SHOWN, UNRESOLVED_SHOWN, HIGH = 20, 12, 8, 8, 0.75


def within_budget(targets: DataFrame, depths: DataFrame, budget: int = BUDGET) -> DataFrame:
    """file, decision: deepen, done (full already, or asked for before) or over_budget. targets: (ord, file); depths: (file, depth).

    What is left of the budget goes to the files that are asked for first.
    """
    first = targets.groupBy("file").agg(F.min("ord").alias("ord"))
    full = depths.where("depth = 'full'").select("file").distinct()
    spent = full.agg(F.count("*").alias("spent"))
    told = first.join(full.withColumn("full", F.lit(True)), "file", "left")
    new = told.where("full IS NULL").withColumn("nth", F.row_number().over(Window.orderBy("ord", "file"))).crossJoin(F.broadcast(spent))
    decided = new.select("file", F.when(F.col("spent") + F.col("nth") <= budget, "deepen").otherwise("over_budget").alias("decision"))
    return decided.unionByName(told.where("full").select("file", F.lit("done").alias("decision")))


def refreshed(nodes: DataFrame, full: DataFrame, files: DataFrame) -> DataFrame:
    """Skeleton nodes whose code, signature and docstring come from the full graph for functions of the deepened files."""
    taken = full.where("type = 'FUNCTION'").join(files, "file", "left_semi").select("id", *(F.col(c).alias(f"_{c}") for c in ("code", "signature", "docstring")))
    joined = nodes.join(taken, "id", "left")
    return joined.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in ("code", "signature", "docstring") else F.col(c) for c in nodes.columns))


def method_texts(nodes: DataFrame, edges: DataFrame, file: str) -> DataFrame:
    """node, text of the methods of a file that have code."""
    classes = nodes.where("type = 'CLASS'").select(F.col("id").alias("_class"), F.col("name").alias("_name"), F.col("signature").alias("_signature"), F.col("docstring").alias("_docstring"))
    parents = of_type(edges, "PARENT_CHILD", "_class", "id").groupBy("id").agg(F.min("_class").alias("_class"))
    own = nodes.where((F.col("type") == "METHOD") & (F.col("file") == file) & (F.trim("code") != ""))
    return own.join(parents, "id", "left").join(classes, "_class", "left").select(F.col("id").alias("node"), nodetext.method_text(F.col("_name"), F.col("_signature"), F.col("_docstring")).alias("text"))


def ranked_methods(vectors: DataFrame, asked: list[float], k: int = 5) -> DataFrame:
    """node, score: the k methods nearest to a question's vector. vectors: (node, vec) of one file's methods."""
    scored = vectors.select("node", F.round(cosine(F.col("vec"), F.array(*map(F.lit, asked))), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "node").limit(max(0, k))


def neighbour_files(methods: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 3) -> DataFrame:
    """file, place: files of classes next to those of the methods, in order of the methods (ord, node) and of the kinds of neighbours:
    parents, children, classes of the same file, classes of callees, classes of callers."""
    parent = of_type(edges, "PARENT_CHILD", "class", "node")
    at = methods.join(parent, "node").select("ord", "node", "class")
    up, calls = of_type(edges, "INHERITS", "class", "near"), of_type(edges, "CALLS", "node", "other")
    classes = nodes.where("type = 'CLASS'").select(F.col("id").alias("near"), "file")
    here = at.join(classes.withColumnRenamed("near", "class"), "class")
    beside = here.join(classes, "file").where("near <> class").select("ord", "near")
    owner = parent.select(F.col("node").alias("other"), F.col("class").alias("near"))
    kinds = [
        at.join(up, "class").select("ord", "near"), at.join(up.select(F.col("near").alias("class"), F.col("class").alias("near")), "class").select("ord", "near"), beside,
        at.join(calls, "node").join(owner, "other").select("ord", "near"), at.join(calls.select(F.col("other").alias("node"), F.col("node").alias("other")), "node").join(owner, "other").select("ord", "near"),
    ]
    found = kinds[0].withColumn("kind", F.lit(0))
    for k, more in enumerate(kinds[1:], 1):
        found = found.unionByName(more.withColumn("kind", F.lit(k)))
    firsts = found.join(classes, "near").groupBy("file").agg(F.min(F.struct("ord", "kind", "near")).alias("first"))
    return firsts.orderBy("first").limit(max(0, limit)).select("file", (F.row_number().over(Window.orderBy("first")) - 1).alias("place"))


def unresolved_calls(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """file, ord, caller, name of the calls that no rule answers. calls: call facts; answers: `resolved_calls`."""
    return calls.join(answers.select("file", "ord").distinct(), ["file", "ord"], "left_anti").select("file", "ord", "caller", "name")


def method_reports(methods: DataFrame, calls: DataFrame, unresolved: DataFrame) -> DataFrame:
    """node, calls, high, unresolved: for each method its surest calls, the sure ones, and names without an answer; a few of each.

    methods: (node); calls: (src, dst, kind, confidence); unresolved: (node, name).
    """
    by = Window.partitionBy("src").orderBy(F.desc("confidence"), "dst")
    few = calls.withColumn("place", F.row_number().over(by)).where(F.col("place") <= CALLS_SHOWN)
    sure = F.col("confidence") >= HIGH
    shown = few.groupBy(F.col("src").alias("node")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "dst", "kind", "confidence"))), lambda c: F.format_string("%s (%s, %.2f)", c["dst"], c["kind"], c["confidence"])).alias("calls"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(sure, F.struct("place", "dst")))), lambda c: c["dst"]), 1, HIGH_SHOWN).alias("high"),
    )
    nth = F.row_number().over(Window.partitionBy("node").orderBy("name"))
    lost = unresolved.select("node", "name").distinct().withColumn("nth", nth).where(F.col("nth") <= UNRESOLVED_SHOWN).groupBy("node").agg(F.array_sort(F.collect_list("name")).alias("unresolved"))
    none = F.array().cast("array<string>")
    return methods.select("node").join(shown, "node", "left").join(lost, "node", "left").select("node", *(F.coalesce(c, none).alias(c) for c in ("calls", "high", "unresolved")))


def relation_text(name: str = "name") -> Column:
    """A method's report in lines."""
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, "; ")))
    return F.concat_ws("\n", F.col(name), part("calls", "calls"), part("sure calls", "high"), part("unresolved", "unresolved"))
