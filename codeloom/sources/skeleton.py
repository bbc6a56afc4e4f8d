"""Skeleton nodes with all that their texts need, a graph as one JSON document, comments, file depths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import nodetext
from codeloom.sources.deepen import ident, skeleton_graph

#: What a stored node and edge have.
NODE = "id string, type string, name string, qualified_name string, file string, start_line int, end_line int, code string, comment string, signature string, docstring string, method_names array<string>"
EDGE = "src string, dst string, relation_type string"


def method_summaries(found: DataFrame) -> DataFrame:
    """class, methods (name, signature, docstring, decorators, line, is_async, in order) of the classes; methods of inner classes aren't theirs."""
    own = found.where("kind = 'def' AND type = 'METHOD'")
    one = F.struct("ord", F.element_at(F.split("name", r"\."), -1).alias("name"), "signature", "docstring", "decorators", F.col("start_line").alias("line"), "is_async")
    grouped = own.groupBy(ident("owner").alias("class")).agg(F.array_sort(F.collect_list(one)).alias("methods"))
    return grouped.select("class", F.transform("methods", lambda m: m.dropFields("ord")).alias("methods"))


def aliases(found: DataFrame) -> DataFrame:
    """file, imports, from_imports: maps of local names to what they stand for; of a repeated name the last."""
    named = found.where("kind = 'alias'").groupBy("file", F.col("owner").alias("form"), "name").agg(F.max_by("type", "ord").alias("of"))
    pairs = lambda form: F.map_from_entries(F.collect_list(F.when(F.col("form") == form, F.struct("name", "of"))))
    return named.groupBy("file").agg(pairs("import").alias("imports"), pairs("from").alias("from_imports"))


def described_skeleton(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes as NODE with decorators, bases, unresolved_bases and methods, and edges, of `skeleton_graph`; code is the node's skeleton text."""
    nodes, edges = skeleton_graph(found)
    top = found.where("kind = 'def' AND owner = ''").withColumn("id", ident("name"))
    facts = top.groupBy("id").agg(F.max_by(F.struct("signature", "docstring", "decorators", "is_async", "start_line", "end_line"), "ord").alias("f"))
    modules = found.where("kind = 'module'").select("file", F.coalesce("docstring", F.lit("")).alias("doc"))
    known = nodes.where("type = 'CLASS'").select(F.col("id").alias("dst"), F.col("name").alias("base"))
    resolved = edges.where("relation_type = 'INHERITS'").join(known, "dst").select("src", "base")
    bases = found.where("kind = 'base'").select(ident("owner").alias("src"), F.col("name").alias("base"), "ord").join(resolved.withColumn("there", F.lit(True)), ["src", "base"], "left")
    ordered = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("ord", "base")))), lambda b: b["base"])
    listed = bases.groupBy(F.col("src").alias("id")).agg(ordered(F.lit(True)).alias("bases"), ordered(F.col("there").isNull()).alias("unresolved_bases"))
    joined = nodes.join(facts, "id", "left").join(method_summaries(found).withColumnRenamed("class", "id"), "id", "left").join(listed, "id", "left").join(modules, "file", "left").join(aliases(found), "file", "left")
    none, nothing = F.array().cast("array<string>"), F.col("methods")
    methods = F.when(F.col("type") == "CLASS", nothing)
    empty = F.from_json(F.lit("[]"), found.sparkSession.createDataFrame([], "a array<struct<name:string,signature:string,docstring:string,decorators:array<string>,line:int,is_async:boolean>>").schema["a"].dataType)
    no_aliases = F.create_map().cast("map<string,string>")
    text = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(""))
    full = joined.select(
        "id", "type", "name", "qualified_name", "file", F.coalesce("f.start_line", F.lit(0)).alias("start_line"), F.coalesce("f.end_line", F.lit(0)).alias("end_line"), F.lit("").alias("comment"),
        text("signature").alias("signature"), F.when(F.col("type") == "MODULE", F.col("doc")).otherwise(text("docstring")).alias("docstring"), F.coalesce("f.decorators", none).alias("decorators"), F.coalesce("f.is_async", F.lit(False)).alias("is_async"),
        F.coalesce("bases", none).alias("bases"), F.coalesce("unresolved_bases", none).alias("unresolved_bases"), F.coalesce(methods, empty).alias("methods"),
        F.coalesce("imports", no_aliases).alias("imports"), F.coalesce("from_imports", no_aliases).alias("from_imports"),
    )
    c = F.col
    code = F.when(c("type") == "CLASS", nodetext.class_skeleton(c("name"), c("signature"), c("decorators"), c("docstring"), c("methods")))
    code = code.when(c("type") == "FUNCTION", nodetext.function_skeleton(c("name"), c("signature"), c("decorators"), c("docstring"), c("is_async"))).otherwise(nodetext.import_summary(c("docstring"), c("imports"), c("from_imports")))
    return full.withColumn("code", code).withColumn("method_names", F.transform("methods", lambda m: m["name"])), edges


def write_graph_json(nodes: DataFrame, edges: DataFrame, depths: DataFrame, folder: str, root: str = "") -> None:
    """A graph as rows of JSON, a folder for nodes, edges, depths (file, depth) and the head; no row passes the driver."""
    for name, df in (("nodes", nodes), ("edges", edges), ("file_depth", depths), ("graph", nodes.sparkSession.createDataFrame([(root,)], "repo_root string"))):
        df.write.mode("overwrite").json(f"{folder}/{name}")


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges, depths from such a folder or from one document {repo_root, nodes, edges, file_depth}; unknown keys go, missing ones are empty."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        doc = whole.select(F.from_json("value", f"repo_root string, nodes array<struct<{NODE.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array')}>>, edges array<struct<{EDGE.replace(' string', ':string')}>>, file_depth map<string,string>").alias("g"))
        nodes, edges = (doc.select(F.explode(f"g.{n}").alias("x")).select("x.*") for n in ("nodes", "edges"))
        depths = doc.select(F.explode("g.file_depth").alias("file", "depth"))
    else:
        nodes, edges = spark.read.schema(NODE).json(f"{path}/nodes"), spark.read.schema(EDGE).json(f"{path}/edges")
        depths = spark.read.schema("file string, depth string").json(f"{path}/file_depth")
    texts = [f.name for f in nodes.schema if f.dataType.simpleString() == "string" and f.name != "id"]
    return nodes.fillna("", texts).fillna(0).withColumn("method_names", F.coalesce("method_names", F.array().cast("array<string>"))), edges, depths


def with_comments(nodes: DataFrame, comments: DataFrame, ids: list[str] | None = None, types: list[str] | None = None, skip_if_exists: bool = True) -> DataFrame:
    """nodes with the comments (id, comment) that apply: to the ids and types asked for, and, with skip_if_exists, only where none is."""
    joined = nodes.join(comments.select("id", F.col("comment").alias("_new")), "id", "left")
    takes = F.trim(F.coalesce("_new", F.lit(""))) != ""
    if ids is not None:
        takes &= F.col("id").isin(ids) if ids else F.lit(False)
    if types is not None:
        takes &= F.col("type").isin(types)
    if skip_if_exists:
        takes &= F.trim(F.coalesce("comment", F.lit(""))) == ""
    return joined.withColumn("comment", F.when(takes, F.col("_new")).otherwise(F.col("comment"))).drop("_new")


def to_annotate(nodes: DataFrame, types: list[str], skip_if_exists: bool = True) -> DataFrame:
    """The nodes that a comment is wanted for: of these types, with code, and, with skip_if_exists, without a comment."""
    wanted = nodes.where(F.col("type").isin(types) & (F.trim(F.coalesce("code", F.lit(""))) != ""))
    return wanted.where(F.trim(F.coalesce("comment", F.lit(""))) == "") if skip_if_exists else wanted


def annotated(nodes: DataFrame, comment_of, types: list[str], retries: int = 2, skip_if_exists: bool = True) -> DataFrame:
    """id, comment, status (ok or failed): comment_of(batch of codes) gives a comment for each, in Arrow batches of nodes that want one.

    A batch that fails is tried again, `retries` times, then each of its nodes is marked as failed.
    """
    import pandas as pd

    def made(batches):
        for batch in batches:
            status, comments = "failed", [""] * len(batch)
            for _ in range(retries + 1):
                try:
                    comments, status = list(comment_of(list(batch["code"]))), "ok"
                    break
                except Exception as e:  # whatever the service raises is told in the rows
                    comments = [f"[annotation failed: {e}]"] * len(batch)
            yield pd.DataFrame({"id": batch["id"], "comment": comments, "status": status})

    return to_annotate(nodes, types, skip_if_exists).select("id", "code").mapInPandas(made, "id string, comment string, status string")


def with_depths(depths: DataFrame, changes: DataFrame) -> DataFrame:
    """file, depth after changes (file, depth)."""
    return depths.join(changes.select("file"), "file", "left_anti").unionByName(changes.select("file", "depth"))


def of_depth(files: DataFrame, depths: DataFrame, depth: str | None = None) -> DataFrame:
    """file, depth (empty where it isn't known) of the files, of all depths or of one."""
    told = files.select("file").distinct().join(depths, "file", "left").fillna("", ["depth"])
    return told if depth is None else told.where(F.col("depth") == depth)
