"""Python source trees as tables: files, facts by one Arrow-batched parse, then joins.

Scanned code is parsed, never run. Facts: a row for each module, definition, import, call and base class.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values.
EXCLUDED = (".git", "__pycache__", ".tox", ".venv", "venv", "env", "node_modules", "dist", "build", ".eggs")
SKIPPED_BASES = ("object", "ABC", "Exception", "BaseException", "type")
FACTS = "file string, kind string, owner string, name string, type string, level int, start_line int, end_line int, ord int, signature string, docstring string, code string, error string, decorators array<string>, is_async boolean"


def source_files(spark: SparkSession, root: str, excluded=()) -> DataFrame:
    """file (relative path) and content of each .py file outside the excluded folders; a given set replaces the usual one.

    Spark's file readers skip empty files and names with a leading underscore, `__init__.py` among them, so the names are
    listed here and tasks read the contents, by any file system that pyarrow opens.
    """
    system, top = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    skip, top = set(excluded or EXCLUDED), top.rstrip("/")
    names = [f.path[len(top) + 1 :] for f in system.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".py")]
    kept = sorted(n for n in names if not any(p in skip or p.endswith(".egg-info") for p in n.split("/")[:-1]))

    def read(batches):
        there = fs.FileSystem.from_uri(root)[0] if "://" in root else fs.LocalFileSystem()
        for batch in batches:
            yield pd.DataFrame({"file": batch["file"], "content": [there.open_input_stream(f"{top}/{n}").read() for n in batch["file"]]})

    listed = spark.createDataFrame([(n,) for n in kept], "file string")
    return listed.repartition(max(1, min(len(kept) // 16, 512))).mapInPandas(read, "file string, content binary")


def facts_of(file: str, content: bytes) -> Iterator[tuple]:
    text, seen = content.decode("utf-8", "replace"), [0]
    lines = text.split("\n")

    def row(kind, owner="", name="", type_="", level=0, node=None, error=None):
        seen[0] += 1
        start, end = (node.lineno, node.end_lineno) if node is not None and hasattr(node, "lineno") else (0, 0)
        signature = docstring = code = ""
        decorators = [ast.unparse(d) for d in node.decorator_list] if kind == "def" else []
        if type_ == "CLASS" and node.bases:
            signature = f"({', '.join(map(ast.unparse, node.bases))})"
        if type_ in ("FUNCTION", "METHOD"):
            signature = f"({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
        if kind == "def":
            docstring, code = (ast.get_docstring(node) or "").strip().split("\n")[0], "\n".join(lines[start - 1 : end])
        return file, kind, owner, name, type_, level, start, end, seen[0], signature, docstring, code, error, decorators, isinstance(node, ast.AsyncFunctionDef)

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        yield row("module", error=str(e))
        return
    yield row("module")
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield row("import", name=a.name, node=node)
                yield row("alias", "import", a.asname or a.name.split(".")[0], type_=a.name, node=node)
        elif isinstance(node, ast.ImportFrom):
            yield row("import", name=node.module or "", level=node.level, node=node)
            if of := "." * node.level + (node.module or ""):
                for a in node.names:
                    yield row("alias", "from", a.asname or a.name, type_=f"{of}.{a.name}", node=node)

    def last(expression):
        return expression.id if isinstance(expression, ast.Name) else expression.attr if isinstance(expression, ast.Attribute) else None

    def visit(body, owner, in_class):
        for node in body:
            if isinstance(node, ast.ClassDef):
                name = f"{owner}.{node.name}" if owner else node.name
                yield row("def", owner, name, "CLASS", node=node)
                for base in map(last, node.bases):
                    if base and base not in SKIPPED_BASES:
                        yield row("base", name, base)
                yield from visit(node.body, name, True)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                name = f"{owner}.{node.name}" if owner else node.name
                yield row("def", owner, name, "METHOD" if in_class else "FUNCTION", node=node)
                for called in sorted({n for x in ast.walk(node) if isinstance(x, ast.Call) and (n := last(x.func))}):
                    yield row("call", name, called)
                yield from visit(node.body, name, False)

    yield from visit(tree.body, "", False)


def facts(files: DataFrame) -> DataFrame:
    def parse(batches):
        for batch in batches:
            yield pd.DataFrame([f for x in batch.itertuples(index=False) for f in facts_of(x.file, x.content)], columns=[c.split()[0] for c in FACTS.split(", ")])

    return files.mapInPandas(parse, FACTS)


def import_edges(found: DataFrame) -> DataFrame:
    """src, dst (files): absolute and relative imports of files in the tree; `p.py` goes before `p/__init__.py`."""
    files = found.where("kind = 'module'").select(F.col("file").alias("path")).distinct()
    folder = F.split(F.col("file"), "/")
    kept = F.array_join(F.slice(folder, 1, F.greatest(F.size(folder) - F.col("level"), F.lit(0))), "/")
    dotted = F.replace(F.col("name"), F.lit("."), F.lit("/"))
    target = F.when(F.col("level") == 0, dotted).otherwise(F.concat_ws("/", F.nullif(kept, F.lit("")), F.nullif(dotted, F.lit(""))))
    wanted = found.where("kind = 'import'").select("file", "ord", target.alias("t"), F.posexplode(F.array(F.concat(target, F.lit(".py")), F.concat(target, F.lit("/__init__.py")))).alias("prio", "path"))
    return wanted.join(files, "path").groupBy("file", "ord").agg(F.min_by("path", "prio").alias("dst")).select(F.col("file").alias("src"), "dst").distinct()


def full_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, type, name, qualified_name, file, ord, ...) and edges (src, dst, relation_type) of a source tree."""
    ident = lambda name: F.concat_ws("::", "file", name)
    module = F.concat(F.col("file"), F.lit("::MODULE"))
    modules = found.where("kind = 'module'").select(module.alias("id"), F.lit("MODULE").alias("type"), "file", F.col("file").alias("qualified_name"), F.col("file").alias("name"), "ord", "start_line", "end_line", "signature", "docstring", "code", F.col("error").alias("parse_error"))
    named = found.where("kind = 'def'").select(ident("name").alias("id"), "type", "file", F.col("name").alias("qualified_name"), F.element_at(F.split("name", r"\."), -1).alias("name"), "ord", "start_line", "end_line", "signature", "docstring", "code", F.col("error").alias("parse_error"))
    latest = named.groupBy("id").agg(F.max_by(F.struct(*named.columns[1:]), "ord").alias("v")).select("id", "v.*")
    nodes = modules.unionByName(latest)

    defs = found.where("kind = 'def'").select("file", "ord", "owner", ident("name").alias("id"), "name", "type")
    parent = F.when(F.col("owner") == "", module).otherwise(ident("owner"))
    under = defs.select(parent.alias("src"), F.col("id").alias("dst"), "ord", F.when(F.col("owner") == "", "CONTAINS").otherwise("PARENT_CHILD").alias("relation_type"))
    after = F.lead("dst").over(Window.partitionBy("src").orderBy("ord"))
    sibling = under.select(F.col("dst").alias("src"), after.alias("dst")).where("dst IS NOT NULL").withColumn("relation_type", F.lit("SIBLING"))
    imports = import_edges(found)
    imported = imports.select(F.concat("src", F.lit("::MODULE")).alias("src"), F.concat("dst", F.lit("::MODULE")).alias("dst"), F.lit("IMPORTS").alias("relation_type"))

    callable_ = latest.where("type <> 'CLASS'").select(F.col("name").alias("callee"), F.col("id").alias("dst"), F.col("file").alias("at"))
    calls = found.where("kind = 'call'").select("file", ident("owner").alias("src"), F.col("name").alias("callee")).join(callable_, "callee")
    near = (F.col("file") == F.col("at")).cast("int")
    calls = calls.withColumn("near", near).withColumn("best", F.max("near").over(Window.partitionBy("src", "callee"))).where("near = best AND src <> dst").select("src", "dst", F.lit("CALLS").alias("relation_type"))

    classes = latest.where("type = 'CLASS'").select(F.col("name").alias("base"), F.col("id").alias("dst"), F.col("file").alias("at"), F.col("ord").alias("at_ord"))
    reach = imports.select(F.col("src").alias("file"), F.col("dst").alias("at"), F.lit(1).alias("reach"))
    bases = found.where("kind = 'base'").select("file", ident("owner").alias("src"), F.col("name").alias("base")).join(classes, "base").join(reach, ["file", "at"], "left")
    tier = F.when(F.col("file") == F.col("at"), 0).when(F.col("reach") == 1, 1).otherwise(2)
    inherits = bases.groupBy("src", "base").agg(F.min_by("dst", F.struct(tier, "at", "at_ord")).alias("dst")).select("src", "dst", F.lit("INHERITS").alias("relation_type"))

    method = under.where("relation_type = 'PARENT_CHILD'").select(F.col("src").alias("owner"), F.col("dst").alias("id")).join(latest.where("type = 'METHOD'").select("id", "name"), "id")
    mine, theirs = method.select(F.col("owner").alias("c"), F.col("id").alias("src"), "name"), method.select(F.col("owner").alias("p"), F.col("id").alias("dst"), "name")
    overriding = inherits.select(F.col("src").alias("c"), F.col("dst").alias("p")).join(mine, "c").join(theirs, ["p", "name"]).select("src", "dst", F.lit("OVERRIDES").alias("relation_type"))
    edges = under.select("src", "dst", "relation_type")
    for more in (sibling, imported, calls, inherits, overriding):
        edges = edges.unionByName(more)
    return nodes, edges.distinct()
