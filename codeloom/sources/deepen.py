"""The skeleton graph of a source tree, and what a deepening of some of its files adds: methods, and calls by a ladder of rules.

Files are parsed once, each by itself; everything that looks across files is a join. A deepening takes a set of files and
resolves their calls against the skeleton and the methods of the whole set, so its result doesn't depend on an order of files.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.graph import best_calls
from codeloom.sources.repo import import_edges

#: Kind and confidence of each rule, in the order in which they are tried; where there are two, the first candidate has the first.
LADDER = {
    "constructor_init": (0.90, 0.90),
    "constructor_class": (0.75, 0.75),
    "same_file_direct_function": (0.90, 0.90),
    "from_import_alias": (0.85, 0.85),
    "global_name_fallback": (0.25, 0.25),
    "self_method": (1.00, 0.92),
    "cls_method": (0.95, 0.88),
    "super_method": (0.95, 0.95),
    "self_attr_inferred_type": (0.80, 0.80),
    "object_inferred_type": (0.78, 0.78),
    "class_method_or_static_method": (0.88, 0.88),
    "import_alias_attribute": (0.85, 0.85),
    "from_import_alias_attribute": (0.78, 0.78),
    "same_file_attribute_name_fallback": (0.35, 0.35),
}
MOST = 3
CALL_FACTS = "file string, caller string, owner string, ord int, form string, base string, name string, hints array<string>, module string, imported string"


def annotated(node: ast.AST | None) -> str:
    """The type that an annotation names, the first inner one of a subscript; empty if none."""
    match node:
        case ast.Name():
            return node.id
        case ast.Attribute():
            return node.attr
        case ast.Subscript(slice=ast.Tuple(elts=inner)):
            return next(filter(None, map(annotated, inner)), "")
        case ast.Subscript():
            return annotated(node.slice)
        case ast.Constant(value=str()):
            return node.value.split(".")[-1].strip("'\"")
    return ""


def spoken(node: ast.AST) -> tuple[str, str]:
    """What a value is read from: form (self, cls, super, self_attr, object or other) and the name."""
    match node:
        case ast.Name(id="self" | "cls"):
            return node.id, node.id
        case ast.Name():
            return "object", node.id
        case ast.Call(func=ast.Name(id="super")):
            return "super", ""
        case ast.Attribute(value=ast.Name(id="self")):
            return "self_attr", node.attr
    return "other", ""


def hints_of(function: ast.FunctionDef | ast.AsyncFunctionDef, returns: dict[str, str]) -> dict[tuple[str, str], list[str]]:
    """(form, name) to the types it may have, the latest first: `=T` for a stated type, `?T` if a class of that name exists."""
    a, out = function.args, {}

    def note(target: ast.AST, types: list[str]):
        form, name = spoken(target)
        if types and form in ("object", "self_attr"):
            out[form, name] = types + out.get((form, name), [])

    for x in [*a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]:
        if t := annotated(x.annotation):
            out["object", x.arg] = [f"={t}"]
    for x in ast.walk(function):
        if isinstance(x, ast.AnnAssign) and (t := annotated(x.annotation)):
            note(x.target, [f"={t}"])
        elif isinstance(x, ast.Assign) and isinstance(x.value, ast.Call):
            made = x.value.func
            types = [f"?{made.attr}"] if isinstance(made, ast.Attribute) else [f"?{made.id}"] if isinstance(made, ast.Name) else []
            if isinstance(made, ast.Name) and made.id in returns:
                types.append(f"={returns[made.id]}")
            for target in x.targets:
                note(target, types)
    return out


def call_facts_of(file: str, content: bytes) -> Iterator[tuple]:
    try:
        tree = ast.parse(content.decode("utf-8", "replace"))
    except (SyntaxError, ValueError):
        return
    modules, imported = {}, {}
    for x in tree.body:
        if isinstance(x, ast.Import):
            modules |= {n.asname or n.name.split(".")[0]: n.name for n in x.names}
        elif isinstance(x, ast.ImportFrom):
            stem = "." * x.level + (x.module or "")
            imported |= {n.asname or n.name: f"{stem}.{n.name}" if stem else n.name for n in x.names if n.name != "*"}
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    returns = {x.name: t for x in ast.walk(tree) if isinstance(x, functions) and (t := annotated(x.returns))}
    defined = [("", x) for x in tree.body if isinstance(x, functions)]
    defined += [(c.name, x) for c in tree.body if isinstance(c, ast.ClassDef) for x in c.body if isinstance(x, functions)]
    place = 0
    for owner, function in defined:
        hints, caller = hints_of(function, returns), f"{owner}.{function.name}" if owner else function.name
        for x in (n for stmt in function.body for n in ast.walk(stmt) if isinstance(n, ast.Call)):
            place += 1
            if isinstance(x.func, ast.Name):
                n = x.func.id
                yield file, caller, owner, place, "name", n, n, hints.get(("object", n), []), modules.get(n), imported.get(n)
            elif isinstance(x.func, ast.Attribute):
                form, base = spoken(x.func.value)
                named = form == "object"
                yield file, caller, owner, place, form, base, x.func.attr, hints.get((form, base), []), modules.get(base) if named else None, imported.get(base) if named else None


def call_facts(files: DataFrame) -> DataFrame:
    """A row for each call in a method of a top-level class or in a top-level function. files: (file, content)."""

    def parse(batches):
        for batch in batches:
            yield pd.DataFrame([f for x in batch.itertuples(index=False) for f in call_facts_of(x.file, x.content)], columns=[c.split()[0] for c in CALL_FACTS.split(", ")])

    return files.mapInPandas(parse, CALL_FACTS)


def edge(df: DataFrame, src, dst, relation: str) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation_type"))


def ident(name: str):
    return F.concat_ws("::", "file", name)


def skeleton_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, type, name, qualified_name, file, ord) and edges of modules, top-level classes and functions.

    A base class is the one of its name in the file, else in the files it imports, else anywhere, where there is just one.
    """
    module = F.concat(F.col("file"), F.lit("::MODULE"))
    modules = found.where("kind = 'module'").select(module.alias("id"), F.lit("MODULE").alias("type"), F.col("file").alias("name"), F.col("file").alias("qualified_name"), "file", "ord")
    top = found.where("kind = 'def' AND owner = ''").groupBy("file", "name").agg(F.max_by("type", "ord").alias("type"), F.max("ord").alias("ord"))
    nodes = modules.unionByName(top.select(ident("name").alias("id"), "type", "name", F.col("name").alias("qualified_name"), "file", "ord"))
    classes = nodes.where("type = 'CLASS'").select(F.col("name").alias("base"), F.col("id").alias("dst"), F.col("file").alias("at"))
    imports = import_edges(found)
    reach = imports.select(F.col("src").alias("file"), F.col("dst").alias("at"), F.lit(1).alias("reach"))
    bases = found.where("kind = 'base' AND NOT contains(owner, '.')").select("file", ident("owner").alias("src"), F.col("name").alias("base")).distinct()
    tier = F.when(F.col("file") == F.col("at"), 0).when(F.col("reach") == 1, 1).otherwise(2)
    tiers = bases.join(classes, "base").where("src <> dst").join(reach, ["file", "at"], "left").groupBy("src", "base", tier.alias("tier")).agg(F.min("dst").alias("dst"), F.count("*").alias("n"))
    alone = (F.col("n") == 1) & ((F.col("tier") < 2) | (F.sum("n").over(Window.partitionBy("src", "base")) == 1))
    one = tiers.withColumn("alone", alone).where("alone").groupBy("src", "base").agg(F.min_by("dst", "tier").alias("dst"))
    edges = edge(top, module, ident("name"), "CONTAINS").unionByName(edge(one, F.col("src"), F.col("dst"), "INHERITS"))
    return nodes, edges.unionByName(edge(imports, F.concat("src", F.lit("::MODULE")), F.concat("dst", F.lit("::MODULE")), "IMPORTS"))


def class_chain(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """class, above, depth: each class with itself and its ancestors, nearest first; cycles end."""
    inherits, classes = edges.where("relation_type = 'INHERITS'").select("src", "dst"), nodes.where("type = 'CLASS'").select("id")
    return nodes.sparkSession.sql(
        f"""WITH RECURSIVE up(class, above, depth, path) AS (
             SELECT id, id, 0, array(id) FROM {{classes}}
             UNION ALL
             SELECT up.class, i.dst, up.depth + 1, array_append(up.path, i.dst) FROM up JOIN {{inherits}} i ON i.src = up.above
             WHERE NOT array_contains(up.path, i.dst) AND up.depth < {rounds})
           SELECT class, above, min(depth) AS depth FROM up GROUP BY class, above""",
        classes=classes, inherits=inherits,
    )


def first_candidates(df: DataFrame, keys: list[str], *order, most: int = MOST) -> DataFrame:
    """rank 1, 2, ... of the first few of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def imported_candidates(wanted: DataFrame, named: DataFrame) -> DataFrame:
    """qname, name, dst, rank: nodes of a name that fit an imported name best by its path. wanted: (qname, name); named: (name, dst, qualified_name, at, nth)."""
    q = F.regexp_replace("qname", r"^\.+|\.+$", "")
    parts = F.filter(F.split(q, r"\."), lambda p: p != "")
    module = F.replace(F.replace(F.col("at"), F.lit("/"), F.lit(".")), F.lit(".py"), F.lit(""))
    before = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    near = F.get(parts, F.size(parts) - 2)
    score = F.when((q != "") & F.endswith("qualified_name", q), 5).otherwise(0) + F.when(F.col("name") == F.get(parts, F.size(parts) - 1), 2).otherwise(0)
    score = score + F.when((F.size(parts) >= 2) & F.contains(module, near), 3).otherwise(0) + F.exists(before, lambda p: F.contains(module, p)).cast("int")
    scored = wanted.distinct().join(named, "name").withColumn("fit", score).where("fit > 0")
    return first_candidates(scored, ["qname", "name"], F.desc("fit"), "at", "nth").select("qname", "name", "dst", "rank")


def resolved_calls(calls: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """file, ord, src, dst, kind, confidence: for each call the candidates of the first rule that has any, at most three.

    nodes and edges: the graph with the methods known so far (id, type, name, qualified_name, file, ord; PARENT_CHILD, INHERITS).
    """
    call = calls.withColumn("src", ident("caller")).withColumn("class", F.when(F.col("owner") != "", ident("owner")))
    inner = nodes.where("type <> 'MODULE'").select("name", F.col("id").alias("dst"), "type", "qualified_name", F.col("file").alias("at"), F.col("ord").alias("nth"))
    classes = inner.where("type = 'CLASS'").select("name", F.col("dst").alias("class"), "at", "nth")
    owned = edges.where("relation_type = 'PARENT_CHILD'").select(F.col("src").alias("above"), F.col("dst"))
    methods = owned.join(inner.where("type = 'METHOD'").select("dst", "name"), "dst")
    on_chain = class_chain(nodes, edges).join(methods, "above").select("class", "depth", "name", "dst", "above")
    key = ["file", "ord"]
    kept = lambda df, kind: df.select(*key, "src", "dst", F.lit(kind).alias("kind"), "rank")

    names, others = call.where("form = 'name'"), call.where("form <> 'name'")
    hinted = call.select(*key, "form", "src", "name", "base", F.posexplode("hints").alias("pos", "hint"))
    exists_ = classes.select(F.concat(F.lit("?"), "name").alias("hint"), F.lit(1).alias("there")).distinct()
    typed = hinted.join(exists_, "hint", "left").where("startswith(hint, '=') OR there = 1").groupBy(*key, "form", "src", "name").agg(F.substring(F.min_by("hint", "pos"), 2, 1 << 20).alias("type_name"))

    made = first_candidates(names.join(classes.withColumnRenamed("class", "_class"), "name"), key, F.col("file") != F.col("at"), "at", "nth")
    init = methods.where("name = '__init__'").groupBy(F.col("above").alias("_class")).agg(F.min("dst").alias("init"))
    made = made.join(init, "_class", "left").withColumn("dst", F.coalesce("init", "_class"))
    built = made.select(*key, "src", "dst", F.when(F.col("init").isNotNull(), "constructor_init").otherwise("constructor_class").alias("kind"), "rank")
    near = names.join(inner.where("type = 'FUNCTION'").select("name", "dst", F.col("at").alias("file"), "nth"), ["file", "name"])

    # Methods on the chain of a class: the caller's own, or those of a type's name, where those of the same file come first.
    own = F.create_map(*(F.lit(x) for f in ("self", "cls", "super") for x in (f, f"{f}_method")))[F.col("form")]
    far = lambda *c: F.struct(*(x.alias(n) for n, x in zip(("far", "at", "nth"), c, strict=True)))
    mine = call.where("form IN ('self', 'cls', 'super') AND class IS NOT NULL").select(*key, "src", "name", own.alias("kind"), "class", far(F.lit(False), F.lit(""), F.lit(0)).alias("o"))
    by_type = typed.where("form = 'self_attr'").select(*key, "src", "name", F.lit("self_attr_inferred_type").alias("kind"), "type_name")
    by_type = by_type.unionByName(typed.where("form = 'object'").select(*key, "src", "name", F.lit("object_inferred_type").alias("kind"), "type_name"))
    by_type = by_type.unionByName(call.where("form = 'object'").select(*key, "src", "name", F.lit("class_method_or_static_method").alias("kind"), F.col("base").alias("type_name")))
    there = classes.select(F.col("name").alias("type_name"), "class", "at", "nth")
    asked = mine.unionByName(by_type.join(there, "type_name").select(*key, "src", "name", "kind", "class", far(F.col("file") != F.col("at"), F.col("at"), F.col("nth")).alias("o")))
    met = asked.join(on_chain, ["class", "name"]).where((F.col("kind") != "super_method") | (F.col("depth") > 0))
    once = met.groupBy(*key, "src", "kind", "dst").agg(F.min(F.struct("o", "depth")).alias("o"))
    chained = first_candidates(once, [*key, "kind"], "o", "dst").select(*key, "src", "dst", "kind", "rank")

    attr = lambda c: F.concat(F.col(c), F.lit("."), F.col("name"))
    ways = ((names, F.col("imported"), "from_import_alias"), (others, attr("module"), "import_alias_attribute"), (others, attr("imported"), "from_import_alias_attribute"))
    wanted = [df.select(*key, "src", "name", q.alias("qname"), F.lit(k).alias("kind")).where("qname IS NOT NULL") for df, q, k in ways]
    wanted = wanted[0].unionByName(wanted[1]).unionByName(wanted[2])
    named = inner.select("name", "dst", "qualified_name", "at", "nth")
    by_import = wanted.join(imported_candidates(wanted.select("qname", "name"), named), ["qname", "name"]).select(*key, "src", "dst", "kind", "rank")

    callable_ = inner.where("type IN ('FUNCTION', 'METHOD')")
    few = first_candidates(callable_, ["name"], "at", "nth", most=MOST + 1).select("name", "dst", F.col("rank").alias("nth"))
    unknown = names.where("module IS NULL AND imported IS NULL").join(typed.select(*key), key, "left_anti")
    anywhere = first_candidates(unknown.join(few, "name").where("src <> dst"), key, "nth")
    beside = others.where("module IS NULL").join(callable_.select("name", "dst", F.col("at").alias("file"), "nth"), ["file", "name"]).where("src <> dst")
    rungs = [
        chained,
        by_import,
        kept(near.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("nth"))), "same_file_direct_function"),
        kept(anywhere, "global_name_fallback"),
        kept(first_candidates(beside, key, "nth"), "same_file_attribute_name_fallback"),
    ]
    every = built
    for rung in rungs:
        every = every.unionByName(rung)
    rules = F.create_map(*(F.lit(x) for i, k in enumerate(LADDER) for x in (k, max(i, 1))))  # both constructors are one rule
    first, rest = (F.create_map(*(F.lit(x) for k, v in LADDER.items() for x in (k, v[n]))) for n in (0, 1))
    tried = every.withColumn("rule", rules[F.col("kind")]).withColumn("best", F.min("rule").over(Window.partitionBy(*key))).where("rule = best")
    return tried.select(*key, "src", "dst", "kind", F.when(F.col("rank") == 1, first[F.col("kind")]).otherwise(rest[F.col("kind")]).alias("confidence"))


def deepened(found: DataFrame, calls: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New nodes (METHOD) and new edges, CALLS with confidence, kind and high. found: facts, calls: call facts, files: (file) to deepen."""
    nodes, edges = skeleton_graph(found)
    chosen = files.select("file").distinct()
    top = nodes.where("type = 'CLASS'").select("file", F.col("name").alias("owner"))
    inside = found.where("kind = 'def' AND type = 'METHOD'").join(chosen, "file", "left_semi").join(top, ["file", "owner"], "left_semi")
    rows = inside.select(ident("name").alias("id"), F.lit("METHOD").alias("type"), F.element_at(F.split("name", r"\."), -1).alias("name"), F.col("name").alias("qualified_name"), "file", "ord", ident("owner").alias("owner"))
    methods = rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns[1:]), "ord").alias("v")).select("id", "v.*")
    under = edge(methods, F.col("owner"), F.col("id"), "PARENT_CHILD")
    after = F.lead("id").over(Window.partitionBy("owner").orderBy("ord"))
    sibling = edge(rows.withColumn("after", after).where("after IS NOT NULL"), F.col("id"), F.col("after"), "SIBLING")
    mine, theirs = methods.select(F.col("owner").alias("c"), F.col("id").alias("a"), "name"), methods.select(F.col("owner").alias("p"), F.col("id").alias("b"), "name")
    over = edges.where("relation_type = 'INHERITS'").select(F.col("src").alias("c"), F.col("dst").alias("p")).join(mine, "c").join(theirs, ["p", "name"])
    added = under.unionByName(sibling).unionByName(edge(over, F.col("a"), F.col("b"), "OVERRIDES")).distinct()
    answers = resolved_calls(calls.join(chosen, "file", "left_semi"), nodes.unionByName(methods.drop("owner")), edges.unionByName(under))
    calling = best_calls(answers).select("src", "dst", F.lit("CALLS").alias("relation_type"), "confidence", "kind", "high")
    return methods, added.unionByName(calling, allowMissingColumns=True)
