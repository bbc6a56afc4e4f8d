"""Neighbours of seed nodes by structure: siblings, inheritance, dependencies, and all of them together.

nodes: id, type, name, file, ord; edges: src, dst, relation_type, ord. `seeds` has a column seed and is a stated set,
so what is found grows with the seeds, not with the square of a package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import package
from codeloom.operators.graph import best_per_node
from codeloom.operators.graph import co_dependents as alike_files

#: Fixed values.
SCORES = {"same class": 0.82, "same file": 0.70, "same package": 0.45, "parent": 0.92, "overridden": 0.95, "shared parent": 0.78, "child": 0.88, "caller": 0.85, "callee": 0.80, "importer": 0.70, "importee": 0.65}
PER_FILE = 5


def found(df: DataFrame, node: str, reason: str) -> DataFrame:
    """seed, node, score, reason, ord: of equal scores the first reason counts."""
    place = list(SCORES).index(reason)
    return df.select("seed", F.col(node).alias("node"), F.lit(SCORES[reason]).alias("score"), F.lit(reason).alias("reason"), F.lit(place).alias("ord"))


def together(first: DataFrame, *more: DataFrame) -> DataFrame:
    for df in more:
        first = first.unionByName(df)
    return first.where("seed <> node")


def known(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """seed, type, name, file of the seeds that are nodes."""
    return seeds.select("seed").distinct().join(nodes.select(F.col("id").alias("seed"), "type", "name", "file"), "seed")


def of_type(edges: DataFrame, relation: str, src: str, dst: str) -> DataFrame:
    return edges.where(F.col("relation_type") == relation).select(F.col("src").alias(src), F.col("dst").alias(dst)).distinct()


def first_of(df: DataFrame, most: int | None, *keys: str) -> DataFrame:
    """The rows of the first `most` nodes of each list by keys, all without `most`.

    All nodes of a list have one score, and equal scores go by node: a node is among the k best of a seed by this list only if it is
    among its first k. `most` is k and as many more as the seed may leave out of the list.
    """
    if most is None:
        return df
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy("node"))
    return df.where("node IS NOT NULL").withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def own_class(seeds: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """seed, type, name, class: a class itself, the class of a method."""
    classes = nodes.where("type = 'CLASS'").select(F.col("id").alias("class"))
    inside = seeds.where("type IN ('FUNCTION', 'METHOD')").join(of_type(edges, "PARENT_CHILD", "class", "seed"), "seed").join(classes, "class", "left_semi")
    return seeds.where("type = 'CLASS'").select("seed", "type", "name", F.col("seed").alias("class")).unionByName(inside.select("seed", "type", "name", "class"))


def siblings(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, k: int | None = None) -> DataFrame:
    """Methods of the same class, classes of the same file, and classes and functions of the package's other files.

    Here and in the next two, with k only those that can be among a seed's k best.
    """
    most = lambda out: None if k is None else k + out
    at = known(seeds, nodes)
    inside = own_class(at.where("type <> 'CLASS'"), nodes, edges).join(first_of(of_type(edges, "PARENT_CHILD", "class", "node"), most(1), "class"), "class")
    classes = nodes.where("type = 'CLASS'").select(F.col("id").alias("node"), "file")
    beside = at.where("type = 'CLASS'").join(first_of(classes, most(1), "file"), "file")
    place = F.row_number().over(Window.partitionBy("file").orderBy("ord", "id"))
    shown = nodes.where("type <> 'MODULE'").withColumn("place", place).where((F.col("place") <= PER_FILE) & F.col("type").isin("CLASS", "FUNCTION"))
    shown = shown.select(F.col("id").alias("node"), F.col("file").alias("there"), package(F.col("file")).alias("pkg"))
    around = at.withColumn("pkg", package(F.col("file"))).where("pkg <> ''").join(first_of(shown, most(PER_FILE + 1), "pkg"), "pkg").where("file <> there")
    return together(found(inside, "node", "same class"), found(beside, "node", "same file"), found(around, "node", "same package"))


def inheritance(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, k: int | None = None) -> DataFrame:
    """Parents, children and classes with a shared parent of a seed's class, and what a method overrides."""
    most = lambda out: None if k is None else k + out
    at = own_class(known(seeds, nodes), nodes, edges)
    up, down = of_type(edges, "INHERITS", "class", "parent"), of_type(edges, "INHERITS", "node", "class")
    parents = at.join(up, "class")
    named = of_type(edges, "PARENT_CHILD", "parent", "node").join(nodes.select(F.col("id").alias("node"), "name"), "node")
    overridden = parents.where("type <> 'CLASS'").join(first_of(named, most(1), "parent", "name"), ["parent", "name"])
    shared = parents.join(first_of(of_type(edges, "INHERITS", "node", "parent"), most(2), "parent"), "parent").where(F.col("node") != F.col("class"))
    return together(found(parents, "parent", "parent"), found(overridden, "node", "overridden"), found(shared, "node", "shared parent"), found(at.join(first_of(down, most(1), "class"), "class"), "node", "child"))


def dependencies(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, k: int | None = None) -> DataFrame:
    """Callers, callees, and the first class, else function, of each file that imports the seed's file or that it imports.

    A file counts once: of an import each way, the first edge tells which.
    """
    at = known(seeds, nodes)
    callers = at.join(of_type(edges, "CALLS", "node", "seed"), "seed")
    callees = at.join(of_type(edges, "CALLS", "seed", "node"), "seed")
    file_of = lambda n, f: nodes.select(F.col("id").alias(n), F.col("file").alias(f))
    imports = edges.where("relation_type = 'IMPORTS'").select("src", "dst", "ord").join(file_of("src", "a"), "src").join(file_of("dst", "b"), "dst").where("a <> b")
    ways = imports.select(F.col("b").alias("file"), F.col("a").alias("other"), "ord", F.lit("importer").alias("way")).unionByName(imports.select(F.col("a").alias("file"), F.col("b").alias("other"), "ord", F.lit("importee").alias("way")))
    once = ways.groupBy("file", "other").agg(F.min_by("way", F.struct("ord", "way")).alias("way"))
    stands = representatives(nodes).withColumnRenamed("file", "other")
    reached = once.join(stands, "other").select("file", "way", "node")
    linked = at.join(first_of(reached, None if k is None else k + 1, "file", "way"), "file")
    return together(found(callers, "node", "caller"), found(callees, "node", "callee"), *(found(linked.where(F.col("way") == w), "node", w) for w in ("importer", "importee")))


def representatives(nodes: DataFrame) -> DataFrame:
    """file, node: the first class of each file, else its first function."""
    inner = nodes.where("type IN ('CLASS', 'FUNCTION')")
    return inner.groupBy("file").agg(F.min_by("id", F.struct((F.col("type") != "CLASS").cast("int"), "ord", "id")).alias("node"))


def co_dependents(seeds: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Representatives of the files whose imports are like those of the seed's file; the score goes by their likeness."""
    at = known(seeds, nodes)
    file_of = lambda n, f: nodes.select(F.col("id").alias(n), F.col("file").alias(f))
    imports = of_type(edges, "IMPORTS", "src", "dst").join(file_of("src", "file"), "src").join(file_of("dst", "target"), "dst").select("file", "target")
    like = alike_files(imports, of=at.select("file").distinct())
    linked = at.join(like, at["file"] == like["a"]).select("seed", F.col("b").alias("file"), F.col("score").alias("likeness")).join(representatives(nodes), "file")
    return linked.where("seed <> node").select("seed", "node", F.col("likeness").alias("score"), F.lit("like imports").alias("reason"), F.lit(len(SCORES)).alias("ord"))


def related(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """seed, node, score, reason: the k best of all modes, each node once."""
    every = together(siblings(seeds, nodes, edges, k), inheritance(seeds, nodes, edges, k), dependencies(seeds, nodes, edges, k), co_dependents(seeds, nodes, edges))
    best = best_per_node(every, "seed")
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "node"))
    return best.withColumn("place", place).where(F.col("place") <= k).drop("place")


MODES = {"siblings": siblings, "inheritance": inheritance, "dependencies": dependencies, "co_dependents": co_dependents, "related": related}
