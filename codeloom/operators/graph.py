"""The typed property graph as two tables, nodes and edges, and questions about it as joins.

nodes: id, type, name, file, ord; edges: src, dst, relation_type, ord.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.scratch import written


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node or edge), type (null: all), n."""
    one = lambda df, kind, column: df.rollup(column).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.col(column).alias("type"), "n")
    return one(nodes, "node", "type").unionByName(one(edges, "edge", "relation_type"))


def siblings(children: DataFrame) -> DataFrame:
    """src, dst: consecutive definitions of one parent. children: (parent, id, ord)."""
    after = F.lead("id").over(Window.partitionBy("parent").orderBy("ord", "id"))
    return children.select(F.col("id").alias("src"), after.alias("dst")).where("dst IS NOT NULL")


def degrees(edges: DataFrame) -> DataFrame:
    """id, n_out, n_in: distinct neighbours each way."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n_out"))
    into = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    return out.join(into, "id", "full").fillna(0, ["n_out", "n_in"])


def ranked_resolution(uses: DataFrame, definitions: DataFrame, unique: bool) -> DataFrame:
    """use, definition, tier: candidates of the nearest tier. uses: (use, name, near); definitions: (definition, name, near).

    Tier 1 is the same scope, tier 2 any. With unique, a tier counts only if it has one candidate, and uses without one get a null.
    A name's candidates are counted before uses meet them: uses only meet those of their own tier, and with unique none but the one.
    """
    one = lambda *keys: definitions.groupBy(*keys).agg(F.count("*").alias("n"), F.min("definition").alias("one"))
    near = one("name", F.col("near").alias("_near")).where("_near IS NOT NULL").select(F.col("name").alias("_name"), "_near", F.col("n").alias("near_n"), F.col("one").alias("near_one"))
    told = uses.join(near, (F.col("name") == F.col("_name")) & (F.col("near") == F.col("_near")), "left").select("use", "name", "near", F.coalesce("near_n", F.lit(0)).alias("near_n"), "near_one")
    if not unique:
        # Repeated rows of a use and name share a tier.
        told = told.withColumn("best", F.max("near_n").over(Window.partitionBy("use", "name")) > 0).select("use", "name", "near", "best")
        inner = told.where("best").join(definitions, ["name", "near"]).select("use", "name", "definition", F.lit(1).alias("tier"))
        return inner.unionByName(told.where("NOT best").join(definitions.select("name", "definition"), "name").select("use", "name", "definition", F.lit(2).alias("tier")))
    every = one("name").select(F.col("name").alias("_name"), F.col("n").alias("all_n"), F.col("one").alias("all_one"))
    told = told.join(every, F.col("name") == F.col("_name"), "left")
    counted = told.groupBy("use", "name").agg(F.sum("near_n").alias("near_n"), F.max("near_one").alias("near_one"), F.sum(F.coalesce("all_n", F.lit(0))).alias("all_n"), F.max("all_one").alias("all_one"))
    tier = F.when(F.col("use").isNull(), None).when(F.col("near_n") == 1, 1).when((F.col("near_n") == 0) & (F.col("all_n") == 1), 2)
    found = counted.withColumn("tier", tier)
    return found.select("use", "name", F.when(F.col("tier") == 1, F.col("near_one")).when(F.col("tier") == 2, F.col("all_one")).alias("definition"), "tier")


def overrides(inherits: DataFrame, methods: DataFrame) -> DataFrame:
    """src, dst: methods with the name of a method of the parent class. inherits: (child, parent); methods: (owner, name, id)."""
    child = methods.select(F.col("owner").alias("child"), "name", F.col("id").alias("src"))
    parent = methods.select(F.col("owner").alias("parent"), "name", F.col("id").alias("dst"))
    return inherits.join(child, "child").join(parent, ["parent", "name"]).select("src", "dst").distinct()


def inherit_depth(nodes: DataFrame, inherits: DataFrame, rounds: int | None = None) -> DataFrame:
    """id, depth: steps to the top along first parents, each node of the way counted once where it ends in a cycle; with `rounds` at most so many. inherits: (child, parent, ord)."""
    first = inherits.groupBy("child").agg(F.min_by("parent", "ord").alias("parent")).where("child IS NOT NULL AND parent IS NOT NULL")
    ways, left = to_tops(first.select(F.col("child").alias("id"), F.col("parent").alias("at")))
    found = ways.where("NOT open").select("id", "steps")
    if left:
        found = found.unionByName(cycle_depths(ways.where("open"), left))
    depth = F.coalesce("steps", F.lit(0))
    own = nodes.select("id").distinct().join(found.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    return own.select("id", (depth if rounds is None else F.least(depth, F.lit(rounds))).alias("depth"))


def to_tops(links: DataFrame) -> tuple[DataFrame, int]:
    """id, next, at, steps, open: how far the top of each node is; open ones lead into a cycle, and their number. links: (id, at), one of each id.

    Each round joins two ways to one of twice the length. Where a way of 2^k steps is not the last, some way of 2^k + 1 to 2^(k+1) is,
    unless all that are left go round in cycles: a round that closes none ends it.
    """
    owner = links.select(F.col("id").alias("_id"))
    ways = written(links.join(owner, F.col("at") == F.col("_id"), "left").select("id", F.col("at").alias("next"), "at", F.lit(1).alias("steps"), F.col("_id").isNotNull().alias("open")), "ways")
    left = ways.where("open").count()
    while left:
        more = ways.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("open").alias("_open"))
        longer = ways.where("open").join(more, F.col("at") == F.col("_id")).select("id", "next", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_open").alias("open"))
        ways = written(ways.where("NOT open").unionByName(longer), "ways")
        was, left = left, ways.where("open").count()
        if was == left:
            break
    return ways, left


def cycle_depths(ways: DataFrame, n: int) -> DataFrame:
    """id, steps of the n nodes whose ways end in cycles: to the cycle, and round it but for the last step. ways: (id, next)."""
    links = written(ways.select("id", F.col("next").alias("at")), "links")
    far, length = links, 1
    while length < n:
        far = written(far.join(far.select(F.col("id").alias("_id"), F.col("at").alias("_at")), F.col("at") == F.col("_id")).select("id", F.col("_at").alias("at")), "far")
        length *= 2
    inner = written(far.select(F.col("at").alias("id")).distinct(), "inner")  # after n steps a way is on its cycle, and meets all of it
    label = written(links.join(inner, "id", "left_semi").select("id", "at", F.col("id").alias("label")), "label")
    while True:
        ahead = label.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("label").alias("_label"))
        label = written(label.join(ahead, F.col("at") == F.col("_id")).select("id", F.col("_at").alias("at"), F.least("label", "_label").alias("label"), (F.col("_label") < F.col("label")).alias("lower")), "label")
        if label.where("lower").isEmpty():
            break
    size = label.groupBy("label").agg((F.count("*") - 1).cast("int").alias("round"))
    on = written(label.join(size, "label").select("id", "round"), "round")
    outside, _ = to_tops(links.join(inner, "id", "left_anti"))
    to_it = outside.join(on.withColumnRenamed("id", "_id"), F.col("at") == F.col("_id")).select("id", (F.col("steps") + F.col("round")).alias("steps"))
    return on.select("id", F.col("round").alias("steps")).unionByName(to_it)


def co_dependents(imports: DataFrame, least: float = 0.3, k: int = 10, of: DataFrame | None = None) -> DataFrame:
    """a, b, score: files with similar import sets, the best k of each, or of the files `of` alone. imports: (file, target).

    Only files that share a target meet, and only where the sizes of their sets allow a cosine above `least`; self-imports don't count.
    """
    pairs = imports.where("file <> target").select("file", "target").distinct()
    size = pairs.groupBy("file").agg(F.count("*").alias("n"))
    left, right = (pairs.join(size, "file").select(F.col("file").alias(f), "target", F.col("n").alias(n)) for f, n in (("a", "na"), ("b", "nb")))
    left = left if of is None else left.join(of.select(F.col("file").alias("a")), "a", "left_semi")
    # The cosine is at most sqrt(smaller / larger).
    fits = F.least("na", "nb") >= (least * least - 1e-9) * F.greatest("na", "nb")
    both = left.join(right, "target").where(F.col("a") != F.col("b")).where(fits).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    close = both.withColumn("sim", F.col("c") / F.sqrt(F.col("na") * F.col("nb"))).where(F.round("sim", 9) > least)
    scored = close.select("a", "b", F.round(F.col("sim") * 0.85, 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return scored.withColumn("place", place).where(F.col("place") <= k).drop("place")


def best_per_node(found: DataFrame, *keys: str) -> DataFrame:
    """The best score of each key; of equal ones the first by ord. found: (*keys, node, score, reason, ord)."""
    best = F.max_by(F.struct("score", "reason"), F.struct("score", -F.col("ord"))).alias("best")
    return found.groupBy(*keys, "node").agg(best).select(*keys, "node", "best.score", "best.reason")


def structural(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """seed, node, score, reason: neighbours by file and by call edges. nodes: (id, file); edges: (src, dst)."""
    a, b = nodes.select(F.col("id").alias("seed"), "file"), nodes.select(F.col("id").alias("node"), "file")
    same = a.join(b, "file").select("seed", "node", F.lit(0.70).alias("score"), F.lit("same file").alias("reason"), F.lit(3).alias("ord"))
    callers = edges.select(F.col("dst").alias("seed"), F.col("src").alias("node"), F.lit(0.85), F.lit("caller"), F.lit(1))
    callees = edges.select(F.col("src").alias("seed"), F.col("dst").alias("node"), F.lit(0.80), F.lit("callee"), F.lit(2))
    return best_per_node(same.union(callers).union(callees).where("seed <> node"), "seed")


def best_calls(calls: DataFrame) -> DataFrame:
    """One row for each (src, dst): the most confident, of equal ones the first. calls: (src, dst, confidence, kind, ord)."""
    best = F.max_by(F.struct("confidence", "kind"), F.struct("confidence", -F.col("ord"))).alias("best")
    return calls.where("src <> dst").groupBy("src", "dst").agg(best).select("src", "dst", "best.confidence", "best.kind", (F.col("best.confidence") >= 0.75).alias("high"))
