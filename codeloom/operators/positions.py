"""Where nodes stand in a graph: their calls, their inheritance, what they override; and what looks odd about a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.structure import of_type

#: Neighbours that are named.
NAMED = 5


def positions(nodes: DataFrame, edges: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """id, n_callers, n_callees, callers, callees (the first NAMED names by id), n_subclasses, n_methods, overrides, depth. depths: (id, depth) of classes.

    Names are the first by id, limited before they are shuffled, so a node that very many call costs no long list.
    """
    types, names = nodes.select("id", "type"), nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"))

    def met(relation: str, own: str, other: str) -> DataFrame:
        return of_type(edges, relation, "src", "dst").select(F.col(own).alias("id"), F.col(other).alias("other"))

    def calls(own: str, other: str, to: str) -> DataFrame:
        found = met("CALLS", own, other)
        counted = found.groupBy("id").agg(F.count("*").alias(f"n_{to}"))
        place = F.row_number().over(Window.partitionBy("id").orderBy("other"))  # a limit for each group, kept before the shuffle too
        few = found.withColumn("place", place).where(F.col("place") <= NAMED).join(names, "other")
        named = few.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "other_name"))).alias("some"))
        return counted.join(named.select("id", F.transform("some", lambda e: e["other_name"]).alias(to)), "id", "left")

    count = lambda relation, own, other, to: met(relation, own, other).groupBy("id").agg(F.count("*").alias(to))
    found = types
    for more in (
        calls("dst", "src", "callers"), calls("src", "dst", "callees"), count("INHERITS", "dst", "src", "n_subclasses"), count("PARENT_CHILD", "src", "dst", "n_methods"), count("OVERRIDES", "src", "dst", "n_overridden"),
    ):
        found = found.join(more, "id", "left")
    found = found.join(depths, "id", "left") if depths is not None else found.withColumn("depth", F.lit(0))
    of_class = lambda c: F.when(F.col("type") == "CLASS", F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    nothing = F.array().cast("array<string>")
    return found.select(
        "id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_callers", "n_callees")), *(F.coalesce(c, nothing).alias(c) for c in ("callers", "callees")),
        of_class("n_subclasses"), of_class("n_methods"), F.coalesce(F.col("n_overridden") > 0, F.lit(False)).alias("overrides"), of_class("depth"),
    )


def position_text() -> Column:
    """A position in words."""
    some = lambda c: F.array_join(F.slice(c, 1, 3), ", ")
    parts = [
        F.when(F.col("n_callers") > 0, F.format_string("called by %d functions (among them %s)", "n_callers", some("callers"))).otherwise("called by none (a leaf or an entry)"),
        F.when(F.col("n_callees") > 0, F.format_string("calls %d functions (among them %s)", "n_callees", some("callees"))), F.when(F.col("depth") > 0, F.format_string("at level %d of its inheritance", "depth")),
        F.when(F.col("n_subclasses") > 0, F.format_string("has %d subclasses", "n_subclasses")), F.when(F.col("overrides"), "overrides a parent's method"), F.when(F.col("n_methods") > 0, F.format_string("has %d methods", "n_methods")),
    ]
    return F.concat_ws("; ", *parts)


def robustness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """isolated, without_code, modules_with_children (share), most_calls, busiest: one row. Isolated and without code: of all but modules."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    inner = nodes.where("type <> 'MODULE'")
    alone = inner.join(ends, "id", "left_anti").agg(F.count("*").alias("isolated"))
    bare = inner.agg(F.count_if(F.coalesce(F.length("code"), F.lit(0)) == 0).alias("without_code"))
    parents = edges.where("relation_type = 'CONTAINS'").select(F.col("src").alias("id")).distinct().withColumn("_has", F.lit(1))
    share = nodes.where("type = 'MODULE'").join(parents, "id", "left").agg((F.count("_has") / F.greatest(F.count("*"), F.lit(1))).alias("modules_with_children"))
    out = of_type(edges, "CALLS", "id", "dst").groupBy("id").agg(F.count("*").alias("n")).join(nodes.where("type = 'FUNCTION'").select("id"), "id", "left_semi")
    busy = out.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most_calls"), F.min_by("id", F.struct(-F.col("n"), "id")).alias("busiest"))
    return alone.crossJoin(bare).crossJoin(share).crossJoin(busy)
