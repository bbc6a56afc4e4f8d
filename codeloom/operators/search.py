"""Search of all kinds together: by meaning, by words and by structure, from a text or from a node.

An index is a set of tables: texts (node, text), vectors (node, vec), nodes and edges of a graph whose ids are the nodes'.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators import ranking, structure
from codeloom.operators.ranking import bm25_search, bm25_search_many, cosine_search, fused, seeds, top

ALPHA, BETA, GAMMA = 0.25, 0.55, 0.20


@dataclass
class Index:
    texts: DataFrame
    vectors: DataFrame
    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.texts.sparkSession


def by_words(index: Index, query: str, queries: DataFrame | None, k: int) -> DataFrame:
    """node, score. queries: (query_id, text, weight); without any, the query itself is searched for."""
    if queries is not None and not queries.isEmpty():
        return bm25_search_many(index.texts, queries, k, k, "node").select("node", "score")
    if not query.strip():
        return index.spark.createDataFrame([], index.texts.select("node").schema.add("score", "double"))
    return bm25_search(index.texts, query, k, "node").select("node", "score")


def by_meaning(index: Index, vector: list | None, k: int) -> DataFrame:
    """node, score of the nearest vectors."""
    if vector is None:
        return index.spark.createDataFrame([], index.vectors.select("node").schema.add("score", "double"))
    one = index.spark.createDataFrame([("", [float(x) for x in vector])], "query_id string, vec array<double>")
    return cosine_search(index.vectors, one, k).select("node", "score")


def held(df: DataFrame) -> DataFrame:
    """df as rows of the driver: a list of a search, which its k bounds."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def ranked(df: DataFrame) -> DataFrame:
    return df.select("node", "score", (F.row_number().over(Window.orderBy(F.desc("score"), "node")) - 1).alias("rank"))


def merged(structural: DataFrame, semantic: DataFrame, lexical: DataFrame, k: int, weights=(ALPHA, BETA, GAMMA)) -> DataFrame:
    """node, score, s, e, b: the k best of the weighted sums."""
    return top(fused(semantic, structural, lexical, *weights), k, "score", "node")


def hybrid_search(index: Index, query: str, vector: list | None, k: int = 5, queries: DataFrame | None = None, weights=(ALPHA, BETA, GAMMA), seed_k: int = 3) -> DataFrame:
    """node, score, s, e, b. The best of both lists are the seeds from which structure is followed; of several seeds the first that finds a node gives its score."""
    alpha, beta, gamma = weights
    if min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights are non-negative and not all zero")
    wide = max(3 * k, k)
    semantic, lexical = held(by_meaning(index, vector, wide)), held(by_words(index, query, queries, max(2 * wide, 20)))
    types = index.nodes.select(F.col("id").alias("node"), "type")
    first = seeds(ranked(semantic), ranked(lexical), types, max(1, seed_k), beta, gamma)
    order = [r.node for r in first.collect()]  # at most seed_k
    if not order or alpha == 0:
        return merged(semantic.limit(0), semantic, lexical, k, weights)
    seeded = index.spark.createDataFrame(list(zip(order, range(len(order)), strict=True)), index.texts.select(F.col("node").alias("seed")).schema.add("nth", "integer"))
    found = structure.related(seeded, index.nodes, index.edges, wide).join(F.broadcast(seeded), "seed")
    return merged(found.groupBy("node").agg(F.min_by("score", "nth").alias("score")), semantic, lexical, k, weights)


def search_by_node(index: Index, node, query: str, vector: list | None, k: int = 5, mode: str = "related", weights=(ALPHA, BETA, GAMMA)) -> DataFrame:
    """node, score, s, e, b: neighbours by structure in a mode and by the node's own query text and vector; without the node itself."""
    wide = max(3 * k, k)
    seeded = index.spark.createDataFrame([(node,)], index.texts.select(F.col("node").alias("seed")).schema)
    near = search_structural(index, seeded, mode, wide).select("node", "score")
    semantic, lexical = by_meaning(index, vector, wide), by_words(index, query, None, wide)
    own = F.col("node") != F.lit(node)
    return merged(near.where(own), semantic.where(own), lexical.where(own), k, weights)


def search_structural(index: Index, seeds_: DataFrame, mode: str = "related", k: int = 5) -> DataFrame:
    """seed, node, score, reason: the k best of a mode for each seed, each node once."""
    if mode not in structure.MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(structure.MODES)}")
    if mode == "related":
        return structure.related(seeds_, index.nodes, index.edges, k)
    found = structure.best_per_node(structure.MODES[mode](seeds_, index.nodes, index.edges), "seed")
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "node"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def expanded_search(index: Index, cache: DataFrame, query: str, vector: list | None, k: int = 5, step: int = 0) -> DataFrame:
    """hybrid_search with the queries of an instance's focus cache, (instance, initial, query), one row or none; without any the query alone."""
    from codeloom.functions.focus import query_bundle

    bundle = query_bundle(cache.withColumn("current", F.lit(query)).withColumn("step", F.lit(step)))
    return hybrid_search(index, query, vector, k, bundle.select(F.col("place").alias("query_id"), F.col("query").alias("text"), F.lit(1.0).alias("weight")))


class Tools:
    """The searches by name, as an agent calls them. embed turns a text to a vector, or to None."""

    def __init__(self, index: Index, embed, deepen=None):
        self.index, self.embed = index, embed
        self.known = {"search_structural": self.search_structural, "search_semantic": self.search_semantic, "search_bm25": self.search_bm25, "search_hybrid": self.search_hybrid}
        if deepen is not None:
            self.known["deepen_file"] = deepen

    def search_structural(self, node_id, mode: str = "related", top_k: int = 5) -> DataFrame:
        return search_structural(self.index, self.index.spark.createDataFrame([(node_id,)], self.index.texts.select(F.col("node").alias("seed")).schema), mode, top_k)

    def search_semantic(self, query: str, top_k: int = 5) -> DataFrame:
        return by_meaning(self.index, self.embed(query), top_k)

    def search_bm25(self, query: str, top_k: int = 10) -> DataFrame:
        return bm25_search(self.index.texts, query, top_k, "node")

    def search_hybrid(self, query: str, top_k: int = 5) -> DataFrame:
        return hybrid_search(self.index, query, self.embed(query), top_k)

    def dispatch(self, name: str, arguments: dict):
        if name not in self.known:
            raise ValueError(f"unknown tool {name!r}; one of {', '.join(self.known)}")
        return self.known[name](**arguments)


def explained(query: str, found: DataFrame, texts: DataFrame, most: int = 6) -> DataFrame:
    """found with shared: up to `most` words of the query that the text of each node has, in order. texts: (node, text)."""
    asked = index_words(F.lit(query))
    return found.join(texts, "node").withColumn("shared", F.slice(F.array_sort(F.array_intersect(asked, index_words(F.col("text")))), 1, most)).drop("text")


def index_words(text):
    return F.array_distinct(ranking.token_bag(text))
