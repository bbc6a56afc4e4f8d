"""Ranked retrieval: an inverted index as tables, BM25, cosine search, fusion, seeds, query weights."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codeloom.functions.text import looks_like_code, once, token_bag

K1, B = 1.5, 0.75
#: Different terms of the queries that are collected and broadcast; query vectors that a round sends to every task.
MOST_TERMS, MOST_VECTORS = 20_000, 10_000


def postings(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """node, term, tf."""
    return docs.select(F.col(ident).alias("node"), F.explode(token_bag(F.col(text))).alias("term")).groupBy("node", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """node, dl: texts without tokens count too."""
    return docs.select(F.col(ident).alias("node"), F.size(token_bag(F.col(text))).alias("dl"))


def bm25_terms(docs: DataFrame, queries: DataFrame, ident: str, text: str) -> DataFrame:
    """query_id, node, score of every match. queries: (query_id, text); a query's terms are a set.

    Texts are tokenised twice, once for the statistics of the corpus and once for the matches; only terms of the queries
    leave a row. Up to MOST_TERMS different ones they are counted first, then filtered by and broadcast; beyond, they are joined.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(token_bag(F.col("text")))).alias("term"))
    some = [r.term for r in wanted.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    few = len(some) <= MOST_TERMS
    small = F.broadcast if few else lambda df: df
    kept = (lambda a: F.filter(a, lambda t: t.isin(some or [""]))) if few else (lambda a: a)
    per = docs.select(F.col(ident).alias("node"), once(token_bag(F.col(text)), lambda a: F.struct(F.size(a).alias("dl"), kept(a).alias("hits"))).alias("p"))
    counted = per.select(F.col("p.dl").alias("dl"), F.explode(F.concat(F.array_distinct("p.hits"), F.array(F.lit("")))).alias("term"))
    counted = counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("total"))
    corpus = counted.where("term = ''").select(F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("avgdl"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rarity = counted.where("term <> ''").select("term", "df").join(wanted.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(corpus)).select("term", idf.alias("idf"), "avgdl")
    hits = per.select("node", F.col("p.dl").alias("dl"), F.explode_outer("p.hits").alias("term")).where("term IS NOT NULL").groupBy("node", "dl", "term").agg(F.count("*").alias("tf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.join(small(rarity), "term").join(small(wanted), "term").select("query_id", "node", weight.alias("w")).groupBy("query_id", "node").agg(F.sum("w").alias("score"))


def candidates(docs: DataFrame, query: str, k: int = 200, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """node: the ids of the best matches."""
    return bm25_search(docs, query, k, ident, text).select("node")


def top(df: DataFrame, k: int, score: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(score), *ties).limit(k)


def bm25_search(docs: DataFrame, query: str, k: int = 5, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """node, raw, score (raw over the largest)."""
    one = docs.sparkSession.createDataFrame([(0, query)], "query_id int, text string")
    best = top(bm25_terms(docs, one, ident, text).withColumn("raw", F.round("score", 6)), k, "raw", "node")
    return best.select("node", "raw", F.round(F.col("raw") / F.max("raw").over(Window.partitionBy()), 6).alias("score"))


def bm25_search_many(docs: DataFrame, queries: DataFrame, k: int = 20, per_query: int = 50, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """node, score, hits: the best weighted score over all queries and a bonus for nodes that more queries find. queries: (query_id, text, weight)."""
    raw = bm25_terms(docs, queries, ident, text).withColumn("raw", F.round("score", 6))
    by = Window.partitionBy("query_id")
    place = F.row_number().over(by.orderBy(F.desc("raw"), "node"))
    norm = raw.withColumn("norm", F.col("raw") / F.max("raw").over(by)).withColumn("place", place).where(F.col("place") <= per_query)
    found = norm.join(F.broadcast(queries.select("query_id", "weight")), "query_id").groupBy("node").agg(F.max(F.col("norm") * F.col("weight")).alias("best"), F.count("*").alias("hits"))
    bonus = 0.10 * (F.col("hits") - 1) / F.greatest(F.lit(1), F.max("hits").over(Window.partitionBy()) - 1)
    return top(found.select("node", F.round(F.least(F.lit(1.0), F.col("best") + bonus), 6).alias("score"), "hits"), k, "score", "node")


def cosine_search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 1024) -> DataFrame:
    """query_id, node, score: for each query vector the k nearest. vectors: (node, vec); queries: (query_id, vec), a stated set.

    Vectors of norm 1 meet by blocks in matrix products; a block sends on its k nearest to each query. Up to MOST_VECTORS
    queries are sent to every task, more go through in rounds of so many. A vector without a direction, or with NaN, has similarity 0.
    """
    of_type = {f.name: f.dataType.simpleString() for f in [*vectors.schema, *queries.schema]}

    def unit(column) -> np.ndarray:
        rows = column.to_pylist()
        m = np.array(rows, float) if rows else np.zeros((0, 1))
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.nan_to_num(np.where(norm > 1e-12, m / norm, 0.0), nan=0.0, posinf=0.0, neginf=0.0)

    def nearest(known):
        def near(batches):
            ids, units = known.value
            for batch in batches:
                for a in range(0, batch.num_rows, block):
                    part = batch.slice(a, block)
                    nodes, out = part.column(0).to_pylist(), []
                    scores = np.round(np.maximum(units @ unit(part.column(1)).T, 0.0), 6)
                    for q, row in zip(ids, scores, strict=True):
                        some = sorted(zip((-row).tolist(), nodes, strict=True))[: k + 1] if len(row) <= k + 1 else best_of(row, nodes, k + 1)
                        out += [(q, n, -s) for s, n in some if n != q][:k]
                    q, n, s = zip(*out, strict=True) if out else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(q, id_type), pa.array(n, part.column(0).type), pa.array(s, pa.float64())], names=["query_id", "node", "score"])

        return near

    id_type, found = to_arrow_type(queries.schema["query_id"].dataType), None
    rows = queries.select("query_id", "vec").toLocalIterator()
    plain = vectors.select("node", F.col("vec").cast("array<double>").alias("vec"))
    while part := list(islice(rows, MOST_VECTORS)):
        known = vectors.sparkSession.sparkContext.broadcast(([r.query_id for r in part], unit(pa.array([list(map(float, r.vec)) for r in part]))))
        one = plain.mapInArrow(nearest(known), f"query_id {of_type['query_id']}, node {of_type['node']}, score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {of_type['query_id']}, node {of_type['node']}, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def best_of(row: np.ndarray, nodes: list, k: int) -> list:
    """The k largest with their nodes, ties by node."""
    least = np.partition(row, len(row) - k)[len(row) - k]
    return sorted((-float(row[j]), nodes[j]) for j in np.flatnonzero(row >= least))[:k]


def fused(semantic: DataFrame, structural: DataFrame, lexical: DataFrame, alpha=0.25, beta=0.55, gamma=0.20) -> DataFrame:
    """node and its weighted sum, with 0.05 more where both semantic and lexical scores are there. Inputs: (node, score)."""
    if min(alpha, beta, gamma) < 0 or alpha + beta + gamma <= 0:
        raise ValueError("weights are non-negative and not all zero")
    named = [df.select("node", F.col("score").alias(n)) for df, n in ((structural, "s"), (semantic, "e"), (lexical, "b"))]
    joined = named[0].join(named[1], "node", "full").join(named[2], "node", "full").fillna(0.0, ["s", "e", "b"])
    return joined.withColumn("score", F.round(alpha * F.col("s") + beta * F.col("e") + gamma * F.col("b") + F.when((F.col("e") > 0) & (F.col("b") > 0), 0.05).otherwise(0.0), 8))


#: Weights that stay, and the least and the factor of those that decay.
STEADY = {"current_query": 1.20, "query_exact_symbols": 1.20, "query_method_class": 1.10, "query_error": 1.00, "query_bm25_queries": 1.00, "query_behavior": 0.90}
DECAYING = {"initial_exact_symbols": (0.50, 1.10), "initial_method_class": (0.40, 0.95), "initial_error": (0.30, 0.85), "initial_bm25_queries": (0.30, 0.80), "initial_behavior": (0.20, 0.60)}


def group_weights(step: Column) -> dict[str, Column]:
    """Weights of the query groups after so many steps; a step below 0 counts as 0."""
    base = 0.3 + 0.9 * F.exp(-0.25 * F.greatest(step, F.lit(0)))
    return {n: F.lit(w) for n, w in STEADY.items()} | {n: F.round(F.greatest(F.lit(least), factor * base), 6) for n, (least, factor) in DECAYING.items()}


def seeds(semantic: DataFrame, lexical: DataFrame, types: DataFrame, k: int = 3, beta=0.55, gamma=0.20) -> DataFrame:
    """node, score: the nodes from which structural search starts. semantic, lexical: (node, score, rank from 0), ranked lists; types: (node, type)."""
    one = lambda df, n: df.select("node", F.col("score").alias(n), F.col("rank").alias(f"{n}_rank"))
    both = one(semantic, "e").join(one(lexical, "b"), "node", "full").join(types.select("node", F.lower("type").alias("type")), "node", "left")
    part = lambda weight, n: F.coalesce(weight * F.col(n) + 0.02 / (F.col(f"{n}_rank") + 1), F.lit(0.0))
    bonus = F.when(F.col("type").isin("method", "function"), 0.04).when(F.col("type") == "class", 0.03).when(F.col("type") == "module", 0.01).otherwise(0.0)
    overlap = F.when(F.col("e").isNotNull() & F.col("b").isNotNull(), 0.05).otherwise(0.0)
    scored = both.select("node", F.round(part(beta, "e") + part(gamma, "b") + overlap + bonus, 8).alias("score"), F.when(F.col("e").isNull(), F.col("b")).otherwise(0.0).alias("by_b"), F.coalesce("e", F.lit(0.0)).alias("by_e"))
    return scored.orderBy(F.desc("score"), F.desc("by_b"), F.desc("by_e"), "node").limit(k).select("node", "score")


def priority_queries(queries: DataFrame, most: int = 12, initial: int = 2) -> DataFrame:
    """instance, place, query, score: the queries that are kept, best first. queries: (instance, ord, group, query, weight).

    Of queries that are equal but for case the first counts. The best `initial` of the groups named initial_* stay in any case.
    """
    text, group = F.trim("query"), F.col("group")
    by = Window.partitionBy("instance")
    clean = queries.withColumn("query", text).where("query <> ''").withColumn("nth", F.row_number().over(Window.partitionBy("instance", F.lower("query")).orderBy("ord"))).where("nth = 1")
    plus = lambda when, x: F.when(when, x).otherwise(0.0)
    score = F.col("weight") + F.when(group == "current_query", 0.40).when(group.startswith("query_"), 0.25).otherwise(0.0)
    for mark, x in (("exact_symbols", 0.35), ("method_class", 0.25), ("error", 0.15), ("behavior", -0.20), ("bm25_queries", -0.10)):
        score = score + plus(group.contains(mark), x)
    score = score + plus(looks_like_code(F.col("query")), 0.30) + plus(F.size(F.split(F.col("query"), r"\s+")) > 12, -0.15)
    scored = clean.withColumn("score", F.round(score, 6)).withColumn("early", group.startswith("initial_"))
    ranked = scored.withColumn("nth", F.row_number().over(Window.partitionBy("instance", "early").orderBy(F.desc("score"), "ord")))
    kept = ranked.withColumn("sure", F.col("early") & (F.col("nth") <= initial))
    chosen = kept.withColumn("nth", F.row_number().over(by.orderBy(F.desc("sure"), F.desc("score"), "ord"))).where(F.col("nth") <= most)
    return chosen.select("instance", F.row_number().over(by.orderBy(F.desc("score"), "ord")).alias("place"), "query", "score")
