"""TF-IDF as a table, and its truncated singular value decomposition as dense vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
WORD = r"[a-zA-Z_][a-zA-Z0-9_]*"
FEATURES, WIDTH = 5000, 64
#: Rows of the Gram matrix in a stripe; tasks that add it up, each of which holds one.
STRIPE, PARTS = 50, 6


def vocabulary(counts: DataFrame, n_docs: DataFrame, features: int) -> DataFrame:
    """term, place, idf of the most frequent terms. At most `features` rows, so it may be broadcast."""
    of_term = counts.groupBy("term").agg(F.sum("tf").alias("all"), F.count("*").alias("df"))
    best = of_term.orderBy(F.desc("all"), "term").limit(features)
    placed = best.withColumn("place", F.row_number().over(Window.orderBy("term")) - 1)
    return placed.crossJoin(F.broadcast(n_docs)).select("term", "place", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(docs: DataFrame, ident: str = "doc_id", text: str = "text", features: int = FEATURES) -> DataFrame:
    """node, term, place, w: weights of the most frequent terms, of length 1 for each text that has any."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    counts = docs.select(F.col(ident).alias("node"), F.explode(words).alias("term")).groupBy("node", "term").agg(F.count("*").alias("tf"))
    terms = vocabulary(counts, docs.agg(F.count("*").alias("n")), features)
    weighed = counts.join(F.broadcast(terms), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("node").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, "node").select("node", "term", "place", F.round(F.col("w") / F.col("norm"), 9).alias("w"))


def stripes(weights: DataFrame, size: int) -> DataFrame:
    """k, stripe: summands of STRIPE rows of the rows' Gram matrix, made in one pass."""

    def summed(batches):
        total = None
        for batch in batches:
            for row in batch.column(0).to_pylist():
                total = np.zeros((size, size)) if total is None else total
                at, w = np.array([x["place"] for x in row]), np.array([x["w"] for x in row])
                total[np.ix_(at, at)] += np.outer(w, w)
        for k in range(0, size if total is not None else 0, STRIPE):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + STRIPE].tobytes()], pa.binary())], names=["k", "stripe"])

    return weights.select("row").coalesce(PARTS).mapInArrow(summed, "k int, stripe binary")


def largest_axes(summands: DataFrame, size: int, k: int) -> np.ndarray:
    """The eigenvectors of the k largest eigenvalues, largest first. One task solves the matrix, whose size `features` bounds."""

    def solved(batches):
        total = np.zeros((size, size))
        for batch in batches:
            for at, stripe in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[at : at + STRIPE] += np.frombuffer(stripe.as_buffer(), np.float64).reshape(-1, size)
        _, right = np.linalg.eigh(total)  # smallest values first
        yield pa.RecordBatch.from_arrays([pa.array([right[:, ::-1][:, :k].tobytes()], pa.binary())], names=["axes"])

    found = summands.repartition(1).mapInArrow(solved, "axes binary").first().axes
    return np.frombuffer(found, np.float64).reshape(size, k).copy()


def embedded(docs: DataFrame, ident: str = "doc_id", text: str = "text", features: int = FEATURES, width: int = WIDTH) -> DataFrame:
    """node, vec: rows of length 1 in the space of the largest singular values; texts without a term have none.

    The decomposition runs on the features' Gram matrix, whose size `features` bounds; the right singular vectors are
    at most features times width numbers.
    """
    weights = tfidf(docs, ident, text, features).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("row")).cache()
    there, wide = weights.count(), weights.select(F.max(F.element_at("row", -1)["place"])).first()[0]
    if not there or wide is None:
        return weights.select("node", F.array().cast("array<double>").alias("vec"))
    k = max(1, min(width, wide, there - 1))
    axes = largest_axes(stripes(weights, int(wide) + 1), int(wide) + 1, k)
    axes = docs.sparkSession.sparkContext.broadcast(axes)

    @F.pandas_udf("array<double>")
    def projected(places, values):
        out = []
        for p, w in zip(places, values, strict=True):
            v = np.asarray(w) @ axes.value[np.asarray(p)]
            out.append(v / (np.linalg.norm(v) or 1.0))
        return pd.Series([v.tolist() for v in out])

    return weights.select("node", projected("row.place", "row.w").alias("vec"))
