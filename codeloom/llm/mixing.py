"""Mixing sources to target weights.

Sizes are counted in words. Sources in code-point order (null last) get the weights in turn; the mix is a
multiple of all words, dealt by weight, and no source gets more than its cap. A document is emitted
floor(rate) times, and once more when a hash of its id falls below the fraction, where rate is the target
of its source over the words that the source has. Only DataFrame operations are used.

Defined results: a null or empty text has no words, and its copies weigh nothing; a null source is a source
of its own; rows with one id share one draw; an empty table gives an empty mix; columns other than the three
that are named pass through `mix` and are ignored by `mixing_plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.shared import WORD, unit_hash, written

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2.0, "mix-1"
#: Targets are broadcast up to so many sources with so many bytes of names; beyond that they are joined by salted keys.
BROADCAST_SOURCES, BROADCAST_BYTES, SALTS = 10_000, 4_000_000, 32


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target. One row for each source, so the windows run over as many rows as there are sources.

    Sharing by weight with caps has the closed form min(cap, weight * level). Taken in order of cap / weight,
    the level that remains for a source and those after it rises while sources are capped, then falls.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", turn)
        .withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.max(F.col("left") / F.col("open")).over(every))
        .select("source", "source_size", F.least("most", F.col("weight") * F.col("level")).alias("target"))
    )


def with_targets(docs: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """docs with _size and _target of their source. targets: a written table."""
    targets = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_size"), F.col("target").alias("_target"))
    sources, names = targets.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_source")), F.lit(0))).first()
    if sources <= BROADCAST_SOURCES and names <= BROADCAST_BYTES:
        return docs.join(F.broadcast(targets), docs[source].eqNullSafe(F.col("_source")), "left").drop("_source")
    salted = docs.withColumn("_salt", F.floor(F.rand(7) * SALTS))
    spread = targets.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(spread, salted[source].eqNullSafe(spread["_source"]) & (salted["_salt"] == spread["_spread"]), "left").drop("_source", "_salt", "_spread")


def copies(ident: Column, size: Column, target: Column, cap: float = CAP, seed: str = SEED) -> Column:
    """How often a document is emitted."""
    rate = F.least(F.coalesce(F.try_divide(target, size), F.lit(0.0)), F.lit(cap))
    return F.floor(rate) + F.when(unit_hash(ident, seed) < rate - F.floor(rate), 1).otherwise(0)


def sizes(docs: DataFrame, ident: str, text: str, source: str) -> DataFrame:
    return docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), count_words(F.col(text)).alias("size"))


def mixing_plan(docs: DataFrame, ident="doc_id", text="text", source="source", weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of each document."""
    sized = written(sizes(docs, ident, text, source), "sizes")
    targets = written(source_targets(sized, weights, share, cap), "targets")
    return with_targets(sized, targets).select(
        "doc_id",
        "size",
        F.col("_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("size") * copies(F.col("doc_id"), F.col("_size"), F.col("_target"), cap, seed)).cast("bigint").alias("taken"),
    )


def mix(docs: DataFrame, ident="doc_id", text="text", source="source", weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED) -> DataFrame:
    """docs with each row as often as the mix takes it, with the columns of docs."""
    targets = written(source_targets(sizes(docs, ident, text, source), weights, share, cap), "targets")
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(ident).alias("_id"), F.col(source).alias("_of"))
    often = with_targets(kept, targets, "_of").withColumn("_copies", copies(F.col("_id"), F.col("_size"), F.col("_target"), cap, seed).cast("int"))
    return often.select("row", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_n")).select("row.*")


#: The hash is an MD5 so that plain SQL can follow it.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM per),
weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS most FROM ranked),
levels AS (
  SELECT *, ((SUM(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
         - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
targets AS (SELECT source, source_size, least(most, weight * (max(level) OVER ())) AS target FROM levels),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         least(CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size END, 2.0::DOUBLE) AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
