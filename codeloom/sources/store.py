"""Graphs and indexes kept as named parquet tables, and a manifest that is written last.

A folder without a manifest, or whose manifest lacks a table that is asked for, isn't complete. The manifest has the rows and an
order-free digest of each table as it was saved, so a table that was changed since is told from one that is whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest.parquet"


def summed_up(df: DataFrame, name: str) -> DataFrame:
    """name, n_rows, digest; columns count by name, null like any value. Maps have no order and aren't taken."""
    each = F.xxhash64(*(F.xxhash64(F.lit(c), F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in sorted(df.columns)))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(each.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest")).select(F.lit(name).alias("name"), "n_rows", "digest")


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """name, n_rows, digest of each saved table; None where nothing was saved to the end."""
    return read_or_none(spark, f"{folder}/{MANIFEST}")


def is_complete(spark: SparkSession, folder: str, names) -> bool:
    found = manifest(spark, folder)
    return found is not None and {r.name for r in found.select("name").collect()} >= set(names)  # a row for each table


def save(folder: str, tables: dict[str, DataFrame], force: bool = False) -> bool:
    """Writes the tables, then the manifest. Returns False, and writes nothing, where all are there and force isn't set."""
    spark = next(iter(tables.values())).sparkSession
    if not force and is_complete(spark, folder, tables):
        return False
    nothing = spark.createDataFrame([], "name string, n_rows long, digest string")
    nothing.write.mode("overwrite").parquet(f"{folder}/{MANIFEST}")  # until the end the folder isn't complete
    rows = nothing
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        rows = rows.unionByName(summed_up(spark.read.parquet(f"{folder}/{name}.parquet"), name))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{MANIFEST}")
    return True


def load(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """The saved tables; FileNotFoundError where the folder isn't complete."""
    if not is_complete(spark, folder, names):
        raise FileNotFoundError(f"{folder} lacks one of {', '.join(names)}")
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def changed(spark: SparkSession, folder: str) -> list[str]:
    """Tables that are gone or not as they were saved."""
    found = manifest(spark, folder)
    out = []
    for r in found.collect() if found is not None else []:  # a row for each table
        df = read_or_none(spark, f"{folder}/{r.name}.parquet")
        now = None if df is None else summed_up(df, r.name).first()
        if now != r:
            out.append(r.name)
    return sorted(out)
