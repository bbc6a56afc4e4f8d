"""Evaluation reports: statuses in JSON of any depth, predictions, logs; run names; the summary table as CSV and markdown."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.agentlog import eval_status

#: Keys that list instances by status, words of a status, and the datasets of a subset.
LISTS = {
    "resolved": ("resolved", "resolved_ids", "pass_ids", "passed_ids"), "failed": ("unresolved", "unresolved_ids", "failed", "fail_ids", "failed_ids"),
    "errored": ("error", "errors", "error_ids", "errored", "errored_ids"),
}
WORDS = {"resolved": ("resolved", "passed", "pass"), "failed": ("failed", "fail", "unresolved"), "errored": ("error", "errored")}
DATASETS = {"lite": "princeton-nlp/SWE-bench_Lite", "verified": "princeton-nlp/SWE-bench_Verified", "full": "princeton-nlp/SWE-bench"}
STATUS_OF_LIST = {key: status for status, keys in LISTS.items() for key in keys}
STATUS_OF_WORD = {word: status for status, words in WORDS.items() for word in words}
VERDICT = {True: "resolved", False: "failed"}


def statuses_of(report) -> Iterator[tuple[str, str]]:
    """instance, status: lists and maps of ids under a key, an object that names its instance, an object under an instance's id; at any depth."""
    waiting = [report]
    while waiting:
        at = waiting.pop()
        if isinstance(at, list):
            waiting += at
        if not isinstance(at, dict):
            continue
        waiting += at.values()
        named = at.get("instance_id")
        if isinstance(named, str):
            for status in (VERDICT.get(at.get("resolved")) if isinstance(at.get("resolved"), bool) else None, STATUS_OF_WORD.get(str(at.get("status", "")).lower())):
                if status:
                    yield named, status
        for key, value in at.items():
            listing = STATUS_OF_LIST.get(key.lower())
            if listing and isinstance(value, list | dict):
                yield from ((str(x), listing) for x in value)
            if "__" in key and isinstance(value, dict) and isinstance(value.get("resolved"), bool):
                yield key, VERDICT[value["resolved"]]


def reported(texts: DataFrame) -> DataFrame:
    """instance, status of (text): each pair once. Texts that aren't JSON say nothing. JSON of any depth has no schema, so it is read in Python."""

    def read(batches):
        for batch in batches:
            rows = []
            for text in batch["text"]:
                try:
                    rows += statuses_of(json.loads(text))
                except (TypeError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["instance", "status"])

    return texts.select("text").mapInPandas(read, "instance string, status string").distinct()


def files_of_run(spark: SparkSession, root: str, run_id: str, pattern: str = "*.json") -> DataFrame:
    """path, text of all files of a name pattern under root whose path holds the run's id."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.where(F.contains("path", F.lit(run_id))).select("path", F.col("content").cast("string").alias("text"))


def inferred(text: Column) -> Column:
    """What a test log says where no report does."""
    low = F.lower(text)
    bad = F.contains(text, F.lit("FAILED")) | F.contains(text, F.lit("FAILURES")) | F.contains(text, F.lit("ERROR")) | F.contains(text, F.lit("Traceback"))
    return F.when(F.contains(low, F.lit("resolved")) & ~F.contains(low, F.lit("unresolved")), "RESOLVED_MAYBE").when(bad, "FAILED_OR_ERROR").when(text.isNotNull(), "RAN")


def predictions(texts: DataFrame) -> DataFrame:
    """instance, patch of (text): a JSON object by instance, or a list of objects that name theirs; of a repeated instance the last counts."""
    whole = F.trim("text")
    entry = "struct<instance_id:string,model_patch:string>"
    listed = texts.where(whole.startswith("[")).select(F.posexplode(F.from_json("text", f"array<{entry}>")).alias("pos", "e"))
    keyed = texts.where(whole.startswith("{")).select(F.posexplode(F.map_entries(F.from_json("text", f"map<string,{entry}>"))).alias("pos", "m")).select("pos", F.col("m.key").alias("instance"), F.col("m.value.model_patch").alias("patch"))
    every = listed.where("e.instance_id IS NOT NULL").select("pos", F.col("e.instance_id").alias("instance"), F.col("e.model_patch").alias("patch")).unionByName(keyed)
    return every.groupBy("instance").agg(F.max_by("patch", "pos").alias("patch"))


def evaluated(preds: DataFrame, reports: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """instance, patch_status, eval_status. preds: (instance, patch); reports: (instance, status); logs: (instance, text)."""
    flags = reports.groupBy("instance").agg(*(F.max(F.col("status") == s).alias(s) for s in LISTS))
    joined = preds.join(flags, "instance", "left")
    said = F.lit(None).cast("string")
    if logs is not None:
        joined, said = joined.join(logs.groupBy("instance").agg(F.min("text").alias("log")), "instance", "left"), inferred(F.col("log"))
    empty = F.trim(F.coalesce("patch", F.lit(""))) == ""
    told = [F.coalesce(F.col(s), F.lit(False)) for s in LISTS]
    return joined.select("instance", F.when(empty, "EMPTY").otherwise("HAS_PATCH").alias("patch_status"), eval_status(empty, *told, said).alias("eval_status"))


def run_id(folder: Column, part: Column) -> Column:
    """The last name of the output folder and the slice."""
    named = F.when(F.coalesce(part, F.lit("")) == "", "unknown").otherwise(F.regexp_replace(part, r"[:/\\]", "_"))
    return F.concat_ws("_", F.regexp_extract(F.regexp_replace(folder, "/+$", ""), "([^/]*)$", 1), named)


def dataset(subset: str | None) -> str:
    name = (subset or "lite").strip()
    if name not in DATASETS and "/" not in name:
        raise ValueError(f"unknown subset {name!r}; one of {', '.join(sorted(DATASETS))} or a whole dataset name")
    return DATASETS.get(name, name)


def write_summary(table: DataFrame, folder: str) -> None:
    """A CSV with a header and a markdown table in folders of these names; table: (instance, patch_status, eval_status)."""
    named = table.select(F.col("instance").alias("instance_id"), "patch_status", "eval_status").orderBy("instance_id")
    named.write.mode("overwrite").option("header", True).csv(f"{folder}/eval_summary.csv")
    line = F.format_string("| `%s` | %s | %s |", "instance_id", "patch_status", "eval_status").alias("value")
    head = table.sparkSession.createDataFrame([(0, "| instance_id | patch_status | eval_status |"), (1, "|---|---:|---:|")], "nth int, value string")
    rows = head.unionByName(named.select(F.lit(2).alias("nth"), line)).orderBy("nth", "value").select("value")
    rows.write.mode("overwrite").text(f"{folder}/eval_summary.md")


def sliced(rows: DataFrame, order: str, part: str) -> DataFrame:
    """The rows of a slice `a:b`, `:b`, `a:` or `a` (that one row) in an order; an empty slice is all."""
    from pyspark.sql import Window

    numbered = rows.withColumn("_nth", F.row_number().over(Window.orderBy(order)) - 1)
    first, colon, last = part.partition(":")
    if not part:
        return rows
    low = int(first) if first else 0
    high = int(last) if last else None if colon else low + 1
    kept = numbered.where(F.col("_nth") >= low)
    return (kept if high is None else kept.where(F.col("_nth") < high)).drop("_nth")


def chosen(rows: DataFrame, ident: str, pattern: str = "", part: str = "") -> DataFrame:
    """The rows whose id begins with a match of the pattern, then of these the slice by id."""
    return sliced(rows.where(F.col(ident).rlike(f"^(?:{pattern})")) if pattern else rows, ident, part)


def still_to_do(all_ids: DataFrame, done: DataFrame, ident: str = "instance") -> DataFrame:
    """done, left, total of the instances, each counted once."""
    marked = all_ids.select(ident).distinct().join(done.select(ident).distinct().withColumn("_done", F.lit(1)), ident, "left")
    return marked.agg(F.count("_done").alias("done"), F.count_if(F.col("_done").isNull()).alias("left"), F.count("*").alias("total"))
