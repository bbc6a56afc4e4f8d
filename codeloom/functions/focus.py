"""What rules find in an issue text, the queries that come of it, and the cache of an instance's focus.

A focus is a struct of the arrays FIELDS and the text itself. A word is a run of letters, digits and underscores; names are
words of ASCII that don't begin with a digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import keywords
from codeloom.operators.ranking import group_weights, priority_queries

#: Fixed values.
NOTHING = ("none", "null", "n/a", "unknown")
KNOWN_METHODS = ("__init__", "__str__", "__repr__", "deconstruct", "formfield", "clean", "save")
FIELDS = ("exact_symbols", "file_hints", "class_hints", "function_hints", "method_hints", "parameter_hints", "behavior_terms", "error_terms", "bm25_queries", "raw_keywords")
GROUPS = ("exact_symbols", "method_class", "behavior", "error", "bm25_queries")
SYMBOLS = ("exact_symbols", "file_hints", "class_hints", "function_hints", "method_hints", "parameter_hints")
TERMS = ("behavior_terms", "error_terms", "raw_keywords")
NAME = r"^[_a-zA-Z][a-zA-Z0-9_]*$"


def cleaned(items: Column) -> Column:
    """Trimmed, without empty items and words for nothing; the first of those that are equal but for case."""
    kept = F.array_distinct(F.filter(F.transform(items, lambda s: F.trim(s)), lambda s: (s != "") & ~F.lower(s).isin(*NOTHING)))
    low = F.transform(kept, lambda s: F.lower(s))
    return F.when(F.size(F.array_distinct(low)) == F.size(low), kept).otherwise(F.filter(kept, lambda s, i: F.array_position(low, F.lower(s)) == i + 1))


def joined(items: Column, most: int) -> Column:
    return F.array_join(F.slice(items, 1, most), " ")


def with_focus(df: DataFrame, text: str, to: str = "focus") -> DataFrame:
    """df with the focus of a text column; null counts as empty."""
    said = F.coalesce(F.col(text), F.lit(""))
    all_of = lambda p, g=0: F.regexp_extract_all(said, F.lit(p), F.lit(g))
    found = df.withColumn("_words", F.filter(all_of(r"[\p{L}\p{N}_]+"), lambda w: w.rlike(NAME)))
    found = found.withColumn("_calls", all_of(r"(?<![\p{L}\p{N}_])([_a-zA-Z][a-zA-Z0-9_]*)\s*\(", 1)).withColumn("_spans", all_of("`([^`]+)`", 1))
    words, calls = F.col("_words"), F.col("_calls")
    found = found.withColumn("_camel", F.filter(words, lambda w: w.rlike("[A-Z]") & (F.length(w) >= 3)))
    found = found.withColumn("_exact", F.concat("_spans", calls, F.filter(words, lambda w: F.contains(w, F.lit("_"))), F.col("_camel")))
    found = found.withColumn("_functions", F.filter(calls, lambda w: ~w.rlike("^[A-Z]"))).withColumn("_classes", F.filter("_camel", lambda w: w.rlike("^[A-Z]")))
    found = found.withColumn("_methods", F.filter("_exact", lambda w: w.isin(*KNOWN_METHODS))).withColumn("_raw", F.filter(keywords(said, 100), lambda w: ~w.isin(*NOTHING)))
    found = found.withColumn("_raw", F.slice("_raw", 1, 30)).withColumn("_exact", cleaned(F.col("_exact")))
    names = cleaned(F.concat("_classes", "_methods", "_functions"))
    queries = cleaned(F.array(joined(F.col("_exact"), 8), joined(names, 8), joined(F.col("_raw"), 10)))
    focus = {
        "source_text": said, "exact_symbols": F.col("_exact"), "file_hints": cleaned(all_of(r"[\p{L}\p{N}_./\\-]+\.py")), "class_hints": cleaned(F.col("_classes")),
        "function_hints": cleaned(F.col("_functions")), "method_hints": cleaned(F.col("_methods")),
        "parameter_hints": cleaned(F.filter(words, lambda w: F.contains(w, F.lit("_")) & ~F.array_contains("_functions", w))),
        "behavior_terms": F.slice("_raw", 1, 8), "error_terms": cleaned(F.filter(words, lambda w: w.rlike(r"^[A-Z][A-Za-z0-9_]*(Error|Exception|Warning)$"))),
        "bm25_queries": queries, "raw_keywords": F.col("_raw"),
    }
    return found.withColumn(to, F.struct(*(c.alias(n) for n, c in focus.items()))).drop("_words", "_calls", "_spans", "_camel", "_exact", "_functions", "_classes", "_methods", "_raw")


def normalised(focus: Column) -> Column:
    """A focus given from outside, as a struct with any of FIELDS: lists cleaned, missing ones empty."""
    return F.struct(focus["source_text"].alias("source_text"), *(cleaned(F.coalesce(focus[n], F.array().cast("array<string>"))).alias(n) for n in FIELDS))


def as_list(value: Column) -> Column:
    """A JSON value that should be a list of texts: a list as it is, a text as a list of one, nothing as an empty list."""
    text = F.trim(value)
    one = F.when(text.startswith('"'), F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")).otherwise(F.array(text))
    return F.when(value.isNull() | (text == "null"), F.array().cast("array<string>")).when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(one)


def group_queries(focus: Column) -> dict[str, Column]:
    """The queries of each group, first the one that joins several terms."""
    of = lambda *names: cleaned(F.concat(*(focus[n] for n in names)))
    lead = lambda items, most: F.when(F.size(items) > 0, F.array(joined(items, most))).otherwise(F.array().cast("array<string>"))
    exact, names, strong = of("exact_symbols", "file_hints", "parameter_hints"), of("class_hints", "function_hints", "method_hints", "parameter_hints"), of("class_hints", "method_hints")
    return {
        "exact_symbols": cleaned(F.concat(lead(exact, 10), F.slice(focus["file_hints"], 1, 5))),
        "method_class": cleaned(F.concat(lead(names, 10), F.slice(strong, 1, 5))),
        "behavior": cleaned(F.concat(lead(focus["behavior_terms"], 8), lead(focus["raw_keywords"], 10))),
        "error": cleaned(F.concat(lead(focus["error_terms"], 8), F.slice(focus["error_terms"], 1, 5))),
        "bm25_queries": focus["bm25_queries"],
    }


def focus_cache(rows: DataFrame) -> DataFrame:
    """instance, initial, query: the first issue's focus, the last query's. rows: (instance, ord, source, focus); source: initial_issue or query."""
    of = lambda source, pick: pick(F.when(F.col("source") == source, F.col("focus")), F.when(F.col("source") == source, F.col("ord")))
    return rows.groupBy("instance").agg(of("initial_issue", F.min_by).alias("initial"), of("query", F.max_by).alias("query"))


def query_bundle(cache: DataFrame, most: int = 12) -> DataFrame:
    """instance, place, query, score. cache: (instance, initial, query, current, step); initial and query may be null.

    Groups are taken in a fixed order; an instance of which nothing is kept has its current query alone.
    """
    current = F.trim(F.coalesce("current", F.lit("")))
    weights = group_weights(F.greatest(F.col("step"), F.lit(0)))
    entries = [F.struct(F.lit("current_query").alias("group"), F.when(current != "", F.array(current)).alias("queries"), weights["current_query"].alias("weight"))]
    for side, column in (("initial", "initial"), ("query", "query")):
        of = group_queries(F.col(column))
        entries += [F.struct(F.lit(f"{side}_{g}").alias("group"), F.when(F.col(column).isNotNull(), of[g]).alias("queries"), weights[f"{side}_{g}"].alias("weight")) for g in GROUPS]
    listed = cache.select("instance", F.posexplode(F.array(*entries)).alias("g", "e")).select("instance", "g", "e.group", "e.weight", F.posexplode("e.queries").alias("nth", "query"))
    return priority_queries(listed.select("instance", (F.col("g") * 1000 + F.col("nth")).alias("ord"), "group", "query", "weight"), most)


def deepen_query(explicit: Column, query: Column, initial: Column, most: int = 12) -> Column:
    """The text by which methods of a file are ranked: what was asked for, else the texts of the two focuses and some of their terms."""
    nothing = F.array().cast("array<string>")
    listed = lambda names: cleaned(F.concat(*(F.coalesce(f[n], nothing) for f in (query, initial) for n in names)))
    parts = [F.trim(F.coalesce(f["source_text"], F.lit(""))) for f in (query, initial)]
    for label, names in (("Related code symbols: ", SYMBOLS), ("Related behavior/error terms: ", TERMS)):
        some = F.slice(listed(names), 1, most)
        parts.append(F.when(F.size(some) > 0, F.concat(F.lit(label), F.array_join(some, ", "))).otherwise(""))
    asked = F.trim(F.coalesce(explicit, F.lit("")))
    return F.when(asked != "", asked).otherwise(F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n"))
