"""URL filter: block and allow rules by host and path, and a character language-model ratio for the rest.

Two variable-order Markov models (contexts of 0 to 3 symbols, each order smoothed towards the next lower one
by the Witten-Bell rule) are counted over the URLs that allow rules accept and those that block rules reject.
A URL that no rule fits is judged by the difference of the two log-likelihoods over its length. The
threshold is calibrated on a fifth of the ruled URLs, which the models don't see. Symbols are folded to an
alphabet of 32, so a model has at most 32^4 counts and its size is bounded whatever the corpus.

Defined results: host and path of a null URL, or one without `://`, are empty; such a URL has no rule and an
empty path, its score is 0 and it is allowed; where a side has no training URL the method allows; repeated
URLs count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.shared import LOWER, UPPER, byte_buffer, crc_mod, small_batches

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER, SYMBOLS, BINS, REACH = 3, 32, 4000, 10.0
MOST_RULES = 1000


def symbols() -> np.ndarray:
    """Byte to symbol: letters of either case, one symbol for digits, some punctuation, other ASCII, the rest."""
    fold = np.full(256, 30, np.int64)
    fold[128:] = 31
    for k in range(26):
        fold[ord("a") + k] = fold[ord("A") + k] = k
    fold[ord("0") : ord("9") + 1] = 26
    for k, c in enumerate("/.-"):
        fold[ord(c)] = 27 + k
    return fold


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, parts, 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules are compiled into the plan")
    rule = verdict = None
    for said, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row of each symbol; its code with ORDER symbols before it; how many of those the URL really has."""
    data, offsets = byte_buffer(column)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    s, at = symbols()[data], np.arange(len(data)) - offsets[row]
    code = s.copy()
    for k in range(1, ORDER + 1):
        code[k:] += s[:-k] * SYMBOLS**k
    return row, code, np.minimum(at, ORDER)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """side, reach, code, n over (url, side); each batch sends one row for each gram that it has."""

    def count(batches):
        for batch in small_batches(batches, 8192):
            row, code, reach = grams(batch.column(0))
            side = np.asarray(batch.column(1), np.int64)[row]
            for k in range(ORDER + 1):
                own = reach >= k
                keys, n = np.unique(side[own] * 2**40 + code[own] % SYMBOLS ** (k + 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys >> 40, pa.int32()), pa.array(np.full(len(keys), k), pa.int32()), pa.array(keys % 2**40), pa.array(n)], names=["side", "reach", "code", "n"])

    return labelled.mapInArrow(count, "side int, reach int, code long, n long").groupBy("side", "reach", "code").agg(F.sum("n").alias("n"))


def smoothed(counts: list[np.ndarray]) -> list[np.ndarray]:
    """Log-probabilities for each order, from the counts of the orders 0 to ORDER."""
    lower, out = np.full(SYMBOLS, 1 / SYMBOLS), []
    for k, flat in enumerate(counts):
        n = flat.reshape(SYMBOLS**k, SYMBOLS).astype(np.float64)
        total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        back = np.tile(lower.reshape(-1, SYMBOLS), (SYMBOLS if k else 1, 1))
        weight = np.maximum(kinds, 1)
        lower = (n + weight * back) / (total + weight)
        out.append(np.log(lower).astype(np.float32).ravel())
    return out


@dataclass
class RatioModel:
    """log P(accepted) - log P(rejected) by order and gram, and the threshold; tables is None without training URLs."""

    tables: list | None
    threshold: float = 0.0

    def scores(self, column: pa.Array) -> np.ndarray:
        row, code, reach = grams(column)
        if self.tables is None or not len(row):
            return np.zeros(len(column))
        each = np.zeros(len(code))
        for k, table in enumerate(self.tables):
            own = reach == k
            each[own] = table[code[own] % SYMBOLS ** (k + 1)]
        n = np.bincount(row, minlength=len(column))
        return np.bincount(row, each, minlength=len(column)) / np.maximum(n, 1)


def scored(df: DataFrame, model: RatioModel, url: str, name: str) -> DataFrame:
    """df with the score of its url as another column."""
    held, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(url)

    def score(batches):
        for batch in small_batches(batches, 8192):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.scores(batch.column(at)))], names=[*batch.schema.names, name])

    return df.mapInArrow(score, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def train(ruled: DataFrame) -> RatioModel:
    """Models of (url, verdict): counts over all URLs but a fifth, which sets the threshold with the best balanced accuracy."""
    sides = ruled.where(F.col("url").isNotNull() & F.col("verdict").isNotNull()).select("url", (F.col("verdict") == "allow").cast("int").alias("side"))
    calibrates = crc_mod(F.col("url"), 5) == 0
    rows = gram_counts(sides.where(~calibrates)).toPandas()  # at most 2 * (32 + 32^2 + 32^3 + 32^4) rows
    if rows["side"].nunique() < 2:
        return RatioModel(None)
    logs = []
    for side in (0, 1):
        counts = [np.zeros(SYMBOLS ** (k + 1)) for k in range(ORDER + 1)]
        for k, part in rows[rows["side"] == side].groupby("reach"):
            counts[k][part["code"].to_numpy()] = part["n"].to_numpy()
        logs.append(smoothed(counts))
    model = RatioModel([a - r for r, a in zip(*logs, strict=True)])
    bin_of = F.least(F.greatest(F.floor((F.col("score") + REACH) * (BINS / (2 * REACH))), F.lit(0)), F.lit(BINS - 1)).cast("int")
    held = scored(sides.where(calibrates), model, "url", "score").groupBy("side", bin_of.alias("bin")).count().toPandas()  # at most 2 * BINS rows
    if held["side"].nunique() == 2:
        below = np.zeros((2, BINS + 1))
        for side, b, n in held.itertuples(index=False):
            below[side, b + 1] += n
        below = below.cumsum(1)
        right = below[0] / below[0, -1] + 1 - below[1] / below[1, -1]
        best = np.flatnonzero(right >= right.max() - 1e-12)
        model.threshold = float(best[len(best) // 2] * (2 * REACH / BINS) - REACH)
    return model


def judge_urls(pages: DataFrame, ident="page_id", url="url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of pages."""
    host, path = host_and_path(F.col("url"))
    parted = pages.select(F.col(ident).alias("page_id"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parted.withColumns({"rule": rule, "verdict": verdict})
    model = train(ruled)
    said = F.when(F.col("score") < model.threshold, "block").otherwise("allow")
    return scored(ruled, model, "url", "score").select("page_id", "host", "path", "rule", F.coalesce("verdict", said).alias("verdict"), "score")
