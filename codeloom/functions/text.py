"""Scalar text functions as Column expressions: tokens, identifiers, paths, cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TOKEN = r"[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+|[一-鿿]+"
SNAKE = r"\b_+[A-Za-z0-9_]+|[a-z]+_[a-zA-Z0-9_]+\b"
CAMEL = r"\b[A-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\b"
DOTTED = r"\b[a-zA-Z_][a-zA-Z0-9_]*(\.[a-zA-Z_][a-zA-Z0-9_]*)+\b"
STOPWORDS = (
    "the a an and or to of in on for with is are was were be been being this that these those it its as by from at not "
    "should would could can cannot when while if then than into using use used"
).split()


def split_identifier(text: Column) -> Column:
    """Path marks and underscores become blanks, a blank goes before an upper-case letter after a lower one or a digit; lower case."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"[./\\:]+", " "), "_", " ")
    return F.lower(F.trim(F.regexp_replace(spaced, "([a-z0-9])([A-Z])", "$1 $2")))


def tokens(text: Column) -> Column:
    """Tokens of two or more characters, each followed by its parts, so that a plain token counts twice."""
    raw = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) >= 2)
    parts = lambda t: F.filter(F.split(t, "_"), lambda p: F.length(p) >= 2)
    return F.flatten(F.transform(raw, lambda t: F.when(F.contains(t, F.lit("_")), F.concat(F.array(t), parts(t))).otherwise(F.array(t, t))))


def token_bag(text: Column) -> Column:
    """The tokens and parts of `tokens` in another order: first all tokens, then all parts. Regular expressions alone, without a lambda."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z_][a-z0-9_]+|[0-9]{2,}|[一-鿿]{2,}"), F.lit(0))
    return once(raw, lambda r: F.concat(r, F.regexp_extract_all(F.array_join(r, " "), F.lit(r"[a-z0-9]{2,}|[一-鿿]{2,}"), F.lit(0))))


def once(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def keywords(text: Column, most: int = 30) -> Column:
    """The first different tokens that aren't stopwords."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.slice(F.array_distinct(F.filter(raw, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))), 1, most)


def head_and_tail(text: Column, most: int = 6000, head: int = 2500, tail: int = 2500) -> Column:
    """Long texts keep both ends and say how much is left out."""
    left_out = F.concat(F.lit("\n... "), (F.length(text) - (head + tail)).cast("string"), F.lit(" characters elided ...\n"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), left_out, F.right(text, F.lit(tail))))


def package(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]+$", 1)


def dotted_module(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/", "."), r"\.py$", "")


def tool_path(path: Column) -> Column:
    return F.split_part(F.regexp_replace(path, "^[./]+", ""), F.lit("::"), F.lit(1))


def dedup_clean(items: Column) -> Column:
    """Trimmed, not empty, the first of those that are equal but for case."""
    trimmed = F.filter(F.transform(items, lambda s: F.trim(s)), lambda s: s != "")
    lowered = F.transform(trimmed, lambda s: F.lower(s))
    return F.filter(trimmed, lambda s, i: F.array_position(lowered, F.lower(s)) == i + 1)


def looks_like_code(text: Column) -> Column:
    """A path, a name with underscores, a name with two capitals, or a dotted name."""
    path = text.rlike(r"[/\\]|\.py")
    return path | text.rlike(SNAKE) | text.rlike(CAMEL) | text.rlike(DOTTED)


def tolerant_json(text: Column, field: str) -> Column:
    """A field of a JSON text: as it is, without code fences, or from the first brace to the last."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), "^```[a-z]*", ""), "```$", "")
    braced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(*(F.get_json_object(t, f"$.{field}") for t in (text, bare, braced)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm vanishes or a value isn't a number."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(wide(x), wide(y), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms <= 1e-12, 0.0).otherwise(F.nanvl(dot(a, b) / norms, F.lit(0.0)))
