"""Texts of graph nodes: as skeleton source, for dense vectors, for lexical search, as queries, as references.

Columns of a node: type, name, qualified_name, file, signature, docstring, code, comment, method_names (array), start_line, end_line and, where
known, decorators, bases, unresolved_bases (arrays) and methods (array of method structs: name, signature, docstring, decorators, line, is_async).
A text that a node lacks may be null or blank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.text import split_identifier

#: Cuts of code and lists.
SEARCHED, ASKED, PREBUILT, EMBEDDED = 1200, 800, 500, 1600
ALIASES, METHODS, SUMMARIES = 30, 80, 50


def said(text: Column) -> Column:
    """Null where nothing is said."""
    return F.when(F.trim(text) != "", text)


def labelled(label: str, text: Column) -> Column:
    return F.concat(F.lit(f"{label} "), F.when(text != "", text))


def lines(*parts: Column) -> Column:
    """What is said, a line each."""
    return F.trim(F.concat_ws("\n", *(said(p) for p in parts)))


def listed(items: Column, by: str = " ") -> Column:
    return said(F.array_join(F.filter(items, lambda x: x.isNotNull() & (x != "")), by))


def class_skeleton(name: Column, bases: Column, decorators: Column, docstring: Column, methods: Column) -> Column:
    """The head of a class and a comment for each of its first METHODS methods. methods: array of method structs."""
    n = F.size(methods)
    decorated = lambda m: F.when(F.size(m["decorators"]) > 0, F.concat(F.lit(" decorators=['"), F.array_join(m["decorators"], "', '"), F.lit("']"))).otherwise("")
    method = lambda m: F.concat(F.when(m["is_async"], "    # - async def ").otherwise("    # - def "), m["name"], m["signature"], F.lit(" line="), m["line"].cast("string"), decorated(m))
    head = F.concat(F.lit("class "), name, F.coalesce(bases, F.lit("")), F.lit(":"))
    doc = F.when(docstring != "", F.concat(F.lit('    """'), docstring, F.lit('"""')))
    shown = F.when(n > 0, F.concat(F.array(F.lit("    # Methods:")), F.transform(F.slice(methods, 1, METHODS), method))).otherwise(F.array().cast("array<string>"))
    more = F.when(n > METHODS, F.concat(F.lit("    # ... "), (n - METHODS).cast("string"), F.lit(" more methods")))
    bare = F.when((n == 0) & (F.coalesce(docstring, F.lit("")) == "") & (F.size(decorators) == 0), "    ...")
    every = F.concat(F.transform(decorators, lambda d: F.concat(F.lit("@"), d)), F.array(head, doc), shown, F.array(more, bare))
    return F.concat(F.array_join(F.array_compact(every), "\n"), F.lit("\n"))


def function_skeleton(name: Column, signature: Column, decorators: Column, docstring: Column, is_async: Column) -> Column:
    head = F.concat(F.when(is_async, "async def ").otherwise("def "), name, signature, F.lit(":"))
    doc = F.when(docstring != "", F.concat(F.lit('    """'), docstring, F.lit('"""')))
    every = F.concat(F.transform(decorators, lambda d: F.concat(F.lit("@"), d)), F.array(head, doc, F.lit("    ...")))
    return F.concat(F.array_join(F.array_compact(every), "\n"), F.lit("\n"))


def import_summary(docstring: Column, imports: Column, from_imports: Column) -> Column:
    """A module's docstring and its first aliases of each kind in order. imports: maps of alias to what it stands for."""
    def told(label, aliases):
        pairs = F.transform(F.slice(F.array_sort(F.map_entries(aliases)), 1, ALIASES), lambda e: F.concat(e["key"], F.lit(" -> "), e["value"]))
        return F.when(F.size(aliases) > 0, F.concat(F.lit(f"# {label}: "), F.array_join(pairs, "; ")))

    doc = F.when(docstring != "", F.concat(F.lit('"""'), docstring, F.lit('"""')))
    return lines(doc, told("Import aliases", imports), told("From-import aliases", from_imports))


def skeleton_text(type_: Column, name: Column, signature: Column, docstring: Column, methods: Column, qualified: Column) -> Column:
    """What a skeleton node is, in one line."""
    doc = F.when(docstring != "", F.concat(F.lit(": "), docstring))
    names = F.when(F.size(methods) > 0, F.concat(F.lit(". Methods: "), F.array_join(methods, ", ")))
    own = F.concat(name, F.coalesce(signature, F.lit("")))
    return (
        F.when(type_ == "CLASS", F.concat_ws(" ", F.concat(F.lit("class "), own), doc, names))
        .when(type_.isin("FUNCTION", "METHOD"), F.concat_ws(" ", F.concat(F.lit("def "), own), doc))
        .when(type_ == "MODULE", F.concat_ws(" ", F.concat(F.lit("module "), name), doc))
        .otherwise(qualified)
    )


def node_skeleton() -> Column:
    return skeleton_text(*(F.col(c) for c in ("type", "name", "signature", "docstring", "method_names", "qualified_name")))


def shared_parts() -> list[Column]:
    return [F.trim("comment"), F.trim(node_skeleton()), labelled("signature", F.col("signature")), labelled("docstring", F.col("docstring")), labelled("methods", listed(F.col("method_names"), ", "))]


def searched_text() -> Column:
    """What a node's dense vector is made from."""
    return lines(*shared_parts(), F.trim(F.left("code", F.lit(SEARCHED))), F.col("qualified_name"), labelled("file", F.col("file")))


def query_text() -> Column:
    """What is searched for when a node is the query."""
    return lines(*shared_parts(), F.col("qualified_name"), labelled("file", F.col("file")), F.trim(F.left("code", F.lit(ASKED))))


def prebuilt_text() -> Column:
    """The text of the vectors that are made ahead; null for modules and nodes that say nothing."""
    skeleton = node_skeleton()
    text = F.when((F.trim(skeleton) == "") | (skeleton == F.col("qualified_name")), F.trim(F.left("code", F.lit(PREBUILT)))).otherwise(skeleton)
    return F.when(F.col("type").isin("CLASS", "FUNCTION", "METHOD"), said(text))


def method_text(class_name: Column, class_signature: Column, class_docstring: Column) -> Column:
    """What methods of a file are ranked by; the class columns are null without one."""
    own = F.when(F.coalesce(F.col("qualified_name"), F.lit("")) != "", F.col("qualified_name")).otherwise(F.col("name"))
    code = F.when(F.col("code") != "", F.concat(F.lit("code\n"), F.left("code", F.lit(EMBEDDED))))
    of_class = [labelled("class", class_name), labelled("class_bases", class_signature), labelled("class_docstring", class_docstring)]
    return F.trim(F.concat_ws("\n", F.concat(F.lit("method "), own), F.concat(F.lit("file "), F.col("file")), *of_class, labelled("signature", F.col("signature")), labelled("docstring", F.col("docstring")), code))


def lexical_text(extended: bool = True) -> Column:
    """What BM25 finds a node by: each symbol is there as it is and split into words."""
    both = lambda c: [c, split_identifier(c)]
    parts = [*both(F.col("name")), *both(F.col("qualified_name")), F.col("file"), F.translate("file", "/\\", "  "), *both(F.col("signature")), F.col("docstring")]
    parts += [*both(F.array_join("method_names", " ")), F.col("comment"), F.col("code"), node_skeleton()]
    if extended:
        summary = lambda m: F.concat_ws("\n", *(said(x) for x in (*both(m["name"]), *both(m["signature"]), m["docstring"], *both(F.array_join(m["decorators"], " ")))))
        for c in ("decorators", "bases", "unresolved_bases"):
            parts += both(listed(F.col(c)))
        parts.append(F.array_join(F.transform(F.slice("methods", 1, SUMMARIES), summary), "\n"))
    return lines(*parts)


def reference() -> Column:
    """qualified_name (file:first-last)."""
    return F.format_string("%s (%s:%s-%s)", "qualified_name", "file", F.col("start_line").cast("string"), F.col("end_line").cast("string"))


def preview(code: Column, most: int = 400) -> Column:
    return F.when(F.length(code) > most, F.concat(F.left(code, F.lit(most)), F.lit("..."))).otherwise(code)
