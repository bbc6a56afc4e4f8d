"""Messages of several shapes, as JSON texts: their text, their tool calls, the actions in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = r"(?s)```(?:bash|sh)?\s*\n(.*?)\n```"


def kind_of(value: Column) -> Column:
    """STRING, ARRAY, OBJECT, ... of a variant; null for null."""
    return F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def text_at(value: Column, path: str) -> Column:
    """A text at a path, and nothing where something else stands there."""
    found = at(value, path)
    return F.when(kind_of(found) == "STRING", F.try_variant_get(value, path, "string"))


def items_at(value: Column, path: str) -> Column:
    return F.coalesce(F.when(kind_of(at(value, path)) == "ARRAY", F.try_variant_get(value, path, "array<variant>")), F.array().cast("array<variant>"))


def observed(text: Column) -> Column:
    """An observation that is a JSON object with a return code: its keys and values, a line each; any other text as it is."""
    parsed = F.try_parse_json(text)
    keys = F.map_entries(F.from_json(text, "map<string,string>"))
    shown = F.array_join(F.transform(keys, lambda e: F.concat(F.lit("<"), e["key"], F.lit(">\n"), F.coalesce(e["value"], F.lit("None")))), "\n")
    return F.when((kind_of(parsed) == "OBJECT") & at(parsed, "$.returncode").isNotNull(), shown).otherwise(text)


def called(arguments: Column) -> Column:
    """The command of a call's arguments in a fence, else the arguments."""
    command = text_at(F.try_parse_json(arguments), "$.command")
    return F.concat(F.lit("```\n"), F.coalesce(command, arguments), F.lit("\n```"))


def message_text(message: Column) -> Column:
    """The text of a message: plain or listed content, results and uses of tools, tool calls, and outputs of a response."""
    m = F.try_parse_json(message)
    arguments = lambda c, path: F.coalesce(text_at(c, path), F.lit("{}"))
    item = lambda x: (
        F.when(text_at(x, "$.type") == "tool_use", called(F.coalesce(F.to_json(at(x, "$.input")), F.lit("{}")))).when(text_at(x, "$.type") == "tool_result", observed(text_at(x, "$.content"))).otherwise(text_at(x, "$.text"))
    )
    output = lambda x: F.when(text_at(x, "$.type") == "message", F.array_join(F.filter(F.transform(items_at(x, "$.content"), lambda c: text_at(c, "$.text")), lambda t: t != ""), "\n\n")).when(text_at(x, "$.type") == "function_call", called(arguments(x, "$.arguments")))
    parts = F.concat(
        F.array(observed(text_at(m, "$.content"))), F.transform(items_at(m, "$.content"), item), F.transform(items_at(m, "$.tool_calls"), lambda c: F.when(at(c, "$.function").isNotNull(), called(arguments(c, "$.function.arguments")))),
        F.array(observed(text_at(m, "$.output"))), F.transform(items_at(m, "$.output"), output),
    )
    return F.array_join(F.filter(parts, lambda t: t.isNotNull() & (t != "")), "\n\n")


def raw_calls(message: Column) -> Column:
    """The most tool calls that a shape of the message holds."""
    m = F.try_parse_json(message)
    return F.greatest(F.size(items_at(m, "$.tool_calls")), F.size(items_at(m, "$.extra.response.choices[0].message.tool_calls")))


def one_action(content: Column, pattern: str = BLOCK) -> tuple[Column, Column]:
    """The action of a text, null unless there is just one, and how many there are."""
    found = F.transform(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(pattern), F.lit(1)), lambda a: F.trim(a))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))), F.size(found)


def call_error(name: Column, arguments: Column) -> Column:
    """What is wrong with a tool call; null where it can be run."""
    parsed = F.try_parse_json(arguments)
    wrong = F.concat_ws(
        " ", F.when(parsed.isNull(), "arguments are not JSON"), F.when(F.coalesce(name, F.lit("")) != "bash", F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("")))),
        F.when((F.coalesce(kind_of(parsed), F.lit("")) != "OBJECT") | at(parsed, "$.command").isNull(), "no command"),
    )
    return F.when(wrong != "", wrong)


def merged(*maps: Column) -> Column:
    """Maps put together, a later value wins; null maps and null values are passed over."""
    entries = F.concat(*(F.coalesce(F.map_entries(F.map_filter(m, lambda k, v: v.isNotNull())), F.array().cast("array<struct<key:string,value:string>>")) for m in maps))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))
