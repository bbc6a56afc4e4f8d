"""Secret scan by one deterministic automaton for all rules.

All rules are compiled into one automaton that walks each text once, byte by byte, and notes the rules that
match somewhere. Only where it finds any, the automaton of each such rule reversed walks back over the text and marks where
matches start, and from each leftmost start the rule's own automaton takes the longest match. Matches of
a kind don't overlap, and one that fails the kind's length condition is dropped after it has consumed its
text. Work is linear in the text, whatever it holds.

Spans are in code points, the end exclusive. Defined results: null and empty texts have no spans; rows are
independent, so ties and repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.automaton import Automaton, Syntax, compiled, either_case, reversed_node, shortest_end
from codeloom.llm.shared import byte_texts, small_batches


@dataclass(frozen=True)
class Rule:
    """head: in either case if folded; the match has at least `least` characters, counted after the head if `of_body`."""

    kind: str
    head: str
    body: str
    least: int
    folded: bool = False
    of_body: bool = False

    def node(self):
        head = Syntax(self.head).parse()
        return ("cat", [either_case(head) if self.folded else head, Syntax(self.body).parse()])


#: The base rules, in the order of the kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=\-]+", 6, folded=True, of_body=True),
    Rule("access", "AKIA", "[A-Z0-9]+", 20),
    Rule("hex", "", "[0-9a-f]{24,}", 24),  # a run's match is the run: shorter ones need no mark
)
#: Further kinds: formats that their issuers publish.
MORE = (
    Rule("private_key", "-----BEGIN ", "([A-Z]+ )*PRIVATE KEY-----", 0),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]\-", r"[A-Za-z0-9\-]+", 15),
    Rule("google", "AIza", r"[A-Za-z0-9_\-]+", 39),
    Rule("jwt", "eyJ", r"[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 30),
)
RULES = BASE + MORE


@dataclass
class Scanner:
    forward: Automaton
    backward: list
    own: list
    heads: list
    rules: tuple

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, kind number, end) in bytes, by start."""
        moves, ends, accepts = self.forward.moves, self.forward.ends * 256, self.forward.accepts
        state = seen = 0
        for b in text:
            state = moves[state + b]
            if state >= ends:
                seen |= accepts[state >> 8]
        if not seen:
            return []
        found = []
        for k, rule in enumerate(self.rules):
            free_from = 0
            for at in reversed(self.starts(text, k)) if seen >> k & 1 else ():
                if at >= free_from:
                    free_from = longest(self.own[k], text, at)
                    counted = longest(self.heads[k], text, at) if rule.of_body else at
                    if free_from - counted >= rule.least:
                        found.append((at, k, free_from))
        return sorted(found)

    def starts(self, text: bytes, k: int) -> list[int]:
        """Where matches of rule k start, from the last."""
        moves, ends, state, found = self.backward[k].moves, self.backward[k].ends * 256, 0, []
        for at in range(len(text) - 1, -1, -1):
            state = moves[state + text[at]]
            if state >= ends:
                found.append(at)
        return found


def longest(automaton: Automaton, text: bytes, at: int) -> int:
    """Where the longest match from `at` ends."""
    moves, ends, dead = automaton.moves, automaton.ends * 256, automaton.dead * 256
    state, end = 0, at
    for k in range(at, len(text)):
        state = moves[state + text[k]]
        if state >= ends:
            end = k + 1
        elif state == dead:
            break
    return end


@cache
def scanner(rules: tuple = RULES) -> Scanner:
    """The rules' automata; compiled once in a process."""
    nodes = [r.node() for r in rules]
    heads = [compiled([either_case(h) if r.folded else h], False) if r.of_body else None for r in rules for h in [Syntax(r.head).parse()]]
    return Scanner(compiled([shortest_end(n) for n in nodes], True), [compiled([reversed_node(n)], True) for n in nodes], [compiled([n], False) for n in nodes], heads, rules)


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Rules match ASCII only, so spans begin and end between characters."""
    if text.isascii():
        return spans
    place, done, count = {}, 0, 0
    for at in sorted({p for s in spans for p in (s[0], s[2])}):
        count += len(text[done:at].decode())
        place[at], done = count, at
    return [(place[a], k, place[z]) for a, k, z in spans]


def find_secrets(docs: DataFrame, ident="doc_id", text="text", rules: tuple = RULES) -> DataFrame:
    """doc_id, and spans as an array of (kind, start, end), by start and then by the order of the rules."""
    schema = f"doc_id {docs.schema[ident].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    known = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def scan(batches):
        scan_one = known.value
        kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in small_batches(batches):
            found = [[(rules[k].kind, a, z) for a, k, z in in_code_points(t, s)] if (s := scan_one.spans(t)) else [] for t in byte_texts(batch.column(1))]
            rows = [[{"kind": k, "start": a, "end": z} for k, a, z in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind_of)], names=["doc_id", "spans"])

    return docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(scan, schema)


def secret_report(docs: DataFrame, ident="doc_id", text="text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text), n_spans."""
    base = [r.kind for r in BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return find_secrets(docs, ident, text).select(
        "doc_id",
        *(F.size(of_kind([k])).cast("bigint").alias(f"n_{k}") for k in base),
        F.sha2(joined(of_kind(base)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
