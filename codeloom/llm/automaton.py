"""Byte automata: a small regex syntax, subset construction, minimisation, transition arrays.

Syntax, over bytes: literals, `\\` escapes (`\\xNN` too), `[...]` classes with ranges and `^`, groups, `|`, `?`, `*`,
`+`, `{m}`, `{m,}` and `{m,n}`. A set of rules is compiled together; each state of the result knows which
rules have a match that ends there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class Syntax:
    """Recursive descent over a pattern. Nodes: ("set", bytes), ("cat", [..]), ("alt", [..]), ("rep", node, least, most)."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def parse(self):
        node = self.alternatives()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} in {self.text!r}")
        return node

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"{self.text!r} ends early")
        self.at += 1
        return c

    def alternatives(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        found = []
        while self.peek() not in ("", "|", ")"):
            found.append(self.repeated())
        return ("cat", found)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                inner = ""
                while self.peek() != "}":
                    inner += self.take()
                self.take()
                least, _, most = inner.partition(",")
                bounds = (int(least), (int(most) if most else None) if "," in inner else int(least))
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, *bounds)
        return node

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def atom(self):
        c = self.take()
        if c == "(":
            node = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"a group isn't closed in {self.text!r}")
            return node
        if c == "[":
            return ("set", self.members())
        return ("set", frozenset([self.escaped() if c == "\\" else ord(c)]))

    def members(self) -> frozenset:
        invert = self.peek() == "^"
        if invert:
            self.take()
        found: set[int] = set()
        while (c := self.take()) != "]":
            low = self.escaped() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("", "]"):
                self.take()
                high = self.escaped() if (c := self.take()) == "\\" else ord(c)
            found.update(range(low, high + 1))
        return frozenset(range(256)) - found if invert else frozenset(found)


def either_case(node):
    """The node with both cases of each ASCII letter."""
    kind = node[0]
    if kind == "set":
        return ("set", node[1] | {b ^ 32 for b in node[1] if chr(b).isascii() and chr(b).isalpha()})
    if kind == "rep":
        return ("rep", either_case(node[1]), *node[2:])
    return (kind, [either_case(x) for x in node[1]])


def shortest_end(node):
    """The node with its last repetition cut to the least number: it matches somewhere exactly if the node does."""
    if node[0] == "cat" and node[1]:
        return ("cat", [*node[1][:-1], shortest_end(node[1][-1])])
    return ("rep", node[1], node[2], node[2]) if node[0] == "rep" and node[2] else node


def reversed_node(node):
    if node[0] == "cat":
        return ("cat", [reversed_node(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [reversed_node(x) for x in node[1]])
    return ("rep", reversed_node(node[1]), *node[2:]) if node[0] == "rep" else node


class Threads:
    """A nondeterministic automaton: for each state, moves (bytes, target) and free moves."""

    def __init__(self):
        self.moves: list[list] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, node, start: int) -> int:
        """Builds node from the state start; returns the state where it ends."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                into = self.state()
                self.free[start].append(into)
                self.free[self.add(x, into)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = self.add(inner, start)
        end = self.state()
        self.free[start].append(end)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            back = self.add(inner, loop)
            self.free[back] += [loop, end]
        else:
            for _ in range(most - least):
                start = self.add(inner, start)
                self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


@dataclass
class Automaton:
    """moves[state * 256 + byte] is the next state times 256; states are numbered so that those from `ends` on accept.

    accepts[state] is a bit for each rule. State 0 is the first; `dead` is the state without a way to a match, or -1.
    """

    moves: list
    ends: int
    accepts: list
    dead: int


def compiled(nodes: list, anywhere: bool) -> Automaton:
    """The minimal automaton for matches of any rule: of a prefix of the input, or, with anywhere, of any part of it."""
    threads = Threads()
    first = threads.state()
    finals = {}
    for k, node in enumerate(nodes):
        into = threads.state()
        threads.free[first].append(into)
        finals[threads.add(node, into)] = k
    start = threads.closure([first])

    # Bytes that no set tells apart are one class.
    signature = np.zeros(256, np.int64)
    for members in {m for moves in threads.moves for m, _ in moves}:
        inside = np.zeros(256, np.int64)
        inside[list(members)] = 1
        signature = np.unique(signature * 2 + inside, return_inverse=True)[1]
    classes = int(signature.max()) + 1
    sample = [int(np.flatnonzero(signature == c)[0]) for c in range(classes)]

    # Subset construction.
    number, todo, rows = {start: 0}, [start], []
    while todo:
        subset = todo.pop(0)
        row = []
        for b in sample:
            reached = {t for s in subset for members, t in threads.moves[s] if b in members}
            after = threads.closure(reached | ({first} if anywhere else set()))
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        rows.append(row)
    table = np.array(rows, np.int64)
    marks = np.array([sum({1 << finals[s] for s in subset if s in finals}) for subset in number], np.int64)

    # Minimisation: states stay in one block while all their moves lead to the same blocks.
    block = np.unique(marks, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    n = int(block.max()) + 1
    member = np.zeros(n, np.int64)
    member[block] = np.arange(len(block))
    small, mark = block[table[member]], marks[member]

    # The first state is 0 and the accepting ones come last.
    order = sorted(range(n), key=lambda s: (mark[s] != 0, s != block[0], s))
    place = np.zeros(n, np.int64)
    place[order] = np.arange(n)
    small, mark = place[small[order]], mark[order]
    stuck = [s for s in range(n) if not mark[s] and (small[s] == s).all()]
    if mark[0] or order[0] != block[0]:
        raise ValueError("a rule matches the empty text")
    return Automaton((small[:, signature] * 256).ravel().tolist(), int((mark == 0).sum()), mark.tolist(), stuck[0] if stuck else -1)
