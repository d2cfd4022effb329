"""Deterministic automata over bytes: patterns to NFA fragments, subset construction, minimisation, transition arrays.

Patterns have literals, escapes (\\xHH, \\., ...), classes with ranges, groups, alternation, and the
repeats ? * + {m} {m,} {m,n}. There are no anchors and no references. A set of patterns becomes one
automaton whose states know which of them end there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

#: States of one automaton at most: what a rule set costs in memory is known before anything runs. More are an error.
MOST_STATES = 1 << 15


@dataclass
class Nfa:
    """States with edges on byte sets and edges on nothing; ``ends`` says which pattern a state ends."""

    edges: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    ends: dict[int, int] = field(default_factory=dict)

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def closure(self, states) -> frozenset[int]:
        seen, left = set(states), list(states)
        while left:
            for other in self.free[left.pop()]:
                if other not in seen:
                    seen.add(other)
                    left.append(other)
        return frozenset(seen)


# A pattern as a tree: ("set", bytes), ("then", parts), ("or", parts), ("repeat", part, least, most or None).
def parsed(pattern: str, any_case: bool = False) -> tuple:
    """The tree of a pattern; a byte outside ASCII has to be written as \\xHH."""
    at = 0

    def peek() -> str:
        return pattern[at] if at < len(pattern) else ""

    def take() -> str:
        nonlocal at
        if at >= len(pattern):
            raise ValueError(f"the pattern {pattern!r} ends early")
        at += 1
        return pattern[at - 1]

    def byte() -> int:
        c = take()
        if c != "\\":
            return ord(c)
        c = take()
        if c == "x":
            return int(take() + take(), 16)
        if c.isalnum():
            raise ValueError(f"unknown escape \\{c} in {pattern!r}")
        return ord(c)

    def cased(members: set[int]) -> tuple:
        if any(b > 255 for b in members):
            raise ValueError(f"{pattern!r} has a character that is no byte")
        if any_case:
            members = members | {b ^ 32 for b in members if chr(b).isascii() and chr(b).isalpha()}
        return ("set", frozenset(members))

    def members() -> tuple:
        nonlocal at
        negated = peek() == "^"
        at += negated
        out: set[int] = set()
        first = True
        while first or peek() != "]":
            first = False
            low = byte()
            if peek() == "-" and pattern[at + 1 : at + 2] not in ("]", ""):
                at += 1
                out |= set(range(low, byte() + 1))
            else:
                out.add(low)
        at += 1
        kind, found = cased(out)
        return (kind, frozenset(range(256)) - found) if negated else (kind, found)

    def atom() -> tuple:
        nonlocal at
        if peek() == "(":
            at += 1
            inner = either()
            if take() != ")":
                raise ValueError(f"unclosed group in {pattern!r}")
            return inner
        if peek() == "[":
            at += 1
            return members()
        if peek() == ".":
            at += 1
            return ("set", frozenset(range(256)) - {10})
        if peek() in "*+?{":
            raise ValueError(f"nothing to repeat in {pattern!r}")
        return cased({byte()})

    def repeated() -> tuple:
        nonlocal at
        part = atom()
        while peek() and peek() in "*+?{":
            sign = take()
            if sign == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at:end].partition(",")
                at = end + 1
                part = ("repeat", part, int(low), (int(high) if high else None) if comma else int(low))
            else:
                part = ("repeat", part, int(sign == "+"), 1 if sign == "?" else None)
        return part

    def sequence() -> tuple:
        parts = []
        while peek() and peek() not in "|)":
            parts.append(repeated())
        return ("then", parts)

    def either() -> tuple:
        nonlocal at
        parts = [sequence()]
        while peek() == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    tree = either()
    if at < len(pattern):
        raise ValueError(f"unopened group in {pattern!r}")
    return tree


def mirrored(tree: tuple) -> tuple:
    """The tree of the pattern's strings read backwards."""
    kind = tree[0]
    if kind == "then":
        return (kind, [mirrored(p) for p in reversed(tree[1])])
    if kind == "or":
        return (kind, [mirrored(p) for p in tree[1]])
    return ("repeat", mirrored(tree[1]), *tree[2:]) if kind == "repeat" else tree


def head(tree: tuple) -> tuple:
    """The tree without what goes on endlessly at its end: where a match of the pattern ends for the first time, one of its head's does."""
    kind = tree[0]
    if kind == "then" and tree[1]:
        return (kind, [*tree[1][:-1], head(tree[1][-1])])
    if kind == "or":
        return (kind, [head(p) for p in tree[1]])
    return ("repeat", tree[1], tree[2], tree[2]) if kind == "repeat" and tree[3] is None else tree


def _added(nfa: Nfa, tree: tuple, begin: int) -> int:
    """Adds a tree behind ``begin``; returns the state after it."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.edges[begin].append((tree[1], end))
        return end
    if kind == "then":
        for part in tree[1]:
            begin = _added(nfa, part, begin)
        return begin
    if kind == "or":
        end = nfa.state()
        for part in tree[1]:
            own = nfa.state()
            nfa.free[begin].append(own)
            nfa.free[_added(nfa, part, own)].append(end)
        return end
    _, part, least, most = tree
    for _ in range(least):
        begin = _added(nfa, part, begin)
    if most is None:
        hub = nfa.state()
        nfa.free[begin].append(hub)
        nfa.free[_added(nfa, part, hub)].append(hub)
        return hub
    end = nfa.state()
    nfa.free[begin].append(end)
    for _ in range(most - least):
        begin = _added(nfa, part, begin)
        nfa.free[begin].append(end)
    return end


@dataclass(frozen=True)
class Automaton:
    """``steps[state + kind]`` is the next state, a multiple of the number of kinds of bytes; ``kinds`` translates bytes. States from ``ending`` on end a pattern: ``ends`` has which, one after the other. State ``dead`` (-1: none) never ends one."""

    steps: np.ndarray
    kinds: bytes
    width: int
    start: int
    ending: int
    ends: tuple[tuple[int, ...], ...]
    dead: int

    @property
    def states(self) -> int:
        return len(self.steps) // self.width


def compiled(trees: Sequence[tuple], anywhere: bool) -> Automaton:
    """The minimal automaton of patterns that begin at the start, or ``anywhere``."""
    nfa = Nfa()
    root = nfa.state()
    for number, tree in enumerate(trees):
        own = nfa.state()
        nfa.free[root].append(own)
        nfa.ends[_added(nfa, tree, own)] = number
    kinds, of = _byte_kinds(nfa)
    first = nfa.closure([root])
    numbers, order, rows = {first: 0}, [first], []
    for held in order:  # grows while new subsets are found
        targets: list[set[int]] = [set() for _ in kinds]
        for state in held:
            for accepted, end in nfa.edges[state]:
                for kind, sample in enumerate(kinds):
                    if sample in accepted:
                        targets[kind].add(end)
        row = []
        for target in targets:
            reached = nfa.closure(target) | first if anywhere else nfa.closure(target)
            if reached not in numbers:
                if len(order) == MOST_STATES:
                    raise ValueError(f"the patterns need more than {MOST_STATES} states")
                numbers[reached] = len(order)
                order.append(reached)
            row.append(numbers[reached])
        rows.append(row)
    ended = [tuple(sorted({nfa.ends[s] for s in held if s in nfa.ends})) for held in order]
    return _minimal(np.array(rows, np.int64), ended, of)


def _byte_kinds(nfa: Nfa) -> tuple[list[int], bytes]:
    """Bytes that no edge tells apart are of one kind: a byte of each kind, and every byte's kind."""
    sets = sorted({accepted for edges in nfa.edges for accepted, _ in edges}, key=sorted)
    marks: dict[tuple[bool, ...], int] = {}
    of = bytes(marks.setdefault(tuple(b in s for s in sets), len(marks)) for b in range(256))
    return [of.index(k) for k in range(len(marks))], of


def _minimal(rows: np.ndarray, ended: list[tuple[int, ...]], of: bytes) -> Automaton:
    """Partition refinement: states stay together while they end the same patterns and lead to the same blocks on every kind of byte."""
    names: dict[tuple[int, ...], int] = {}
    block = np.array([names.setdefault(e, len(names)) for e in ended])
    while True:
        _, finer = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    sample = np.array([np.flatnonzero(block == b)[0] for b in range(block.max() + 1)])
    order = sorted(range(len(sample)), key=lambda b: (bool(ended[sample[b]]), b))  # what ends a pattern comes last
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    width = rows.shape[1]
    steps = place[block[rows[sample[order]]]] * width
    ending = sum(not ended[sample[b]] for b in order)
    alone = [s * width for s in range(ending) if (steps[s] == s * width).all()]
    return Automaton(steps.ravel(), of, width, int(place[block[0]]) * width, ending * width, tuple(ended[sample[b]] for b in order[ending:]), alone[0] if alone else -1)
