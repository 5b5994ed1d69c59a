"""Regular expressions as one combined deterministic automaton over bytes.

Each rule is parsed into a small tree, the trees become one non-deterministic automaton, subset construction makes it
deterministic over classes of bytes that no rule tells apart, and partition refinement makes it as small as it can be.
The result is two arrays: the class of a byte, and the next state by (state, class). Which rules accept in a state is
another.

Understood: literals, `\\x20` and escaped punctuation, classes with ranges and negation, groups, `|`, `?`, `*`, `+`, `{m}`, `{m,}`
and `{m,n}`. Everything works on the bytes of UTF-8; a negated class takes every byte beyond ASCII, so it fits runs of
characters, not single ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MOST_STATES = 1 << 15

# A tree is ("bytes", frozenset), ("all", [trees]) in sequence, ("any", [trees]) as alternatives, or ("rep", tree, least, most).


class _Reader:
    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"pattern ends too early: {self.pattern}")
        self.at += 1
        return c

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("any", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.single()))
        return ("all", parts)

    def single(self):
        c = self.take()
        if c == "(":
            inner = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"group is not closed: {self.pattern}")
            return inner
        if c == "[":
            return ("bytes", self.byte_class())
        if c in "?*+{":
            raise ValueError(f"nothing to repeat: {self.pattern}")
        return ("bytes", frozenset([self.escaped() if c == "\\" else self.plain(c)]))

    def plain(self, c: str) -> int:
        if not c.isascii() or c in ".^$":
            raise ValueError(f"{c!r} is not understood: {self.pattern}")
        return ord(c)

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        if c.isalnum():
            raise ValueError(f"\\{c} is not understood: {self.pattern}")
        return ord(c)

    def byte_class(self) -> frozenset:
        negated = self.peek() == "^"
        if negated:
            self.take()
        found: set[int] = set()
        while self.peek() != "]":
            low = self.escaped() if (c := self.take()) == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.pattern[self.at + 1 : self.at + 2] != "]":
                self.take()
                high = self.escaped() if (c := self.take()) == "\\" else ord(c)
            found |= set(range(low, high + 1))
        self.take()
        if max(found) > 127:
            raise ValueError(f"only ASCII in classes: {self.pattern}")
        return frozenset(range(256)) - found if negated else frozenset(found)

    def repeated(self, tree):
        while self.peek() in ("?", "*", "+", "{"):
            c = self.take()
            if c == "{":
                stop = self.pattern.index("}", self.at)
                low, _, high = self.pattern[self.at : stop].partition(",")
                bounded = "," not in self.pattern[self.at : stop]
                self.at = stop + 1
                tree = ("rep", tree, int(low), int(low) if bounded else int(high) if high else None)
            else:
                tree = ("rep", tree, 1 if c == "+" else 0, 1 if c == "?" else None)
        return tree


def parse(pattern: str):
    reader = _Reader(pattern)
    tree = reader.alternatives()
    if reader.peek():
        raise ValueError(f"a group is closed that was not opened: {pattern}")
    return tree


def backwards(tree):
    """The tree of the mirrored strings."""
    kind = tree[0]
    if kind == "all":
        return ("all", [backwards(t) for t in reversed(tree[1])])
    if kind == "any":
        return ("any", [backwards(t) for t in tree[1]])
    return tree if kind == "bytes" else ("rep", backwards(tree[1]), *tree[2:])


class _Nfa:
    """States with steps on a set of bytes and steps on nothing."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def new(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Lay `tree` from `start` on; gives its end."""
        kind = tree[0]
        if kind == "bytes":
            at, end = self.new(), self.new()
            self.free[start].append(at)
            self.step[at] = (tree[1], end)
            return end
        if kind == "all":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "any":
            end = self.new()
            for option in tree[1]:
                at = self.new()
                self.free[start].append(at)
                self.free[self.add(option, at)].append(end)
            return end
        _, inner, least, most = tree
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            at, end = self.new(), self.new()
            self.free[start] += [at, end]
            self.free[self.add(inner, at)] += [at, end]
            return end
        end = self.new()
        for _ in range(most - least):
            self.free[start].append(end)
            at = self.new()
            self.free[start].append(at)
            start = self.add(inner, at)
        self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """`step[state, byte_class[byte]]` is the next state, `accepts[state]` the rules as bits; `start` is state 0.

    `dead` is the state that nothing leads out of and that accepts nothing, or -1.
    """

    byte_class: np.ndarray
    step: np.ndarray
    accepts: np.ndarray
    dead: int


def compile_rules(trees: list, anywhere: bool) -> Automaton:
    """One minimal automaton for all rules, from the start of the input or, with `anywhere`, from every place of it."""
    nfa = _Nfa()
    start = nfa.new()
    ends = {}
    for rule, tree in enumerate(trees):
        at = nfa.new()
        nfa.free[start].append(at)
        ends[nfa.add(tree, at)] = rule
    used = sorted({s[0] for s in nfa.step if s}, key=sorted)
    signature = np.array([[b in s for s in used] for b in range(256)], dtype=bool).reshape(256, -1)
    _, byte_class = np.unique(signature, axis=0, return_inverse=True)
    byte_class = byte_class.reshape(-1)
    sample = [int(np.argmax(byte_class == c)) for c in range(byte_class.max() + 1)]

    initial = nfa.closure([start])
    numbers, order, rows = {initial: 0}, [initial], []
    while len(rows) < len(order):
        here = order[len(rows)]
        moves = [nfa.step[s] for s in here if nfa.step[s]]
        row = []
        for b in sample:
            to = nfa.closure([t for on, t in moves if b in on]) | (initial if anywhere else frozenset())
            if to not in numbers:
                if len(order) >= MOST_STATES:
                    raise ValueError(f"the rules need more than {MOST_STATES} states")
                numbers[to] = len(order)
                order.append(to)
            row.append(numbers[to])
        rows.append(row)
    step = np.array(rows, dtype=np.int64)
    accepts = np.array([sum(1 << ends[s] for s in states if s in ends) for states in order], dtype=np.int64)
    return _minimal(byte_class, step, accepts)


def _minimal(byte_class: np.ndarray, step: np.ndarray, accepts: np.ndarray) -> Automaton:
    """States that no input tells apart become one: parts are split by where they lead until none splits."""
    part = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    first = np.full(part.max() + 1, -1)
    first[part[::-1]] = np.arange(len(part))[::-1]
    order = np.argsort(first)  # the part of the initial state first
    name = np.empty(len(order), dtype=np.int64)
    name[order] = np.arange(len(order))
    step, accepts = name[part[step[first[order]]]], accepts[first[order]]
    stuck = np.flatnonzero((step == np.arange(len(step))[:, None]).all(axis=1) & (accepts == 0))
    return Automaton(byte_class.astype(np.uint8), step.astype(np.int32), accepts, int(stuck[0]) if len(stuck) else -1)


def states_after(automaton: Automaton, data: np.ndarray, state: int, lanes: int) -> np.ndarray:
    """The state after each byte of `data`, from `state` on.

    The bytes are cut into lanes that are walked side by side. A lane starts from a guess, the state the automaton starts in;
    lanes whose predecessor ended elsewhere are walked again from there until every guess is right, and only as
    far as their states differ. The result is that of a walk byte by byte.
    """
    n = len(data)
    length = max(1, -(-n // lanes))
    lanes = -(-n // length) if n else 0
    if not lanes:
        return np.empty(0, dtype=np.int32)
    classes = np.zeros(lanes * length, dtype=np.uint8)
    classes[:n] = automaton.byte_class[data]
    classes = np.ascontiguousarray(classes.reshape(lanes, length).T)
    width = automaton.step.shape[1]
    flat = (automaton.step * width).reshape(-1)  # states as offsets of their row
    out = np.empty((length, lanes), dtype=np.int32)
    begin = np.zeros(lanes, dtype=np.int32)
    begin[0] = state * width
    at = begin
    for j in range(length):
        at = flat[at + classes[j]]
        out[j] = at
    while True:
        wanted = np.concatenate([begin[:1], out[-1, :-1]])
        again = np.flatnonzero(wanted != begin)
        if not len(again):
            break
        begin[again] = wanted[again]
        at = wanted[again]
        for j in range(length):
            at = flat[at + classes[j, again]]
            differs = at != out[j, again]
            if not differs.any():
                break
            again, at = again[differs], at[differs]
            out[j, again] = at
    return (out.T.reshape(-1)[:n] // width).astype(np.int32)


def longest(automaton: Automaton, data: bytes, start: int) -> int:
    """End of the longest match from `start` on, -1 where nothing matches."""
    state, end = 0, start if automaton.accepts[0] else -1
    step, classes, accepts, dead = automaton.step, automaton.byte_class, automaton.accepts, automaton.dead
    for at in range(start, len(data)):
        state = step[state, classes[data[at]]]
        if state == dead:
            break
        if accepts[state]:
            end = at + 1
    return end
