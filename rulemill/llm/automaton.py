"""Deterministic automata over bytes: rule patterns are parsed, united, made deterministic by subset construction, and
minimised into a transition array of states x 256.

Patterns know literals, `\\x20`-style and `\\.`-style escapes, classes, groups, `|`, `? * + {m} {m,} {m,n}` and `(?i:...)`
for ASCII letters in either case. They describe bytes, so a character outside ASCII is the sequence of its bytes.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np


class _Nfa:
    """Thompson's construction: free moves and moves on byte sets."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def turned(self) -> _Nfa:
        """The same states with every move the other way round."""
        out = _Nfa()
        for _ in self.free:
            out.state()
        for s, targets in enumerate(self.free):
            for t in targets:
                out.free[t].append(s)
        for s, moves in enumerate(self.moves):
            for allowed, t in moves:
                out.moves[t].append((allowed, s))
        return out

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class _Parser:
    """Builds the part of an Nfa for one pattern; every method takes a start state and returns the end state."""

    def __init__(self, nfa: _Nfa, pattern: str):
        self.nfa, self.s, self.i, self.fold = nfa, pattern, 0, False

    def alternatives(self, start: int) -> int:
        end, first = self.nfa.state(), True
        while first or self.peek() == "|":
            self.i += not first
            first = False
            self.nfa.free[self.sequence(start)].append(end)
        return end

    def sequence(self, start: int) -> int:
        entry = self.nfa.state()
        self.nfa.free[start].append(entry)
        while self.peek() not in ("", "|", ")"):
            entry = self.item(entry)
        return entry

    def item(self, start: int) -> int:
        at = self.i
        low, high = 1, 1
        self.i = at
        probe = _Parser(_Nfa(), self.s)
        probe.i = at
        probe.atom(probe.nfa.state())
        low, high, after = self.counts(probe.i)
        state = start
        for _ in range(low):
            self.i = at
            state = self.atom(state)
        if high is None:
            loop = self.nfa.state()
            self.nfa.free[state].append(loop)
            self.i = at
            self.nfa.free[self.atom(loop)].append(loop)
            state = loop
        else:
            end = self.nfa.state()
            for _ in range(high - low):
                self.nfa.free[state].append(end)
                self.i = at
                state = self.atom(state)
            self.nfa.free[state].append(end)
            state = end
        self.i = after
        return state

    def counts(self, i: int) -> tuple[int, int | None, int]:
        c = self.s[i:i + 1]
        if c == "?":
            return 0, 1, i + 1
        if c == "*":
            return 0, None, i + 1
        if c == "+":
            return 1, None, i + 1
        if c == "{":
            end = self.s.index("}", i)
            low, comma, high = self.s[i + 1:end].partition(",")
            return int(low), (int(high) if high else None) if comma else int(low), end + 1
        return 1, 1, i

    def atom(self, start: int) -> int:
        c = self.s[self.i]
        if c == "(":
            folded = self.s.startswith("(?i:", self.i)
            self.i += 4 if folded else 1
            before, self.fold = self.fold, self.fold or folded
            end = self.alternatives(start)
            self.fold = before
            self.i += 1
            return end
        if c == "[":
            return self.move(start, self.byte_class())
        for byte in self.character().encode():
            start = self.move(start, {byte})
        return start

    def move(self, start: int, allowed: set[int]) -> int:
        if self.fold:
            allowed = allowed | {b ^ 32 for b in allowed if chr(b).isascii() and chr(b).isalpha()}
        end = self.nfa.state()
        self.nfa.moves[start].append((frozenset(allowed), end))
        return end

    def byte_class(self) -> set[int]:
        allowed: set[int] = set()
        self.i += 1
        while self.s[self.i] != "]":
            low = high = ord(self.character())
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                high = ord(self.character())
            if high > 127:
                raise ValueError("a class holds ASCII only")
            allowed.update(range(low, high + 1))
        self.i += 1
        return allowed

    def character(self) -> str:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return c
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return chr(int(self.s[self.i - 2:self.i], 16))
        return c

    def peek(self) -> str:
        return self.s[self.i:self.i + 1]


@dataclass(frozen=True)
class Automaton:
    """moves[state, byte] is the next state; accepts[state] has bit k if rule k ends there; state 0 is the start."""
    moves: np.ndarray
    accepts: np.ndarray

    @cached_property
    def lists(self) -> tuple[list[list[int]], list[int]]:
        """Both arrays as lists, which are faster to look up one by one."""
        return self.moves.tolist(), self.accepts.tolist()

    def never(self) -> np.ndarray:
        """Bytes that no match holds, for an automaton whose matches begin at the first byte."""
        return (self.moves == self.dead()).all(axis=0)

    def dead(self) -> int:
        """The state that nothing leaves and that accepts nothing, or -1."""
        stuck = (self.moves == np.arange(len(self.moves))[:, None]).all(axis=1) & (self.accepts == 0)
        return int(np.flatnonzero(stuck)[0]) if stuck.any() else -1

    def shortest(self) -> int:
        """Fewest bytes that lead from the start to an accepting state."""
        seen, front, steps = {0}, {0}, 0
        while front and not any(self.accepts[s] for s in front):
            front = {int(t) for s in front for t in np.unique(self.moves[s])} - seen
            seen |= front
            steps += 1
        return steps


def compile_patterns(patterns: Sequence[str], anywhere: bool, backwards: bool = False) -> Automaton:
    """One automaton for all patterns. `anywhere`: a match may begin at any byte; otherwise only at the first.

    `backwards`: it reads from right to left, and accepts where a match begins.
    """
    nfa = _Nfa()
    start = nfa.state()
    ends = {}
    for k, pattern in enumerate(patterns):
        parser = _Parser(nfa, pattern)
        ends[parser.alternatives(start)] = k
        if parser.i != len(pattern):
            raise ValueError(f"not understood from character {parser.i} on: {pattern}")
    if backwards:
        if len(patterns) != 1:
            raise ValueError("only one pattern is read backwards")
        nfa, start, ends = nfa.turned(), next(iter(ends)), {start: 0}
    if anywhere:
        before = nfa.state()
        nfa.free[before].append(start)
        nfa.moves[before].append((frozenset(range(256)), before))
        start = before
    # Bytes that no move tells apart are one letter.
    letters: dict[frozenset, list[int]] = {}
    sets = {m[0] for moves in nfa.moves for m in moves}
    for byte in range(256):
        letters.setdefault(frozenset(s for s in sets if byte in s), []).append(byte)
    letter_of = np.zeros(256, np.int64)
    for k, group in enumerate(letters.values()):
        letter_of[group] = k
    first_of = [group[0] for group in letters.values()]
    # Subset construction.
    known, order, table = {nfa.closure([start]): 0}, [nfa.closure([start])], []
    closures: dict[frozenset, frozenset] = {}
    for subset in order:
        row = []
        for byte in first_of:
            reached = frozenset(t for s in subset for allowed, t in nfa.moves[s] if byte in allowed)
            closed = closures.get(reached)
            if closed is None:
                closed = closures[reached] = nfa.closure(reached)
            if closed not in known:
                known[closed] = len(order)
                order.append(closed)
            row.append(known[closed])
        table.append(row)
    moves = np.array(table, np.int64)
    accepts = np.array([sum(1 << ends[s] for s in subset if s in ends) for subset in order], np.int64)
    # Minimisation: split classes until states of a class agree on where each letter leads.
    part = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        _, finer = np.unique(np.column_stack([part, part[moves]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    # The class of the start becomes state 0.
    names = np.unique(part, return_index=True)[1]
    swap = np.argsort(np.argsort(np.where(np.arange(len(names)) == part[0], -1, np.arange(len(names)))))
    small = np.empty((len(names), len(first_of)), np.int64)
    small[swap] = swap[part[moves[names]]]
    kept = np.empty(len(names), np.int64)
    kept[swap] = accepts[names]
    return Automaton(small[:, letter_of].astype(np.int32), kept)
