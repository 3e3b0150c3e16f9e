"""Many byte regexes as one minimised deterministic automaton.

The rules' expressions become one nondeterministic automaton; subset
construction makes it deterministic, partition refinement minimises it, and the
result is a plain transition array. One pass over the bytes of a text then
tells, for all rules together, where some match ends. Only around such ends
two more automata of the rule at hand run: its mirror image, which finds every
place where a match starts, and its anchored form, which finds the longest
match from there. Matches are leftmost-longest and do not overlap within a rule.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np

_parser = re._parser  # the syntax tree of a standard expression

ALL = range(256)


class Rule(NamedTuple):
    """A kind of secret. ``min_chars`` bounds the whole match and ``min_tail``
    the run that ends it (the expression then ends in ``[...]+``); a match that
    fails either is dropped but has used up its text."""

    kind: str
    pattern: str
    min_chars: int = 1
    min_tail: int = 0


class Graph:
    """A nondeterministic automaton over bytes."""

    def __init__(self) -> None:
        self.free: list[set[int]] = []       # moves that read nothing
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append(set())
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree, at: int) -> int:
        """Append an expression after state ``at``; returns its last state."""
        for op, arg in tree:
            at = getattr(self, "_" + str(op).lower())(arg, at)
        return at

    def _step(self, chars: frozenset, at: int) -> int:
        to = self.state()
        self.moves[at].append((chars, to))
        return to

    def _literal(self, arg: int, at: int) -> int:
        if arg > 127:
            raise ValueError("rules are ASCII expressions")
        return self._step(frozenset([arg]), at)

    def _not_literal(self, arg: int, at: int) -> int:
        return self._step(frozenset(set(range(128)) - {arg}), at)

    def _in(self, arg, at: int) -> int:
        found: set[int] = set()
        for op, x in arg:
            name = str(op).lower()
            if name == "literal":
                found.add(x)
            elif name == "range":
                found.update(range(x[0], x[1] + 1))
            elif name != "negate":
                raise ValueError(f"unsupported class item {op}")
        inverse = any(str(op).lower() == "negate" for op, _ in arg)
        return self._step(frozenset(set(range(128)) - found if inverse else found), at)

    def _branch(self, arg, at: int) -> int:
        end = self.state()
        for tree in arg[1]:
            first = self.state()
            self.free[at].add(first)
            self.free[self.add(tree, first)].add(end)
        return end

    def _subpattern(self, arg, at: int) -> int:
        return self.add(arg[-1], at)

    def _max_repeat(self, arg, at: int) -> int:
        least, most, tree = arg
        for _ in range(least):
            at = self.add(tree, at)
        if most is _parser.MAXREPEAT:
            loop, end = self.state(), self.state()
            self.free[at].add(loop)
            self.free[self.add(tree, loop)].add(loop)
            self.free[loop].add(end)
            return end
        end = self.state()
        self.free[at].add(end)
        for _ in range(most - least):
            at = self.add(tree, at)
            self.free[at].add(end)
        return end

    def mirrored(self) -> "Graph":
        out = Graph()
        for _ in self.free:
            out.state()
        for a, tos in enumerate(self.free):
            for b in tos:
                out.free[b].add(a)
        for a, moves in enumerate(self.moves):
            for chars, b in moves:
                out.moves[b].append((chars, a))
        return out


class Automaton(NamedTuple):
    """``table[state * 256 + byte]`` is the next state; state 0 is the start.
    ``accepts[state]`` is a bit mask of the rules that match there."""

    table: np.ndarray
    accepts: np.ndarray


def determinise(graph: Graph, starts: list[int], ends: dict[int, int], anywhere: bool) -> Automaton:
    """Subset construction, then minimisation. ``ends``: state to rule number;
    ``anywhere``: a match may begin at any byte."""
    closures: dict[int, frozenset] = {}

    def closure(s: int) -> frozenset:
        if s not in closures:
            seen, todo = {s}, [s]
            while todo:
                for x in graph.free[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            closures[s] = frozenset(seen)
        return closures[s]

    # bytes that no expression tells apart share a column
    groups: dict[tuple, list[int]] = {}
    sets = sorted({chars for moves in graph.moves for chars, _ in moves}, key=sorted)
    for b in ALL:
        groups.setdefault(tuple(b in s for s in sets), []).append(b)
    columns = list(groups.values())
    first = frozenset().union(*(closure(s) for s in starts))
    known, order, rows = {first: 0}, [first], []
    while len(rows) < len(order):
        here, row = order[len(rows)], []
        live = [m for s in here for m in graph.moves[s]]
        for column in columns:
            nxt = frozenset().union(first if anywhere else (), *(closure(to) for chars, to in live if column[0] in chars))
            if nxt not in known:
                known[nxt] = len(order)
                order.append(nxt)
            row.append(known[nxt])
        rows.append(row)
    trans = np.array(rows, np.int64).reshape(len(order), len(columns))
    accepts = np.array([sum({1 << ends[s] for s in subset if s in ends}) for subset in order], np.int64)

    _, block = np.unique(accepts, return_inverse=True)  # Moore's refinement
    while True:
        _, finer = np.unique(np.column_stack([block, block[trans]]), axis=0, return_inverse=True)
        if finer.max() == block.max():
            break
        block = finer
    number: dict[int, int] = {}
    for b in block.tolist():
        number.setdefault(b, len(number))  # the start's block becomes 0
    block = np.array([number[b] for b in block.tolist()])
    _, member = np.unique(block, return_index=True)
    small = block[trans[member]]
    table = np.zeros((len(member), 256), np.int32)
    for i, column in enumerate(columns):
        table[:, column] = small[:, [i]]
    return Automaton(table.ravel(), accepts[member])


class Scanner:
    """All rules compiled. Small (a few thousand states at most, whatever the
    data), so it travels to the tasks inside their function."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = list(rules)
        whole, starts, ends = Graph(), [], {}
        self.single = []
        for i, rule in enumerate(self.rules):
            tree = _parser.parse(rule.pattern)
            starts.append(whole.state())
            ends[whole.add(tree, starts[-1])] = i
            own = Graph()
            a = own.state()
            z = own.add(tree, a)
            forward = determinise(own, [a], {z: 0}, anywhere=False)
            if forward.accepts[0]:
                raise ValueError(f"rule {rule.kind} matches the empty text")
            self.single.append((forward, determinise(own.mirrored(), [z], {a: 0}, anywhere=True)))
        combined = determinise(whole, starts, ends, anywhere=True)
        # states that accept are numbered last, so that one comparison finds them
        order = np.argsort(combined.accepts != 0, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.n_states = len(order)
        self.table = (rank[combined.table.reshape(-1, 256)[order]] * 256).ravel().astype(np.int32)
        self.accepts = combined.accepts[order]
        self.first_accept = int((self.accepts == 0).sum()) * 256
        self._lists = None

    def __getstate__(self):
        return self.__dict__ | {"_lists": None}

    def _ready(self):
        if self._lists is None:
            dead = []
            for forward, _ in self.single:
                rows = forward.table.reshape(-1, 256)
                dead.append([bool((rows[s] == s).all() and not forward.accepts[s]) for s in range(len(rows))])
            self._lists = (self.table.tolist(), [
                (f.table.tolist(), f.accepts.tolist(), d, r.table.tolist(), r.accepts.tolist())
                for (f, r), d in zip(self.single, dead)])
        return self._lists

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, by start and then rule."""
        flat, single = self._ready()
        least, s, hits = self.first_accept, 0, []
        for i, b in enumerate(data):
            s = flat[s + b]
            if s >= least:
                hits.append((i + 1, s))
        if not hits:
            return []
        ends: dict[int, list[int]] = {}
        for at, s in hits:
            mask = int(self.accepts[s >> 8])
            while mask:
                low = mask & -mask
                ends.setdefault(low.bit_length() - 1, []).append(at)
                mask ^= low
        found = []
        for k, own in ends.items():
            found += [(a, k, z) for a, z in self._resolve(data, own, self.rules[k], *single[k])]
        return sorted(found)

    @staticmethod
    def _resolve(data, ends, rule, forward, final, dead, back, begins):
        starts, k = [], len(ends) - 1
        while k >= 0:
            p, s = ends[k], 0
            while p > 0:
                p -= 1
                s = back[s * 256 + data[p]]
                if begins[s]:
                    starts.append(p)
                if s == 0:
                    break  # no match reaches further back
            while k >= 0 and ends[k] > p:
                k -= 1
            if p == 0:
                break
        out, free_from, n = [], 0, len(data)
        for a in reversed(starts):
            if a < free_from:
                continue
            p, s, first, last = a, 0, 0, 0
            while p < n:
                s = forward[s * 256 + data[p]]
                p += 1
                if final[s]:
                    first, last = first or p, p
                elif dead[s]:
                    break
            if last:
                free_from = last
                if last - a >= rule.min_chars and last - first + 1 >= rule.min_tail:
                    out.append((a, last))
        return out
