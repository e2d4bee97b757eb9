"""Regular expressions over bytes compiled to one minimal deterministic automaton.

Syntax: literals, \\xHH, classes with ranges, groups, |, ?, *, + and {n,}. Rules are joined
by a Thompson automaton, made deterministic by subset construction over byte classes and
minimised by partition refinement; the result is a flat transition array. Compiled backward,
the rules' edges are turned round first: read from a text's end, it accepts where matches start.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


class _Parser:
    """Builds Thompson fragments: edges[state] = [(bytes or None, target)]."""

    def __init__(self, fold: bool):
        self.edges: list[list[tuple[frozenset[int] | None, int]]] = []
        self.fold = fold

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def link(self, a: int, label, b: int) -> None:
        self.edges[a].append((label, b))

    def parse(self, pattern: str) -> tuple[int, int]:
        self.p, self.i = pattern, 0
        out = self.union()
        if self.i != len(pattern):
            raise ValueError(f"unbalanced pattern at {self.i}")
        return out

    def more(self, stop: str) -> bool:
        return self.i < len(self.p) and self.p[self.i] not in stop

    def union(self) -> tuple[int, int]:
        a, b = self.state(), self.state()
        while True:
            s, e = self.sequence()
            self.link(a, None, s)
            self.link(e, None, b)
            if not (self.i < len(self.p) and self.p[self.i] == "|"):
                return a, b
            self.i += 1

    def sequence(self) -> tuple[int, int]:
        a = end = self.state()
        while self.more("|)"):
            s, e = self.repeated()
            self.link(end, None, s)
            end = e
        return a, end

    def repeated(self) -> tuple[int, int]:
        at = self.i
        s, e = self.atom()
        after = self.i
        if not self.more("|)"):
            return s, e
        sign = self.p[self.i]
        if sign == "{":
            stop = self.p.index("}", self.i)
            low = int(self.p[self.i + 1 : stop].rstrip(","))
            open_end = self.p[stop - 1] == ","
            for _ in range(low - 1):
                self.i = at
                s2, e2 = self.atom()
                self.link(e, None, s2)
                last, e = s2, e2
            if open_end:
                self.link(e, None, last if low > 1 else s)
            self.i = stop + 1
            return s, e
        if sign not in "?*+":
            return s, e
        self.i = after + 1
        if sign == "?":
            self.link(s, None, e)
            return s, e
        a, b = self.state(), self.state()
        self.link(a, None, s)
        self.link(e, None, b)
        self.link(e, None, s)
        if sign == "*":
            self.link(a, None, b)
        return a, b

    def atom(self) -> tuple[int, int]:
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            s, e = self.union()
            self.i += 1
            return s, e
        if c == "[":
            self.i += 1
            items: set[int] = set()
            while self.p[self.i] != "]":
                low = self.byte()
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    items.update(range(low, self.byte() + 1))
                else:
                    items.add(low)
            self.i += 1
        else:
            items = {self.byte()}
        if self.fold:
            items |= {ord(chr(x).swapcase()) for x in items if x < 128 and chr(x).isalpha()}
        s, e = self.state(), self.state()
        self.link(s, frozenset(items), e)
        return s, e

    def byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        if self.p[self.i] == "x":
            self.i += 3
            return int(self.p[self.i - 2 : self.i], 16)
        self.i += 1
        return ord(self.p[self.i - 1])


@dataclass(frozen=True)
class Automaton:
    """classes: byte -> class; table: state * n_classes + class -> state; accepts: bit mask of rules per state.

    State 0 is the dead state, `start` the first.
    """

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    start: int
    n_classes: int

    def longest(self, data: bytes, at: int, stop: int) -> int:
        """End of the longest match that begins at `at`, or -1."""
        table, classes, accepts, n = self._lists
        state, end = self.start, -1
        while at < stop:
            state = table[state * n + classes[data[at]]]
            if not state:
                break
            at += 1
            if accepts[state]:
                end = at
        return end

    @property
    def _lists(self):
        have = self.__dict__.get("_cached")
        if have is None:
            have = (self.table.tolist(), self.classes.tolist(), self.accepts.tolist(), self.n_classes)
            object.__setattr__(self, "_cached", have)
        return have

    def accepting(self, data: bytes, positions: Iterable[int]) -> list[tuple[int, int]]:
        """(position, mask of rules) of the bytes behind which an unanchored automaton accepts, fed in this order."""
        table, classes, accepts, n = self._lists
        state, out = self.start, []
        for at in positions:
            state = table[state * n + classes[data[at]]]
            if accepts[state]:
                out.append((at, accepts[state]))
        return out

    def resets(self) -> np.ndarray:
        """Bytes that lead from every state to where the start state goes without progress (unanchored use)."""
        t = self.table.reshape(-1, self.n_classes)
        home = np.array([(t[1:, c] == self.start).all() for c in range(self.n_classes)])
        return home[self.classes]


def compile_rules(rules: list[tuple[str, bool]], anywhere: bool = False, backward: bool = False) -> Automaton:
    """One automaton for (pattern, fold case) rules; `anywhere`: a match may start at any byte.

    `backward`: bytes are to be fed from the last to the first, so a match's start accepts.
    """
    b = _Parser(False)
    root = b.state()
    finals, roots = {}, []
    for r, (pattern, fold) in enumerate(rules):
        b.fold = fold
        s, e = b.parse(pattern)
        if backward:
            s, e = e, s
        roots.append(s)
        finals[e] = 1 << r
    if backward:
        turned: list[list] = [[] for _ in b.edges]
        for a, es in enumerate(b.edges):
            for label, t in es:
                turned[t].append((label, a))
        b.edges = turned
    for s in roots:
        b.link(root, None, s)
    if anywhere:
        b.link(root, frozenset(range(256)), root)
    labels = {x for es in b.edges for x, _ in es if x is not None}
    rows: dict[tuple, int] = {}
    classes = np.zeros(256, np.uint8)
    ordered = sorted(labels, key=sorted)
    for byte in range(256):
        classes[byte] = rows.setdefault(tuple(byte in x for x in ordered), len(rows))
    sample = {int(c): int(np.flatnonzero(classes == c)[0]) for c in range(len(rows))}

    reach: dict[int, frozenset[int]] = {}

    def closure(states: frozenset[int]) -> frozenset[int]:
        for x in states:
            if x not in reach:
                seen, todo = {x}, [x]
                while todo:
                    for label, t in b.edges[todo.pop()]:
                        if label is None and t not in seen:
                            seen.add(t)
                            todo.append(t)
                reach[x] = frozenset(s for s in seen if s in finals or any(label is not None for label, _ in b.edges[s]))
        return frozenset().union(*(reach[x] for x in states))

    moves: dict[tuple[int, int], list[int]] = {}

    def steps(s: int, c: int) -> list[int]:
        if (s, c) not in moves:
            moves[s, c] = [t for label, t in b.edges[s] if label is not None and sample[c] in label]
        return moves[s, c]

    dead, first = frozenset(), closure(frozenset([root]))
    index, order, table = {dead: 0, first: 1}, [dead, first], []
    k = 0
    while k < len(order):
        row = []
        for c in range(len(rows)):
            t = closure(frozenset(t for s in order[k] for t in steps(s, c)))
            if t not in index:
                index[t] = len(order)
                order.append(t)
            row.append(index[t])
        table.append(row)
        k += 1
    t = np.array(table)
    accept = np.array([sum({finals[s] for s in o if s in finals}) for o in order], np.int64)
    block = np.unique(accept, return_inverse=True)[1]
    while True:  # refine until no class of states has members that differ in a successor's class
        keys = np.column_stack([block, block[t]])
        new = np.unique(keys, axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    names = {int(block[0]): 0}
    for x in block:
        names.setdefault(int(x), len(names))
    block = np.array([names[int(x)] for x in block])
    pick = [int(np.flatnonzero(block == i)[0]) for i in range(len(names))]
    return Automaton(classes, block[t][pick].ravel().astype(np.int32), accept[pick], int(block[1]), len(rows))


#: Fewer lanes than this are run to their ends one by one, which is quicker than in step.
FEW_LANES = 32


def scan_lanes(a: Automaton, buf: np.ndarray, resets: np.ndarray, lanes: int = 2048) -> np.ndarray:
    """Positions of a buffer at which an unanchored automaton accepts, in one pass.

    The buffer is cut behind reset bytes (every state goes home there), so its lanes advance
    in step through one transition array and give what a single pass over the bytes gives.
    """
    n = len(buf)
    if not n:
        return np.empty(0, np.int64)
    cuts = np.flatnonzero(resets[buf]) + 1
    want = np.arange(1, lanes) * (n // lanes + 1)
    at = np.searchsorted(cuts, want[want < n])
    starts = np.unique(np.concatenate([[0], cuts[at[at < len(cuts)]]]))
    starts = starts[starts < n]
    sizes = np.diff(np.append(starts, n))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    running = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # lanes longer than t
    cls = a.classes[buf].astype(np.int32)
    state = np.full(len(starts), a.start * a.n_classes, np.int32)
    wide = (a.table * a.n_classes).astype(np.int32)
    good = np.zeros(len(a.accepts) * a.n_classes, bool)
    good[:: a.n_classes] = a.accepts != 0
    found = []
    for t in range(int(sizes[0])):
        m = running[t]
        if m < FEW_LANES:
            break
        here = starts[:m] + t
        s = wide[state[:m] + cls[here]]
        state[:m] = s
        hit = good[s]
        if hit.any():
            found.append(here[hit])
    else:
        m = 0
    table, accepts = wide.tolist(), good.tolist()
    for lane in range(m):
        s, own = int(state[lane]), []
        for at, c in enumerate(cls[starts[lane] + t : starts[lane] + sizes[lane]].tolist(), int(starts[lane]) + t):
            s = table[s + c]
            if accepts[s]:
                own.append(at)
        found.append(np.array(own, np.int64))
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
