"""Regular expressions over bytes as one deterministic automaton.

The patterns are those of the secret rules: literals, ``\\xHH`` and escaped characters, classes, groups,
alternatives and the quantifiers ``? * + {m} {m,} {m,n}``. ``(?i)`` in front makes ASCII letters match in either case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ANY = (1 << 256) - 1


class _Pattern:
    """Reads a pattern into nested ``("set", mask)``, ``("seq", ...)``, ``("or", ...)`` and ``("rep", node, least, most)``."""

    def __init__(self, text: str):
        self.fold = text.startswith("(?i)")
        self.text, self.at = text.removeprefix("(?i)"), 0

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def byte(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def mask(self, low: int, high: int) -> int:
        out = sum(1 << b for b in range(low, high + 1))
        if self.fold:
            out |= sum(1 << (b ^ 32) for b in range(low, high + 1) if chr(b).isalpha() and b < 128)
        return out

    def one(self):
        if self.peek() == "(":
            self.take()
            node = self.either()
            self.take()
            return node
        if self.peek() != "[":
            b = self.byte()
            return "set", self.mask(b, b)
        self.take()
        out = 0
        while self.peek() != "]":
            low = high = self.byte()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                high = self.byte()
            out |= self.mask(low, high)
        self.take()
        return "set", out

    def repeated(self):
        node, c = self.one(), self.peek()
        if c and c in "?*+":
            self.take()
            return "rep", node, int(c == "+"), 1 if c == "?" else None
        if c == "{":
            close = self.text.index("}", self.at)
            least, comma, most = self.text[self.at + 1 : close].partition(",")
            self.at = close + 1
            return "rep", node, int(least), int(most) if most else None if comma else int(least)
        return node

    def either(self):
        options = [[]]
        while self.peek() and self.peek() != ")":
            if self.peek() == "|":
                self.take()
                options.append([])
            else:
                options[-1].append(self.repeated())
        return ("or", *[("seq", *o) for o in options])


def _backward(node):
    """What matches the texts of ``node`` read from the end."""
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return "rep", _backward(node[1]), *node[2:]
    parts = [_backward(n) for n in node[1:]]
    return (kind, *(reversed(parts) if kind == "seq" else parts))


class _Nfa:
    """States with empty moves and moves on a set of bytes."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def build(self, node, start: int) -> int:
        """Adds what ``node`` matches from ``start`` on; the state where it ends."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start] = (node[1], end)
            return end
        if kind == "seq":
            for part in node[1:]:
                start = self.build(part, self.fresh(start))
            return start
        if kind == "or":
            end = self.state()
            for option in node[1:]:
                self.empty[self.build(option, self.fresh(start))].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.build(part, self.fresh(start))
        if most is None:
            loop = self.fresh(start)
            again = self.build(part, self.fresh(loop))
            self.empty[again].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.build(part, self.fresh(start))
            self.empty[start].append(end)
        return end

    def fresh(self, start: int) -> int:
        new = self.state()
        self.empty[start].append(new)
        return new

    def closure(self, states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)


@dataclass
class Automaton:
    """``next[state, group_of[byte]]``; ``accepts[state]`` has a bit per rule; state 0 is the start, ``dead`` is -1 or a state."""

    next: np.ndarray
    group_of: np.ndarray
    accepts: np.ndarray
    dead: int

    @property
    def resets(self) -> np.ndarray:
        """Per byte, whether it leads from every state to the start."""
        return (self.next == 0).all(0)[self.group_of]


def compiled(patterns: list[str], anywhere: bool, backward: bool = False) -> Automaton:
    """One minimal automaton of all patterns: matching from the first byte on, or beginning anywhere; or reading from the end."""
    nfa = _Nfa()
    start = nfa.state()
    rule_at: dict[int, int] = {}
    for rule, text in enumerate(patterns):
        pattern = _Pattern(text).either()
        end = nfa.build(_backward(pattern) if backward else pattern, nfa.fresh(start))
        rule_at[end] = rule_at.get(end, 0) | 1 << rule
    # Bytes that no pattern tells apart form a group.
    masks = {m[0] for m in nfa.moves if m}
    kinds: dict[tuple[bool, ...], int] = {}
    group_of = np.array([kinds.setdefault(tuple(bool(m >> b & 1) for m in masks), len(kinds)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(group_of == g)[0]) for g in range(len(kinds))]
    first = nfa.closure([start])
    number, todo, rows = {first: 0}, [first], []
    for subset in todo:
        row = []
        for b in sample:
            to = {nfa.moves[s][1] for s in subset if nfa.moves[s] and nfa.moves[s][0] >> b & 1}
            after = nfa.closure(to | ({start} if anywhere else set()))
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            row.append(number[after])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([sum({s: rule_at[s] for s in subset if s in rule_at}.values()) for subset in todo], np.int64)
    # Minimise: states stay together while they accept alike and lead to states that are together.
    part = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    order = {int(part[0]): 0}
    for p in part.tolist():
        order.setdefault(p, len(order))
    part = np.array([order[p] for p in part.tolist()])
    some = np.array([np.flatnonzero(part == p)[0] for p in range(len(order))])
    small, accepting = part[table[some]], accepts[some]
    dead = [s for s in range(len(small)) if (small[s] == s).all() and not accepting[s]] if not anywhere else []
    return Automaton(small.astype(np.int32), group_of, accepting, dead[0] if dead else -1)


class Matcher:
    """Leftmost longest matches of one pattern, one after the other.

    A pass from the end, by the automaton of the pattern read backward, finds every place where a match starts; from
    the first of these that the matches before leave free, the pattern's own automaton reads on as long as it can
    match. So no byte is read again for starts that come to nothing.
    """

    def __init__(self, pattern: str):
        automaton = compiled([pattern], anywhere=False)
        self.rows = [[int(row[g]) for g in automaton.group_of] for row in automaton.next]
        self.accepting = [bool(a) for a in automaton.accepts]
        self.dead = automaton.dead
        back = compiled([pattern], anywhere=True, backward=True)
        self.back = [[int(row[g]) for g in back.group_of] for row in back.next]
        self.starting = [bool(a) for a in back.accepts]

    def starts(self, data: bytes) -> list[int]:
        """Where some match starts, in falling order."""
        state, at, out = 0, len(data), []
        back, starting = self.back, self.starting
        for b in reversed(data):
            at -= 1
            state = back[state][b]
            if starting[state]:
                out.append(at)
        return out

    def spans(self, data: bytes):
        free = 0
        for at in reversed(self.starts(data)):
            if at < free:
                continue
            state, end, k = 0, at, at
            while k < len(data):
                state = self.rows[state][data[k]]
                if state == self.dead:
                    break
                k += 1
                if self.accepting[state]:
                    end = k
            if end > at:
                yield at, end
                free = end
