"""One deterministic automaton for a set of labelled regular expressions.

The expressions (the regular subset of Python's syntax: literals, classes, groups, alternation, repetition) are joined
into one nondeterministic automaton and determinised on demand by subset construction: a state is the set of
positions reached, transitions are memoised per character. Running it never backtracks. Start positions come
from an Aho-Corasick automaton over the literal triggers that every expression begins with.
"""

from __future__ import annotations

import re._constants as C
import re._parser as P

_ANY = ("any",)


def _matcher(items):
    """A predicate on characters for the members of a class."""
    negate, single, ranges, cats = False, set(), [], []
    for op, av in items:
        if op is C.NEGATE:
            negate = True
        elif op is C.LITERAL:
            single.add(av)
        elif op is C.RANGE:
            ranges.append(av)
        elif op is C.CATEGORY:
            cats.append(av)

    def ok(ch: str) -> bool:
        o = ord(ch)
        hit = o in single or any(a <= o <= b for a, b in ranges)
        for cat in cats:
            if cat is C.CATEGORY_SPACE:
                hit |= ch.isspace()
            elif cat is C.CATEGORY_NOT_SPACE:
                hit |= not ch.isspace()
            elif cat is C.CATEGORY_DIGIT:
                hit |= "0" <= ch <= "9"
            elif cat is C.CATEGORY_WORD:
                hit |= ch == "_" or (ch.isalnum() and ch.isascii())
            elif cat is C.CATEGORY_NOT_WORD:
                hit |= not (ch == "_" or (ch.isalnum() and ch.isascii()))
        return hit != negate

    return ok


class Automaton:
    def __init__(self, rules: list[tuple[str, str]], max_states: int = 20_000):
        self.eps: list[list[int]] = []
        self.edge: list[tuple | None] = []  # (predicate, target)
        self.accept: dict[int, int] = {}
        self.labels = [name for name, _ in rules]
        self.max_states = max_states
        starts = []
        for i, (_, pattern) in enumerate(rules):
            s, e = self._build(P.parse(pattern))
            self.accept[e] = i
            starts.append(s)
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.labelled: list[tuple[int, ...]] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._intern(self._close(starts))

    def _new(self) -> int:
        self.eps.append([])
        self.edge.append(None)
        return len(self.eps) - 1

    def _build(self, seq) -> tuple[int, int]:
        first = last = self._new()
        for op, av in seq:
            if op in (C.LITERAL, C.NOT_LITERAL, C.ANY, C.IN):
                if op is C.LITERAL:
                    ok = (lambda o: lambda ch: ord(ch) == o)(av)
                elif op is C.NOT_LITERAL:
                    ok = (lambda o: lambda ch: ord(ch) != o)(av)
                elif op is C.ANY:
                    ok = lambda ch: ch != "\n"
                else:
                    ok = _matcher(av)
                nxt = self._new()
                self.edge[last] = (ok, nxt)
                last = nxt
                continue
            if op is C.SUBPATTERN:
                s, e = self._build(av[3])
            elif op is C.BRANCH:
                s, e = self._new(), self._new()
                for alt in av[1]:
                    a, b = self._build(alt)
                    self.eps[s].append(a)
                    self.eps[b].append(e)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                lo, hi, body = av
                s = e = self._new()
                for _ in range(lo):
                    a, b = self._build(body)
                    self.eps[e].append(a)
                    e = b
                if hi is C.MAXREPEAT:
                    a, b = self._build(body)
                    self.eps[e].append(a)
                    self.eps[b].append(e)
                    tail = self._new()
                    self.eps[e].append(tail)
                    e = tail
                else:
                    tail = self._new()
                    self.eps[e].append(tail)
                    for _ in range(hi - lo):
                        a, b = self._build(body)
                        self.eps[e].append(a)
                        self.eps[b].append(tail)
                        e = b
                    e = tail
            else:
                raise ValueError(f"not a regular construct: {op}")
            self.eps[last].append(s)
            last = self._new()
            self.eps[e].append(last)
        return first, last

    def _close(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if self.edge[s] is not None or s in self.accept)

    def _intern(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.labelled.append(tuple(sorted(self.accept[s] for s in states if s in self.accept)))
            self.moves.append({})
        return self.ids[states]

    def _step(self, state: int, ch: str) -> int:
        to = self._close([t for ok, t in filter(None, (self.edge[s] for s in self.sets[state])) if ok(ch)])
        nxt = self._intern(to) if to else -1
        self.moves[state][ch] = nxt
        return nxt

    def run(self, text: str, at: int, end: int) -> list[tuple[str, int]]:
        """Every label accepted from ``at`` on, with the end of its longest match."""
        if len(self.sets) > self.max_states:  # bound the memo; states are rebuilt on demand
            start = self.sets[self.start]
            self.ids, self.sets, self.labelled, self.moves = {}, [], [], []
            self.start = self._intern(start)
        state, best, moves = self.start, {}, self.moves
        while at < end:
            ch = text[at]
            nxt = moves[state].get(ch)
            if nxt is None:
                nxt = self._step(state, ch)
            if nxt < 0:
                break
            state = nxt
            at += 1
            for label in self.labelled[state]:
                best[label] = at
        return [(self.labels[k], v) for k, v in best.items()]
