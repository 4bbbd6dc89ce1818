"""A generalised LL recogniser over a graph-structured stack, for grammars written in a small EBNF.

Grammar text: ``Name = alternative | alternative ;`` with ``( )``, ``?``, ``*``, ``+``, quoted terminals, bare upper-case token
classes and ``@Group`` for a bracket group whose content is known to derive ``Group``. ``$`` matches the end only; ``![a b]`` matches nothing, where none of these keywords stands next.
Tokens are single characters: the lexer turns every token, and the reducer every bracket group, into one.

All derivations of an input proceed together: a descriptor is (slot, stack node, position); stack nodes are shared by
(nonterminal, position), so ambiguity and left recursion cost polynomial time. Whole results are memoised per
(nonterminal, token string), which serves as a stack shared between inputs: source code repeats few shapes.
"""

from __future__ import annotations

import re

_LEX = re.compile(r"'([^']+)'|(@\w+)|(\$)|(\w+)|([|()?*+=;])|!\[([^\]]*)\]|\s+|#[^\n]*")


class Grammar:
    def __init__(self, text: str, tokens: dict[str, str], memo: int = 400_000):
        """``tokens`` maps terminal names (keywords, operators, classes) to their characters."""
        self.tokens = tokens
        self.nts: dict[str, int] = {}
        self.alts: list[list[list]] = []
        self.groups: dict[str, int] = {}
        self.masks: dict[str, int] = {}
        self.of_mask: dict[int, str] = {}
        self.memo: dict[tuple[int, str], bool] = {}
        self.limit = memo
        self._parse(text)
        self._firsts()

    def extend(self, text: str) -> None:
        """Add productions."""
        self._parse(text)
        self._firsts()

    # grammar text -> productions
    def _nt(self, name: str) -> int:
        if name not in self.nts:
            self.nts[name] = len(self.alts)
            self.alts.append([])
        return self.nts[name]

    def _fresh(self) -> int:
        self.alts.append([])
        return len(self.alts) - 1

    def _terminal(self, name: str):
        if name in self.tokens:
            return [("t", self.tokens[name])]
        return [("t", self.tokens.get(c, c)) for c in name]

    def _parse(self, text: str) -> None:
        toks = [m for m in _LEX.finditer(text) if m.group().strip() and not m.group().startswith("#")]
        self.at, self.src = 0, toks
        while self.at < len(toks):
            name = toks[self.at].group(4)
            assert toks[self.at + 1].group() == "=", (name, toks[self.at + 1].group())
            self.at += 2
            self.alts[self._nt(name)] += self._choice()
            assert toks[self.at].group() == ";", name
            self.at += 1
        for name, i in self.nts.items():
            if not self.alts[i]:
                raise ValueError(f"undefined nonterminal {name}")

    def _choice(self) -> list[list]:
        out = [self._sequence()]
        while self.src[self.at].group() == "|":
            self.at += 1
            out.append(self._sequence())
        return out

    def _sequence(self) -> list:
        seq = []
        while self.src[self.at].group() not in ("|", ")", ";"):
            m = self.src[self.at]
            self.at += 1
            if m.group() == "(":
                inner = self._choice()
                assert self.src[self.at].group() == ")"
                self.at += 1
                nt = self._fresh()
                self.alts[nt] = inner
                item = [("n", nt)]
            elif m.group(1):
                item = self._terminal(m.group(1))
            elif m.group(2):
                g = m.group(2)[1:]
                item = [("g", 1 << self.groups.setdefault(g, len(self.groups)))]
            elif m.group(3):
                item = [("e", 0)]
            elif m.group(6):
                seq.append(("x", frozenset(self.tokens[w] for w in m.group(6).split())))
                continue
            else:
                w = m.group(4)
                item = [("t", self.tokens[w])] if w in self.tokens and w.isupper() else [("n", self._nt(w))]
            op = self.src[self.at].group() if self.at < len(self.src) else ""
            if op in "?*+" and op:
                self.at += 1
                nt = self._fresh()
                if op == "?":
                    self.alts[nt] = [item, []]
                else:
                    # Left recursion: one stack node serves the whole repetition, so long lists cost linear time.
                    self.alts[nt] = [[("n", nt), *item], item if op == "+" else []]
                item = [("n", nt)]
            seq += item
        return seq

    # FIRST sets prune alternatives that cannot start with the next token
    def _firsts(self) -> None:
        n = len(self.alts)
        null, chars, mask = [False] * n, [set() for _ in range(n)], [0] * n
        changed = True
        while changed:
            changed = False
            for i, alts in enumerate(self.alts):
                for alt in alts:
                    c, g, e = self._first(alt, null, chars, mask)
                    if e and not null[i] or c - chars[i] or g & ~mask[i]:
                        null[i] |= e
                        chars[i] |= c
                        mask[i] |= g
                        changed = True
        self.first = [[self._first(a, null, chars, mask) for a in alts] for alts in self.alts]
        self.pick: list[dict[str, tuple]] = [{} for _ in self.alts]  # next token -> alternatives that may start with it

    @staticmethod
    def _first(alt, null, chars, mask):
        c, g = set(), 0
        for kind, v in alt:
            if kind == "t":
                return c | {v}, g, False
            if kind == "g":
                return c, g | v, False
            if kind in "ex":
                continue
            c |= chars[v]
            g |= mask[v]
            if not null[v]:
                return c, g, False
        return c, g, True

    def group_char(self, mask: int) -> str:
        """The character of a bracket group with this set of readings."""
        ch = self.of_mask.get(mask)
        if ch is None:
            ch = self.of_mask[mask] = chr(0xF0000 + len(self.of_mask))
            self.masks[ch] = mask
        return ch

    def derives(self, name: str, s: str) -> bool:
        nt = self.nts[name]
        key = (nt, s)
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) >= self.limit:  # results only; dropping them costs time, not correctness
                self.memo.clear()
            got = self.memo[key] = self._recognise(nt, s)
        return got

    def _recognise(self, start: int, s: str) -> bool:
        n, masks, alts_of, first_of, picks = len(s), self.masks, self.alts, self.first, self.pick
        nodes: dict[tuple[int, int], tuple[list, set]] = {}
        seen: set = set()
        todo: list = []

        def call(nt: int, i: int):
            key = (nt, i)
            node = nodes.get(key)
            if node is not None:
                return node
            node = nodes[key] = ([], set())
            c = s[i] if i < n else ""
            chosen = picks[nt].get(c)
            if chosen is None:
                m = masks.get(c, 0)
                chosen = picks[nt][c] = tuple(a for a, (chars, gm, null) in zip(alts_of[nt], first_of[nt]) if null or c in chars or m & gm)
            for alt in chosen:
                todo.append((alt, 0, key, i))
            return node

        call(start, 0)
        while todo:
            alt, pos, key, i = todo.pop()
            size = len(alt)
            while pos < size:
                kind, v = alt[pos]
                if kind == "t":
                    if i < n and s[i] == v:
                        i += 1
                        pos += 1
                        continue
                    break
                if kind == "g":
                    if i < n and masks.get(s[i], 0) & v:
                        i += 1
                        pos += 1
                        continue
                    break
                if kind == "x":
                    if i < n and s[i] in v:
                        break
                    pos += 1
                    continue
                if kind == "e":
                    if i == n:
                        pos += 1
                        continue
                    break
                mark = (id(alt), pos, key, i)
                if mark in seen:
                    break
                seen.add(mark)
                back, ends = call(v, i)
                back.append((alt, pos + 1, key))
                for e in ends:
                    todo.append((alt, pos + 1, key, e))
                break
            else:
                back, ends = nodes[key]
                if i not in ends:
                    ends.add(i)
                    for a, p, k in back:
                        todo.append((a, p, k, i))
        return n in nodes[(start, 0)][1]
