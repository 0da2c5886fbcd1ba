"""Regular expressions to one minimal deterministic automaton over bytes.

Supported syntax: literals, escapes (\\xNN and escaped punctuation), classes with ranges, groups, alternation and the
quantifiers ? * + {m} {m,} {m,n}.  Patterns are ASCII.
"""

from __future__ import annotations

import numpy as np


class _Nfa:
    """Thompson construction: byte edges and empty edges."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def chars(self, chars: frozenset[int]) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.edges[a].append((chars, b))
        return a, b


def _parse(pattern: str, either_case: bool):
    """A tree of ('chars', set), ('seq', [..]), ('alt', [..]) and ('rep', node, least, most or None)."""
    at = 0

    def fold(s: set[int]) -> frozenset[int]:
        return frozenset(s | {ord(chr(c).swapcase()) for c in s if chr(c).isalpha()}) if either_case else frozenset(s)

    def one() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def atom():
        nonlocal at
        if pattern[at] == "(":
            at += 1
            node = alternatives()
            at += 1
            return node
        if pattern[at] == "[":
            at += 1
            found: set[int] = set()
            while pattern[at] != "]":
                low = high = one()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = one()
                found.update(range(low, high + 1))
            at += 1
            return "chars", fold(found)
        return "chars", fold({one()})

    def sequence():
        nonlocal at
        nodes = []
        while at < len(pattern) and pattern[at] not in "|)":
            node = atom()
            while at < len(pattern) and pattern[at] in "?*+{":
                c = pattern[at]
                at += 1
                if c == "{":
                    end = pattern.index("}", at)
                    low, _, high = pattern[at:end].partition(",")
                    node = ("rep", node, int(low), int(high) if high else (None if "," in pattern[at:end] else int(low)))
                    at = end + 1
                else:
                    node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
            nodes.append(node)
        return "seq", nodes

    def alternatives():
        nonlocal at
        nodes = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            nodes.append(sequence())
        return "alt", nodes

    return alternatives()


def _build(nfa: _Nfa, node, back: bool = False) -> tuple[int, int]:
    """The first and last state of a tree; with back, of its mirror image."""
    kind = node[0]
    if kind == "chars":
        return nfa.chars(node[1])
    a = b = nfa.state()
    if kind == "seq":
        for x in node[1][::-1] if back else node[1]:
            s, e = _build(nfa, x, back)
            nfa.empty[b].append(s)
            b = e
        return a, b
    b = nfa.state()
    if kind == "alt":
        for x in node[1]:
            s, e = _build(nfa, x, back)
            nfa.empty[a].append(s)
            nfa.empty[e].append(b)
        return a, b
    _, inner, least, most = node
    last = a
    for _ in range(least):
        s, e = _build(nfa, inner, back)
        nfa.empty[last].append(s)
        last = e
    if most is None:
        s, e = _build(nfa, inner, back)
        nfa.empty[last] += [s, b]
        nfa.empty[e] += [s, b]
    else:
        nfa.empty[last].append(b)
        for _ in range(most - least):
            s, e = _build(nfa, inner, back)
            nfa.empty[last].append(s)
            nfa.empty[e].append(b)
            last = e
    return a, b


class Automaton:
    """next: states x 256 transition array; accepts: states, bit r set where pattern r has matched.  State 0 starts.

    With `anywhere`, a match may begin at any byte, so one pass tells where some pattern has matched.  Without it, the
    automaton is anchored, and state -1 is the dead end.  With `back`, it reads bytes from the last to the first, and so
    tells where matches begin.
    """

    def __init__(self, patterns: list[tuple[str, bool]], anywhere: bool, back: bool = False):
        nfa = _Nfa()
        start, ends = nfa.state(), {}
        for r, (pattern, either_case) in enumerate(patterns):
            a, b = _build(nfa, _parse(pattern, either_case), back)
            nfa.empty[start].append(a)
            ends[b] = ends.get(b, 0) | 1 << r
        closed = []
        for s in range(len(nfa.empty)):
            todo, seen = [s], {s}
            while todo:
                for x in nfa.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            closed.append(frozenset(seen))
        alphabet = np.zeros(256, np.int64)  # bytes that no pattern tells apart share a class
        for chars in {c for e in nfa.edges for c, _ in e}:
            _, alphabet = np.unique(alphabet * 2 + np.isin(np.arange(256), list(chars)), return_inverse=True)
        shown = [int(np.flatnonzero(alphabet == k)[0]) for k in range(alphabet.max() + 1)]
        useful = {s for s in range(len(nfa.edges)) if nfa.edges[s] or s in ends}
        first = closed[start] & useful
        index, order, rows = {first: 0}, [first], []
        for group in order:  # subset construction
            row = []
            for b in shown:
                to: frozenset[int] = first if anywhere else frozenset()
                for s in group:
                    for chars, x in nfa.edges[s]:
                        if b in chars:
                            to |= closed[x]
                to &= useful
                if to not in index:
                    index[to] = len(order)
                    order.append(to)
                row.append(index[to])
            rows.append(row)
        moves = np.array(rows)
        accepts = np.array([sum({ends[s] for s in g if s in ends}) for g in order])
        group = np.unique(accepts, return_inverse=True)[1]
        while True:  # minimisation: split groups until their members move alike
            finer = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == group.max():
                break
            group = finer
        _, pick = np.unique(group, return_index=True)
        name = np.full(len(pick), -1)
        name[group[0]] = 0
        name[[g for g in range(len(pick)) if g != group[0]]] = np.arange(1, len(pick))
        picked = np.empty(len(pick), int)
        picked[name] = pick
        self.next = name[group[moves[picked]]][:, alphabet].astype(np.int32)
        self.accepts = accepts[picked]
        if not anywhere:
            dead = (self.accepts == 0) & (self.next == np.arange(len(self.next))[:, None]).all(1)
            self.next[dead[self.next]] = -1

    def rows(self) -> list[list]:
        """Linked rows for a scan: row[byte] is the next row, row[256] tells whether a pattern has matched."""
        rows: list[list] = [[] for _ in self.next]
        for row, to, acc in zip(rows, self.next.tolist(), self.accepts.tolist()):
            row.extend(rows[x] for x in to)
            row.append(acc)
        return rows
