"""Regular expressions over bytes compiled to one minimal deterministic automaton.

Syntax: literals, ``.``, escapes (``\\xHH \\. \\d \\w \\s`` ...), classes with ranges and ``^``, groups,
``|``, ``? * +`` and ``{m} {m,} {m,n}``. Rules meet in one machine by subset construction; Moore's
partition refinement then makes it minimal. Both run over classes of bytes that no rule tells apart.
"""

from __future__ import annotations

from dataclasses import dataclass, field

ALL = frozenset(range(256))
_NAMED = {"d": frozenset(b"0123456789"), "w": frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"), "s": frozenset(b" \t\n\r\x0b\x0c"), "n": frozenset(b"\n"), "t": frozenset(b"\t"), "r": frozenset(b"\r")}


class _Parser:
    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def parse(self):
        tree = self.either()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} of {self.p!r}")
        return tree

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def either(self):
        parts = [self.chain()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.chain())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def chain(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())
        return ("cat", parts)

    def repeat(self):
        tree = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                least, most = int(low), int(high) if high else (None if comma else int(low))
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            tree = ("rep", tree, least, most)
        return tree

    def cased(self, found: set[int] | frozenset[int]) -> frozenset[int]:
        if self.fold:
            found = set(found) | {b ^ 32 for b in found if chr(b & ~32) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
        return frozenset(found)

    def escape(self) -> frozenset[int]:
        c = self.peek()
        self.i += 1
        if c == "x":
            self.i += 2
            return frozenset([int(self.p[self.i - 2 : self.i], 16)])
        return _NAMED.get(c) or frozenset(c.encode())

    def atom(self):
        c = self.peek()
        self.i += 1
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            tree = self.either()
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.p!r}")
            self.i += 1
            return tree
        if c == "[":
            return ("set", self.members())
        if c == ".":
            return ("set", ALL - {10})
        if c == "\\":
            return ("set", self.cased(self.escape()))
        return ("cat", [("set", self.cased({b})) for b in c.encode()])

    def members(self) -> frozenset[int]:
        inverse = self.peek() == "^"
        self.i += inverse
        found: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.peek()
            self.i += 1
            if c == "":
                raise ValueError(f"missing ] in {self.p!r}")
            low = self.escape() if c == "\\" else frozenset(c.encode())
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] not in ("]", ""):
                self.i += 1
                c = self.peek()
                self.i += 1
                high = self.escape() if c == "\\" else frozenset(c.encode())
                found |= set(range(min(low), max(high) + 1))
            else:
                found |= low
        self.i += 1
        found = set(self.cased(found))
        return frozenset(ALL - found if inverse else found)


def _reverse(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [_reverse(x) for x in reversed(tree[1])])
    if kind == "or":
        return ("or", [_reverse(x) for x in tree[1]])
    if kind == "rep":
        return ("rep", _reverse(tree[1]), *tree[2:])
    return tree


@dataclass
class _Nfa:
    empty: list[list[int]] = field(default_factory=list)
    step: list[tuple[frozenset[int], int] | None] = field(default_factory=list)

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def build(self, tree, start: int) -> int:
        """Add ``tree`` from ``start``; the state where it ends."""
        kind = tree[0]
        if kind == "set":
            end, here = self.state(), self.state()
            self.empty[start].append(here)
            self.step[here] = (tree[1], end)
            return end
        if kind == "cat":
            for x in tree[1]:
                start = self.build(x, start)
            return start
        if kind == "or":
            end = self.state()
            for x in tree[1]:
                self.empty[self.build(x, start)].append(end)
            return end
        _, inner, least, most = tree
        for _ in range(least):
            start = self.build(inner, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.build(inner, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(most - least):
            self.empty[start].append(end)
            start = self.build(inner, start)
        self.empty[start].append(end)
        return end


@dataclass(frozen=True)
class Dfa:
    """``table[state][byte]`` is the next state, ``accept[state]`` a bit mask of the rules that end there."""

    table: tuple[tuple[int, ...], ...]
    accept: tuple[int, ...]
    start: int = 0

    def rows(self) -> list[list]:
        """Each state as a list of the next states' lists; place 256 holds the accept mask and 257
        tells whether another state can still be reached."""
        rows: list[list] = [[] for _ in self.table]
        for row, nexts, mask in zip(rows, self.table, self.accept, strict=True):
            row.extend(rows[n] for n in nexts)
            row.append(mask)
            row.append(bool(mask) or any(self.table[n] != nexts or n != nexts[0] for n in nexts))
        return rows


def compile_rules(patterns: list[tuple[str, bool]], anywhere: bool = True, backwards: bool = False) -> Dfa:
    """One minimal automaton for all (pattern, either case). ``anywhere``: matches may begin at any
    byte, so that a state's mask names the rules of which a match ends here."""
    nfa = _Nfa()
    start, ends = nfa.state(), {}
    for k, (pattern, either_case) in enumerate(patterns):
        tree = _Parser(pattern, either_case).parse()
        begin = nfa.state()
        nfa.empty[start].append(begin)
        ends[nfa.build(_reverse(tree) if backwards else tree, begin)] = 1 << k

    sets = list(dict.fromkeys(x[0] for x in nfa.step if x))
    kinds: dict[tuple[bool, ...], int] = {}
    kind_of = [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]
    sample = {k: b for b, k in reversed(list(enumerate(kind_of)))}

    def closed(states: list[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for n in nfa.empty[todo.pop()]:
                if n not in found:
                    found.add(n)
                    todo.append(n)
        return frozenset(found)

    first = closed([start])
    again = first if anywhere else frozenset()
    after = [closed([x[1]]) if x else None for x in nfa.step]
    stepping = [s for s in range(len(nfa.step)) if nfa.step[s]]
    by_kind = [{s: after[s] for s in stepping if sample[k] in nfa.step[s][0]} for k in range(len(kinds))]
    number, order, moves = {first: 0}, [first], []
    for here in order:
        out = []
        for move in by_kind:
            there = again.union(*(move[s] for s in here if s in move))
            if there not in number:
                number[there] = len(order)
                order.append(there)
            out.append(number[there])
        moves.append(out)
    accept = [sum({ends[s] for s in here if s in ends}) for here in order]

    block = list(accept)
    while True:
        ids: dict[tuple, int] = {}
        new = [ids.setdefault((block[s], *(block[t] for t in moves[s])), len(ids)) for s in range(len(order))]
        if len(ids) == len(set(block)):
            break
        block = new
    names: dict[int, int] = {}
    for b in block:
        names.setdefault(b, len(names))
    picked = {names[b]: s for s, b in reversed(list(enumerate(block)))}
    table = tuple(tuple(names[block[moves[picked[n]][k]]] for k in kind_of) for n in range(len(names)))
    return Dfa(table, tuple(accept[picked[n]] for n in range(len(names))), names[block[0]])


def projections(whole: Dfa, parts: list[Dfa]) -> list[tuple[int, ...]]:
    """For each state of ``whole``, the automaton of all rules anywhere, the state of each part, the automaton of one
    rule anywhere. It depends on the state alone: a minimal state tells where all rules can end, so where each can."""
    states: list[tuple[int, ...]] = [()] * len(whole.table)
    states[whole.start] = tuple(p.start for p in parts)
    todo = [whole.start]
    for here in todo:
        for byte in range(256):
            there = whole.table[here][byte]
            if not states[there]:
                states[there] = tuple(p.table[n][byte] for p, n in zip(parts, states[here], strict=True))
                todo.append(there)
    return states
