"""Joins between models: what is declared, and the tree of joins that a set of models needs.

Each pair of joined models has two directed edges. An edge's weight grows with how far it multiplies
rows, so the cheapest path is the one that multiplies least; a join's priority scales its weights.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

CARDINALITIES = ("one_to_one", "many_to_one", "one_to_many", "many_to_many")
_SCALE = {"high": 1, "normal": 10, "low": 100}
_REVERSED = {"many_to_one": "one_to_many", "one_to_many": "many_to_one"}


@dataclass(frozen=True)
class Join:
    """A join as it is walked from ``left`` to ``right``; ``flipped`` if it was declared the other way."""

    left: str
    right: str
    cardinality: str
    on: Callable[..., Any]
    how: str | None = None
    priority: str = "normal"
    flipped: bool = False

    @property
    def weight(self) -> int:
        return (CARDINALITIES.index(self.cardinality) + 1) * _SCALE[self.priority]

    @property
    def multiplies(self) -> bool:
        return self.cardinality in ("one_to_many", "many_to_many")

    @property
    def spark_how(self) -> str:
        """A declared kind holds in both directions; else the model named first in the declaration keeps its rows."""
        return self.how or ("right" if self.flipped else "left")

    def flip(self) -> Join:
        return Join(self.right, self.left, _REVERSED.get(self.cardinality, self.cardinality), self.on, self.how, self.priority, not self.flipped)


@dataclass
class JoinGraph:
    """Directed and weighted; all orders are those of insertion."""

    successors: dict[str, dict[str, int]] = field(default_factory=dict)
    predecessors: dict[str, dict[str, None]] = field(default_factory=dict)

    def add_node(self, node: str) -> None:
        self.successors.setdefault(node, {})
        self.predecessors.setdefault(node, {})

    def add_edge(self, a: str, b: str, weight: int = 0) -> None:
        self.add_node(a)
        self.add_node(b)
        self.successors[a][b] = weight
        self.predecessors[b].setdefault(a)

    def neighbours(self, node: str) -> list[str]:
        return list(dict.fromkeys([*self.predecessors[node], *self.successors[node]]))

    def cheapest_from(self, start: str) -> dict[str, tuple[int, str | None]]:
        """Distance and last stop before each node that ``start`` reaches; ties keep the path found first."""
        found: dict[str, tuple[int, str | None]] = {start: (0, None)}
        queue, entered, done = [(0, 0, start)], 1, set()
        while queue:
            far, _, node = heapq.heappop(queue)
            if node in done:
                continue
            done.add(node)
            for after, weight in self.successors[node].items():
                if after not in found or far + weight < found[after][0]:
                    found[after] = (far + weight, node)
                    heapq.heappush(queue, (far + weight, entered, after))
                    entered += 1
        return found

    def components(self) -> list[set[str]]:
        left, out = dict.fromkeys(self.successors), []
        while left:
            todo, seen = [next(iter(left))], set()
            while todo:
                if (node := todo.pop()) not in seen:
                    seen.add(node)
                    todo += self.neighbours(node)
            out.append(seen)
            left = {n: None for n in left if n not in seen}
        return out


def spanning_graph(graph: JoinGraph, wanted: Iterable[str]) -> JoinGraph:
    """The hops of a least tree over ``wanted``, whose edges are cheapest paths (so it may pass through others).

    The tree grows from the first wanted model. Between two of them the distance is that from the one
    asked for first; of equal offers the earlier stays. A branch is walked from its new model to the tree.
    """
    names = list(dict.fromkeys(wanted))
    hops = JoinGraph()
    for n in names[:1]:
        hops.add_node(n)
    paths = {n: graph.cheapest_from(n) for n in names}
    rank = {n: i for i, n in enumerate(names)}
    offers: dict[str, tuple[int, str] | None] = dict.fromkeys(names[1:])
    last = names[0] if names else None
    while offers:
        for n, offer in offers.items():
            first, second = sorted((last, n), key=rank.get)
            if (step := paths[first].get(second)) and (offer is None or step[0] < offer[0]):
                offers[n] = (step[0], last)
        open_offers = [(offer[0], rank[n], n) for n, offer in offers.items() if offer]
        if not open_offers:
            raise ValueError(f"no joins lead from {names[0]} to {', '.join(offers)}")
        last = min(open_offers)[2]
        _, parent = offers.pop(last)
        walk, at = [], parent
        while at != last:
            before = paths[last].get(at, (0, None))[1]
            if before is None:
                raise ValueError(f"no joins lead from {last} to {parent}")
            walk.append((before, at))
            at = before
        for a, b in reversed(walk):
            hops.add_edge(a, b)
    return hops


@dataclass(frozen=True)
class JoinStep:
    left: str
    right: str
    how: str


@dataclass(frozen=True)
class JoinPlan:
    initial: str
    steps: tuple[JoinStep, ...]
    multiplies_rows: bool


def plan_joins(graph: JoinGraph, joins: dict[tuple[str, str], Join], wanted: list[str], initial: str) -> JoinPlan:
    """Walk the tree depth first from ``initial``, the last neighbour first."""
    tree = spanning_graph(graph, wanted)
    seen: set[str] = set()
    todo: list[tuple[str, Join | None]] = [(initial, None)]
    steps, multiplies = [], False
    while todo:
        name, join = todo.pop()
        if name in seen:
            continue
        seen.add(name)
        if join:
            multiplies |= join.multiplies
            steps.append(JoinStep(join.left, name, join.spark_how))
        todo += [(n, joins[name, n]) for n in tree.neighbours(name) if n not in seen]
    return JoinPlan(initial, tuple(steps), multiplies)


def counts_rows(joins: dict[tuple[str, str], Join], steps: Iterable[JoinStep], models: Iterable[str]) -> str | None:
    """The model of which each row is in at most one joined row of ``models``, so that the joined rows are no more than the
    tables' own; None if the joins multiply rows from both sides (1:N twice away from one model, N:M)."""
    models = set(models)
    onwards: dict[str, list[str]] = {m: [] for m in models}
    for s in steps:
        for a, b in ((s.left, s.right), (s.right, s.left)):
            if {a, b} <= models and not joins[a, b].multiplies:
                onwards[a].append(b)
    for m in sorted(models):
        seen, todo = {m}, [m]
        while todo:
            new = [b for b in onwards[todo.pop()] if b not in seen]
            seen.update(new)
            todo += new
        if seen == models:
            return m
    return None
