"""Drill-down: which hierarchies a query touches, and the query for each of a hierarchy's levels."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from metricloom.hierarchy import HierarchyConfig, LevelConfig
from metricloom.query import QueryBuilder


@dataclass(frozen=True)
class Touched:
    hierarchy: HierarchyConfig
    level: int  # the first one of which the query has a dimension


@dataclass(frozen=True)
class QueryAnalysis:
    query: dict[str, Any]
    dimensions: list[str]
    metrics: list[str]
    hierarchies: dict[str, list[Touched]]  # categorical, temporal and all


@dataclass(frozen=True)
class LevelQuery:
    element: LevelConfig
    key_dimensions: list[str]
    query: dict[str, Any]


@dataclass(frozen=True)
class HierarchyAnalysis:
    hierarchy: HierarchyConfig
    rest_members: list[str]
    original_query: dict[str, Any]
    totals_query: dict[str, Any]
    queries: list[LevelQuery] = field(default_factory=list)


def analyze_query(builder: QueryBuilder, query: dict[str, Any]) -> QueryAnalysis:
    asked = set(query["members"])
    touched = []
    for h in builder.hierarchies:
        level = next((i for i, e in enumerate(h.elements) if asked.intersection(e.dimensions)), None)
        if level is not None:
            touched.append(Touched(h, level))
    touched.sort(key=lambda t: t.level)  # stable: within a level as declared
    is_dimension = {p: builder.repository.member(p).is_dimension for p in query["members"]}
    return QueryAnalysis(
        query,
        [p for p in query["members"] if is_dimension[p]],
        [p for p in query["members"] if not is_dimension[p]],
        {"categorical": [t for t in touched if t.hierarchy.type == "categorical"], "temporal": [t for t in touched if t.hierarchy.type == "temporal"], "all": touched},
    )


def analyze_query_hierarchy(analysis: QueryAnalysis, hierarchy: HierarchyConfig) -> HierarchyAnalysis:
    """A query for every level, with the keys of the levels above, and once more for the last level with all
    dimensions that the hierarchy leaves over."""
    rest, extras_so_far, keys_so_far = list(analysis.dimensions), [], []
    levels: list[tuple[LevelConfig, list[str], list[str]]] = []  # level, keys down to it, members without the rest
    for e in hierarchy.elements:
        chosen = [d for d in e.dimensions if d in analysis.dimensions]
        extras = [d for d in chosen if d not in e.key_dimensions and d not in e.format_dimensions]
        hidden_keys = [d for d in e.key_dimensions if d in chosen and d not in e.format_dimensions]
        rest = [d for d in rest if d not in chosen] + hidden_keys
        keys = [*keys_so_far, *e.key_dimensions]
        levels.append((e, keys, [*keys, *e.format_dimensions, *extras_so_far, *extras]))
        keys_so_far, extras_so_far = keys, [*extras_so_far, *extras]
    level_queries = []
    for e, keys, members in [*levels, (*levels[-1][:2], [*levels[-1][2], *rest])]:
        order = [{"member": d, "direction": "asc"} for d in e.format_dimensions] + list(analysis.query.get("order") or [])
        level_queries.append(LevelQuery(e, keys, analysis.query | {"members": list(dict.fromkeys([*members, *analysis.metrics])), "order": order}))
    return HierarchyAnalysis(hierarchy, [*extras_so_far, *rest, *analysis.metrics], dict(analysis.query), analysis.query | {"members": list(analysis.metrics)}, level_queries)
