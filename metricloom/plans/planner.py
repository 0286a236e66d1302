"""From a query to a logical plan, in plain Python: which models, which joins, what is aggregated apart.

Metrics over the same models make a segment, which is aggregated on its own, so that no metric's rows are
multiplied by another's. A segment has three levels: rows (``model_query``), aggregates (``segment_query``) and
what the query shows of it (``root_query``). Members that only filter are in the lower levels alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from metricloom.members import Dimension, Metric
from metricloom.operators.filters import leaves
from metricloom.plans.evaluation import Evaluation
from metricloom.plans.joins import JoinPlan, plan_joins

if TYPE_CHECKING:
    from metricloom.repository import Repository


@dataclass(frozen=True)
class Level:
    dimensions: tuple[str, ...]
    metrics: tuple[str, ...]

    @property
    def members(self) -> tuple[str, ...]:
        return self.dimensions + self.metrics


@dataclass(frozen=True)
class MetricRefs:
    """The sub-query that aggregates the metrics which a segment's metrics refer to, and where it is joined."""

    join_on: tuple[str, ...]
    plan: QueryPlan


@dataclass(frozen=True)
class Segment:
    alias: str
    models: tuple[str, ...]
    model_query: Level
    segment_query: Level
    root_query: Level
    join_plan: JoinPlan | None
    metric_refs: MetricRefs | None
    filters: tuple[dict, ...]


@dataclass(frozen=True)
class QueryPlan:
    segments: tuple[Segment, ...]
    filters: tuple[dict, ...]  # on metrics: after aggregation
    projected_dimensions: tuple[str, ...]
    projected_metrics: tuple[str, ...]
    order: tuple[dict, ...] | None
    limit: int | None
    offset: int | None


def _unique(items) -> tuple:
    return tuple(dict.fromkeys(items))


def plan_query(repository: Repository, evaluation: Evaluation, query: dict[str, Any]) -> QueryPlan:
    members = [repository.member(p) for p in query["members"]]
    dimensions = [m for m in members if m.is_dimension]
    metrics = [m for m in members if not m.is_dimension]
    on_rows, on_aggregates = [], []
    for f in query.get("filters") or ():
        first = repository.member(next(leaves([f]))["member"])
        (on_rows if first.is_dimension else on_aggregates).append(f)
    only_filtering = lambda filters, shown: [m for m in _last_first(repository, filters) if m not in shown]
    filter_dimensions, filter_metrics = only_filtering(on_rows, dimensions), only_filtering(on_aggregates, metrics)

    groups: dict[tuple[str, ...], tuple[list[Metric], list[Metric]]] = {}
    for kind, found in enumerate((metrics, filter_metrics)):
        for m in found:
            groups.setdefault(evaluation.metric(m).models, ([], []))[kind].append(m)
    segments = [
        _segment(repository, evaluation, f"s{i}", dimensions, filter_dimensions, own_models, shown, filtering, on_rows)
        for i, (own_models, (shown, filtering)) in enumerate((groups or {(): ([], [])}).items())
    ]
    shown_paths = [m.path for m in (*dimensions, *metrics)]
    order = tuple(o for o in query.get("order") or () if o["member"] in shown_paths)
    return QueryPlan(
        tuple(segments), tuple(on_aggregates), tuple(d.path for d in dimensions), tuple(m.path for m in metrics), order or None, query.get("limit"), query.get("offset")
    )


def _last_first(repository: Repository, filters: list[dict]) -> list:
    """Members of the filters, the last one first; of a connective's filters too."""
    out = []
    for f in reversed(filters):
        out += _last_first(repository, f["filters"]) if f["operator"] in ("and", "or") else [repository.member(f["member"])]
    return out


def _segment(
    repository: Repository, evaluation: Evaluation, alias: str, shown: list[Dimension], filtering: list[Dimension], own_models: tuple[str, ...], metrics: list[Metric], filter_metrics: list[Metric], filters: list[dict]
) -> Segment:
    keys = [d for name in own_models for d in repository.model(name).primary_key]
    models = _unique([*(m for d in (*shown, *filtering) for m in evaluation.dimension(d).models), *own_models])
    paths = lambda *groups: _unique(m.path for g in groups for m in g)
    rows = Level(paths(shown, filtering, keys), paths(metrics, filter_metrics))
    initial = (own_models or models or (None,))[0]
    refs = _unique(r for p in rows.metrics for r in evaluation.metric(repository.metric(p)).metric_refs)
    sub = MetricRefs(rows.dimensions, plan_query(repository, evaluation, {"members": [*rows.dimensions, *refs], "filters": filters})) if refs else None
    if initial is None and sub is None:
        raise ValueError("no model to read: the metrics refer to nothing")
    return Segment(
        alias,
        models,
        rows,
        Level(paths(shown), paths(metrics, filter_metrics)),
        Level(paths(shown), paths(metrics)),
        plan_joins(repository.graph, repository.joins, list(models), initial) if initial else None,
        sub,
        tuple(filters),
    )
