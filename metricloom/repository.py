"""A repository: models, the joins between them, members across models, and the filters that queries may use."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from metricloom.hierarchy import Hierarchy, Level
from metricloom.members import Dimension, Format, Member, Metric
from metricloom.model import Model
from metricloom.operators.filters import FilterRegistry, default_filters
from metricloom.plans.joins import _SCALE as PRIORITIES
from metricloom.plans.joins import Join, JoinGraph


class Repository:
    def __init__(self) -> None:
        self.models: dict[str, Model] = {}
        self.graph = JoinGraph()
        self.joins: dict[tuple[str, str], Join] = {}
        self.calculated: dict[str, Member] = {}
        self.hierarchies: dict[str, Hierarchy] = {}
        self.filters: FilterRegistry = default_filters()

    # declaration

    def with_model(self, model: Model) -> Repository:
        self.models[model.name] = model
        self.graph.add_node(model.name)
        return self

    def with_calculated_dimension(self, path: str, type: str, expr: Callable[..., Any], private: bool = False, description: str | None = None, format: Format = None) -> Repository:
        """``expr`` gets references to all models (``m["orders"].dimension("id")``) and returns a Column."""
        self.calculated[path] = Dimension(path, type, None, expr, private, description, format)
        return self

    def with_calculated_metric(
        self, path: str, type: str, expr: Callable[..., Any], private: bool = False, description: str | None = None, format: Format = None, ignores_duplicates: bool = False
    ) -> Repository:
        self.calculated[path] = Metric(path, type, None, expr, private, description, format, ignores_duplicates)
        return self

    def with_filters(self, registry: FilterRegistry) -> Repository:
        """Queries may use these filters, and no others."""
        self.filters = registry
        return self

    def _add_hierarchy(self, name: str, levels: tuple[Level, ...], type: str) -> Repository:
        if name in self.hierarchies:
            raise ValueError(f'Hierarchy "{name}" already exists')
        self.hierarchies[name] = Hierarchy(name, type, levels)
        return self

    def with_categorical_hierarchy(self, name: str, *levels: Level) -> Repository:
        return self._add_hierarchy(name, levels, "categorical")

    def with_temporal_hierarchy(self, name: str, *levels: Level) -> Repository:
        return self._add_hierarchy(name, levels, "temporal")

    def join(self, cardinality: str, left: str, right: str, on: Callable[..., Any], how: str | None = None, priority: str = "normal") -> Repository:
        """``on`` gets references to both models and returns a Boolean Column. ``how``: inner or full; by default the
        rows of ``left`` are kept. A join of the same models that was declared before is replaced."""
        if left == right:
            raise ValueError(f"model {left} can't be joined to itself; clone it")
        for name in (left, right):
            self.model(name)
        if how not in (None, "inner", "full"):
            raise ValueError(f"a join is inner or full, or keeps the rows of the left model, but not {how!r}")
        if priority not in PRIORITIES:
            raise ValueError(f"priority {priority!r} is none of {', '.join(PRIORITIES)}")
        join = Join(left, right, cardinality, on, how, priority)
        for j in (join, join.flip()):
            self.joins[j.left, j.right] = j
            self.graph.add_edge(j.left, j.right, j.weight)
        return self

    def join_one_to_one(self, left: str, right: str, on: Callable[..., Any], **options: Any) -> Repository:
        return self.join("one_to_one", left, right, on, **options)

    def join_one_to_many(self, left: str, right: str, on: Callable[..., Any], **options: Any) -> Repository:
        return self.join("one_to_many", left, right, on, **options)

    def join_many_to_one(self, left: str, right: str, on: Callable[..., Any], **options: Any) -> Repository:
        return self.join("many_to_one", left, right, on, **options)

    def join_many_to_many(self, left: str, right: str, on: Callable[..., Any], **options: Any) -> Repository:
        return self.join("many_to_many", left, right, on, **options)

    # look-up

    def model(self, name: str) -> Model:
        if name not in self.models:
            raise KeyError(f"Model {name} not found")
        return self.models[name]

    def _members(self, kind: str) -> dict[str, Member]:
        found = {m.path: m for model in self.models.values() for m in getattr(model, kind).values()}
        found |= {p: m for p, m in self.calculated.items() if m.is_dimension == (kind == "dimensions")}
        return found

    @property
    def dimensions(self) -> list[Dimension]:
        return list(self._members("dimensions").values())

    @property
    def metrics(self) -> list[Metric]:
        return list(self._members("metrics").values())

    def member(self, path: str) -> Member:
        """A dimension before a metric of the same path."""
        first, _, rest = path.partition(".")
        model = self.models.get(first)
        calculated = self.calculated.get(path)
        found = (calculated if calculated and calculated.is_dimension else None) or (model and model.dimensions.get(rest)) or calculated or (model and model.metrics.get(rest))
        if not found:
            raise KeyError(f"Member {path} not found")
        return found

    def dimension(self, path: str) -> Dimension:
        if not (found := self.member(path)).is_dimension:
            raise KeyError(f"Dimension {path} not found")
        return found

    def metric(self, path: str) -> Metric:
        found = self._members("metrics").get(path)
        if not found:
            raise KeyError(f"Metric {path} not found")
        return found

    def joins_of(self, model: str) -> list[Join]:
        self.model(model)
        return [j for (left, _), j in self.joins.items() if left == model]

    def find_join(self, left: str, right: str) -> Join | None:
        return self.joins.get((left, right))

    def build(self, spark: SparkSession):
        """A query builder; all models must be connected by joins."""
        from metricloom.query import QueryBuilder

        if not self.models:
            raise ValueError("the repository has no model")
        if len(parts := self.graph.components()) > 1:
            raise ValueError("All models must be connected by joins; separate groups: " + "; ".join(", ".join(sorted(p)) for p in parts))
        return QueryBuilder(self, spark)


def repository() -> Repository:
    return Repository()
