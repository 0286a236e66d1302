"""Models: a relation with named dimensions, metrics and hierarchies.

    model("orders").from_table("orders")
        .with_dimension("id", type="number", primary_key=True, expr=lambda m: m.column("o_orderkey"))
        .with_metric("total", type="number", expr=lambda m: F.sum(m.column("o_totalprice")))
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from metricloom.functions.granularity import BY_TYPE, EXAMPLES, TYPES
from metricloom.hierarchy import Hierarchy, Level, temporal_levels
from metricloom.members import Dimension, Format, Metric
from metricloom.names import check_name
from metricloom.sources.relation import Files, Frame, Source, SqlQuery, Table
from metricloom.streaming import require_batch


class Model:
    def __init__(self, name: str, source: Source | None = None):
        self.name = check_name(name)
        self.source: Source = source or Table(name)
        self.dimensions: dict[str, Dimension] = {}
        self.metrics: dict[str, Metric] = {}
        self.hierarchies: dict[str, Hierarchy] = {}

    # where rows come from

    def from_table(self, name: str | Callable[[Any], str] | None = None) -> Model:
        self.source = Table(name or self.name)
        return self

    def from_files(self, path: str | Callable[[Any], str], format: str = "parquet", schema: Any = None, **options: Any) -> Model:
        self.source = Files(path, format, options, schema)
        return self

    def from_sql(self, text: str | Callable[[Any], str | tuple[str, dict]], **args: Any) -> Model:
        self.source = SqlQuery(text, args)
        return self

    def from_dataframe(self, frame: DataFrame | Callable[[SparkSession, Any], DataFrame]) -> Model:
        self.source = Frame(frame)
        return self

    def read(self, spark: SparkSession, context: Any) -> DataFrame:
        return require_batch(self.source.read(spark, context), self.name).alias(self.name)

    # members

    def _check_new(self, name: str) -> None:
        if name in self.dimensions or name in self.metrics:
            raise ValueError(f'Member "{name}" already exists')

    def with_dimension(
        self,
        name: str,
        type: str,
        expr: Callable[..., Any] | None = None,
        primary_key: bool = False,
        private: bool = False,
        description: str | None = None,
        format: Format = None,
        omit_granularity: bool = False,
    ) -> Model:
        """``expr`` gets the model's references and returns a Column; without it the dimension is the column of
        its name. Dates, times and datetimes get their parts as further dimensions and, unless private, a
        hierarchy."""
        self._check_new(name)
        self.dimensions[name] = Dimension(name, type, self.name, expr, private, description, format, primary_key)
        if type in BY_TYPE and not omit_granularity:
            for part in BY_TYPE[type]:
                full = f"{name}.{part}"
                self.dimensions[full] = Dimension(full, TYPES[part], self.name, None, private, EXAMPLES[part], str, primary_key, name, part)
            if not private:
                self._add_hierarchy(name, temporal_levels(name, type), "temporal")
        return self

    def with_metric(
        self, name: str, type: str, expr: Callable[..., Any], private: bool = False, description: str | None = None, format: Format = None, ignores_duplicates: bool = False
    ) -> Model:
        """``expr`` gets the model's references and returns an aggregate Column."""
        self._check_new(name)
        self.metrics[name] = Metric(name, type, self.name, expr, private, description, format, ignores_duplicates)
        return self

    # hierarchies

    def _add_hierarchy(self, name: str, levels: tuple[Level, ...], type: str) -> None:
        if name in self.hierarchies:
            raise ValueError(f'Hierarchy "{name}" already exists')
        self.hierarchies[name] = Hierarchy(name, type, levels)

    def with_categorical_hierarchy(self, name: str, *levels: Level) -> Model:
        self._add_hierarchy(name, levels, "categorical")
        return self

    def with_temporal_hierarchy(self, name: str, *levels: Level) -> Model:
        self._add_hierarchy(name, levels, "temporal")
        return self

    # look-up

    def dimension(self, name: str) -> Dimension:
        if name not in self.dimensions:
            raise KeyError(f"Dimension {name} not found in model {self.name}")
        return self.dimensions[name]

    def metric(self, name: str) -> Metric:
        if name not in self.metrics:
            raise KeyError(f"Metric {name} not found in model {self.name}")
        return self.metrics[name]

    @property
    def primary_key(self) -> list[Dimension]:
        return [d for d in self.dimensions.values() if d.primary_key and not d.granularity]

    def clone(self, name: str) -> Model:
        """The same relation and members under another name, to join one table in several roles."""
        other = Model(name, self.source)
        other.dimensions = {k: d.of_model(name) for k, d in self.dimensions.items()}
        other.metrics = {k: m.of_model(name) for k, m in self.metrics.items()}
        other.hierarchies = dict(self.hierarchies)
        return other


def model(name: str) -> Model:
    return Model(name)
