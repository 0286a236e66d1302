"""What members compute in one query: callbacks are called once, and what they refer to is recorded.

A dimension's callback makes a Column over the models' columns. A metric's callback makes an aggregate over
its *inputs*: each reference becomes a column of its own, ``<metric>___mr_<i>``, of the rows that are
aggregated later, and the callback gets that column.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.functions.granularity import granularity
from metricloom.members import Dimension, Metric
from metricloom.names import SUBQUERY, quoted

if TYPE_CHECKING:
    from metricloom.repository import Repository


@dataclass(frozen=True)
class Expression:
    """A dimension's Column and the models that it reads, the one referred to last first."""

    column: Column
    models: tuple[str, ...]
    text: str | None = None  # the same as SQL, if it is known


@dataclass(frozen=True)
class Input:
    """Something that a metric aggregates."""

    alias: str
    column: Column
    models: tuple[str, ...]
    metric: str | None = None  # path, if the input is another metric's value
    key: bool = False  # the aggregate is grouped by it


@dataclass(frozen=True)
class Aggregate:
    """A metric's Column over its inputs."""

    column: Column
    inputs: tuple[Input, ...]

    @property
    def models(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(m for i in reversed(self.inputs) for m in i.models))

    @property
    def metric_refs(self) -> tuple[str, ...]:
        return tuple(i.metric for i in reversed(self.inputs) if i.metric)


class _Scope:
    """What callbacks refer with. ``m["orders"]`` gives the references of another model, where more than
    one is in reach."""

    def __init__(self, evaluation: Evaluation, model: str | None, reach: tuple[str, ...] = ()):
        self._evaluation, self._model, self._reach = evaluation, model, reach
        self._texts: list[tuple[Column, str]] = []

    @property
    def context(self) -> Any:
        return self._evaluation.context

    def __getitem__(self, model: str) -> _Scope:
        if model not in self._reach:
            raise KeyError(f"model {model} is out of reach here; in reach: {', '.join(self._reach) or 'none'}")
        return self._of(model)

    def _of(self, model: str) -> _Scope:
        other = type(self).__new__(type(self))
        other.__dict__ = self.__dict__ | {"_model": model}  # records are shared
        return other

    def _own(self) -> str:
        if self._model is None:
            raise ValueError("name the model first: m[<model>]")
        return self._model

    def _told(self, column: Column, text: str | None) -> Column:
        if text:
            self._texts.append((column, text))
        return column

    def identifier(self, *parts: str) -> Column:
        return self._told(F.col(quoted(*parts)), quoted(*parts))

    def sql(self, text: str, *values: Any) -> Column:
        """SQL with ``{}`` for each value: a reference made by this object, what another call of this made, or a
        literal (quoted by its type; other braces stay as they are). Where rows are told one by one, any other Column
        may stand there too."""
        parts = text.split("{}")
        if len(parts) != len(values) + 1:
            raise ValueError(f"{len(parts) - 1} places for {len(values)} values in {text!r}")
        said = [self._as_sql(v) for v in values]
        others = [v for v, t in zip(values, said, strict=True) if t is None]
        if others:
            return self._over(parts, said, others)
        whole = "".join(x for pair in zip(parts, [*said, ""], strict=True) for x in pair)
        return self._told(F.expr(whole), f"({whole})")

    def _over(self, parts: list[str], said: list[str | None], others: list[Column]) -> Column:
        raise ValueError("sql() in a metric takes references to columns and metric inputs, other sql() and literals; combine other Columns with functions")

    def text_of(self, column: Column) -> str | None:
        return next((text for known, text in self._texts if known is column), None)

    def _as_sql(self, value: Any) -> str | None:
        """None for a Column of which no text is known."""
        if isinstance(value, Column):
            return self.text_of(value)
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).upper()
        if isinstance(value, int):
            return repr(value) if abs(value) < 1 << 31 else f"{value}L"
        if isinstance(value, float):
            return f"double('{value!r}')"
        if isinstance(value, Decimal):
            return f"{value:f}BD"
        if isinstance(value, (bytes, bytearray)):
            return f"X'{bytes(value).hex()}'"
        if isinstance(value, datetime):
            return f"{'timestamp' if value.tzinfo else 'timestamp_ntz'}'{value.isoformat(' ')}'"
        if isinstance(value, date):
            return f"date'{value.isoformat()}'"
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


class RowScope(_Scope):
    """For dimensions, joins: columns and dimensions row by row."""

    def __init__(self, evaluation: Evaluation, model: str | None, reach: tuple[str, ...] = ()):
        super().__init__(evaluation, model, reach)
        self._used: list[tuple[str, ...]] = []

    def column(self, name: str) -> Column:
        self._used.append((self._own(),))
        text = quoted(self._own(), name)
        return self._told(F.col(text), text)

    def dimension(self, name: str) -> Column:
        found = self._evaluation.dimension(self._evaluation.repository.model(self._own()).dimension(name))
        self._used.append(found.models)
        return self._told(found.column, found.text)

    def _over(self, parts: list[str], said: list[str | None], others: list[Column]) -> Column:
        """The text as a function of the Columns of which none is known, applied to them."""
        fields = iter(range(len(others)))
        whole = "".join(x for pair in zip(parts, [*(f"__v.v{next(fields)}" if t is None else t for t in said), ""], strict=True) for x in pair)
        row = F.struct(*(v.alias(f"v{k}") for k, v in enumerate(others)))
        return F.call_function("transform", F.array(row), F.expr(f"__v -> ({whole})"))[0]

    def models(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(m for used in reversed(self._used) for m in used))


class MetricScope(_Scope):
    """For metrics: every reference is an input."""

    def __init__(self, evaluation: Evaluation, metric: Metric, reach: tuple[str, ...] = ()):
        super().__init__(evaluation, metric.model, reach)
        self._metric, self._inputs = metric, []

    def _input(self, column: Column, models: tuple[str, ...], metric: str | None = None, key: bool = False) -> Column:
        alias = f"{self._metric.alias}___mr_{len(self._inputs)}"
        self._inputs.append(Input(alias, column, models, metric, key))
        return self._told(F.col(quoted(alias)), quoted(alias))

    def column(self, name: str, group_by: bool = False) -> Column:
        return self._input(F.col(quoted(self._own(), name)), (self._own(),), key=group_by)

    def dimension(self, name: str, group_by: bool = False) -> Column:
        found = self._evaluation.dimension(self._evaluation.repository.model(self._own()).dimension(name))
        return self._input(found.column, found.models, key=group_by)

    def metric(self, name: str, aggregated: bool = False) -> Column:
        """The value of another metric at the query's dimensions and the primary keys of the metric's models;
        ``aggregated``: at the query's dimensions alone, to be used outside of aggregate functions."""
        other = self._evaluation.repository.model(self._own()).metric(name)
        models = () if aggregated else self._evaluation.metric(other).models
        return self._input(F.col(quoted(SUBQUERY, other.alias)), models, other.path, aggregated)

    def inputs(self) -> tuple[Input, ...]:
        return tuple(self._inputs)


class Evaluation:
    """All members of one query, with its context."""

    def __init__(self, repository: Repository, context: Any = None):
        self.repository, self.context = repository, context
        self._rows: dict[str, Expression] = {}
        self._aggregates: dict[str, Aggregate] = {}
        self._open: list[str] = []

    @contextmanager
    def _opened(self, path: str) -> Iterator[None]:
        if path in self._open:
            raise ValueError("members refer to each other in a circle: " + " -> ".join([*self._open, path]))
        self._open.append(path)
        try:
            yield
        finally:
            self._open.pop()

    def dimension(self, d: Dimension) -> Expression:
        if d.path not in self._rows:
            with self._opened(d.path):
                self._rows[d.path] = self._dimension(d)
        return self._rows[d.path]

    def _dimension(self, d: Dimension) -> Expression:
        if d.granularity:
            parent = self.repository.model(d.model).dimension(d.parent)
            whole = self.dimension(parent)
            return Expression(granularity(whole.column, d.granularity, parent.type), whole.models)
        if d.expr is None:
            return Expression(F.col(quoted(d.model, d.name)), (d.model,), quoted(d.model, d.name))
        scope = RowScope(self, d.model, () if d.model else tuple(self.repository.models))
        column = d.expr(scope)
        return Expression(column, (d.model,) if d.model else scope.models(), scope.text_of(column))

    def metric(self, m: Metric) -> Aggregate:
        if m.path not in self._aggregates:
            with self._opened(m.path):
                scope = MetricScope(self, m, () if m.model else tuple(self.repository.models))
                column = m.expr(scope)
                self._aggregates[m.path] = Aggregate(column, scope.inputs())
        return self._aggregates[m.path]

    def condition(self, left: str, right: str) -> Column:
        """The condition of the join between two models."""
        return self.repository.joins[left, right].on(RowScope(self, None, (left, right)))
