"""From a logical plan to a DataFrame. Only declarative operations: Catalyst prunes columns, pushes filters
into scans, turns outer joins that filters make inner into inner ones and picks the joins' strategies."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.names import SUBQUERY, path_to_alias, quoted
from metricloom.operators.filters import condition
from metricloom.plans.evaluation import Evaluation, Input
from metricloom.plans.joins import JoinStep, counts_rows
from metricloom.plans.planner import QueryPlan, Segment, plan_query

if TYPE_CHECKING:
    from metricloom.repository import Repository


_PLAIN = re.compile(r"Column<'\w+\.\w+'>")
_EQUAL = re.compile(r"=\((\w+)\.(\w+), (\w+)\.(\w+)\)")


def equal_columns(on: Column, left: str, right: str) -> list[tuple[str, str]] | None:
    """The pairs of columns, if the condition says only that columns of both models are equal; None for any
    other condition, and wherever it can't be told."""
    told = re.fullmatch(r"Column<'(.*)'>", str(on))
    if not told:
        return None
    pairs, text, before = [], _EQUAL.sub("E", told[1]), None
    while text != before:
        before, text = text, text.replace("and(E, E)", "E")
    if text != "E":
        return None
    for a, x, b, y in _EQUAL.findall(told[1]):
        if {a, b} != {left, right}:
            return None
        pairs.append((quoted(a, x), quoted(b, y)) if a == left else (quoted(b, y), quoted(a, x)))
    return pairs


_NOT_COMPARED = re.compile(r"\b(map|variant|collate)\b")

Columns = frozenset[tuple[str, str]]  # (model, column)


@dataclass(frozen=True)
class Reads:
    """What a segment whose repeated rows don't count reads: the columns above all joins, those in the condition of each
    join, and those of each model's primary key (no entry if it has none)."""

    steps: Sequence[JoinStep]
    above: Columns
    conditions: dict[frozenset[str], Columns]
    keys: dict[str, Columns]

    def outside(self, inside: set[str]) -> Columns:
        """Columns of the joined models ``inside`` that anything but the joins between them reads."""
        read = self.above.union(*(c for pair, c in self.conditions.items() if not pair <= inside))
        return frozenset(c for c in read if c[0] in inside)


class Lowering:
    """One query's way to a DataFrame; filters get it as their context."""

    def __init__(self, repository: Repository, spark: SparkSession, evaluation: Evaluation):
        self.repository, self.spark, self.evaluation = repository, spark, evaluation
        self._sources: dict[str, DataFrame] = {}

    @property
    def context(self) -> Any:
        return self.evaluation.context

    def rows(self, query: dict) -> DataFrame:
        """The result of a parsed sub-query, with the same context. Its order doesn't matter unless it is cut."""
        plan = plan_query(self.repository, self.evaluation, query)
        return self.query(plan, ordered=bool(plan.limit or plan.offset))

    def query(self, plan: QueryPlan, ordered: bool = True) -> DataFrame:
        df = self._joined(plan)
        if plan.filters:
            on_metric = lambda path: F.col(quoted(path_to_alias(path)))
            df = df.where(condition(self.repository.filters, self, list(plan.filters), on_metric))
        shown = [*plan.projected_dimensions, *(p for s in plan.segments for p in s.root_query.metrics)]
        df = df.select(*(F.col(quoted(path_to_alias(p))) for p in dict.fromkeys(shown)))
        if ordered:
            df = df.orderBy(*self._order(plan))
        if plan.offset:
            df = df.offset(plan.offset)
        return df.limit(plan.limit) if plan.limit else df

    def _order(self, plan: QueryPlan) -> list[Column]:
        """As asked; else by the first part of a date, else the first metric (greatest first), else the first dimension."""
        if plan.order:
            return [getattr(F.col(quoted(path_to_alias(o["member"]))), o["direction"])() for o in plan.order]
        for path in plan.projected_dimensions:
            if self.repository.member(path).granularity:
                return [F.col(quoted(path_to_alias(path))).asc()]
        for path in plan.projected_metrics:
            return [F.col(quoted(path_to_alias(path))).desc()]
        return [F.col(quoted(path_to_alias(p))).asc() for p in plan.projected_dimensions[:1]]

    def _joined(self, plan: QueryPlan) -> DataFrame:
        """Segments side by side, where they agree in all dimensions that are shown (nulls agree with nothing)."""
        first, *others = plan.segments
        df = self._segment(first)
        for s in others:
            right = self._segment(s)
            keys = list(dict.fromkeys(map(path_to_alias, plan.projected_dimensions)))
            df = df.join(right, keys, "inner") if keys else df.crossJoin(right)
        return df

    def _segment(self, s: Segment) -> DataFrame:
        inputs = self._inputs(s)
        aggregates: list[Column] = []
        plain = True  # no duplicate row changes a result
        for path in s.segment_query.metrics:
            metric = self.repository.metric(path)
            aggregates.append(self.evaluation.metric(metric).column.alias(metric.alias))
            plain &= metric.ignores_duplicates
        rows = self._rows(s)
        keys = [path_to_alias(p) for p in s.segment_query.dimensions]
        if not aggregates:
            return rows.select(*(c.alias(a) for a, c in self._dimensions(s.segment_query.dimensions))).distinct()
        narrow = [*self._dimensions(s.model_query.dimensions), *((i.alias, i.column) for i in inputs)]
        if s.join_plan and s.join_plan.multiplies_rows and not plain:
            # a plain column that is there under several names is compared and shuffled once
            first: dict[str, str] = {}
            names = [(alias, first.setdefault(text if _PLAIN.fullmatch(text := str(column)) else alias, alias)) for alias, column in narrow]
            once = rows.select(*(c.alias(a) for a, c in narrow if a in first.values())).distinct()
            narrow = once.select(*(F.col(quoted(a)).alias(alias) for alias, a in names))
        else:
            narrow = rows.select(*(c.alias(a) for a, c in narrow))
        keys += [i.alias for i in inputs if i.key]
        grouped = narrow.groupBy(*(F.col(quoted(k)) for k in dict.fromkeys(keys))) if keys else narrow
        shown = [*map(path_to_alias, s.segment_query.members)]
        return grouped.agg(*aggregates).select(*(F.col(quoted(c)) for c in shown))

    def _inputs(self, s: Segment) -> list[Input]:
        return [i for path in s.segment_query.metrics for i in self.evaluation.metric(self.repository.metric(path)).inputs]

    def _dimensions(self, paths: Iterable[str]) -> list[tuple[str, Column]]:
        found = [self.repository.dimension(p) for p in paths]
        return [(d.alias, self.evaluation.dimension(d).column) for d in found]

    def _source(self, name: str) -> DataFrame:
        if name not in self._sources:
            self._sources[name] = self.repository.model(name).read(self.spark, self.context)
        return self._sources[name]

    def _tree(self, root: str, steps: Sequence[JoinStep], reads: Reads | None = None) -> DataFrame:
        """Models joined step by step. Where a step keeps the rows of its right model, and its condition is false
        for nulls, all that hangs on that model is joined to it first: (a RIGHT b) then c is a RIGHT (b then c). So
        a fact table is shuffled by its own keys, of which there are many, and not by those of small tables
        beyond. With ``reads`` repeated rows don't count, and models, and what hangs on a step that multiplies rows, are
        made distinct before they are joined."""
        df, whole, at = self._fewer(self._source(root), {root}, reads), True, 0
        while at < len(steps):
            step = steps[at]
            on = self.evaluation.condition(step.left, step.right)
            at += 1
            inside, end = {step.right}, at
            while end < len(steps) and steps[end].left in inside:
                inside.add(steps[end].right)
                end += 1
            keys = equal_columns(on, step.left, step.right) if step.how == "right" else None
            multiplies = reads is not None and self.repository.joins[step.left, step.right].multiplies
            if keys is None and not (multiplies and self._first(step.how, steps[at:end])):
                df = df.join(self._fewer(self._source(step.right), {step.right}, reads), on, step.how)
                whole &= step.how == "left"
                continue
            right = self._tree(step.right, steps[at:end], reads)
            if multiplies and end > at:
                right = self._fewer(right, inside, reads)
            if keys is None:
                df = df.join(right, on, step.how)
                whole &= step.how == "left"
            else:
                df = self._right(df, right, on, keys, root if whole and step.left == root else None)
                whole = False
            at = end
        return df

    def _first(self, how: str, steps: Sequence[JoinStep]) -> bool:
        """Whether (a LEFT b) or (a INNER b), then ``steps`` that hang on b, is a LEFT or INNER (b then ``steps``)."""
        if how == "left":
            return all(s.how == "left" and equal_columns(self.evaluation.condition(s.left, s.right), s.left, s.right) for s in steps)
        return how == "inner" and all(s.how in ("left", "inner") for s in steps)

    def _fewer(self, df: DataFrame, inside: set[str], reads: Reads | None) -> DataFrame:
        """The distinct rows of what is read of the joined models ``inside``; as they are where a key among it says that no
        row is repeated, or where rows can't be compared."""
        if reads is None or not (columns := reads.outside(inside)):
            return df
        counted = counts_rows(self.repository.joins, reads.steps, inside)
        if all(m in reads.keys and reads.keys[m] <= columns for m in ([counted] if counted else inside)):
            return df
        narrow = df.select(*(F.col(quoted(*c)) for c in sorted(columns)))
        return df if any(_NOT_COMPARED.search(f.dataType.simpleString()) for f in narrow.schema.fields) else narrow.distinct()

    def _reads(self, s: Segment) -> Reads | None:
        """None where joined rows are no more than the tables' own, where they must not be made fewer, and where the session
        doesn't tell what is read (Spark Connect)."""
        plan = s.join_plan
        if not plan or not plan.multiplies_rows or not hasattr(self._source(plan.initial), "_jdf"):
            return None
        models = [plan.initial, *(step.right for step in plan.steps)]
        if counts_rows(self.repository.joins, plan.steps, models):
            return None
        # the joins' conditions left out, so that only what is above them reads
        all_rows = self._met(s, reduce(DataFrame.crossJoin, map(self._source, models)))
        above = all_rows.select(*(c for _, c in self._dimensions(s.model_query.dimensions)), *(i.column for i in self._inputs(s)))
        joined = {frozenset((j.left, j.right)): self._source(j.left).join(self._source(j.right), self.evaluation.condition(j.left, j.right)) for j in plan.steps}
        if not all(df._jdf.queryExecution().analyzed().deterministic() for df in (above, *joined.values())):
            return None
        keys = {m: self._source(m).select(*(self.evaluation.dimension(d).column for d in self.repository.model(m).primary_key)) for m in models if self.repository.model(m).primary_key}
        read = lambda df: self._read(df, {*models})
        return Reads(plan.steps, read(above), {pair: read(df) for pair, df in joined.items()}, {m: read(df) for m, df in keys.items()})

    def _read(self, df: DataFrame, models: set[str]) -> Columns:
        """The models' columns that the analyzed plan refers to, down to where the models begin."""
        found, todo = set(), [df._jdf.queryExecution().analyzed()]
        while todo:
            node = todo.pop()
            if node.nodeName() == "SubqueryAlias" and node.alias() in (*models, SUBQUERY):
                continue
            refs, children = node.references().toSeq(), node.children()
            for a in (refs.apply(k) for k in range(refs.size())):
                if a.qualifier().size() and a.qualifier().last() in models:
                    found.add((a.qualifier().last(), a.name()))
            todo += [children.apply(k) for k in range(children.size())]
        return frozenset(found)

    def _right(self, df: DataFrame, right: DataFrame, on: Column, keys: list[tuple[str, str]], root: str | None) -> DataFrame:
        """A right outer join can't broadcast the side that it keeps. Where that side is small and the other one
        is not, it is an inner join, which can, and the kept side's rows without partner, which are found
        among the distinct keys of ``root``. Sizes are Spark's own estimates, held against its own threshold."""
        if root is None or not self._is_small(right) or self._is_small(self._source(root)):
            return df.join(right, on, "right")
        found = self._source(root).select(*(F.col(a).alias(f"__key{k}") for k, (a, _) in enumerate(keys))).distinct()
        alone = right.join(found, reduce(operator.and_, (F.col(b) == F.col(f"__key{k}") for k, (_, b) in enumerate(keys))), "left_anti")
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
        return df.join(right, on, "inner").unionAll(alone.select(*nulls, "*"))

    def _is_small(self, df: DataFrame) -> bool:
        """False also where the session can't tell sizes (Spark Connect): the join then keeps its declared form."""
        if not hasattr(df, "_jdf"):
            return False
        limit = self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit

    def _rows(self, s: Segment) -> DataFrame:
        """All models joined, with the values of referenced metrics, and filtered."""
        return self._met(s, self._tree(s.join_plan.initial, s.join_plan.steps, self._reads(s)) if s.join_plan else None)

    def _met(self, s: Segment, df: DataFrame | None) -> DataFrame:
        if s.metric_refs:
            sub = self.query(s.metric_refs.plan, ordered=False).alias(SUBQUERY)
            if df is None:
                return self._only_subquery(s, sub)
            on = [self.evaluation.dimension(self.repository.dimension(p)).column == F.col(quoted(SUBQUERY, path_to_alias(p))) for p in s.metric_refs.join_on]
            df = df.join(sub, reduce(operator.and_, on), "left") if on else df.crossJoin(sub)
        if s.filters:
            on_row = lambda path: self.evaluation.dimension(self.repository.dimension(path)).column
            df = df.where(condition(self.repository.filters, self, list(s.filters), on_row))
        return df

    def _only_subquery(self, s: Segment, sub: DataFrame) -> DataFrame:
        """Without a model of its own a segment reads what it refers to; the filters are met there."""
        if s.model_query.dimensions:
            raise ValueError("dimensions without a model")
        return sub
