"""Queries over a repository: validated, planned and turned into DataFrames."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.hierarchy import HierarchyConfig
from metricloom.names import path_to_alias
from metricloom.operators.lowering import Lowering
from metricloom.plans.evaluation import Evaluation
from metricloom.plans.planner import QueryPlan, plan_query
from metricloom.schema import QuerySchema

if TYPE_CHECKING:
    from metricloom.repository import Repository


class QueryBuilder:
    def __init__(self, repository: Repository, spark: SparkSession):
        self.repository, self.spark = repository, spark
        self.schema = QuerySchema(repository)
        self.hierarchies: list[HierarchyConfig] = self._hierarchies()

    def _hierarchies(self) -> list[HierarchyConfig]:
        """The repository's categorical ones, each model's categorical and then temporal ones, the repository's temporal ones."""
        r = self.repository
        own = lambda kind: [h.config(h.name, r.dimension) for h in r.hierarchies.values() if h.type == kind]
        of_models = [
            h.config(f"{m.name}.{h.name}", m.dimension) for m in r.models.values() for kind in ("categorical", "temporal") for h in m.hierarchies.values() if h.type == kind
        ]
        return [*own("categorical"), *of_models, *own("temporal")]

    def hierarchy(self, name: str) -> HierarchyConfig:
        for h in self.hierarchies:
            if h.name == name:
                return h
        raise KeyError(f"Hierarchy {name} not found")

    def plan(self, query: dict[str, Any], context: Any = None) -> QueryPlan:
        return plan_query(self.repository, Evaluation(self.repository, context), self.schema.parse(query))

    def build_query(self, query: dict[str, Any], context: Any = None) -> DataFrame:
        """The result as a DataFrame with columns ``model___member``: dimensions first, then metrics. Without ``order`` it
        has the default order; with an empty one (``[]``) none, which saves a sort of the whole result."""
        return self._build(self.schema.parse(query), context, ordered=query.get("order") != [])

    def build_count_query(self, query: dict[str, Any], context: Any = None) -> DataFrame:
        """One row with the number of rows (``count``) that the query has without limit and offset."""
        whole = {k: v for k, v in query.items() if k not in ("limit", "offset", "order")}
        return self._build(self.schema.parse(whole), context, ordered=False).agg(F.count(F.lit(1)).alias("count"))

    def _build(self, query: dict[str, Any], context: Any, ordered: bool) -> DataFrame:
        evaluation = Evaluation(self.repository, context)
        return Lowering(self.repository, self.spark, evaluation).query(plan_query(self.repository, evaluation, query), ordered)

    def introspect(self, query: dict[str, Any]) -> dict[str, dict[str, Any]]:
        """What is known of each member of the query, by result column."""
        out = {}
        for path in query["members"]:
            m = self.repository.member(path)
            out[path_to_alias(path)] = {
                "memberType": "dimension" if m.is_dimension else "metric",
                "path": m.path,
                "alias": path_to_alias(path),
                "format": m.format,
                "type": m.type,
                "description": m.description,
                "isPrimaryKey": m.primary_key,
                "isGranularity": bool(m.granularity),
                "isPrivate": m.private,
            }
        return out
