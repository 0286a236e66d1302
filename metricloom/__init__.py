"""Metrics and dimensions over Spark DataFrames."""

from metricloom.analyzer import analyze_query, analyze_query_hierarchy
from metricloom.functions.formatting import format_results
from metricloom.hierarchy import element
from metricloom.model import Model, model
from metricloom.names import alias_to_path, path_to_alias
from metricloom.operators.filters import Filter, FilterRegistry, default_filters
from metricloom.query import QueryBuilder
from metricloom.repository import Repository, repository
from metricloom.schema import QueryError

__all__ = [
    "Filter",
    "FilterRegistry",
    "Model",
    "QueryBuilder",
    "QueryError",
    "Repository",
    "alias_to_path",
    "analyze_query",
    "analyze_query_hierarchy",
    "default_filters",
    "element",
    "format_results",
    "model",
    "path_to_alias",
    "repository",
]
