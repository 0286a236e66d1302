"""Where a model's rows come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from metricloom.names import quoted


@dataclass(frozen=True)
class Table:
    """A table or view by name, whose parts are separated by dots; or a function from the context to the name."""

    name: str | Callable[[Any], str]

    def read(self, spark: SparkSession, context: Any) -> DataFrame:
        name = self.name(context) if callable(self.name) else self.name
        return spark.table(quoted(*name.split(".")))


@dataclass(frozen=True)
class Files:
    """Files of one format (Parquet, ORC, CSV, JSON ...), by path or by a function from the context to the path."""

    path: str | Callable[[Any], str]
    format: str = "parquet"
    options: dict[str, Any] = field(default_factory=dict)
    schema: Any = None

    def read(self, spark: SparkSession, context: Any) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        if self.schema is not None:
            reader = reader.schema(self.schema)
        return reader.load(self.path(context) if callable(self.path) else self.path)


@dataclass(frozen=True)
class SqlQuery:
    """SQL text, with named parameters (``:name``), or a function from the context to (text, parameters)."""

    text: str | Callable[[Any], str | tuple[str, dict]]
    args: dict[str, Any] | None = None

    def read(self, spark: SparkSession, context: Any) -> DataFrame:
        told = self.text(context) if callable(self.text) else self.text
        text, args = told if isinstance(told, tuple) else (told, self.args)
        return spark.sql(text, args=args or {})


@dataclass(frozen=True)
class Frame:
    """A DataFrame, or a function (spark, context) that makes one."""

    frame: DataFrame | Callable[[SparkSession, Any], DataFrame]

    def read(self, spark: SparkSession, context: Any) -> DataFrame:
        return self.frame(spark, context) if callable(self.frame) else self.frame


Source = Table | Files | SqlQuery | Frame
