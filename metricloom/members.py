"""Dimensions and metrics as they are declared; what they compute is worked out per query (plans/evaluation)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from metricloom.names import path_to_alias

MEMBER_TYPES = ("string", "number", "boolean", "date", "datetime", "time")
_FORMATS: dict[str, Callable[[Any], str]] = {"percentage": lambda v: f"{v}%", "currency": lambda v: f"${v}"}

Format = str | Callable[[Any], str] | None


@dataclass(frozen=True)
class Member:
    """``model`` is None for members of the repository (calculated ones), whose name is the whole path."""

    name: str
    type: str
    model: str | None = None
    expr: Callable[..., Any] | None = None
    private: bool = False
    description: str | None = None
    format: Format = None

    def __post_init__(self) -> None:
        if self.type not in MEMBER_TYPES:
            raise ValueError(f"{self.name}: type {self.type!r} is none of {', '.join(MEMBER_TYPES)}")
        if isinstance(self.format, str) and self.format not in _FORMATS:
            raise ValueError(f"{self.name}: format {self.format!r} is none of {', '.join(_FORMATS)} and no function")

    @property
    def path(self) -> str:
        return f"{self.model}.{self.name}" if self.model else self.name

    @property
    def alias(self) -> str:
        return path_to_alias(self.path)

    def formatted(self, value: Any) -> str | None:
        """None without a format."""
        if self.format is None:
            return None
        return (_FORMATS[self.format] if isinstance(self.format, str) else self.format)(value)

    def of_model(self, model: str) -> Member:
        return replace(self, model=model)


@dataclass(frozen=True)
class Dimension(Member):
    primary_key: bool = False
    parent: str | None = None  # of a granularity: the dimension that it is a part of
    granularity: str | None = None

    is_dimension = True


@dataclass(frozen=True)
class Metric(Member):
    """``ignores_duplicates``: repeated rows don't change the result (least, greatest, distinct counts), so a
    query with such metrics only need not remove them."""

    ignores_duplicates: bool = False

    is_dimension = False
    primary_key = False
    granularity = None
