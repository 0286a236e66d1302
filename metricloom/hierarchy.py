"""Hierarchies: levels of dimensions to drill down through."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from metricloom.functions.granularity import LEVELS


@dataclass(frozen=True)
class Shown:
    """A dimension's value in a row, for a level's formatter."""

    value: Any
    formatted: str | None


class Level:
    """``element("city").with_dimensions("id", "name").with_key("id").with_format(["name"])``"""

    def __init__(self, name: str, dimensions: tuple[str, ...] = ()):
        self.name, self.dimensions = name, tuple(dimensions)
        self.keys: tuple[str, ...] | None = None
        self.shown: tuple[str, ...] | None = None
        self.formatter: Callable[[Callable[[str], Shown]], str] | None = None

    def with_dimensions(self, *names: str) -> Level:
        self.dimensions = names
        return self

    def with_key(self, *names: str) -> Level:
        self.keys = names
        return self

    def with_format(self, names: list[str] | tuple[str, ...], formatter: Callable[[Callable[[str], Shown]], str] | None = None) -> Level:
        """``formatter`` gets a function from a dimension's name to what it shows in the row."""
        self.shown, self.formatter = tuple(names), formatter
        return self


class _Element:
    def __call__(self, name: str) -> Level:
        return Level(name)

    def from_dimension(self, name: str) -> Level:
        return Level(name, (name,))


element = _Element()


@dataclass(frozen=True)
class LevelConfig:
    name: str
    dimensions: tuple[str, ...]
    key_dimensions: tuple[str, ...]
    format_dimensions: tuple[str, ...]
    formatter: Callable[[dict], str]


@dataclass(frozen=True)
class HierarchyConfig:
    name: str
    type: str
    elements: tuple[LevelConfig, ...]


@dataclass(frozen=True)
class Hierarchy:
    name: str
    type: str  # categorical or temporal
    levels: tuple[Level, ...]

    def config(self, name: str, find: Callable[[str], Any]) -> HierarchyConfig:
        """``find``: from a dimension's name, as the levels have it, to the dimension."""
        if not self.levels:
            raise ValueError(f"hierarchy {name} has no level")
        return HierarchyConfig(name, self.type, tuple(_level_config(x, find) for x in self.levels))


def _level_config(level: Level, find: Callable[[str], Any]) -> LevelConfig:
    paths = lambda names: tuple(find(n).path for n in names)
    shown = level.dimensions if level.shown is None else level.shown

    def look(row: dict) -> Callable[[str], Shown]:
        def show(name: str) -> Shown:
            d = find(name)
            value = row.get(d.alias)
            return Shown(value, None if value is None else d.formatted(value))

        return show

    def default(row: dict) -> str:
        parts = [look(row)(n) for n in shown]
        return ", ".join("" if p.value is None else str(p.value if p.formatted is None else p.formatted) for p in parts)

    formatter = default if level.formatter is None else lambda row: level.formatter(look(row))
    return LevelConfig(level.name, paths(level.dimensions), paths(level.dimensions if level.keys is None else level.keys), paths(shown), formatter)


def temporal_levels(dimension: str, of_type: str) -> tuple[Level, ...]:
    return tuple(Level(n, (n,)) for n in (*(f"{dimension}.{g}" for g in LEVELS[of_type]), dimension))
