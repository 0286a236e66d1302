"""Filters: what a query may ask of a member, as Boolean Columns.

All follow SQL's three-valued logic: a null member meets neither a condition nor its negation, but for
``set`` and ``notSet``. A registry holds the filters of a repository and can be replaced or extended:

    default_filters().register(Filter("divisibleBy", "...", numbers, lambda ctx, m, v: m % v[0] == 0))
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.functions.dates import date_range, instant

Path = tuple[str | int, ...]
Issue = tuple[Path, str]


def kind_of(value: Any) -> str:
    """The names that messages use."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float, Decimal)):
        return "number"
    if isinstance(value, (list, tuple)):
        return "array"
    if isinstance(value, dict):
        return "object"
    return "date" if isinstance(value, date) else "string" if isinstance(value, str) else type(value).__name__


@dataclass(frozen=True)
class Values:
    """What a filter's value must be; ``parse`` yields issues through ``report`` and returns the value to use."""

    parse: Callable[[Any, Path, Callable[[Path, str], None]], Any]
    json: dict | None


def _array_of(name: str, accept: Callable[[Any], tuple[bool, Any]], json: dict) -> Values:
    def parse(value: Any, path: Path, report: Callable[[Path, str], None]) -> Any:
        if not isinstance(value, (list, tuple)):
            report(path, f"Expected array, received {kind_of(value)}")
            return None
        if not value:
            report(path, "Array must contain at least 1 element(s)")
        out = []
        for i, x in enumerate(value):
            fine, y = accept(x)
            if not fine:
                report((*path, i), f"Expected {name}, received {y}")
            out.append(y)
        return out

    return Values(parse, {"type": "array", "items": json, "minItems": 1})


def _number(x: Any) -> tuple[bool, Any]:
    """Numbers, and what reads as one."""
    if isinstance(x, bool):
        return True, int(x)
    if isinstance(x, (int, float, Decimal)):
        return (False, "nan") if x != x else (True, x)
    if isinstance(x, str):
        text = x.strip()
        for read in (int, float):
            try:
                y = read(text) if text else 0
            except ValueError:
                continue
            return (False, "nan") if y != y else (True, y)
    return False, "nan"


_SCALARS = (str, int, float, Decimal, bool, date)
scalars = _array_of("string, number, boolean or date", lambda x: (isinstance(x, _SCALARS), x if isinstance(x, _SCALARS) else kind_of(x)), {"type": ["string", "number", "boolean"]})
strings = _array_of("string", lambda x: (isinstance(x, str), x if isinstance(x, str) else kind_of(x)), {"type": "string"})
numbers = _array_of("number", _number, {"type": "number"})
nothing = Values(lambda value, path, report: None, None)


def _parse_date(value: Any, path: Path, report: Callable[[Path, str], None]) -> Any:
    if not isinstance(value, (str, date)):
        report(path, f"Expected string or date, received {kind_of(value)}")
        return None
    try:
        return instant(value)
    except ValueError as e:
        report(path, str(e))


def _parse_range(value: Any, path: Path, report: Callable[[Path, str], None]) -> Any:
    if isinstance(value, str):
        try:
            return date_range(value)
        except ValueError as e:
            report(path, str(e))
        return None
    if not isinstance(value, dict):
        report(path, f"Expected string or object, received {kind_of(value)}")
        return None
    ends = []
    for short, long in (("startDate", "start_date"), ("endDate", "end_date")):
        if short not in value and long not in value:
            report((*path, short), "Required")
        else:
            ends.append(_parse_date(value.get(short, value.get(long)), (*path, short), report))
    return tuple(ends) if len(ends) == 2 else None


_DATE_JSON = {"type": "string"}
instants = Values(_parse_date, _DATE_JSON)
ranges = Values(_parse_range, {"anyOf": [_DATE_JSON, {"type": "object", "properties": {"startDate": _DATE_JSON, "endDate": _DATE_JSON}, "required": ["startDate", "endDate"]}]})
#: A query with one member; the query schema itself parses it.
subquery = Values(lambda value, path, report: value, {"$ref": "#"})


@dataclass(frozen=True)
class Filter:
    """``build(context, member, value)``: a Column. The context knows how to run sub-queries (``context.rows``)."""

    name: str
    description: str
    values: Values
    build: Callable[[Any, Column, Any], Column]


def _literal(value: Any) -> Column:
    """Instants have no zone, as Parquet's timestamps: so comparisons reach the scan."""
    return F.lit(value).cast("timestamp_ntz") if isinstance(value, datetime) else F.lit(value)


def _all(parts: Iterator[Column]) -> Column:
    return reduce(operator.and_, parts)


def _any(parts: Iterator[Column]) -> Column:
    return reduce(operator.or_, parts)


def _is_one_of(_: Any, m: Column, values: list) -> Column:
    return m == _literal(values[0]) if len(values) == 1 else m.isin(*map(_literal, values))


def _is_none_of(_: Any, m: Column, values: list) -> Column:
    return m != _literal(values[0]) if len(values) == 1 else ~m.isin(*map(_literal, values))


def _like(before: str, after: str, negated: bool) -> Callable[[Any, Column, list], Column]:
    """``%`` and ``_`` in values are wildcards."""
    if negated:
        return lambda _, m, values: _all(~m.ilike(f"{before}{v}{after}") for v in values)
    return lambda _, m, values: _any(m.ilike(f"{before}{v}{after}") for v in values)


def _compare(op: Callable[[Any, Any], Column]) -> Callable[[Any, Column, list], Column]:
    return lambda _, m, values: _all(op(m, F.lit(v)) for v in values)


def _within(_: Any, m: Column, ends: tuple[datetime, datetime]) -> Column:
    return m.between(*map(_literal, ends))


def _in_query(context: Any, m: Column, query: dict) -> Column:
    return m.isin(context.rows(query))


DEFAULT: tuple[Filter, ...] = (
    Filter("equals", "The member is one of the values.", scalars, _is_one_of),
    Filter("in", "The member is one of the values.", scalars, _is_one_of),
    Filter("notEquals", "The member is none of the values.", scalars, _is_none_of),
    Filter("notIn", "The member is none of the values.", scalars, _is_none_of),
    Filter("notSet", "The member is null.", nothing, lambda _, m, __: m.isNull()),
    Filter("set", "The member is not null.", nothing, lambda _, m, __: m.isNotNull()),
    Filter("contains", "The member contains one of the texts, in either case.", strings, _like("%", "%", False)),
    Filter("notContains", "The member contains none of the texts, in either case.", strings, _like("%", "%", True)),
    Filter("startsWith", "The member starts with one of the texts, in either case.", strings, _like("", "%", False)),
    Filter("notStartsWith", "The member starts with none of the texts, in either case.", strings, _like("", "%", True)),
    Filter("endsWith", "The member ends with one of the texts, in either case.", strings, _like("%", "", False)),
    Filter("notEndsWith", "The member ends with none of the texts, in either case.", strings, _like("%", "", True)),
    Filter("gt", "The member is greater than all values.", numbers, _compare(operator.gt)),
    Filter("gte", "The member is greater than or equal to all values.", numbers, _compare(operator.ge)),
    Filter("lt", "The member is less than all values.", numbers, _compare(operator.lt)),
    Filter("lte", "The member is less than or equal to all values.", numbers, _compare(operator.le)),
    Filter("inDateRange", "The member is in the range, its ends included: startDate and endDate, or a text like 'last month'.", ranges, _within),
    Filter("notInDateRange", "The member is outside of the range.", ranges, lambda c, m, v: ~_within(c, m, v)),
    Filter("beforeDate", "The member is before the date: ISO, or a text like 'start of last year'.", instants, lambda _, m, v: m < _literal(v)),
    Filter("afterDate", "The member is after the date: ISO, or a text like 'start of last year'.", instants, lambda _, m, v: m > _literal(v)),
    Filter("inQuery", "The member is in the result of a query with one member.", subquery, _in_query),
    Filter("notInQuery", "The member is not in the result of a query with one member; never true if that has a null.", subquery, lambda c, m, q: ~_in_query(c, m, q)),
)


class FilterRegistry:
    def __init__(self, filters: tuple[Filter, ...] = ()):
        self._filters: dict[str, Filter] = {}
        for f in filters:
            self.register(f)

    def register(self, f: Filter) -> FilterRegistry:
        if f.name in ("and", "or"):
            raise ValueError(f"{f.name} is a connective")
        self._filters[f.name] = f
        return self

    def __iter__(self) -> Iterator[Filter]:
        return iter(self._filters.values())

    def __contains__(self, name: str) -> bool:
        return name in self._filters

    def __getitem__(self, name: str) -> Filter:
        return self._filters[name]


def default_filters() -> FilterRegistry:
    return FilterRegistry(DEFAULT)


def leaves(filters: list[dict]) -> Iterator[dict]:
    """Filters without connectives, from left to right."""
    for f in filters:
        if f["operator"] in ("and", "or"):
            yield from leaves(f["filters"])
        else:
            yield f


def condition(registry: FilterRegistry, context: Any, filters: list[dict], member: Callable[[str], Column], connective: str = "and") -> Column | None:
    """One Column for all ``filters``; None without any."""
    parts = [
        condition(registry, context, f["filters"], member, f["operator"]) if f["operator"] in ("and", "or") else registry[f["operator"]].build(context, member(f["member"]), f.get("value"))
        for f in filters
    ]
    return (_all if connective == "and" else _any)(iter(parts)) if parts else None
