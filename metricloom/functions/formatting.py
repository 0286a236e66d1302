"""Rows for people: values with their formats."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from metricloom.members import _FORMATS


def format_results(rows: Iterable[Any], introspection: dict[str, dict[str, Any]]) -> list[dict[str, dict[str, Any]]]:
    """``{column: {"value": ..., "formattedValue": ...}}`` for each row (a dict or Row); no formattedValue without a format."""
    out = []
    for row in rows:
        row = row.asDict() if hasattr(row, "asDict") else row
        shown = {}
        for alias, known in introspection.items():
            shown[alias] = {"value": row.get(alias)}
            if (f := known["format"]) is not None:
                shown[alias]["formattedValue"] = (_FORMATS[f] if isinstance(f, str) else f)(row.get(alias))
        out.append(shown)
    return out
