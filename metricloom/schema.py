"""Validation of queries, with the place of everything that is wrong; the same as JSON schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from metricloom.operators.filters import Path, kind_of, leaves, subquery

if TYPE_CHECKING:
    from metricloom.repository import Repository

# Messages that callers may compare with.
MIXED = "All and/or connectives must include filters with members of the same type (dimension or metric)"
NOT_FOUND = "Member not found"
Report = Callable[[Path, str], None]


@dataclass(frozen=True)
class Issue:
    path: Path
    message: str

    def __str__(self) -> str:
        at = "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in self.path).removeprefix(".")
        return f"Error at {at}: {self.message}" if at else f"Error: {self.message}"


class QueryError(ValueError):
    def __init__(self, issues: list[Issue]):
        super().__init__("\n".join(map(str, issues)))
        self.issues = issues


class QuerySchema:
    def __init__(self, repository: Repository):
        self.repository = repository

    @property
    def members(self) -> dict[str, str]:
        """What queries may name: paths that are not private, as dimension or metric."""
        r = self.repository
        found = {m.path: "metric" for m in r.metrics if not m.private}
        return {d.path: "dimension" for d in r.dimensions if not d.private} | {p: k for p, k in found.items() if p not in r.calculated or not r.calculated[p].is_dimension}

    def parse(self, query: Any) -> dict:
        """The query with its values read; QueryError with all issues."""
        found, issues = self.safe_parse(query)
        if issues:
            raise QueryError(issues)
        return found

    def safe_parse(self, query: Any) -> tuple[dict, list[Issue]]:
        issues: list[Issue] = []
        found = self._query(query, (), lambda path, message: issues.append(Issue(path, message)), self.members)
        return found, issues

    def _query(self, query: Any, path: Path, report: Report, members: dict[str, str]) -> dict:
        if not isinstance(query, dict):
            report(path, f"Expected object, received {kind_of(query)}")
            return {}
        out: dict[str, Any] = {"members": self._members(query, path, report, members)}
        for key in ("limit", "offset"):
            if (n := query.get(key)) is not None:
                if isinstance(n, bool) or not isinstance(n, (int, float)) or n != int(n) or n < 0:
                    report((*path, key), f"Expected a whole number of 0 or more, received {n if isinstance(n, (int, float)) else kind_of(n)}")
                else:
                    out[key] = int(n)
        if query.get("order") is not None:
            out["order"] = self._order(query["order"], (*path, "order"), report, members)
        if query.get("filters") is not None:
            out["filters"] = self._filters(query["filters"], (*path, "filters"), report, members)
        return out

    def _members(self, query: dict, path: Path, report: Report, members: dict[str, str]) -> list[str]:
        path = (*path, "members")
        if "members" not in query:
            report(path, "Required")
            return []
        if not isinstance(query["members"], (list, tuple)):
            report(path, f"Expected array, received {kind_of(query['members'])}")
            return []
        if not query["members"]:
            report(path, "Array must contain at least 1 element(s)")
        for i, m in enumerate(query["members"]):
            self._known(m, (*path, i), report, members)
        return list(query["members"])

    def _known(self, m: Any, path: Path, report: Report, members: dict[str, str]) -> None:
        if not isinstance(m, str):
            report(path, f"Expected string, received {kind_of(m)}")
        elif m not in members:
            report(path, NOT_FOUND)

    def _order(self, order: Any, path: Path, report: Report, members: dict[str, str]) -> list[dict]:
        if not isinstance(order, (list, tuple)):
            report(path, f"Expected array, received {kind_of(order)}")
            return []
        for i, o in enumerate(order):
            if not isinstance(o, dict):
                report((*path, i), f"Expected object, received {kind_of(o)}")
                continue
            self._known(o.get("member"), (*path, i, "member"), report, members)
            if o.get("direction") not in ("asc", "desc"):
                report((*path, i, "direction"), f"Invalid enum value. Expected 'asc' | 'desc', received '{o.get('direction')}'")
        return [dict(o) for o in order if isinstance(o, dict)]

    def _filters(self, filters: Any, path: Path, report: Report, members: dict[str, str]) -> list[dict]:
        if not isinstance(filters, (list, tuple)):
            report(path, f"Expected array, received {kind_of(filters)}")
            return []
        out = []
        for i, f in enumerate(filters):
            at = (*path, i)
            if not isinstance(f, dict):
                report(at, f"Expected object, received {kind_of(f)}")
            elif f.get("operator") in ("and", "or"):
                inner = self._filters(f.get("filters"), (*at, "filters"), report, members)
                if isinstance(f.get("filters"), (list, tuple)):
                    if not f["filters"]:
                        report((*at, "filters"), "Array must contain at least 1 element(s)")
                    if len({members[x["member"]] for x in leaves(inner) if x.get("member") in members}) > 1:
                        report((*at, "filters"), MIXED)
                out.append({"operator": f["operator"], "filters": inner})
            elif not isinstance(f.get("operator"), str) or f["operator"] not in self.repository.filters:
                names = ["and", "or", *(x.name for x in self.repository.filters)]
                report((*at, "operator"), "Invalid discriminator value. Expected " + " | ".join(f"'{n}'" for n in names))
            else:
                out.append(self._leaf(f, at, report, members))
        return out

    def _leaf(self, f: dict, at: Path, report: Report, members: dict[str, str]) -> dict:
        self._known(f.get("member"), (*at, "member"), report, members)
        values = self.repository.filters[f["operator"]].values
        if values is subquery:
            value = self._query(f.get("value"), (*at, "value"), report, members)
            if len(value.get("members", ())) > 1:
                report((*at, "value", "members"), "A sub-query must have one member")
        else:
            value = values.parse(f.get("value"), (*at, "value"), report)
        return {"operator": f["operator"], "member": f.get("member"), "value": value}

    def json_schema(self) -> dict:
        """JSON schema of queries, for tools and forms."""
        member = {"type": "string", "enum": list(self.members)}
        each = []
        for name in ("and", "or"):
            each.append({"type": "object", "description": f"All filters inside joined by {name}.", "properties": {"operator": {"const": name}, "filters": {"$ref": "#/$defs/filters", "minItems": 1}}, "required": ["operator", "filters"]})
        for f in self.repository.filters:
            shape: dict[str, Any] = {"operator": {"const": f.name}, "member": {"$ref": "#/$defs/member"}}
            if f.values.json:
                shape["value"] = f.values.json
            each.append({"type": "object", "description": f.description, "properties": shape, "required": list(shape)})
        count = {"type": "integer", "minimum": 0}
        return {
            "$schema": "https://json-schema.org/draft/2020-12/schema",
            "type": "object",
            "properties": {
                "members": {"type": "array", "items": {"$ref": "#/$defs/member"}, "minItems": 1},
                "limit": count,
                "offset": count,
                "order": {"type": "array", "items": {"type": "object", "properties": {"member": {"$ref": "#/$defs/member"}, "direction": {"enum": ["asc", "desc"]}}, "required": ["member", "direction"]}},
                "filters": {"$ref": "#/$defs/filters"},
            },
            "required": ["members"],
            "$defs": {"member": member, "filters": {"type": "array", "description": "Filters joined by and; they nest by and and or.", "items": {"anyOf": each}}},
        }
