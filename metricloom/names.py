"""Paths (``model.member``), result columns (``model___member``) and quoting."""

from __future__ import annotations

import re

_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")

#: Qualifier of the sub-query that brings the values of referenced metrics.
SUBQUERY = "__mrs__"


def path_to_alias(path: str) -> str:
    return path.replace(".", "___")


def alias_to_path(alias: str) -> str:
    return alias.replace("___", ".")


def check_name(name: str) -> str:
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise ValueError(f"invalid model name {name!r}: letters, digits and underscores, not starting with a digit")
    return name


def quoted(*parts: str) -> str:
    """Parts as one column reference; ``*`` stays as it is."""
    return ".".join(p if p == "*" else "`" + p.replace("`", "``") + "`" for p in parts)
