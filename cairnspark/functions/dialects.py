"""Two common filter dialects, translated to this package's filters."""

from __future__ import annotations

from typing import Any

from .predicates import FilterError

#: Operator names of the two dialects.
_COMPARE = {"==": "eq", "!=": "ne", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "eq": "eq", "ne": "ne", "gt": "gt", "gte": "gte", "lt": "lt", "lte": "lte"}


def _leaf(field: str, op: str, value: Any) -> dict:
    op = str(op).lower()
    if op in ("in", "not in", "nin"):
        found = {"in": {"field": field, "values": list(value)}}
        return found if op == "in" else {"not": found}
    if op not in _COMPARE:
        raise FilterError(f"operator {op!r} has no translation")
    return {_COMPARE[op]: {"field": field, "value": value}}


def from_conditions(tree: dict) -> dict:
    """``{"operator": "AND", "conditions": [...]}`` with leaves ``{"field", "operator", "value"}``; a ``meta.`` prefix is dropped."""
    if "conditions" in tree:
        parts = [from_conditions(t) for t in tree["conditions"]]
        op = tree["operator"].upper()
        if op == "NOT":
            return {"not": {"and": parts}}
        if op not in ("AND", "OR"):
            raise FilterError(f"operator {op!r} has no translation")
        return {op.lower(): parts}
    return _leaf(tree["field"].removeprefix("meta."), tree["operator"], tree["value"])


def from_metadata_filters(tree: dict) -> dict:
    """``{"condition": "and", "filters": [...]}`` with leaves ``{"key", "operator", "value"}`` (operator: equality if absent)."""
    if "filters" in tree:
        parts, op = [from_metadata_filters(t) for t in tree["filters"]], str(tree.get("condition") or "and").lower()
        if op == "not":
            return {"not": {"and": parts}}
        if op not in ("and", "or"):
            raise FilterError(f"condition {op!r} has no translation")
        return {op: parts}
    return _leaf(tree["key"], tree.get("operator") or "==", tree["value"])
