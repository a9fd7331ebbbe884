"""JSON filters compiled to columns.

Logic is two-valued: each leaf is true or false, a missing field makes every
leaf but ``ne`` false.  Types are strict: numbers compare with numbers (integers
exactly), strings with strings in byte order; nothing is coerced.

A field is resolved to a typed column where one is given (then the predicate can
be pushed into the scan), else to a path in a variant column.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("eq", "ne", "in", "lt", "lte", "gt", "gte", "exists", "and", "or", "not")


class FilterError(ValueError):
    """A filter is malformed."""


def _number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


class Typed:
    """A payload field held as a column of type string, number or boolean; SQL NULL means missing."""

    def __init__(self, column: Column, kind: str):
        self.column, self.kind = column, kind

    def exists(self) -> Column:
        return self.column.isNotNull()

    def eq(self, value: Any) -> Column:
        fits = {"string": isinstance(value, str), "number": _number(value), "boolean": isinstance(value, bool)}[self.kind]
        return self.column == F.lit(value) if fits else F.lit(False)

    def compare(self, op: str, value: Any) -> Column:
        fits = self.kind == "string" and isinstance(value, str) or self.kind == "number" and _number(value)
        return _ORDER[op](self.column, F.lit(value)) if fits else F.lit(False)


_ORDER = {"lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}


class InVariant:
    """A dotted path of object keys in a variant column; JSON null is present, an absent key is missing."""

    def __init__(self, payload: Column, path: str):
        steps = "".join('["' + p.replace("\\", "\\\\").replace('"', '\\"') + '"]' for p in path.split("."))
        self.value = F.try_variant_get(payload, "$" + steps, "variant")
        kind = F.schema_of_variant(self.value)
        self.is_int = kind.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$")
        self.is_number = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
        self.is_string, self.is_bool = kind == "STRING", kind == "BOOLEAN"

    def _as(self, kind: str) -> Column:
        return F.try_variant_get(self.value, "$", kind)

    def _typed(self, value: Any, test) -> Column:
        """``test`` of the field and a number or string, where the types agree."""
        if isinstance(value, str):
            return F.when(self.is_string, test(self._as("string"), F.lit(value)))
        if isinstance(value, int):
            exact = test(self._as("decimal(38,0)"), F.lit(str(value)).cast("decimal(38,0)"))
            return F.when(self.is_int, exact).when(self.is_number, test(self._as("double"), F.lit(float(value))))
        return F.when(self.is_number, test(self._as("double"), F.lit(float(value))))

    def exists(self) -> Column:
        return self.value.isNotNull()

    def eq(self, value: Any) -> Column:
        if value is None:
            found = F.is_variant_null(self.value)
        elif isinstance(value, bool):
            found = F.when(self.is_bool, self._as("boolean") == F.lit(value))
        elif isinstance(value, (list, dict)):
            found = same_json(self.value, value)
        else:
            found = self._typed(value, lambda a, b: a == b)
        return F.coalesce(found, F.lit(False))

    def compare(self, op: str, value: Any) -> Column:
        if not (_number(value) or isinstance(value, str)):
            return F.lit(False)
        return F.coalesce(self._typed(value, _ORDER[op]), F.lit(False))


def same_json(x: Column, value: Any) -> Column:
    """Whether a variant equals a JSON value member by member; inside a structure an integer and a float are different."""
    kind, part = F.schema_of_variant(x), lambda t: F.try_variant_get(x, "$", t)
    if value is None:
        return F.coalesce(F.is_variant_null(x), F.lit(False))
    if isinstance(value, bool):
        return F.coalesce(part("boolean") == F.lit(value), F.lit(False)) & (kind == "BOOLEAN")
    if isinstance(value, str):
        return F.coalesce(part("string") == F.lit(value), F.lit(False)) & (kind == "STRING")
    if isinstance(value, int):
        whole = kind.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$")
        return whole & F.coalesce(part("decimal(38,0)") == F.lit(str(value)).cast("decimal(38,0)"), F.lit(False))
    if isinstance(value, float):
        return kind.rlike(r"^(DOUBLE|FLOAT|DECIMAL\(\d+,[1-9]\d*\))$") & F.coalesce(part("double") == F.lit(value), F.lit(False))
    if isinstance(value, list):
        items, shape = part("array<variant>"), "^ARRAY"
        parts = [same_json(F.get(items, F.lit(i)), v) for i, v in enumerate(value)]
    else:
        items, shape = part("map<string,variant>"), "^OBJECT"
        parts = [same_json(F.try_element_at(items, F.lit(k)), v) for k, v in value.items()]
    same = kind.rlike(shape) & F.coalesce(F.size(items) == len(value), F.lit(False))
    return F.coalesce(reduce(lambda a, b: a & b, parts, same), F.lit(False))


def kind_of(sql_type: str) -> str | None:
    if sql_type == "string":
        return "string"
    if sql_type == "boolean":
        return "boolean"
    return "number" if sql_type in ("tinyint", "smallint", "int", "bigint", "float", "double") or sql_type.startswith("decimal") else None


def columns_of(dtypes: list[tuple[str, str]]) -> dict[str, Typed]:
    """Every scalar column of a frame as a payload field of its own name."""
    return {c: Typed(F.col(f"`{c}`"), k) for c, t in dtypes if (k := kind_of(t))}


def compile_filter(tree: Mapping | str | bytes | None, fields: Mapping[str, Typed] | None = None, payload: Column | None = None) -> Column:
    """A condition for ``where``, in which null counts as false. ``fields``: typed columns by path; ``payload``: a variant for all others.

    Leaves over typed columns stay bare, so that the scan can take them; a negation makes its operand two-valued first.
    """
    if isinstance(tree, (str, bytes)):
        try:
            tree = json.loads(tree)
        except ValueError as e:
            raise FilterError(f"not JSON: {e}") from None
    if tree is None:
        return F.lit(True)
    fields = fields or {}

    def field(path: Any):
        if not isinstance(path, str):
            raise FilterError("field is a string")
        if path in fields:
            return fields[path]
        return InVariant(payload, path) if payload is not None else None

    def node(t: Any) -> Column:
        if not isinstance(t, Mapping) or len(t) != 1:
            raise FilterError("a filter node is an object with one operator")
        (op, body), = t.items()
        if op in ("and", "or"):
            if not isinstance(body, list):
                raise FilterError(f"{op} takes a list")
            parts = [node(x) for x in body]
            return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts) if parts else F.lit(op == "and")
        if op == "not":
            return ~F.coalesce(node(body), F.lit(False))
        if op not in OPERATORS or not isinstance(body, Mapping) or "field" not in body:
            raise FilterError(f"unknown or malformed operator {op!r}")
        x = field(body["field"])
        if op == "exists":
            return x.exists() if x else F.lit(False)
        if op == "in":
            if not isinstance(body.get("values"), list):
                raise FilterError("in takes a list of values")
            values = body["values"]
            if isinstance(x, Typed) and values:
                fit = [v for v in values if (isinstance(v, str) if x.kind == "string" else isinstance(v, bool) if x.kind == "boolean" else _number(v))]
                return x.column.isin(*fit) if fit else F.lit(False)
            return reduce(lambda a, b: a | b, [x.eq(v) for v in values]) if x and values else F.lit(False)
        if "value" not in body:
            raise FilterError(f"{op} takes a value")
        if op in ("eq", "ne"):
            found = x.eq(body["value"]) if x else F.lit(False)
            return ~F.coalesce(found, F.lit(False)) if op == "ne" else found
        return x.compare(op, body["value"]) if x else F.lit(False)

    return node(tree)


def constrained_fields(tree: Mapping) -> set[str] | None:
    """Fields whose typed columns narrow the candidates; None if nothing does (not, ne and exists never do)."""
    (op, body), = tree.items()
    if op == "and":
        found = [x for t in body if (x := constrained_fields(t)) is not None]
        return set().union(*found) if found else None
    if op == "or":
        found = [constrained_fields(t) for t in body]
        return set().union(*found) if found and None not in found else None
    return {body["field"]} if op in ("eq", "in", "lt", "lte", "gt", "gte") else None


#: Bounds as a double column may see them: rounding to double keeps order but not strictness.
_LOOSE = {"lt": "lte", "gt": "gte", "lte": "lte", "gte": "gte"}


def narrowing(tree: Mapping | str | bytes | None, fields: Mapping[str, Typed]) -> Column | None:
    """A condition on typed columns that every row of ``tree`` satisfies, for the scan; None if there is none.

    A typed column holds the values of one type only and numbers as doubles, so it
    never decides: the exact filter follows on what is left.
    """
    if isinstance(tree, (str, bytes)):
        tree = json.loads(tree)
    if not isinstance(tree, Mapping) or len(tree) != 1:
        return None
    (op, body), = tree.items()
    if op in ("and", "or"):
        parts = [narrowing(t, fields) for t in body]
        if op == "and":
            parts = [x for x in parts if x is not None]
            return reduce(lambda a, b: a & b, parts) if parts else None
        return reduce(lambda a, b: a | b, parts) if parts and all(x is not None for x in parts) else None
    x = fields.get(body["field"]) if op in ("eq", "in", "lt", "lte", "gt", "gte") and isinstance(body, Mapping) and isinstance(body.get("field"), str) else None
    if x is None:
        return None
    values = body.get("values", []) if op == "in" else [body.get("value")]
    if not all(isinstance(v, str) if x.kind == "string" else _number(v) for v in values):
        return None
    values = [float(v) if x.kind == "number" else v for v in values]
    if op in ("eq", "in"):
        return x.column.isin(*values) if values else F.lit(False)
    return _ORDER[_LOOSE[op]](x.column, F.lit(values[0]))
