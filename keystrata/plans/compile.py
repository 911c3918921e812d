"""Criteria to Spark columns.

Everything becomes built-in expressions over bare columns, so comparisons, prefixes, IN lists and
null checks reach the Parquet scan. Absence is folded in at compile time: a leaf that would accept the type's
zero value becomes ``predicate OR column IS NULL``."""

from __future__ import annotations

import datetime as dt
import operator as py
import re
from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, ascii_lower, search_pattern
from .criteria import All, Leaf, Node
from .types import INTEGERS, NUMBERS, TIMES, Field, RequestError, Schema

COMPARE: dict[str, Callable] = {"eq": py.eq, "neq": py.ne, "lt": py.lt, "gt": py.gt, "lte": py.le, "gte": py.ge}
_NEGATIVE = {"not_like": "like", "not_contains": "contains", "not_in": "in", "not_ilike": "ilike", "not_icontains": "icontains", "not_regex": "regex"}
_FOLDED = {"ilike": "like", "icontains": "contains", "istarts_with": "starts_with", "iends_with": "ends_with"}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def const(value: Any) -> Column:
    return F.lit(value).cast("timestamp_ntz") if isinstance(value, dt.datetime) else F.lit(value)


def as_text(f: Field) -> Column:
    """A field as the text that composite names join; absent parts are skipped there."""
    c = quoted(f.name)
    if f.kind == "varchar":
        return c
    if f.kind == "date":
        return F.date_format(c, "yyyyMMdd")
    if f.kind == "datetime":
        return F.date_format(c, "yyyyMMddHHmmss")
    return c.cast("string")


def value_of(schema: Schema, name: str) -> Column | None:
    """A field or a composite of fields (joined without a separator); None if there is no such thing."""
    f = schema.find(name)
    if f is not None:
        return quoted(name)
    parts = schema.parts(name)
    return F.concat_ws("", *(as_text(p) for p in parts)) if parts else None


def compile_criteria(node: Node | None, schema: Schema, lenient: bool = False) -> Column:
    if node is None:
        return F.lit(True)
    if isinstance(node, Leaf):
        return _leaf(node, schema, lenient)
    return reduce(py.and_ if isinstance(node, All) else py.or_, (compile_criteria(x, schema, lenient) for x in node.children))


def _with_absence(c: Column, predicate: Column, accepts_zero: bool) -> Column:
    return predicate | c.isNull() if accepts_zero else predicate


def _leaf(leaf: Leaf, schema: Schema, lenient: bool) -> Column:
    if leaf.op.endswith("_field"):
        return _between_fields(leaf, schema)
    f = schema.find(leaf.field)
    if f is None:
        parts = schema.parts(leaf.field)
        if parts:
            return text_leaf(F.concat_ws("", *(as_text(p) for p in parts)), leaf)
        return F.lit(leaf.op == "not_exists")
    if leaf.op in ("exists", "not_exists"):
        return _presence(f, leaf.op)
    if f.kind == "varchar":
        return _varchar(quoted(f.name), leaf)
    return _typed(f, leaf, lenient)


def _presence(f: Field, op: str) -> Column:
    c = quoted(f.name)
    if f.kind == "varchar":
        return c.isNotNull() & (c != "") if op == "exists" else c.isNull() | (c == "")
    if f.kind in TIMES:
        return c.isNotNull() if op == "exists" else c.isNull()
    return F.lit(op == "exists")


def like_shape(pattern: str) -> tuple[str, str]:
    """Wildcards count at the ends only; one in front means anywhere."""
    if pattern.startswith("%"):
        return "contains", pattern[1:].removesuffix("%")
    return ("starts_with", pattern[:-1]) if pattern.endswith("%") else ("eq", pattern)


_TEXT: dict[str, tuple[Callable[[Column, str], Column], Callable[[str, str], bool]]] = {
    "eq": (lambda c, v: c == v, py.eq),
    "contains": (lambda c, v: c.contains(v), lambda s, v: v in s),
    "starts_with": (lambda c, v: c.startswith(v), str.startswith),
    "ends_with": (lambda c, v: c.endswith(v), str.endswith),
}


def _varchar(c: Column, leaf: Leaf) -> Column:
    """A leaf over text; ``c`` may be any text expression."""
    op = leaf.op
    value = "" if leaf.value is None else str(leaf.value)
    if op.startswith("len_"):
        n = F.octet_length(c)
        if op == "len_between":
            low, high = int(leaf.value), int(leaf.value2)
            return _with_absence(c, n.between(low, high), low <= 0 <= high)
        compare, want = COMPARE[op[4:]], int(leaf.value)
        return _with_absence(c, compare(n, F.lit(want)), compare(0, want))
    negative = op in _NEGATIVE
    op = _NEGATIVE.get(op, op)
    if op in COMPARE:
        return _with_absence(c, COMPARE[op](c, F.lit(value)), COMPARE[op](b"", value.encode()))
    if op == "between":
        low, high = value, "" if leaf.value2 is None else str(leaf.value2)
        return _with_absence(c, c.between(low, high), low == "")
    if op == "in":
        values = [str(v) for v in leaf.listed()]
        positive, zero = (c.isin(values) if values else F.lit(False)), "" in values
    elif op == "regex":
        java = search_pattern(value)
        if java is None:  # a bad pattern matches nothing, its negation everything
            return F.lit(negative)
        positive = c.rlike(java)
        zero = _empty_matches(java)
    else:
        if op in _FOLDED:
            op, c_used, value = _FOLDED[op], ascii_lower(c), ascii_fold(value)
        else:
            c_used = c
            if op == "like":
                value = value.replace("*", "%")
        if op == "like":
            op, value = like_shape(value)
        emit, test = _TEXT[op]
        positive, zero = emit(c_used, value), test("", value)
    return _with_absence(c, ~positive, not zero) if negative else _with_absence(c, positive, zero)


def _empty_matches(java: str) -> bool:
    session = SparkSession.getActiveSession()
    if session is not None:
        return bool(session._jvm.java.util.regex.Pattern.compile(java).matcher("").find())
    try:
        return re.search(java.replace(r"\z", r"\Z"), "") is not None
    except re.error:
        return False


def _typed(f: Field, leaf: Leaf, lenient: bool) -> Column:
    """A leaf over a number, a bool or a time."""
    c, op = quoted(f.name), leaf.op
    read = lambda v: f.literal(v, lenient)
    if op in COMPARE:
        v = read(leaf.value)
        if v is None:
            return F.lit(False)
        zero = f.zero is not None and COMPARE[op](f.zero, v)
        if f.kind == "bool" and op in ("eq", "neq"):  # one equality, so that it can be pushed
            return _with_absence(c, c == F.lit(v if op == "eq" else not v), zero)
        return _with_absence(c, COMPARE[op](c, const(v)), zero)
    if op == "between":
        low, high = read(leaf.value), read(leaf.value2)
        return _with_absence(c, (c >= const(low)) & (c <= const(high)), f.zero is not None and low <= f.zero <= high)
    if op in ("in", "not_in"):
        values = [read(v) for v in leaf.listed()]
        hit = c.isin([const(v) for v in values]) if values else F.lit(False)
        zero = f.zero is not None and f.zero in values
        if op == "in":
            return _with_absence(c, hit, zero)
        return _with_absence(c, ~hit, f.zero is not None and not zero)
    return F.lit(False)  # text operators never match other types


def _between_fields(leaf: Leaf, schema: Schema) -> Column:
    a, b = schema.find(leaf.field), schema.find(str(leaf.value))
    if a is None or b is None or a.kind != b.kind or (a.kind == "numeric" and a.scale != b.scale):
        return F.lit(False)
    x, y, op = quoted(a.name), quoted(b.name), leaf.op.removesuffix("_field")
    if a.kind in TIMES:
        low = F.lit("0001-01-01").cast(a.spark_type)  # before any other day
        x, y = (F.coalesce(z, low) for z in (x, y))
    else:
        x, y = (F.coalesce(z, F.lit(a.zero)) for z in (x, y))
    return COMPARE[op](x, y)


_NUMBER = r"^-?[0-9]*\.?[0-9]*$"


def text_leaf(c: Column, leaf: Leaf) -> Column:
    """The text comparison of composite fields and conditional writes: ordered as numbers when both sides
    look like numbers, else by bytes; equality is always of the text."""
    value = "" if leaf.value is None else str(leaf.value)
    if leaf.op in ("exists", "not_exists"):
        here = c.isNotNull() & (c != "")
        return here if leaf.op == "exists" else ~here
    if leaf.op in ("lt", "gt", "lte", "gte", "between"):

        def side(op: str, v: str) -> Column:
            number = float(v) if re.fullmatch(r"-?\d*\.?\d*", v) and re.search(r"\d", v) else None
            by_text = COMPARE[op](c, F.lit(v))
            if number is None:
                return by_text
            as_number = F.when(c.rlike(_NUMBER) & c.rlike("[0-9]"), c.try_cast("double"))
            return F.when(as_number.isNotNull(), COMPARE[op](as_number, F.lit(number))).otherwise(by_text)

        out = side("gte", value) & side("lte", str(leaf.value2)) if leaf.op == "between" else side(leaf.op, value)
        return F.coalesce(out, F.lit(False))
    return _varchar(c, leaf)


def text_of(value: Any, f: Field | None = None) -> str:
    """A stored value as text, as conditions and composites see it."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dt.datetime):
        return value.strftime("%Y%m%d%H%M%S")
    if isinstance(value, dt.date):
        return value.strftime("%Y%m%d")
    if isinstance(value, float):
        return f"{value:g}"
    if isinstance(value, Decimal):
        return str(value.normalize()) if value else "0"
    return str(value)


def check_having(node: Node | None, columns: dict[str, Any]) -> None:
    if node is None:
        return
    if isinstance(node, Leaf):
        if node.field not in columns:
            raise RequestError(f"having names an unknown column: {node.field}")
    else:
        for x in node.children:
            check_having(x, columns)


__all__ = ["COMPARE", "INTEGERS", "NUMBERS", "as_text", "check_having", "compile_criteria", "const", "like_shape", "quoted", "text_leaf", "text_of", "value_of"]
