"""aggregate: count, sum, avg, min and max with group-by, having, order and limit.

Always Spark's partial and final hash aggregation; decimals are summed exactly."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import criteria as C
from ..plans.compile import check_having, compile_criteria, quoted, value_of
from ..plans.table import Table, adapt
from ..plans.types import NUMBERS, TIMES, RequestError
from .find import ALL, limited, names, where

FUNCTIONS = ("count", "sum", "avg", "min", "max")
MAX_SPECS = 32


@dataclass(frozen=True)
class AggSpec:
    fn: str
    field: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or (f"{self.fn}_{self.field}" if self.field else self.fn)


def parse_specs(items: Any) -> list[AggSpec]:
    """``{"fn", "field", "alias"}`` objects, or ``fn(field) [as alias]`` texts."""
    out = []
    for x in items or [{"fn": "count"}]:
        if isinstance(x, str):
            call, _, alias = x.partition(" as ")
            fn, _, field = call.strip().rstrip(")").partition("(")
            x = {"fn": fn.strip(), "field": field.strip() or None, "alias": alias.strip() or None}
        fn = x.get("fn") or x.get("func")
        if fn not in FUNCTIONS:
            raise RequestError(f"unknown aggregate function: {fn}")
        field = x.get("field") or None
        if field == "*":
            field = None
        if field is None and fn != "count":
            raise RequestError(f"{fn} needs a field")
        out.append(AggSpec(fn, field, x.get("alias") or x.get("as")))
    if len(out) > MAX_SPECS:
        raise RequestError(f"more than {MAX_SPECS} aggregates")
    if len({s.name for s in out}) < len(out):
        raise RequestError("two aggregates have one name")
    return out


def _expression(table: Table, s: AggSpec, zero_is_absent: bool) -> Column:
    if s.field is None:
        return F.count(F.lit(1))
    f = table.schema.find(s.field)
    if f is None:
        parts = table.schema.parts(s.field)
        if parts is None:
            raise RequestError(f"unknown field: {s.field}")
        c = value_of(table.schema, s.field)
        if s.fn == "count":
            return F.count(F.when(c != "", F.lit(1)))
        return getattr(F, s.fn)(c.try_cast("double"))
    c = quoted(f.name)
    if s.fn == "count":
        return F.count(F.when(c != "", F.lit(1))) if f.kind == "varchar" else F.count(c)
    if s.fn in ("sum", "avg"):
        if f.kind in TIMES:
            raise RequestError(f"{s.fn} of a {f.kind}")
        if f.kind == "varchar":
            c = c.try_cast("double")
        elif f.kind == "bool":
            c = c.cast("int")
    if zero_is_absent and f.kind in NUMBERS and f.kind != "numeric":
        c = F.nullif(c, F.lit(0).cast(f.spark_type))
    out = getattr(F, s.fn)(c)
    return out.cast("double") if f.kind == "numeric" and s.fn in ("sum", "avg") else out


def aggregate(
    table: Table,
    specs: Any = None,
    group_by: Any = None,
    criteria: Any = None,
    having: Any = None,
    order_by: str | Sequence[str] | None = None,
    order: str = "asc",
    limit: int | None = None,
    zero_is_absent: bool = False,
    lenient: bool = False,
) -> DataFrame:
    """A row for each group that passes ``having``: every one, unless a limit is given."""
    specs = [s if isinstance(s, AggSpec) else parse_specs([s])[0] for s in specs or [{"fn": "count"}]]
    parse_specs([vars(s) for s in specs])
    groups = names(group_by) or []
    for g in groups:
        if value_of(table.schema, g) is None:
            raise RequestError(f"unknown group_by field: {g}")
    df = where(table, criteria, (), lenient)
    df = df.groupBy(*(value_of(table.schema, g).alias(g) for g in groups)).agg(*(_expression(table, s, zero_is_absent).alias(s.name) for s in specs))
    node = C.parse(having, lenient)
    if node is not None:
        result = adapt(df, table.name)
        check_having(node, dict.fromkeys(df.columns))
        df = df.where(compile_criteria(node, result.schema, lenient))
    by = names(order_by) or []
    for x in by:
        if x not in df.columns:
            raise RequestError(f"order_by names neither a group field nor an aggregate: {x}")
    down = str(order).lower() == "desc"
    if groups:
        columns = [quoted(x).desc_nulls_last() if down else quoted(x).asc_nulls_first() for x in by]
        df = limited(df.orderBy(*columns, *(quoted(g).asc_nulls_first() for g in groups if g not in by)), limit, ALL)
    return df
