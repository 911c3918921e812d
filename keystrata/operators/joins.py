"""Lookup joins: inner or left, each from the driver table to at most one remote row.

A remote key is unique, so the join is a plain equi-join and Catalyst picks its strategy. Another remote
field first keeps the row with the least key of each value, in one partial aggregate."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import quoted, value_of
from ..plans.table import Table
from ..plans.types import RequestError


@dataclass(frozen=True)
class JoinSpec:
    remote: Table
    local: str
    on: str
    as_: str
    kind: str = "inner"
    fields: tuple[str, ...] | None = None


def check_joins(table: Table, joins: Sequence[JoinSpec]) -> None:
    seen = {table.name}
    for j in joins:
        if j.as_ in seen:
            raise RequestError(f"join alias {j.as_} is taken")
        seen.add(j.as_)
        if value_of(table.schema, j.local) is None:
            raise RequestError(f"join: unknown local field {j.local}")
        if j.on != j.remote.key:
            if value_of(j.remote.schema, j.on) is None:
                raise RequestError(f"join: unknown remote field {j.on}")
            if j.on not in j.remote.schema.indexes:
                raise RequestError(f"join: remote field {j.on} is neither the key nor indexed")
        for f in j.fields or ():
            if "+" in f:
                raise RequestError("join: composite fields can't be projected")
            if j.remote.schema.find(f) is None:
                raise RequestError(f"join: unknown field {f} of {j.remote.name}")


def _lookup(j: JoinSpec, n: int) -> tuple[DataFrame, list[str]]:
    """The remote side with columns named by place, so that nothing clashes, and one row a value."""
    wanted = list(j.fields) if j.fields is not None else [f.name for f in j.remote.schema.live() if f.name != j.remote.key]
    columns = [value_of(j.remote.schema, j.on).alias(f"_j{n}_on"), *(quoted(f).alias(f"_j{n}_{i}") for i, f in enumerate(wanted))]
    right = j.remote.data.select(*columns, *([quoted(j.remote.key).alias(f"_j{n}_key")] if j.remote.key else []))
    if j.on != j.remote.key:
        others = [c for c in right.columns if c != f"_j{n}_on"]
        order = f"_j{n}_key" if j.remote.key else others[0]
        right = right.groupBy(f"_j{n}_on").agg(F.min_by(F.struct(*others), order).alias("_row")).select(f"_j{n}_on", "_row.*")
    return right.drop(f"_j{n}_key"), wanted


def apply_joins(table: Table, df: DataFrame, joins: Sequence[JoinSpec], fields: list[str] | None, page: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Driver columns as ``object.field``, remote ones as ``as.field``. Left joins never drop a driver
    row, so when all are left the page is cut before them."""
    check_joins(table, joins)
    early = all(j.kind == "left" for j in joins)
    if early:
        df = page(df)
    out: list = []
    if table.key:
        out.append(quoted(table.key).alias(f"{table.name}.key"))
    for f in fields if fields is not None else [f.name for f in table.schema.live() if f.name != table.key]:
        if f not in ("key", table.key):
            value = value_of(table.schema, f)
            out.append((value if value is not None else F.lit(None).cast("string")).alias(f"{table.name}.{f}"))
    for n, j in enumerate(joins):
        right, wanted = _lookup(j, n)
        local = value_of(table.schema, j.local)
        f = table.schema.find(j.local)
        if f is not None and f.kind == "varchar":
            local = F.when(local != "", local)  # an empty value never joins
        df = df.join(right, local == F.col(f"_j{n}_on"), "left" if j.kind == "left" else "inner")
        out += [F.col(f"_j{n}_{i}").alias(f"{j.as_}.{x}") for i, x in enumerate(wanted)]
    if not early:
        df = page(df)
    return df.select(*out)
