"""find, count, fetch, keys, get and exists as DataFrame plans."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import criteria as C
from ..plans.compile import compile_criteria, const, quoted, value_of
from ..plans.table import Table
from ..plans.types import RequestError
from .joins import JoinSpec, apply_joins

GLOBAL_LIMIT = 100_000
#: Excluded keys beyond this number are anti-joined instead of listed in the filter.
EXCLUDED_IN_FILTER = 200
#: As a limit: every row, sorted only if asked; a result that stays distributed.
ALL = "all"
#: Pages up to this many rows are a top-k; larger ones are sorted in parallel and then cut.
TOP_K = 1_000_000


def names(fields: str | Iterable[str] | None) -> list[str] | None:
    if fields is None or fields == "":
        return None
    return [x.strip() for x in fields.split(",")] if isinstance(fields, str) else list(fields)


def where(table: Table, criteria: Any = None, excluded: Sequence[Any] = (), lenient: bool = False) -> DataFrame:
    node = C.parse(criteria, lenient) if not isinstance(criteria, (C.Leaf, C.All, C.Any_)) else criteria
    df = table.data if node is None else table.data.where(compile_criteria(node, table.schema, lenient))
    excluded = names(excluded) if isinstance(excluded, str) else list(excluded or ())
    if not excluded:
        return df
    key = quoted(_key(table))
    if len(excluded) <= EXCLUDED_IN_FILTER:
        return df.where(~key.isin(excluded))
    listed = df.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(excluded)], df.select(key.alias("_excluded")).schema)
    return df.join(listed, key == F.col("_excluded"), "left_anti")


def _key(table: Table) -> str:
    if table.key is None:
        raise RequestError(f"{table.name} has no key")
    return table.key


def project(table: Table, df: DataFrame, fields: str | Iterable[str] | None, key: bool = True) -> DataFrame:
    """The key and the named fields; composites are joined, unknown names are null."""
    wanted = names(fields)
    if wanted is None:
        wanted = [f.name for f in table.schema.live() if f.name != table.key]
    columns = [quoted(table.key)] if key and table.key else []
    for x in wanted:
        if x == table.key and key:
            continue
        value = value_of(table.schema, x)
        columns.append((value if value is not None else F.lit(None).cast("string")).alias(x))
    return df.select(*columns)


def page_size(limit: int | str | None, default: int | str = GLOBAL_LIMIT) -> int | str:
    try:
        return int(limit) if limit and int(limit) > 0 else default
    except (TypeError, ValueError):
        raise RequestError(f"limit must be a number: {limit}") from None


def limited(df: DataFrame, limit: int | str | None, default: int | str = GLOBAL_LIMIT) -> DataFrame:
    size = ALL if limit == ALL else page_size(limit, default)
    return df if size == ALL else df.limit(size)


def _order(table: Table, order_by: str | Sequence[str] | None, order: str = "asc") -> list[Column]:
    """Sort columns with the key (or every field, where there is none) as the tie break."""
    by = names(order_by) or []
    out = []
    down = str(order).lower() == "desc"
    for x in by:
        value = value_of(table.schema, x)
        if value is None:
            raise RequestError(f"unknown order_by field: {x}")
        out.append(value.desc_nulls_last() if down else value.asc_nulls_first())
    ties = [table.key] if table.key else [f.name for f in table.schema.live()]
    return out + [quoted(t).desc() if down and by and table.key else quoted(t).asc() for t in ties if t not in by]


def find(
    table: Table,
    criteria: Any = None,
    fields: str | Iterable[str] | None = None,
    offset: int = 0,
    limit: int | None = None,
    excluded: Sequence[Any] = (),
    order_by: str | Sequence[str] | None = None,
    order: str = "asc",
    joins: Sequence[JoinSpec] = (),
    lenient: bool = False,
) -> DataFrame:
    """Filter, join, sort, page, project. Rows come in the key's order unless told otherwise; the limit counts
    rows that are left after filters and inner joins."""
    df = where(table, criteria, excluded, lenient)
    if joins:
        return apply_joins(table, df, joins, names(fields), lambda d: _page(d, _order(table, order_by, order), offset, limit, bool(order_by)))
    return project(table, _page(df, _order(table, order_by, order), offset, limit, bool(order_by)), fields)


def _page(df: DataFrame, order: list[Column], offset: int, limit: int | str | None, sort: bool = True) -> DataFrame:
    if limit == ALL and not offset:
        return df.orderBy(*order) if sort else df
    size = page_size(None if limit == ALL else limit)
    if size > TOP_K:
        df.sparkSession.conf.set("spark.sql.execution.topKSortFallbackThreshold", str(TOP_K))
    df = df.orderBy(*order)
    if offset:
        df = df.offset(int(offset))
    return df if limit == ALL else df.limit(size)


def count(table: Table, criteria: Any = None, lenient: bool = False) -> DataFrame:
    return where(table, criteria, (), lenient).agg(F.count(F.lit(1)).alias("count"))


def cursor_page(
    table: Table, order_by: str, cursor: dict | str | None, limit: int | None, criteria: Any = None, fields: Any = None, order: str = "asc", excluded: Sequence[Any] = (), lenient: bool = False
) -> DataFrame:
    """Rows strictly after the cursor ``{order_by: value, key: key}`` (none: the first page) by (value, key).
    Rows without a value are in no page. The page is a filter and a top-k, whatever its number."""
    _check_cursor(table, order_by)
    f = table.schema.find(order_by)
    c, k = quoted(order_by), quoted(_key(table))
    down = str(order).lower() == "desc"
    df = where(table, criteria, excluded, lenient).where(c.isNotNull())
    if isinstance(cursor, str):
        cursor = json.loads(cursor)
    if cursor:
        if order_by not in cursor or table.key not in cursor:
            raise RequestError(f"cursor must hold {order_by} and {table.key}")
        v, last = const(f.literal(cursor[order_by], lenient)), cursor[table.key]
        after = (c < v) | ((c == v) & (k < last)) if down else (c > v) | ((c == v) & (k > last))
        df = df.where(after)
    df = df.orderBy(c.desc(), k.desc()) if down else df.orderBy(c.asc(), k.asc())
    wanted = names(fields)
    if wanted is not None and order_by not in wanted:
        wanted = [*wanted, order_by]
    return project(table, limited(df, limit), wanted)


def _check_cursor(table: Table, order_by: str | None) -> None:
    if not order_by:
        raise RequestError("cursor requires order_by")
    if table.schema.find(order_by) is None:
        raise RequestError(f"unknown order_by field: {order_by}")
    if order_by not in table.schema.indexes:
        raise RequestError(f"cursor requires an indexed order_by field: {order_by}")


def fetch(table: Table, after: Any = None, limit: int | None = None, fields: Any = None) -> DataFrame:
    """A page of all records in the key's order, after a key."""
    key = quoted(_key(table))
    df = table.data if after in (None, "") else table.data.where(key > F.lit(after))
    return project(table, limited(df.orderBy(key), limit), fields)


def keys(table: Table, offset: int = 0, limit: int | None = None) -> DataFrame:
    key = quoted(_key(table))
    return _page(table.data.select(key), [key.asc()], offset, limit)


def get(table: Table, key: Any, fields: Any = None) -> DataFrame:
    return project(table, table.data.where(quoted(_key(table)) == F.lit(key)).limit(1), fields)


def requested(table: Table, wanted: Sequence[Any]) -> DataFrame:
    """The keys of a request with their places."""
    spark = table.data.sparkSession
    kind = table.data.select(quoted(_key(table)).alias("_wanted")).schema
    return spark.createDataFrame([(x, i) for i, x in enumerate(wanted)], kind.add("_place", T.IntegerType()))


def _some(table: Table, wanted: Sequence[Any]) -> DataFrame:
    key = quoted(_key(table))
    return table.data.where(key.isin(list(wanted))) if 0 < len(wanted) <= EXCLUDED_IN_FILTER else table.data


def get_many(table: Table, wanted: Sequence[Any], fields: Any = None) -> DataFrame:
    """Records by key in the order of the request; a missing one has nulls, and ``_found`` false."""
    key = _key(table)
    data = project(table, _some(table, wanted), fields).withColumn("_found", F.lit(True))
    rows = requested(table, wanted).join(data, F.col("_wanted") == quoted(key), "left").orderBy("_place")
    others = [quoted(c) for c in data.columns if c not in (key, "_found")]
    return rows.select(F.col("_wanted").alias(key), *others, F.coalesce("_found", F.lit(False)).alias("_found"))


def exists_many(table: Table, wanted: Sequence[Any]) -> DataFrame:
    key = _key(table)
    data = _some(table, wanted).select(quoted(key)).distinct()
    rows = requested(table, wanted).join(data, F.col("_wanted") == quoted(key), "left").orderBy("_place")
    return rows.select(F.col("_wanted").alias(key), quoted(key).isNotNull().alias("found"))


def not_exists(table: Table, wanted: Sequence[Any]) -> DataFrame:
    key = _key(table)
    rows = requested(table, wanted).join(_some(table, wanted).select(quoted(key)), F.col("_wanted") == quoted(key), "left_anti")
    return rows.orderBy("_place").select(F.col("_wanted").alias(key))
