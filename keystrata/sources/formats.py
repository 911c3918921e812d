"""Results out: JSON records, dict, rows and CSV. Only results that go to a client are collected."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..plans.types import RequestError

FORMATS = ("json", "rows", "dict", "csv")


def plain(v: Any) -> Any:
    """A value for JSON."""
    if isinstance(v, dt.datetime):
        return v.strftime("%Y%m%d%H%M%S")
    if isinstance(v, dt.date):
        return v.strftime("%Y%m%d")
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
        return int(v)
    return v


def record(row: Row, key: str | None) -> dict:
    """Fields without the absent ones, as records are shown."""
    return {k: plain(v) for k, v in row.asDict().items() if k != key and v is not None and v != ""}


def to_records(df: DataFrame, key: str) -> list[dict]:
    return [{"key": plain(r[key]), "value": record(r, key)} for r in df.toLocalIterator()]


def to_dict(df: DataFrame, key: str) -> dict:
    return {str(plain(r[key])): record(r, key) for r in df.toLocalIterator()}


def to_rows(df: DataFrame) -> dict:
    return {"columns": df.columns, "rows": [[plain(v) for v in r] for r in df.toLocalIterator()]}


def delimiter_of(text: str | None) -> str:
    if text in (None, ""):
        return ","
    return "\t" if text == "\\t" else text if len(text) == 1 else ","


def cell(v: Any, delimiter: str) -> str:
    v = plain(v)
    s = "" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)
    s = s.replace("\r\n", " ").replace("\n", " ").replace("\r", " ")
    return '"' + s.replace('"', '""') + '"' if delimiter in s or '"' in s else s


def csv_lines(columns: Iterable[str], rows: Iterable[Iterable[Any]], delimiter: str = ",") -> str:
    lines = [delimiter.join(cell(c, delimiter) for c in columns)]
    lines += [delimiter.join(cell(v, delimiter) for v in r) for r in rows]
    return "\n".join(lines) + "\n"


def to_csv(df: DataFrame, delimiter: str = ",") -> str:
    return csv_lines(df.columns, df.toLocalIterator(), delimiter)


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """The same cells as files written by the executors, for results of any size."""
    text = [F.regexp_replace(F.col(f"`{c}`").cast("string"), r"\r\n|[\r\n]", " ").alias(c) for c in df.columns]
    df.select(*text).write.option("header", True).option("sep", delimiter).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, key: str) -> None:
    """One ``{"key", "value"}`` object a line, written by the executors."""
    df.select(F.to_json(F.struct(F.col(f"`{key}`").alias("key"), F.struct(*(f"`{c}`" for c in df.columns if c != key)).alias("value")))).write.text(path)


def render(df: DataFrame, key: str | None, form: str | None = None, delimiter: str | None = None) -> Any:
    form = form or "json"
    if form not in FORMATS:
        raise RequestError(f"unknown format: {form}")
    if form == "csv":
        return to_csv(df, delimiter_of(delimiter))
    if form == "rows" or key is None:
        return to_rows(df)
    made: Callable = to_dict if form == "dict" else to_records
    return made(df, key)
