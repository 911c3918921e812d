"""Records in: inline JSON, JSON files and delimited files, as typed DataFrames of key and fields."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.types import INTEGERS, Field, RequestError


def typed(c: Column, f: Field) -> Column:
    """Text to a field's type in built-in functions; what can't be read is NULL, long text is cut at its bytes."""
    if f.kind == "varchar":
        return F.when(F.octet_length(c) <= f.size, c).otherwise(F.decode(F.substring(F.encode(c, "utf-8"), 1, f.size), "utf-8"))
    t = F.trim(c)
    if f.kind in INTEGERS:
        kind, low, high = INTEGERS[f.kind]
        n = t.try_cast("bigint")
        return F.when(n.between(low, high), n).try_cast(kind)
    if f.kind == "double":
        return t.try_cast("double")
    if f.kind == "numeric":
        return t.try_cast(f.spark_type)
    if f.kind == "bool":
        return F.when(t != "", F.substring(t, 1, 1).isin("t", "T", "1"))
    digits = F.regexp_replace(t, r"[-:/ T.]", "")
    if f.kind == "date":
        return F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd")).cast("date")
    return F.try_to_timestamp(F.rpad(F.substring(digits, 1, 14), 14, "0"), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def text_of_json(v: Any) -> str | None:
    if v is None:
        return None
    return ("true" if v else "false") if isinstance(v, bool) else v if isinstance(v, str) else json.dumps(v)


def pairs(records: Any) -> list[tuple[str, dict]]:
    """(key, value) of the dict and the array form."""
    if isinstance(records, str):
        records = json.loads(records)
    if isinstance(records, dict) and not ("key" in records and isinstance(records.get("value"), dict)):
        return list(records.items())
    out = []
    for x in records if isinstance(records, list) else [records]:
        if not isinstance(x, dict) or "key" not in x or not isinstance(x.get("value"), dict):
            raise RequestError("a record needs key and value")
        out.append((str(x["key"]), x["value"]))
    return out


def inline(spark: SparkSession, records: Any, fields: list[Field]) -> DataFrame:
    """key, fields, and ``_n`` (place in the request) and ``_given`` (names of the fields present)."""
    kind = T.StructType([T.StructField("key", T.StringType()), T.StructField("_n", T.LongType()), T.StructField("_given", T.ArrayType(T.StringType())), *(T.StructField(f"_t{i}", T.StringType()) for i in range(len(fields)))])
    rows = [(k, n, [f.name for f in fields if f.name in v], *(text_of_json(v.get(f.name)) for f in fields)) for n, (k, v) in enumerate(pairs(records))]
    raw = spark.createDataFrame(rows, kind)
    return raw.select("key", "_n", "_given", *(typed(F.col(f"_t{i}"), f).alias(f.name) for i, f in enumerate(fields)))


def json_file(spark: SparkSession, path: str, fields: list[Field]) -> DataFrame:
    """One JSON document in either form, parsed on the executors by one task a file; or, for large loads, files named
    ``.jsonl`` or ``.ndjson`` (or folders of such a name) with a record ``{"key", "value"}`` a line, which are split."""
    value = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    if path.rstrip("/").endswith((".jsonl", ".ndjson")):
        record = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", value)])
        lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_n")).where(F.trim("value") != "")
        return _records(lines.select("_n", F.from_json("value", record).alias("r")).select("_n", "r.key", "r.value"), fields)
    text = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", value)])))
    as_dict = F.from_json("value", T.MapType(T.StringType(), value))
    is_list = F.ltrim(F.col("value"), F.lit(" \t\r\n")).startswith("[")
    entries = F.when(is_list, as_list).otherwise(F.transform(F.map_entries(as_dict), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return _records(text.select(F.posexplode(entries).alias("_n", "r")).select(F.col("_n").cast("long"), "r.key", "r.value"), fields)


def _records(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """Typed fields of rows (_n, key, value), the value a structure of texts."""
    given = F.array_compact(F.array(*(F.when(F.col(f"value.`{f.name}`").isNotNull(), F.lit(f.name)) for f in fields)))
    return rows.select("key", "_n", given.alias("_given"), *(typed(F.col(f"value.`{f.name}`"), f).alias(f.name) for f in fields))


def delimited_file(spark: SparkSession, path: str, fields: list[Field], delimiter: str = ",") -> DataFrame:
    """Lines ``key<delimiter>field...`` without header or quotes; short lines are padded, lines with no
    delimiter are skipped. ``_n`` is the line's place: the file's, then the line's in it."""
    if len(delimiter) != 1:
        raise RequestError("delimiter must be one character")
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_n")).where(F.col("value").contains(delimiter))
    cells = lines.select("_n", F.split(F.regexp_replace("value", "\r$", ""), "\\Q" + delimiter + "\\E").alias("c"))
    raw = [F.nullif(F.get("c", F.lit(i + 1)), F.lit("")) for i in range(len(fields))]
    given = F.array_compact(F.array(*(F.when(x.isNotNull(), F.lit(f.name)) for x, f in zip(raw, fields))))
    return cells.select(F.get("c", F.lit(0)).alias("key"), "_n", given.alias("_given"), *(typed(x, f).alias(f.name) for x, f in zip(raw, fields)))
