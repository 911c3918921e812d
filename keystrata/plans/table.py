"""A table: its data and its schema."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from .types import Schema, field_of


@dataclass(frozen=True)
class Table:
    data: DataFrame
    schema: Schema

    @property
    def name(self) -> str:
        return self.schema.name

    @property
    def key(self) -> str | None:
        return self.schema.key

    def with_data(self, data: DataFrame) -> Table:
        return replace(self, data=data)


def adapt(data: DataFrame, name: str, key: str | None = None, indexes: Iterable[str] = ()) -> Table:
    """Any DataFrame as a table; columns of types that the data model lacks are left out."""
    fields = {c: f for c, kind in ((f.name, f.dataType) for f in data.schema.fields) if (f := field_of(c, kind)) is not None}
    return Table(data.select(*fields), Schema(name, fields, key, frozenset(indexes)))


def parquet_table(spark: SparkSession, path: str, name: str, key: str | None = None, indexes: Iterable[str] = ()) -> Table:
    return adapt(spark.read.parquet(path), name, key, indexes)
