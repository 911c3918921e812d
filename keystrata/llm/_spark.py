"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of every executor, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(), f"{root.name}_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that the session names. Local sessions (tests) may go without, and get one;
    on a cluster executors would not share it, so there it is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints_")
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that the session names."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = shared_folder(spark)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    out = df.checkpoint()
    del df
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let the cleaner remove shuffle files that nothing refers to any more; it acts on the driver's
    garbage collection, which may otherwise come long after a checkpoint has made them useless."""
    gc.collect()
    spark._jvm.System.gc()


#: Bits of an id filter: 2048 rows of 4 KB at most are broadcast, however many ids there are.
FILTER_BITS = 1 << 26


def _place(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1


def id_filter(ids: DataFrame, column: str) -> DataFrame:
    """A bitmap of the hashes of ``column``, to keep rows of other ids out of a shuffle. Where the ids are so many
    that it fills, more rows pass; the join after it decides."""
    at = _place(column)
    return ids.groupBy(F.bitmap_bucket_number(at).alias("_pf_key")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_pf_map"))


def through(df: DataFrame, ids: DataFrame, column: str, listed: bool = True) -> DataFrame:
    """Rows whose ``column`` the filter lists (or doesn't); a null id isn't listed."""
    at = F.when(F.col(column).isNotNull(), _place(column))
    placed = df.withColumns({"_pf_row": F.bitmap_bucket_number(at), "_pf_bit": F.bitmap_bit_position(at)})
    byte = "cast(conv(hex(substring(_pf_map, cast(_pf_bit div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.expr(f"coalesce((shiftright({byte}, cast(_pf_bit % 8 as int)) & 1) = 1, false)")
    return placed.join(F.broadcast(ids), F.col("_pf_row") == F.col("_pf_key"), "left").where(hit if listed else ~hit).select(df.columns)


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """``schema`` with ``fields`` replaced in place where the name exists, appended elsewhere."""
    new = dict(fields)
    out = [T.StructField(f.name, new.pop(f.name), True) if f.name in new else f for f in schema.fields]
    return T.StructType(out + [T.StructField(n, t, True) for n, t in new.items()])


def replace_columns(batch: pa.RecordBatch, names: list[str], **new: pa.Array) -> pa.RecordBatch:
    """The batch with the columns of ``names``, taken from ``new`` where given there."""
    return pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)


def parallelism(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rekeyed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with its bigint ``column`` as a new expression of the same value.

    What an aggregate has dealt by a key would be joined on that key as it lies; dealt anew, both sides
    of the join are plain exchanges, which adaptive execution can split where a key is hot."""
    return df.withColumn(column, F.col(column).bitwiseXOR(F.lit(0).cast("long")))
