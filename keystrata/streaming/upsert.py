"""A stream of records into an object: each micro-batch is one bulk upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import Engine


def upsert_stream(engine: Engine, records: DataFrame, dir_: str, name: str, checkpoint: str, trigger: dict | None = None, order_by: str | None = None) -> StreamingQuery:
    """``records``: key and the object's fields, and ``order_by`` if it isn't one of them. Of equal keys in a batch the one
    with the greatest ``order_by`` counts, among equals the greatest by content; so a batch that is repeated after a
    failure gives the same rows."""

    def put(batch: DataFrame, _: int) -> None:
        live = {f.name for f in engine.writer._live(engine.catalog.meta(dir_, name))}
        fields = [c for c in batch.columns if c != "key" and c in live]
        content = F.xxhash64(*(F.col(f"`{c}`") for c in batch.columns))
        given = F.array_compact(F.array(*(F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in fields)))
        engine.writer.bulk_insert(dir_, name, batch.withColumns({"_n": F.struct(F.col(f"`{order_by}`"), content) if order_by else content, "_given": given}))

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
