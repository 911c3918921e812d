"""Writes: upsert, partial update, delete, their bulk forms, conditions, sequences and defaults.

Each write appends its own rows: whole records for upserts, the joined ones for partial updates, marks for deletes.
Of what is stored it reads the keys (partial updates: the rows) in the shards that it touches, to tell new from old.
Batches are all or nothing."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import criteria as C
from ..plans.compile import compile_criteria, quoted, text_leaf, text_of
from ..plans.table import Table
from ..plans.types import Field, RequestError
from ..sources import ingest
from ..sources.catalog import DEAD, Catalog, retried, shard_of
from ..sources.formats import record

MAX_CONDITIONS = 64
#: Keys of a batch up to this number are looked up by a filter, which reaches the scan; more by a join.
FILTERED = 200


def conditions(items: Any) -> list[C.Leaf]:
    """A flat list of criteria, all of which must hold for the stored record."""
    node = C.parse(items)
    leaves = list(node.children) if isinstance(node, C.All) else [] if node is None else [node]
    if any(not isinstance(x, C.Leaf) for x in leaves) or len(leaves) > MAX_CONDITIONS:
        raise RequestError("if takes a flat list of criteria")
    return leaves


def condition_column(leaves: list[C.Leaf], table: Table) -> Column:
    """Conditions compare as text, which is what clients hold."""
    out = F.lit(True)
    for x in leaves:
        f = table.schema.find(x.field)
        if f is None:
            out = out & F.lit(x.op == "not_exists")
        elif f.kind == "varchar" or x.op.endswith("_field"):
            out = out & compile_criteria(x, table.schema)
        else:
            c = quoted(f.name)
            shown = F.date_format(c, "yyyyMMdd") if f.kind == "date" else F.date_format(c, "yyyyMMddHHmmss") if f.kind == "datetime" else c.cast("string")
            if f.kind == "numeric":
                shown = F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+$", "$1"), r"\.$", "")
            out = out & text_leaf(F.coalesce(shown, F.lit(text_of(f.zero))), x)
    return out


class Writer:
    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark

    # shared parts

    def _live(self, meta: dict) -> list[Field]:
        return [Field(**f) for f in meta["fields"] if not f["removed"]]

    def _shards(self, meta: dict, keys: DataFrame) -> list[int]:
        """Shards of some keys: at most as many as the object has."""
        return sorted(r[0] for r in keys.select(shard_of(F.col("key"), meta["splits"])).distinct().collect())

    def _view(self, dir_: str, name: str, meta: dict, shards: list[int] | None) -> Table:
        return Table(self.catalog.read(dir_, name, meta, shards), self.catalog.schema(name, meta))

    def _latest(self, rows: DataFrame) -> DataFrame:
        """The last of each key in a batch."""
        w = Window.partitionBy("key").orderBy(F.desc("_n"))
        return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

    def _check_keys(self, meta: dict, rows: DataFrame) -> None:
        bad = rows.where(F.col("key").isNull() | (F.octet_length("key") > meta["max_key"]) | (F.col("key") == "")).limit(1).collect()
        if bad:
            raise RequestError("a key is missing or too long")

    def _defaults(self, dir_: str, name: str, meta: dict, rows: DataFrame, on_insert: bool) -> DataFrame:
        """Values for fields that a record doesn't give; auto_update is stamped on every write."""
        for f in self._live(meta):
            if f.default is None or (not on_insert and f.default != "auto_update"):
                continue
            given = F.array_contains("_given", f.name)
            fn, _, arg = f.default.rstrip(")").partition("(")
            if f.default in ("auto_create", "auto_update"):
                now = F.current_timestamp().cast("timestamp_ntz")
                value = F.date_trunc("second", now).cast("timestamp_ntz") if f.kind == "datetime" else now.cast("date")
                if f.default == "auto_update":
                    given = F.lit(False)
            elif fn == "seq":
                rows = self._numbered(meta, rows, given, f.name, arg)
                continue
            elif fn == "uuid":
                value = F.uuid()
            elif fn == "random":
                value = F.substring(F.regexp_replace(F.concat(*(F.uuid() for _ in range(1 + 2 * int(arg or 8) // 32))), "-", ""), 1, 2 * int(arg or 8))
            else:
                value = F.lit(f.literal(f.default))
            rows = rows.withColumn(f.name, F.when(given, quoted(f.name)).otherwise(value.cast(f.spark_type)))
        return rows

    def _numbered(self, meta: dict, rows: DataFrame, given: Column, field: str, sequence: str) -> DataFrame:
        """The next numbers of a sequence, in the records' order: a distributed sort, and each partition's count."""
        lacking = self._materialised(rows.where(~given).orderBy("_n"))
        at = F.monotonically_increasing_id()
        counts = {r["p"]: r["m"] for r in lacking.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("m")).collect()}  # a row for each partition
        if not counts:
            return rows
        before, offsets = self._take(meta, sequence, sum(counts.values())), []
        for p in sorted(counts):
            offsets.append((p, before))
            before += counts[p]
        first = self.spark.createDataFrame(offsets, "_p int, _first long")
        numbers = lacking.withColumns({"_p": F.spark_partition_id(), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}).join(F.broadcast(first), "_p")
        kind = rows.schema[field].dataType
        filled = numbers.withColumn(field, (F.col("_first") + F.col("_at")).cast(kind)).select(*map(quoted, rows.columns))
        return rows.where(given).unionByName(filled)

    def _full(self, meta: dict, rows: DataFrame) -> DataFrame:
        """Rows in the stored shape; what they lack is absent."""
        kind = self.catalog.stored_type(meta)
        return rows.select(*(quoted(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kind))

    def _materialised(self, rows: DataFrame) -> DataFrame:
        """Generated values (uuid, sequences) must not change between the uses of a batch."""
        sc = self.spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or self.catalog.files.path("_checkpoints"))
        return rows.checkpoint()

    def _existing(self, dir_: str, name: str, meta: dict, keys: DataFrame, size: int) -> DataFrame:
        """Stored rows of some distinct keys."""
        shards = self._shards(meta, keys)
        old = self.catalog.read(dir_, name, meta, shards)
        if size <= FILTERED:
            return old.where(F.col("key").isin([r[0] for r in keys.select("key").collect()]))
        return old.join(keys.select("key"), "key", "left_semi")

    def _put(self, dir_: str, name: str, meta: dict, rows: DataFrame) -> tuple[int, int]:
        """Upsert of rows with distinct keys: (new keys, all keys)."""
        size = rows.count()
        if not size:
            return 0, 0
        new = size - (self._existing(dir_, name, meta, rows, size).count() if meta["count"] else 0)
        self.catalog.append(dir_, name, meta, self._full(meta, rows).withColumn(DEAD, F.lit(False)), size, meta["count"] + new)
        return new, size

    # one record

    def _current(self, dir_: str, name: str, meta: dict, key: str, leaves: list[C.Leaf]) -> tuple[dict | None, bool]:
        """The stored record, and whether the conditions hold for it."""
        probe = self.spark.createDataFrame([(key,)], "key string")
        view = self._view(dir_, name, meta, self._shards(meta, probe))
        live = [f.name for f in self._live(meta)]
        row = view.data.where(F.col("key") == key).select(*map(quoted, ["key", *live]), F.coalesce(condition_column(leaves, view), F.lit(False)).alias("_ok")).first()
        if row is None:
            return None, False
        return {k: v for k, v in record(row, "key").items() if k != "_ok"}, row["_ok"]

    @retried
    def insert(self, dir_: str, name: str, key: str, value: dict, if_not_exists: bool = False, condition: Any = None) -> dict:
        leaves = conditions(condition)
        with self.catalog.writing(dir_, name) as meta:
            if if_not_exists or leaves:
                current, ok = self._current(dir_, name, meta, key, leaves)
                if (if_not_exists and current is not None) or (leaves and not ok):
                    return {"error": "condition_not_met", "current": current}
            rows = ingest.inline(self.spark, {key: value}, self._live(meta))
            self._check_keys(meta, rows)
            new, _ = self._put(dir_, name, meta, self._materialised(self._defaults(dir_, name, meta, rows, True)))
        return {"status": "inserted" if new else "updated", "key": key}

    @retried
    def update(self, dir_: str, name: str, key: str, value: dict, condition: Any = None, dry_run: bool = False) -> dict:
        leaves = conditions(condition)
        with self.catalog.writing(dir_, name) as meta:
            current, ok = self._current(dir_, name, meta, key, leaves)
            if current is None:
                return {"error": "Not found"}
            if not ok:
                return {"error": "condition_not_met", "current": current}
            if dry_run:
                return {"status": "would_update", "key": key, "dry_run": True}
            self._patch(dir_, name, meta, ingest.inline(self.spark, {key: value}, self._live(meta)))
        return {"status": "updated", "key": key}

    @retried
    def delete(self, dir_: str, name: str, key: str, condition: Any = None, dry_run: bool = False) -> dict:
        leaves = conditions(condition)
        with self.catalog.writing(dir_, name) as meta:
            current, ok = self._current(dir_, name, meta, key, leaves)
            if current is None:
                return {"status": "not_found", "key": key}
            if not ok:
                return {"error": "condition_not_met", "current": current}
            if dry_run:
                return {"status": "would_delete", "key": key, "dry_run": True}
            self._remove(dir_, name, meta, self.spark.createDataFrame([(key,)], "key string"))
        return {"status": "deleted", "key": key}

    # bulk

    @retried
    def bulk_insert(self, dir_: str, name: str, rows: DataFrame | Any, if_not_exists: bool = False, defaults: bool = True) -> dict:
        """Upsert of many records; of equal keys the last counts. ``inserted`` counts new keys."""
        with self.catalog.writing(dir_, name) as meta:
            if not isinstance(rows, DataFrame):
                rows = ingest.inline(self.spark, rows, self._live(meta))
            rows = self._latest(rows)
            skipped = 0
            if if_not_exists:
                rows = self._materialised(rows)
                total = rows.count()
                rows = rows.join(self._existing(dir_, name, meta, rows, total).select("key"), "key", "left_anti")
            if defaults:
                rows = self._defaults(dir_, name, meta, rows, True)
            rows = self._materialised(rows)
            self._check_keys(meta, rows)
            if if_not_exists:
                skipped = total - rows.count()
            new, _ = self._put(dir_, name, meta, rows)
        return {"inserted": new} | ({"skipped": skipped} if if_not_exists else {})

    def rows_from(self, dir_: str, name: str, file: str, delimiter: str | None = None) -> DataFrame:
        live = self._live(self.catalog.meta(dir_, name))
        return ingest.json_file(self.spark, file, live) if delimiter is None else ingest.delimited_file(self.spark, file, live, delimiter)

    def _patch(self, dir_: str, name: str, meta: dict, patch: DataFrame) -> tuple[int, int]:
        """Partial update: fields that a patch gives replace the stored ones. (updated, missing)"""
        patch = self._latest(self._defaults(dir_, name, meta, patch, False))
        stamped = [f.name for f in self._live(meta) if f.default == "auto_update"]
        size = patch.count()
        old = self._existing(dir_, name, meta, patch, size)
        live = {f.name for f in self._live(meta)}
        new = patch.select(F.col("key").alias("_k"), F.col("_given").alias("_g"), *(quoted(f).alias(f"_p_{f}") for f in live))
        joined = old.join(new, old["key"] == F.col("_k"))
        columns = []
        for f in self.catalog.stored_type(meta):
            c = quoted(f.name)
            if f.name in stamped:
                c = quoted(f"_p_{f.name}").alias(f.name)
            elif f.name in live:
                c = F.when(F.array_contains("_g", f.name), quoted(f"_p_{f.name}")).otherwise(c).alias(f.name)
            columns.append(c)
        changed = self._materialised(joined.select(*columns, F.lit(False).alias(DEAD)))
        matched = changed.count()
        if matched:
            self.catalog.append(dir_, name, meta, changed, matched, meta["count"])
        return matched, size - matched

    @retried
    def bulk_update(self, dir_: str, name: str, rows: DataFrame | Any) -> dict:
        with self.catalog.writing(dir_, name) as meta:
            if not isinstance(rows, DataFrame):
                rows = ingest.inline(self.spark, rows, self._live(meta))
            updated, skipped = self._patch(dir_, name, meta, rows)
        return {"matched": updated, "updated": updated, "skipped": skipped}

    def _chosen(self, dir_: str, name: str, meta: dict, criteria: Any, limit: int | None, leaves: list[C.Leaf]) -> tuple[DataFrame, int, int]:
        """Keys that match and pass the conditions, and how many match and pass."""
        node = C.parse(criteria)
        if node is None:
            raise RequestError("criteria are needed")
        view = self._view(dir_, name, meta, None)
        hit = view.data.where(compile_criteria(node, view.schema)).select("key", F.coalesce(condition_column(leaves, view), F.lit(False)).alias("_ok"))
        if limit and int(limit) > 0:
            hit = hit.orderBy("key").limit(int(limit))
        hit = self._materialised(hit)
        matched, passed = hit.agg(F.count(F.lit(1)), F.count_if("_ok")).first()
        return hit.where("_ok").select("key"), matched, passed

    @retried
    def bulk_update_where(self, dir_: str, name: str, criteria: Any, value: dict, limit: int | None = None, condition: Any = None, dry_run: bool = False) -> dict:
        with self.catalog.writing(dir_, name) as meta:
            keys, matched, passed = self._chosen(dir_, name, meta, criteria, limit, conditions(condition))
            if dry_run:
                return {"matched": matched, "updated": 0, "skipped": matched - passed, "dry_run": True}
            if passed:
                one = ingest.inline(self.spark, {"": value}, self._live(meta)).first().asDict()
                names = [f.name for f in self._live(meta)]
                kinds = {f.name: f.spark_type for f in self._live(meta)}
                patch = keys.select("key", F.lit(0).cast("long").alias("_n"), F.lit(one["_given"]).cast("array<string>").alias("_given") if one["_given"] else F.array().cast("array<string>").alias("_given"), *(F.lit(one[x]).cast(kinds[x]).alias(x) for x in names))
                self._patch(dir_, name, meta, patch)
        return {"matched": matched, "updated": passed, "skipped": matched - passed}

    def _remove(self, dir_: str, name: str, meta: dict, keys: DataFrame) -> int:
        size = keys.count()
        gone = self._materialised(self._existing(dir_, name, meta, keys, size).select("key")) if size else keys
        found = gone.count()
        if found:
            self.catalog.append(dir_, name, meta, self._full(meta, gone).withColumn(DEAD, F.lit(True)), found, meta["count"] - found)
        return found

    @retried
    def bulk_delete(self, dir_: str, name: str, keys: list[str] | None = None, file: str | None = None) -> dict:
        if file is not None:
            listed = self.spark.read.text(file, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("key"))
        else:
            listed = self.spark.createDataFrame([(k,) for k in keys or []], "key string")
        with self.catalog.writing(dir_, name) as meta:
            return {"deleted": self._remove(dir_, name, meta, listed.distinct())}

    @retried
    def bulk_delete_where(self, dir_: str, name: str, criteria: Any, limit: int | None = None, condition: Any = None, dry_run: bool = False) -> dict:
        with self.catalog.writing(dir_, name) as meta:
            keys, matched, passed = self._chosen(dir_, name, meta, criteria, limit, conditions(condition))
            if dry_run:
                return {"matched": matched, "deleted": 0, "skipped": matched - passed, "dry_run": True}
            if passed:
                self._remove(dir_, name, meta, keys)
        return {"matched": matched, "deleted": passed, "skipped": matched - passed}

    # sequences

    def _take(self, meta: dict, name: str, count: int) -> int:
        start = meta["sequences"].get(name, 0) + 1
        meta["sequences"][name] = start + count - 1
        return start

    @retried
    def sequence(self, dir_: str, name: str, sequence: str, action: str, batch: int = 1, value: int = 0) -> dict:
        with self.catalog.writing(dir_, name) as meta:
            if action in ("init", "reset"):
                meta["sequences"][sequence] = int(value or 0)
            elif action in ("next", "next-batch"):
                n = int(batch or 1)
                start = self._take(meta, sequence, n)
                return {"sequence": sequence, "value": start} if n == 1 else {"sequence": sequence, "start": start, "end": start + n - 1}
            elif action != "current":
                raise RequestError(f"unknown sequence action: {action}")
            return {"sequence": sequence, "value": meta["sequences"].get(sequence, 0)}
