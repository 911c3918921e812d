"""Tenants (dirs) and objects: schemas, indexes, sequences and versioned snapshots.

An object's rows lie in Parquet folders: a base, with one folder for each shard of the key's hash, and *deltas*, which
hold the rows of one write each (a deleted key as a mark), in folders by shard too. A write appends a delta, so it
writes as much as its batch; a read takes of each key the last delta's row, or else the base's. Deltas of like sizes
are merged as they gather, and put into the base once they hold a large share of the object (or by ``vacuum``), so
a row is rewritten a number of times that grows with the logarithm of the object.

Manifests are numbered files, made only if the number is free, and the highest is the object's state: a reader
finds a whole one at any time and keeps the folders that it planned with, and of writers that began with one state, in
whatever process, one commits and the others begin again (``retried``). Folders that a manifest gave up are removed by
``vacuum``. Reading one key prunes to its shard."""

from __future__ import annotations

import json
import math
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.table import Table
from ..plans.types import MAX_FIELDS, NAME, Field, RequestError, Schema, parse_field
from .storage import Storage

MIN_SPLITS, MAX_SPLITS, DEFAULT_SPLITS = 8, 4096, 8
MAX_KEY, KEY_CEILING = 64, 1024
#: Deltas of like sizes that are merged, and the share of an object's rows in deltas at which they go into the base,
#: counted from this many rows or deltas on.
MERGE, SHARE, ENOUGH = 8, 0.5, 100_000
#: Manifests that are kept, writers' attempts, and seconds after which a folder that no manifest ever named is waste.
KEPT, ATTEMPTS, WASTE = 50, 40, 86_400
#: Columns of deltas.
DEAD, ORDER = "__dead", "__order"


class Conflict(Exception):
    """Another writer has committed first."""


def retried(write: Callable) -> Callable:
    """A write that begins again on the new state if another writer was first."""

    @wraps(write)
    def attempt(*args: Any, **named: Any) -> Any:
        for _ in range(ATTEMPTS):
            try:
                return write(*args, **named)
            except Conflict:
                continue
        raise RequestError("too many writers at once")

    return attempt


def shard_of(key: Column, splits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(splits)).cast("int")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Storage(spark, root)
        self._locks: dict[tuple[str, str], threading.RLock] = {}
        self._guard = threading.Lock()

    # tenants

    def dirs(self) -> list[str]:
        return [n for n, folder, _ in self.files.list(self.files.root) if folder]

    def add_dir(self, name: str) -> None:
        if not NAME.match(name or ""):
            raise RequestError(f"invalid dir: {name}")
        self.files.make(self.files.path(name))

    def remove_dir(self, name: str, check_empty: bool = False) -> None:
        if name not in self.dirs():
            raise RequestError(f"unknown dir: {name}")
        if check_empty and self.objects(name):
            raise RequestError(f"dir isn't empty: {name}")
        self.files.delete(self.files.path(name))

    # objects

    def objects(self, dir_: str) -> list[str]:
        return [n for n, folder, _ in self.files.list(self.files.path(dir_)) if folder and self._numbers(dir_, n)]

    def _numbers(self, dir_: str, name: str) -> list[int]:
        return [int(n.removesuffix(".json")) for n, _, _ in self.files.list(self.files.path(dir_, name, "_manifests")) if n.endswith(".json")]

    def _manifest(self, dir_: str, name: str, number: int) -> str:
        return self.files.path(dir_, name, "_manifests", f"{number:012d}.json")

    @contextmanager
    def writing(self, dir_: str, name: str) -> Iterator[dict]:
        """The metadata handed out is saved if the block ends well and changed it, and if nobody else has saved
        meanwhile (else ``Conflict``). Threads of one process take turns."""
        with self._guard:
            lock = self._locks.setdefault((dir_, name), threading.RLock())
        with lock:
            number, meta = self._latest(dir_, name)
            before = json.dumps(meta, sort_keys=True)
            yield meta
            if json.dumps(meta, sort_keys=True) != before:
                if not self.files.create(self._manifest(dir_, name, number + 1), json.dumps(meta, indent=1).encode()):
                    raise Conflict(f"{dir_}/{name}")
                if number >= KEPT:
                    self.files.delete(self._manifest(dir_, name, number - KEPT))

    def _latest(self, dir_: str, name: str) -> tuple[int, dict]:
        numbers = self._numbers(dir_, name) if NAME.match(name or "") and NAME.match(dir_ or "") else []
        if not numbers:
            raise RequestError(f"unknown object: {dir_}/{name}")
        return max(numbers), json.loads(self.files.read(self._manifest(dir_, name, max(numbers))))

    def meta(self, dir_: str, name: str) -> dict:
        return self._latest(dir_, name)[1]

    def meta_at(self, path: str) -> dict:
        """The only manifest of a backup's folder."""
        return json.loads(self.files.read(f"{path}/_manifests/{1:012d}.json"))

    def create(self, dir_: str, name: str, fields: list[str], indexes: list[str] = (), splits: int = DEFAULT_SPLITS, max_key: int = MAX_KEY, if_not_exists: bool = False) -> dict:
        if not NAME.match(name or "") or not NAME.match(dir_ or ""):
            raise RequestError(f"invalid name: {dir_}/{name}")
        if name in self.objects(dir_):
            if if_not_exists:
                return self.meta(dir_, name)
            raise RequestError(f"object exists: {name}")
        splits, max_key = int(splits or DEFAULT_SPLITS), int(max_key or MAX_KEY)
        if not MIN_SPLITS <= splits <= MAX_SPLITS or splits & (splits - 1):
            raise RequestError(f"splits must be a power of 2 from {MIN_SPLITS} to {MAX_SPLITS}")
        if not 1 <= max_key <= KEY_CEILING:
            raise RequestError(f"max_key must be from 1 to {KEY_CEILING}")
        parsed = [parse_field(x) for x in fields or []]
        if not parsed or len(parsed) > MAX_FIELDS:
            raise RequestError(f"from 1 to {MAX_FIELDS} fields are needed")
        if len({f.name for f in parsed}) < len(parsed):
            raise RequestError("two fields have one name")
        meta = {"splits": splits, "max_key": max_key, "fields": [asdict(f) for f in parsed], "indexes": [], "sequences": {}, "version": 0, "shards": {}, "deltas": [], "retired": [], "count": 0}
        for x in indexes or []:
            check_index(meta, x)
            meta["indexes"].append(x)
        if not self.files.create(self._manifest(dir_, name, 1), json.dumps(meta, indent=1).encode()):
            if if_not_exists:
                return self.meta(dir_, name)
            raise RequestError(f"object exists: {name}")
        return meta

    def drop(self, dir_: str, name: str, if_exists: bool = False) -> bool:
        if name not in self.objects(dir_):
            if if_exists:
                return False
            raise RequestError(f"unknown object: {dir_}/{name}")
        return self.files.delete(self.files.path(dir_, name))

    # rows

    def schema(self, name: str, meta: dict) -> Schema:
        return Schema(name, {f["name"]: Field(**f) for f in meta["fields"]}, "key", frozenset(meta["indexes"]))

    def stored_type(self, meta: dict) -> T.StructType:
        fields = (Field(**f) for f in meta["fields"])
        return T.StructType([T.StructField("key", T.StringType(), False), *(T.StructField(f.name, f.spark_type) for f in fields)])

    def layers(self, meta: dict) -> list[dict]:
        """All folders' entries, which say how the folder names fields that were renamed since."""
        return [*meta["shards"].values(), *meta["deltas"]]

    def _stored(self, kind: T.StructType, renamed: dict, paths: list[str]) -> DataFrame:
        at = {f.name: renamed.get(f.name, f.name) for f in kind}  # "": these folders don't have the field
        df = self.spark.read.schema(T.StructType([T.StructField(at[f.name], f.dataType) for f in kind if at[f.name]])).parquet(*paths)
        return df.select(*((F.col(f"`{at[f.name]}`") if at[f.name] else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind))

    def _base(self, dir_: str, name: str, meta: dict, shards: list[int] | None) -> DataFrame:
        held = meta["shards"] if shards is None else {s: meta["shards"][str(s)] for s in map(str, shards) if s in meta["shards"]}
        kind = self.stored_type(meta)
        parts: dict[tuple, list[str]] = {}
        for s, at in held.items():
            parts.setdefault(tuple(sorted(at["renamed"].items())), []).append(self.files.path(dir_, name, "data", at["folder"], f"_shard={s}"))
        out = None
        for renamed, paths in parts.items():
            df = self._stored(kind, dict(renamed), paths)
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], kind) if out is None else out

    def _changes(self, dir_: str, name: str, meta: dict, deltas: list[dict], shards: list[int] | None) -> DataFrame | None:
        """The last row of each key in some deltas; ``DEAD`` marks deleted keys."""
        kind = self.stored_type(meta)
        marked = T.StructType([*kind.fields, T.StructField(DEAD, T.BooleanType())])
        out, parts = None, 0
        for i, d in enumerate(deltas):
            here = [s for s in d["shards"] if shards is None or s in set(shards)]
            if here:
                df = self._stored(marked, d["renamed"], [self.files.path(dir_, name, "data", d["folder"], f"_shard={s}") for s in here]).withColumn(ORDER, F.lit(i))
                out, parts = (df if out is None else out.unionByName(df)), parts + 1
        if parts < 2:  # one delta has a key once
            return out if out is None else out.drop(ORDER)
        others = [f"`{f.name}`" for f in marked if f.name != "key"]
        return out.groupBy("key").agg(F.max_by(F.struct(*others), ORDER).alias("r")).select("key", "r.*")

    def read(self, dir_: str, name: str, meta: dict, shards: list[int] | None = None) -> DataFrame:
        """Stored rows, removed fields included; of some shards, or of all. Filters reach the base's scan through the anti-join."""
        base = self._base(dir_, name, meta, shards)
        changes = self._changes(dir_, name, meta, meta["deltas"], shards)
        if changes is None:
            return base
        return base.join(changes.select("key"), "key", "left_anti").unionByName(changes.where(~F.col(DEAD)).drop(DEAD))

    def table(self, dir_: str, name: str, key: str | None = None) -> Table:
        """The live fields; with a key, of its shard only."""
        meta = self.meta(dir_, name)
        shards = None
        if key is not None:
            shards = [self.spark.range(1).select(shard_of(F.lit(key), meta["splits"])).first()[0]]
        live = [f["name"] for f in meta["fields"] if not f["removed"]]
        return Table(self.read(dir_, name, meta, shards).select("key", *(f"`{x}`" for x in live)), self.schema(name, meta))

    def _write(self, dir_: str, name: str, meta: dict, rows: DataFrame, kind: T.StructType) -> tuple[str, list[int]]:
        """A new folder, by shard: its name, and the shards in it."""
        meta["version"] += 1
        folder = f"v{meta['version']:08d}-{uuid.uuid4().hex[:8]}"
        path = self.files.path(dir_, name, "data", folder)
        rows = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind)).withColumn("_shard", shard_of(F.col("key"), meta["splits"]))
        rows.hint("rebalance", "_shard").sortWithinPartitions("_shard", "key").write.partitionBy("_shard").parquet(path)
        return folder, sorted(int(n.removeprefix("_shard=")) for n, is_folder, _ in self.files.list(path) if is_folder and n.startswith("_shard="))

    def _retire(self, meta: dict, before: list[dict]) -> None:
        held = {at["folder"] for at in self.layers(meta)}
        meta["retired"] = sorted({*meta["retired"], *(at["folder"] for at in before)} - held)

    def commit(self, dir_: str, name: str, meta: dict, rows: DataFrame, shards: list[int] | None, count: int | None = None) -> None:
        """Put ``rows`` in the place of the base and the deltas of the given shards (all: None)."""
        before = self.layers(meta)
        folder, written = self._write(dir_, name, meta, rows, self.stored_type(meta))
        kept = {} if shards is None else {s: at for s, at in meta["shards"].items() if int(s) not in set(shards)}
        meta["shards"] = kept | {str(s): {"folder": folder, "renamed": {}} for s in written}
        meta["deltas"] = [] if shards is None else [d for d in meta["deltas"] if not set(d["shards"]) <= set(shards)]
        self._retire(meta, before)
        meta["count"] = self.read(dir_, name, meta).count() if count is None else count

    def compact(self, dir_: str, name: str, meta: dict) -> None:
        """Put the deltas into the base, in the shards that they touch."""
        shards = sorted({s for d in meta["deltas"] for s in d["shards"]})
        if shards:
            self.commit(dir_, name, meta, self.read(dir_, name, meta, shards), shards, meta["count"])

    def append(self, dir_: str, name: str, meta: dict, rows: DataFrame, size: int, count: int) -> None:
        """Add ``size`` rows of distinct keys (the stored fields and ``DEAD``) as a delta; ``count`` is the object's new count."""
        meta["count"] = count
        if not meta["shards"] and not meta["deltas"]:
            self.commit(dir_, name, meta, rows.where(~F.col(DEAD)), None, count)
            return
        kind = T.StructType([*self.stored_type(meta).fields, T.StructField(DEAD, T.BooleanType())])
        folder, shards = self._write(dir_, name, meta, rows, kind)
        meta["deltas"].append({"folder": folder, "renamed": {}, "shards": shards, "rows": size})
        held = sum(d["rows"] for d in meta["deltas"])
        if held > SHARE * count and (held >= ENOUGH or len(meta["deltas"]) >= MERGE):
            self.compact(dir_, name, meta)
            return
        # the newest deltas that are at most of the newest one's order of size
        most = MERGE ** (1 + math.floor(math.log(max(1, size), MERGE) + 1e-9))
        alike = 0
        while alike < len(meta["deltas"]) and meta["deltas"][-1 - alike]["rows"] <= most:
            alike += 1
        if alike >= MERGE:
            before, old = self.layers(meta), meta["deltas"][-alike:]
            merged = self._changes(dir_, name, meta, old, None)
            folder, shards = self._write(dir_, name, meta, merged, kind)
            meta["deltas"][-alike:] = [{"folder": folder, "renamed": {}, "shards": shards, "rows": sum(d["rows"] for d in old)}]
            self._retire(meta, before)

    def vacuum(self, dir_: str, name: str) -> int:
        """Remove folders that manifests gave up, and those of writers that never committed, once they are old."""
        gone = 0
        with self.writing(dir_, name) as meta:
            used = {at["folder"] for at in self.layers(meta)}
            base = self.files.path(dir_, name, "data")
            for folder, _, _ in self.files.list(base):
                path = f"{base}/{folder}"
                if folder not in used:
                    if folder in meta["retired"] or self.files.age(path) > WASTE:
                        gone += self.files.delete(path)
                    continue
                held = {f"_shard={s}" for s, at in meta["shards"].items() if at["folder"] == folder} | {f"_shard={s}" for d in meta["deltas"] if d["folder"] == folder for s in d["shards"]}
                for shard, is_folder, _ in self.files.list(path):
                    if is_folder and shard.startswith("_shard=") and shard not in held:
                        gone += self.files.delete(f"{path}/{shard}")
            meta["retired"] = []
        return gone


def check_index(meta: dict, name: str) -> None:
    live = {f["name"] for f in meta["fields"] if not f["removed"]}
    if not name or any(x not in live for x in name.split("+")):
        raise RequestError(f"index names an unknown field: {name}")
