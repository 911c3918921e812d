"""Schema evolution, indexes, maintenance, discovery, backup and manifests.

Adding a field is metadata only, for old rows read it as NULL; so is renaming one, as the manifest remembers
each folder's own names. Removing a field hides it until the rows are compacted."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import asdict
from typing import Any

from pyspark.sql import functions as F

from ..plans.types import MAX_FIELDS, NAME, Field, RequestError, parse_field
from ..sources.catalog import MAX_SPLITS, MIN_SPLITS, Catalog, check_index, retried, shard_of


class SchemaOps:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    @retried
    def add_fields(self, dir_: str, name: str, specs: list[str]) -> dict:
        with self.catalog.writing(dir_, name) as meta:
            for x in specs:
                f = parse_field(x)
                if any(old["name"] == f.name for old in meta["fields"]):
                    raise RequestError(f"field exists or was removed and not compacted yet: {f.name}")
                meta["fields"].append(asdict(f))
                for at in self.catalog.layers(meta):
                    if f.name in at["renamed"].values():  # a renamed field's own column has this name
                        at["renamed"][f.name] = ""
            if len(meta["fields"]) > MAX_FIELDS:
                raise RequestError(f"more than {MAX_FIELDS} fields")
        return {"status": "added", "fields": len(specs)}

    @retried
    def rename_field(self, dir_: str, name: str, old: str, new: str) -> dict:
        if not NAME.match(new or "") or new == "key":
            raise RequestError(f"invalid field name: {new}")
        with self.catalog.writing(dir_, name) as meta:
            named = {f["name"]: f for f in meta["fields"]}
            if old not in named or named[old]["removed"]:
                raise RequestError(f"unknown field: {old}")
            if new in named:
                raise RequestError(f"field exists: {new}")
            named[old]["name"] = new
            for at in self.catalog.layers(meta):
                at["renamed"][new] = at["renamed"].pop(old, old)
            meta["indexes"] = ["+".join(new if p == old else p for p in x.split("+")) for x in meta["indexes"]]
        return {"status": "renamed", "old": old, "new": new}

    @retried
    def remove_fields(self, dir_: str, name: str, fields: list[str]) -> dict:
        dropped: list[str] = []
        with self.catalog.writing(dir_, name) as meta:
            named = {f["name"]: f for f in meta["fields"] if not f["removed"]}
            for x in fields:
                if x not in named:
                    raise RequestError(f"unknown field: {x}")
                named[x]["removed"] = True
                gone = [i for i in meta["indexes"] if x in i.split("+")]
                dropped += gone
                meta["indexes"] = [i for i in meta["indexes"] if i not in gone]
        return {"status": "removed", "fields": fields, "indexes_dropped": dropped}

    @retried
    def vacuum(self, dir_: str, name: str, compact: bool = False, splits: int | None = None) -> dict:
        """Put deltas into the base and remove folders of past versions; compact rewrites all rows without removed
        fields, and with ``splits`` over so many shards."""
        if splits is not None and (not MIN_SPLITS <= splits <= MAX_SPLITS or splits & (splits - 1)):
            raise RequestError(f"splits must be a power of 2 from {MIN_SPLITS} to {MAX_SPLITS}")
        with self.catalog.writing(dir_, name) as meta:
            if compact or splits is not None:
                rows = self.catalog.read(dir_, name, meta)
                meta["fields"] = [f for f in meta["fields"] if not f["removed"]]
                meta["splits"] = splits or meta["splits"]
                self.catalog.commit(dir_, name, meta, rows, None, meta["count"])
            else:
                self.catalog.compact(dir_, name, meta)
        self.catalog.vacuum(dir_, name)
        return {"status": "vacuumed", "count": meta["count"], "splits": meta["splits"]}

    @retried
    def truncate(self, dir_: str, name: str) -> dict:
        with self.catalog.writing(dir_, name) as meta:
            folders = {at["folder"] for at in self.catalog.layers(meta)}
            meta.update(shards={}, deltas=[], count=0, version=meta["version"] + 1, retired=sorted({*meta["retired"], *folders}))
        return {"status": "truncated"}

    @retried
    def recount(self, dir_: str, name: str) -> dict:
        with self.catalog.writing(dir_, name) as meta:
            meta["count"] = self.catalog.read(dir_, name, meta).count()
            return {"status": "recounted", "count": meta["count"]}

    @retried
    def add_indexes(self, dir_: str, name: str, fields: list[str], force: bool = False) -> dict:
        with self.catalog.writing(dir_, name) as meta:
            added = []
            for x in fields:
                check_index(meta, x)
                if x not in meta["indexes"] or force:
                    added.append(x)
                if x not in meta["indexes"]:
                    meta["indexes"].append(x)
        return {"status": "indexed", "fields": added}

    @retried
    def remove_indexes(self, dir_: str, name: str, fields: list[str]) -> dict:
        with self.catalog.writing(dir_, name) as meta:
            gone = [x for x in fields if x in meta["indexes"]]
            meta["indexes"] = [x for x in meta["indexes"] if x not in gone]
        return {"status": "removed", "fields": gone}

    def reindex(self, dir_: str | None = None, name: str | None = None) -> dict:
        """Indexes are metadata here; this reports them."""
        found = [(d, o, len(self.catalog.meta(d, o)["indexes"])) for d, o in self._objects(dir_, name)]
        return {"status": "reindexed", "objects": len(found), "indexes": sum(n for _, _, n in found)}

    def _objects(self, dir_: str | None, name: str | None) -> list[tuple[str, str]]:
        return [(d, o) for d in ([dir_] if dir_ else self.catalog.dirs()) for o in ([name] if name else self.catalog.objects(d))]

    def describe(self, dir_: str, name: str) -> dict:
        meta = self.catalog.meta(dir_, name)
        live = [Field(**f) for f in meta["fields"] if not f["removed"]]
        shown = [{"name": f.name, "type": f.kind, "size": f.width} | ({"scale": f.scale} if f.kind == "numeric" else {}) | ({"default": f.default} if f.default else {}) for f in live]
        return {"dir": dir_, "object": name, "splits": meta["splits"], "max_key": meta["max_key"], "value_size": sum(f.width for f in live), "record_count": meta["count"], "fields": shown, "indexes": meta["indexes"]}

    def shard_stats(self, dir_: str | None = None, name: str | None = None) -> list[dict]:
        """Rows of each shard, counted by the executors."""
        out = []
        for d, o in self._objects(dir_, name):
            meta = self.catalog.meta(d, o)
            found = {r[0]: r[1] for r in self.catalog.read(d, o, meta).groupBy(shard_of(F.col("key"), meta["splits"])).count().collect()}
            out.append({"dir": d, "object": o, "splits": meta["splits"], "shards": [{"id": f"{s:03d}", "active": found.get(s, 0), "tombstoned": 0} for s in range(meta["splits"])]})
        return out

    def vacuum_check(self) -> list[dict]:
        """Objects with folders of past versions or removed fields."""
        out = []
        for d, o in self._objects(None, None):
            meta = self.catalog.meta(d, o)
            folders = {f for f, _, _ in self.catalog.files.list(self.catalog.files.path(d, o, "data"))}
            stale = len(folders - {at["folder"] for at in self.catalog.layers(meta)})
            out.append({"dir": d, "object": o, "count": meta["count"], "orphaned": 0, "stale_versions": stale, "vacuum": bool(stale or meta["deltas"]) or any(f["removed"] for f in meta["fields"])})
        return out

    def backup(self, dir_: str, name: str) -> dict:
        """The object as it is now, written by the executors as an object of its own; writers aren't held up."""
        label = f"{name}.backup-{dt.datetime.now():%Y%m%d%H%M%S%f}"
        meta = self.catalog.meta(dir_, name)
        rows = self.catalog.read(dir_, name, meta)
        copy = meta | {"shards": {}, "deltas": [], "retired": [], "version": 0}
        self.catalog.commit(f"_backups/{dir_}", label, copy, rows, None, meta["count"])
        path = self.catalog.files.path("_backups", dir_, label)
        self.catalog.files.create(f"{path}/_manifests/{1:012d}.json", json.dumps(copy, indent=1).encode())
        return {"status": "backed_up", "path": path}

    def export_schema(self, dir_: str | None = None) -> dict:
        objects = []
        for d, o in self._objects(dir_, None):
            meta = self.catalog.meta(d, o)
            objects.append({"dir": d, "object": o, "splits": meta["splits"], "max_key": meta["max_key"], "fields": [Field(**f).spec for f in meta["fields"] if not f["removed"]], "indexes": meta["indexes"]})
        return {"version": 1, "objects": objects}

    def import_schema(self, manifest: Any, if_not_exists: bool = True) -> dict:
        manifest = json.loads(manifest) if isinstance(manifest, str) else manifest
        made = skipped = 0
        for x in manifest["objects"]:
            if x["object"] in self.catalog.objects(x["dir"]):
                if not if_not_exists:
                    raise RequestError(f"object exists: {x['object']}")
                skipped += 1
                continue
            self.catalog.create(x["dir"], x["object"], x["fields"], x.get("indexes", []), x.get("splits"), x.get("max_key"))
            made += 1
        return {"created": made, "skipped": skipped}
