"""``Engine(spark, root).request({...})``: one request object in, one response out."""

from __future__ import annotations

import json
import threading
import time
from collections import Counter
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from .access import Access
from .operators import aggregate as A
from .operators import find as Q
from .operators.joins import JoinSpec
from .operators.schema_ops import SchemaOps
from .operators.write import Writer
from .plans.types import RequestError
from .sources import formats
from .sources.blobs import Blobs
from .sources.catalog import Catalog
from .walks import Walks


class Timeout(RequestError):
    pass


def as_list(x: Any) -> list:
    if x is None or x == "":
        return []
    if isinstance(x, str):
        return json.loads(x) if x.lstrip().startswith("[") else [y.strip() for y in x.split(",")]
    return list(x)


class Engine:
    def __init__(self, spark: SparkSession, root: str, guarded: bool = False, response_rows: int = 1_000_000):
        """``guarded``: requests need a token or a trusted address. ``response_rows``: rows that a response, which the
        driver holds, has at most."""
        self.response_rows = response_rows
        self.spark, self.catalog = spark, Catalog(spark, root)
        self.access, self.guarded = Access(self.catalog.files), guarded
        self.writer, self.schemas, self.blobs = Writer(self.catalog), SchemaOps(self.catalog), Blobs(self.catalog)
        self.walks = Walks()
        self.started, self.served, self.slow = time.time(), Counter(), []

    # plans

    def joins(self, r: dict) -> list[JoinSpec]:
        items = r.get("join") or []
        items = json.loads(items) if isinstance(items, str) else items
        out = []
        for j in items if isinstance(items, list) else [items]:
            if not j.get("object") or not j.get("local") or not j.get("remote"):
                raise RequestError("a join needs object, local and remote")
            fields = Q.names(j.get("fields"))
            out.append(JoinSpec(self.catalog.table(r["dir"], j["object"]), j["local"], j["remote"], j.get("as") or j["object"], "left" if j.get("type") == "left" else "inner", tuple(fields) if fields else None))
        return out

    def frame(self, r: dict) -> DataFrame:
        """The lazy DataFrame of a find, count, aggregate, fetch or keys request."""
        mode, table, lenient = r.get("mode"), self.catalog.table(r["dir"], r["object"]), bool(r.get("lenient"))
        if mode == "find" and "cursor" in r:
            return Q.cursor_page(table, r.get("order_by"), r["cursor"] or None, r.get("limit"), r.get("criteria"), r.get("fields"), r.get("order", "asc"), as_list(r.get("excludedKeys")), lenient)
        if mode == "find":
            return Q.find(table, r.get("criteria"), r.get("fields"), r.get("offset", 0), r.get("limit"), as_list(r.get("excludedKeys")), r.get("order_by"), r.get("order", "asc"), self.joins(r), lenient)
        if mode == "count":
            return Q.count(table, r.get("criteria"), lenient)
        if mode == "aggregate":
            return A.aggregate(table, A.parse_specs(r.get("aggregates")), r.get("group_by"), r.get("criteria"), r.get("having"), r.get("order_by"), r.get("order", "asc"), r.get("limit"), bool(r.get("zero_is_absent")), lenient)
        if mode == "fetch":
            return Q.fetch(table, r.get("cursor"), r.get("limit"), r.get("fields"))
        if mode == "keys":
            return Q.keys(table, r.get("offset", 0), r.get("limit"))
        raise RequestError(f"no plan for mode {mode}")

    # responses

    def request(self, r: dict | str, ip: str | None = None) -> Any:
        """The response as JSON values, or text for CSV; errors are ``{"error": ...}``."""
        began = time.time()
        try:
            if isinstance(r, str):
                r = json.loads(r)
            handler = getattr(self, "_" + str(r.get("mode", "")).replace("-", "_"), None)
            if handler is None or not r.get("mode"):
                raise RequestError(f"unknown mode: {r.get('mode')}")
            if self.guarded:
                self.access.check(r, ip)
            if r.get("limit") == Q.ALL or Q.page_size(r.get("limit"), 0 if r["mode"] == "aggregate" else Q.GLOBAL_LIMIT) > self.response_rows:
                raise RequestError(f"a response is a page of {self.response_rows} rows at most: limit must be a number up to that (frame() takes more, write_csv and write_json put it into files)")
            self.served[r["mode"]] += 1
            return self._timed(handler, r)
        except Timeout as e:
            return {"error": "timeout", "detail": str(e)}
        except (RequestError, json.JSONDecodeError, KeyError) as e:
            return {"error": f"missing {e}" if isinstance(e, KeyError) else str(e)}
        finally:
            took = int(1000 * (time.time() - began))
            if isinstance(r, dict) and took > 500:
                self.slow = [*self.slow[-63:], {"mode": r.get("mode"), "object": r.get("object"), "duration_ms": took}]

    def _timed(self, handler: Any, r: dict) -> Any:
        """Jobs of a request with ``timeout_ms`` carry a tag, by which a timer stops them."""
        ms = int(r.get("timeout_ms") or 0)
        if ms <= 0:
            return handler(r)
        tag, over = f"request-{id(r)}-{time.monotonic_ns()}", threading.Event()

        def stop() -> None:
            over.set()
            self.spark.interruptTag(tag)

        timer = threading.Timer(ms / 1000, stop)
        self.spark.addTag(tag)
        timer.start()
        try:
            out = handler(r)
        except RequestError:
            raise
        except Exception:
            if over.is_set():
                raise Timeout(f"more than {ms} ms") from None
            raise
        finally:
            timer.cancel()
            self.spark.removeTag(tag)
        if over.is_set():
            raise Timeout(f"more than {ms} ms")
        return out

    def _find(self, r: dict) -> Any:
        form = r.get("format")
        if r.get("join"):
            if form == "dict":
                raise RequestError("format=dict is not supported with join")
            if "cursor" in r:
                raise RequestError("cursor is not supported with join")
            return formats.render(self.frame(r), None, "csv" if form == "csv" else "rows", r.get("delimiter"))
        if "cursor" in r:
            if form == "csv":
                raise RequestError("cursor is not supported with csv")
            if r.get("offset"):
                raise RequestError("offset is not supported with cursor")
            return self._cursor(r)
        return formats.render(self.frame(r), "key", form, r.get("delimiter"))

    def _cursor(self, r: dict) -> dict:
        meta = self.catalog.meta(r["dir"], r["object"])  # read before the plan is made: a write in between ends the walk
        walk = self.walks.take(r, meta)
        # a stream's jobs can't be stopped by a later request's timer
        rows, more = walk.page(Q.page_size(r.get("limit")), lambda n: self.frame(r | {"limit": n}), not r.get("timeout_ms"))
        by = r["order_by"]
        wanted = Q.names(r.get("fields"))
        shown = [{"key": x["key"], "value": {k: v for k, v in formats.record(x, "key").items() if wanted is None or k in wanted}} for x in rows]
        if not more:
            return {"rows": shown, "cursor": None}
        cursor = {by: formats.plain(rows[-1][by]), "key": rows[-1]["key"]}
        self.walks.put(r, meta, cursor, walk)
        return {"rows": shown, "cursor": cursor}

    def _count(self, r: dict) -> int:
        if not r.get("criteria"):
            return self.catalog.meta(r["dir"], r["object"])["count"]
        return self.frame(r).first()[0]

    def _held(self, df: DataFrame) -> Iterator[Row]:
        """All rows of a response, or an error if it can't hold them."""
        for i, row in enumerate(df.toLocalIterator()):
            if i == self.response_rows:
                raise RequestError(f"more than {self.response_rows} groups: give a limit (frame() takes them all)")
            yield row

    def _aggregate(self, r: dict) -> Any:
        specs = A.parse_specs(r.get("aggregates"))
        # a global aggregate of no rows is no row: their number comes from the same scan
        counted = bool(r.get("criteria")) and not Q.names(r.get("group_by")) and r.get("format") != "csv" and len(specs) < A.MAX_SPECS
        df = self.frame(r | {"aggregates": [*map(vars, specs), {"fn": "count", "alias": "__rows"}]} if counted else r)
        if r.get("format") == "csv":
            return formats.csv_lines(df.columns, self._held(df), formats.delimiter_of(r.get("delimiter")))
        rows = [{k: formats.plain(v) for k, v in x.asDict().items()} for x in self._held(df)]
        if Q.names(r.get("group_by")):
            return rows
        if counted:
            return {k: v for k, v in rows[0].items() if k != "__rows"} if rows and rows[0]["__rows"] else []
        if r.get("criteria") and self.frame({"mode": "count", "dir": r["dir"], "object": r["object"], "criteria": r["criteria"]}).first()[0] == 0:
            return []
        return rows[0] if rows else []

    def _fetch(self, r: dict) -> Any:
        n = Q.page_size(r.get("limit"))
        df = self.frame(r)
        if r.get("format") in ("csv", "rows", "dict"):
            return formats.render(df, "key", r["format"], r.get("delimiter"))
        results = formats.to_records(df, "key")
        return {"results": results, "cursor": results[-1]["key"] if len(results) == n else None}

    def _keys(self, r: dict) -> Any:
        found = [x[0] for x in self.frame(r).collect()]
        return formats.csv_lines(["key"], [[k] for k in found]) if r.get("format") == "csv" else found

    def _get(self, r: dict) -> Any:
        if "keys" in r:
            df = Q.get_many(self.catalog.table(r["dir"], r["object"]), as_list(r["keys"]), r.get("fields"))
            rows = df.collect()
            if r.get("format") == "csv":
                columns = [c for c in df.columns if c != "_found"]
                return formats.csv_lines(columns, [[x[c] for c in columns] for x in rows], formats.delimiter_of(r.get("delimiter")))
            return {x["key"]: {k: v for k, v in formats.record(x, "key").items() if k != "_found"} if x["_found"] else None for x in rows}
        row = Q.get(self.catalog.table(r["dir"], r["object"], r["key"]), r["key"], r.get("fields")).first()
        return {"error": "Not found"} if row is None else formats.record(row, "key")

    def _exists(self, r: dict) -> Any:
        if "keys" in r:
            rows = Q.exists_many(self.catalog.table(r["dir"], r["object"]), as_list(r["keys"])).collect()
            return formats.csv_lines(["key", "exists"], rows) if r.get("format") == "csv" else {x["key"]: x["found"] for x in rows}
        return not Q.get(self.catalog.table(r["dir"], r["object"], r["key"]), r["key"], []).isEmpty()

    def _not_exists(self, r: dict) -> list:
        return [x[0] for x in Q.not_exists(self.catalog.table(r["dir"], r["object"]), as_list(r["keys"])).collect()]

    def _size(self, r: dict) -> int:
        return self.catalog.meta(r["dir"], r["object"])["count"]

    def _orphaned(self, r: dict) -> int:
        self.catalog.meta(r["dir"], r["object"])
        return 0

    # writes

    def _insert(self, r: dict) -> dict:
        return self.writer.insert(r["dir"], r["object"], r["key"], r.get("value") or {}, bool(r.get("if_not_exists")), r.get("if"))

    def _update(self, r: dict) -> dict:
        return self.writer.update(r["dir"], r["object"], r["key"], r.get("value") or {}, r.get("if"), bool(r.get("dry_run")))

    def _delete(self, r: dict) -> dict:
        return self.writer.delete(r["dir"], r["object"], r["key"], r.get("if"), bool(r.get("dry_run")))

    def _bulk_insert(self, r: dict) -> dict:
        rows = self.writer.rows_from(r["dir"], r["object"], r["file"]) if r.get("file") else r.get("records") or []
        return self.writer.bulk_insert(r["dir"], r["object"], rows, bool(r.get("if_not_exists")))

    def _bulk_insert_delimited(self, r: dict) -> dict:
        rows = self.writer.rows_from(r["dir"], r["object"], r["file"], r.get("delimiter") or "|")
        return self.writer.bulk_insert(r["dir"], r["object"], rows, bool(r.get("if_not_exists")), defaults=False)

    def _bulk_update(self, r: dict) -> dict:
        d, o = r["dir"], r["object"]
        if r.get("criteria"):
            return self.writer.bulk_update_where(d, o, r["criteria"], r.get("value") or {}, r.get("limit"), r.get("if"), bool(r.get("dry_run")))
        if r.get("file"):
            return self.writer.bulk_update(d, o, self.writer.rows_from(d, o, r["file"]))
        if "records" not in r:
            raise RequestError("bulk-update needs criteria, records or file")
        return self.writer.bulk_update(d, o, r["records"])

    def _bulk_update_delimited(self, r: dict) -> dict:
        return self.writer.bulk_update(r["dir"], r["object"], self.writer.rows_from(r["dir"], r["object"], r["file"], r.get("delimiter") or "|"))

    def _bulk_delete(self, r: dict) -> dict:
        if "keys" in r or r.get("file"):
            return self.writer.bulk_delete(r["dir"], r["object"], as_list(r.get("keys")), r.get("file"))
        return self.writer.bulk_delete_where(r["dir"], r["object"], r.get("criteria"), r.get("limit"), r.get("if"), bool(r.get("dry_run")))

    def _sequence(self, r: dict) -> dict:
        return self.writer.sequence(r["dir"], r["object"], r["name"], r.get("action", "next"), r.get("batch", 1), r.get("value", 0))

    # schemas

    def _create_object(self, r: dict) -> dict:
        meta = self.catalog.create(r["dir"], r["object"], as_list(r.get("fields")) if isinstance(r.get("fields"), list) else r.get("fields", "").split("|"), as_list(r.get("indexes")), r.get("splits"), r.get("max_key"), bool(r.get("if_not_exists")))
        shown = self.schemas.describe(r["dir"], r["object"])
        return {"status": "created", "object": r["object"], "splits": meta["splits"], "max_key": meta["max_key"], "value_size": shown["value_size"], "fields": len(shown["fields"])}

    def _drop_object(self, r: dict) -> dict:
        return {"status": "dropped" if self.catalog.drop(r["dir"], r["object"], bool(r.get("if_exists"))) else "not_found", "object": r["object"]}

    def _add_field(self, r: dict) -> dict:
        return self.schemas.add_fields(r["dir"], r["object"], list(r["fields"]) if "fields" in r else [r["field"]])

    def _rename_field(self, r: dict) -> dict:
        return self.schemas.rename_field(r["dir"], r["object"], r["old"], r["new"])

    def _remove_field(self, r: dict) -> dict:
        return self.schemas.remove_fields(r["dir"], r["object"], as_list(r["fields"]) if "fields" in r else [r["field"]])

    def _vacuum(self, r: dict) -> dict:
        return self.schemas.vacuum(r["dir"], r["object"], bool(r.get("compact")), int(r["splits"]) if r.get("splits") else None)

    def _truncate(self, r: dict) -> dict:
        return self.schemas.truncate(r["dir"], r["object"])

    def _recount(self, r: dict) -> dict:
        return self.schemas.recount(r["dir"], r["object"])

    def _add_index(self, r: dict) -> dict:
        return self.schemas.add_indexes(r["dir"], r["object"], as_list(r["fields"]) if "fields" in r else [r["field"]], bool(r.get("force")))

    def _remove_index(self, r: dict) -> dict:
        return self.schemas.remove_indexes(r["dir"], r["object"], as_list(r["fields"]) if "fields" in r else [r["field"]])

    def _reindex(self, r: dict) -> dict:
        return self.schemas.reindex(r.get("dir"), r.get("object"))

    def _backup(self, r: dict) -> dict:
        return self.schemas.backup(r["dir"], r["object"])

    def _export_schema(self, r: dict) -> dict:
        return self.schemas.export_schema(r.get("dir"))

    def _import_schema(self, r: dict) -> dict:
        return self.schemas.import_schema(r["manifest"], r.get("if_not_exists", True))

    def _list_objects(self, r: dict) -> list:
        return self.catalog.objects(r["dir"])

    def _describe_object(self, r: dict) -> dict:
        return self.schemas.describe(r["dir"], r["object"])

    def _db_dirs(self, r: dict) -> list:
        return [d for d in self.catalog.dirs() if not d.startswith("_")]

    def _add_dir(self, r: dict) -> dict:
        self.catalog.add_dir(r["dir"])
        return {"status": "dir_added", "dir": r["dir"]}

    def _remove_dir(self, r: dict) -> dict:
        self.catalog.remove_dir(r["dir"], bool(r.get("check_empty", True)))
        return {"status": "dir_removed", "dir": r["dir"]}

    # access

    def _add_token(self, r: dict) -> dict:
        return self.access.add_token(r.get("token") or "", r.get("dir"), r.get("object"), r.get("perm") or "rw")

    def _remove_token(self, r: dict) -> dict:
        return self.access.remove_token(r.get("token"), r.get("fingerprint"))

    def _list_tokens(self, r: dict) -> list:
        return self.access.tokens()

    def _add_ip(self, r: dict) -> list:
        return self.access.ips(add=r["ip"])

    def _remove_ip(self, r: dict) -> list:
        return self.access.ips(remove=r["ip"])

    def _list_ips(self, r: dict) -> list:
        return self.access.ips()

    # diagnostics

    def _stats(self, r: dict) -> dict:
        return {"uptime_ms": int(1000 * (time.time() - self.started)), "requests": dict(self.served), "active_jobs": len(self.spark.sparkContext.statusTracker().getActiveJobsIds()), "slow_queries": self.slow}

    def _stats_prom(self, r: dict) -> str:
        lines = ["# TYPE engine_uptime_seconds gauge", f"engine_uptime_seconds {time.time() - self.started:.3f}", "# TYPE engine_requests_total counter"]
        return "\n".join([*lines, *(f'engine_requests_total{{mode="{m}"}} {n}' for m, n in sorted(self.served.items()))]) + "\n"

    def _shard_stats(self, r: dict) -> Any:
        found = self.schemas.shard_stats(r.get("dir"), r.get("object"))
        return found[0] if r.get("object") and found else found

    def _vacuum_check(self, r: dict) -> list:
        return self.schemas.vacuum_check()

    # files

    def _put_file(self, r: dict) -> dict:
        return self.blobs.put(r["dir"], r["object"], r["filename"], r["data"], bool(r.get("if_not_exists")))

    def _get_file(self, r: dict) -> dict:
        return self.blobs.get(r["dir"], r["object"], r["filename"])

    def _get_file_path(self, r: dict) -> dict:
        return self.blobs.path(r["dir"], r["object"], r["filename"])

    def _delete_file(self, r: dict) -> dict:
        return self.blobs.delete(r["dir"], r["object"], r["filename"])

    def _list_files(self, r: dict) -> dict:
        pattern = r.get("pattern") or r.get("prefix") or ""
        return self.blobs.list(r["dir"], r["object"], pattern, r.get("match", "prefix"), int(r.get("offset") or 0), int(r.get("limit") or 100))
