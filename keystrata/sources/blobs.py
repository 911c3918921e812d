"""Files kept beside an object: put, get, path, delete and list."""

from __future__ import annotations

import base64
import fnmatch
import re

from pyspark.sql import DataFrame

from ..plans.types import RequestError
from .catalog import Catalog

MATCHES = {"prefix": str.startswith, "suffix": str.endswith, "contains": str.__contains__, "glob": fnmatch.fnmatchcase}


class Blobs:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def _path(self, dir_: str, name: str, file: str) -> str:
        self.catalog.meta(dir_, name)
        if not file or len(file.encode()) > 255 or re.search(r"[/\\\x00-\x1f]", file) or file in (".", ".."):
            raise RequestError("invalid filename")
        return self.catalog.files.path(dir_, name, "files", file)

    def put(self, dir_: str, name: str, file: str, data: str, if_not_exists: bool = False) -> dict:
        path = self._path(dir_, name, file)
        if if_not_exists and self.catalog.files.exists(path):
            return {"error": "file exists", "filename": file}
        try:
            raw = base64.b64decode(re.sub(r"\s", "", data or ""), validate=True)
        except ValueError:
            raise RequestError("invalid base64") from None
        self.catalog.files.write(path, raw)
        return {"status": "stored", "filename": file, "bytes": len(raw)}

    def get(self, dir_: str, name: str, file: str) -> dict:
        path = self._path(dir_, name, file)
        if not self.catalog.files.exists(path):
            raise RequestError("file not found")
        raw = self.catalog.files.read(path)
        return {"status": "ok", "filename": file, "bytes": len(raw), "data": base64.b64encode(raw).decode()}

    def path(self, dir_: str, name: str, file: str) -> dict:
        path = self._path(dir_, name, file)
        if not self.catalog.files.exists(path):
            raise RequestError("file not found")
        return {"path": path}

    def delete(self, dir_: str, name: str, file: str) -> dict:
        path = self._path(dir_, name, file)
        if not self.catalog.files.exists(path):
            raise RequestError("file not found")
        self.catalog.files.delete(path)
        return {"status": "deleted", "filename": file}

    def list(self, dir_: str, name: str, pattern: str = "", match: str = "prefix", offset: int = 0, limit: int = 100) -> dict:
        if match not in MATCHES:
            raise RequestError(f"unknown match: {match}")
        self.catalog.meta(dir_, name)
        found = [n for n, folder, _ in self.catalog.files.list(self.catalog.files.path(dir_, name, "files")) if not folder and (not pattern or MATCHES[match](n, pattern))]
        return {"files": found[offset : offset + limit], "total": len(found), "offset": offset, "limit": limit}

    def frame(self, dir_: str, name: str) -> DataFrame:
        """All files as rows, read by the executors."""
        return self.catalog.spark.read.format("binaryFile").load(self.catalog.files.path(dir_, name, "files"))
