"""Files through Hadoop's FileSystem, so that metadata lives wherever the data does."""

from __future__ import annotations

import os
import time
import uuid
from pathlib import PurePosixPath
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        # classes are looked up once: each part of a name is a call to the JVM
        self._path, self._io = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.org.apache.commons.io.IOUtils
        self._fs = self._at(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def _at(self, path: str):
        return self._path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def read(self, path: str) -> bytes:
        stream = self._fs.open(self._at(path))
        try:
            return bytes(self._io.toByteArray(stream))
        finally:
            stream.close()

    def _beside(self, path: str, data: bytes) -> str:
        """A whole file under another name in the folder of ``path``."""
        folder = self._at(str(PurePosixPath(path).parent)) if "://" not in path else self._at(path).getParent()
        self._fs.mkdirs(folder)
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._at(beside), False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        return beside

    def create(self, path: str, data: bytes) -> bool:
        """A new file, whole or not at all; false if the path is taken, also by a writer in another process.

        Hadoop's rename onto a file that is there fails in shared file systems, in one step; the local one would
        replace it, so there a hard link is made."""
        beside = self._beside(path, data)
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(urlparse(beside).path, urlparse(path).path)
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(self._at(beside), False)
        done = not self.exists(path) and self._fs.rename(self._at(beside), self._at(path))
        if not done:
            self._fs.delete(self._at(beside), False)
        return done

    def write(self, path: str, data: bytes, overwrite: bool = True) -> None:
        """Written beside and renamed. Of two writers the later one counts; a reader may find no file while one is replaced."""
        if not overwrite:
            if not self.create(path, data):
                raise FileExistsError(path)
            return
        beside = self._beside(path, data)
        target = self._at(path)
        if self._fs.exists(target):
            self._fs.delete(target, False)
        if not self._fs.rename(self._at(beside), target):
            self._fs.delete(self._at(beside), False)
            raise FileExistsError(path)

    def age(self, path: str) -> float:
        """Seconds since a file or folder changed."""
        return time.time() - self._fs.getFileStatus(self._at(path)).getModificationTime() / 1000

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._at(path), True)

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._at(path))

    def list(self, path: str) -> list[tuple[str, bool, int]]:
        """(name, is a folder, bytes), by name."""
        if not self.exists(path):
            return []
        return sorted((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in self._fs.listStatus(self._at(path)))
