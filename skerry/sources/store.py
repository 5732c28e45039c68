"""Small objects in a folder of any file system Spark can reach, with conditional puts."""

from __future__ import annotations

import json
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    """Objects by key under a root: manifests, catalogue versions and models, never rows.

    ``put_if_absent`` is what commits are built on; it is as atomic as the file
    system's exclusive create.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, key: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    def _write(self, key: str, data: bytes, replace: bool) -> None:
        out = self._fs.create(self._path(key), replace)
        out.write(bytearray(data))
        out.close()

    def put(self, key: str, data: bytes) -> None:
        self._write(key, data, True)

    def put_if_absent(self, key: str, data: bytes) -> bool:
        """False if the key is there already."""
        try:
            self._write(key, data, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def get(self, key: str) -> bytes:
        stream = self._fs.open(self._path(key))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def get_json(self, key: str) -> Any:
        return json.loads(self.get(key))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it is missing."""
        at = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._path(key))

    def delete(self, key: str) -> bool:
        """The object, or the folder with all in it."""
        return self._fs.delete(self._path(key), True)
