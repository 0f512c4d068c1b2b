"""Small files in any store that Spark can reach, through Hadoop's file systems.

``publish`` is create-if-absent.  On local disks a hard link takes the name, elsewhere a rename that
must not overwrite: both are atomic on local disks and HDFS-like stores.  Object stores without an
atomic rename need a connector that offers one; without it two writers may both win a name.
Each file carries a CRC-32 of its content, so that a torn one isn't taken for a whole one.
"""

from __future__ import annotations

import json
import os
import zlib

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class TornFile(ValueError):
    """A file that isn't what was published."""


def _sealed(value: dict) -> dict:
    return value | {"crc": zlib.crc32(json.dumps(value, sort_keys=True).encode())}


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def size(self, folder: str) -> int:
        path = self._path(folder)
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else 0

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            data = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        try:
            value = json.loads(data.decode())
            crc = value.pop("crc", None)
        except (ValueError, AttributeError, TypeError) as wrong:
            raise TornFile(f"{name} is torn") from wrong
        if crc is not None and crc != _sealed(value)["crc"]:
            raise TornFile(f"{name} is torn")
        return value

    def publish(self, name: str, value: dict) -> bool:
        """Writes a file whole or not at all; false if it is there already."""
        target, made = self._path(name), self._path(f"{name}.{self._jvm.java.util.UUID.randomUUID()}.tmp")
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(made, False)
        try:
            stream.write(bytearray(json.dumps(_sealed(value), sort_keys=True).encode()))
        finally:
            stream.close()
        try:
            return self._named(made, target)
        finally:
            self._fs.delete(made, False)

    def _named(self, made, target) -> bool:
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(made.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        option = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self._gateway.new_array(option, 1)
        none[0] = option.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(made, target, none)
        except Py4JJavaError as failed:
            if failed.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
