"""Versions of a stored index: small JSON manifests that say which folders are in force, put in place by one rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from ..errors import StorageError


class Manifests:
    """The manifests of a folder, m-number-id. The last one is in force, or the one that a reader names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.at = spark, path.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        at = self.at(self.path)
        return sorted(n for x in self.fs.listStatus(at) if (n := x.getPath().getName()).startswith("m-")) if self.fs.exists(at) else []

    def read(self, name: str | None = None) -> dict:
        name = name or self.names()[-1]
        stream = self.fs.open(self.at(f"{self.path}/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"name": name}
        finally:
            stream.close()

    def put(self, made: dict, after: str | None = None) -> dict:
        """Puts a manifest in force next to the one named `after`, or to the last; returns it with its name."""
        number = int((after or ([""] + self.names())[-1] or "m-000000000")[2:11]) + 1
        name, staged = f"m-{number:09d}-{uuid.uuid4().hex}", self.at(f"{self.path}/.staged-{uuid.uuid4().hex}")
        out = self.fs.create(staged)
        out.write(bytearray(json.dumps({k: v for k, v in made.items() if k != "name"}).encode()))
        out.close()
        if not self.fs.rename(staged, self.at(f"{self.path}/{name}")):
            self.fs.delete(staged, False)
            raise StorageError(f"a version of {self.path} can't be put in force")
        return made | {"name": name}

    def vacuum(self, keep: set[str], *folders: str) -> int:
        """Deletes what is in the folders (by default this one) and isn't named; says how much."""
        n = 0
        for folder in folders or ("",):
            at = self.at(f"{self.path}/{folder}" if folder else self.path)
            for x in self.fs.listStatus(at) if self.fs.exists(at) else []:
                if x.getPath().getName() not in keep and not x.getPath().getName().startswith("."):
                    self.fs.delete(x.getPath(), True)
                    n += 1
        return n
