"""Keyed tables that are changed by what is written beside them.

A table is parts: rows in folders by a hash of the key, with the number of the change that wrote
them. A change writes its new rows and the keys that it replaces or deletes; a row is dead if a
later change names its key, which readers find by an anti-join with those keys. As many bytes are
written as the change has; parts of like size are merged, which drops dead rows. The last manifest
says what is in force, readers of one before see what it named until vacuum().
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifests import Manifests

#: Folders of a table, parts of like size (within as many times) that are merged, keys that are looked up as a filter of the scan.
BUCKETS, TIER, LISTED = 16, 4, 1000


class KeyedTable:
    """A table at a path: by default its last version, else the one named. Keys are unique; rows without a key are never replaced."""

    def __init__(self, spark: SparkSession, path: str, version: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._manifests = Manifests(spark, self.path)
        self.made = self._manifests.read(version)
        self.key, self.schema = self.made["key"], self.made["schema"]
        kind = next(x.dataType.simpleString() for x in spark.createDataFrame([], self.schema).schema if x.name == self.key)
        self._schemas = {"rows": f"{self.schema}, _seq int, part string, _bucket long", "gone": f"{self.key} {kind}, _seq int, part string"}

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS, by: str | None = None) -> KeyedTable:
        """An empty table. Its folders are of the values of column `by`, a whole number, where that is given, in place of hashes of the key."""
        made = Manifests(spark, path).put({"parts": [], "gone": [], "seq": 0, "buckets": buckets, "key": key, "schema": schema, "by": by})
        return cls(spark, path, made["name"])

    @property
    def version(self) -> str:
        return self.made["name"]

    # changes

    def change(self, rows: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Puts rows in, in place of those with their keys, and takes out the keys of deleted(key). All of it or none is seen."""
        seq, name, made = self.made["seq"] + 1, uuid.uuid4().hex, dict(self.made)
        many = 0
        if rows is not None:
            many = self._write(rows, name, seq)
            if many:
                made["parts"] = [*made["parts"], {"name": name, "rows": many, "seq": seq}]
        if self.made["parts"]:
            keys = [x.select(self.key) for x in ((self._read("rows", [name]) if many else None), deleted) if x is not None]
            if keys:
                gone = keys[0] if len(keys) == 1 else keys[0].union(keys[1])
                gone.where(F.col(self.key).isNotNull()).distinct().select(self.key, F.lit(seq).alias("_seq")).write.parquet(self._at("gone", name))
                made["gone"] = [*made["gone"], {"name": name, "seq": seq}]
        if made == self.made:
            return
        self.made = self._manifests.put(made | {"seq": seq}, self.made["name"])
        self._merge()

    def _write(self, rows: DataFrame, name: str, seq: int) -> int:
        columns = self.spark.createDataFrame([], self.schema).columns
        folder = F.col(self.made["by"]).cast("long") if self.made["by"] else self._bucket()
        out = rows.select(*columns, F.lit(seq).alias("_seq"), folder.alias("_bucket")).repartition(self.made["buckets"], "_bucket")
        out.sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(self._at("rows", name))
        return self._read("rows", [name]).count()

    def _merge(self) -> None:
        while True:
            tiers: dict[int, list[dict]] = {}
            for p in self.made["parts"]:
                tiers.setdefault(int(math.log(max(1, p["rows"]), TIER)), []).append(p)
            some = next((own for _, own in sorted(tiers.items()) if len(own) >= TIER), None)
            if some is None:
                return
            self.compact([p["name"] for p in some])

    def compact(self, names: list[str] | None = None) -> None:
        """Writes these parts, or all, as one without dead rows."""
        names = [p["name"] for p in self.made["parts"]] if names is None else names
        seq, name = self.made["seq"] + 1, uuid.uuid4().hex
        many = self._write(self._alive(self._read("rows", names)), name, seq)
        parts = [p for p in self.made["parts"] if p["name"] not in names] + [{"name": name, "rows": many, "seq": seq}] * bool(many)
        gone = [g for g in self.made["gone"] if any(p["seq"] < g["seq"] for p in parts)]
        self.made = self._manifests.put(self.made | {"parts": parts, "gone": gone, "seq": seq}, self.made["name"])

    def vacuum(self) -> int:
        """Deletes what the version in force doesn't name; says how much."""
        return self._manifests.vacuum({self.version, "rows", "gone", *(f"part={x['name']}" for x in [*self.made["parts"], *self.made["gone"]])}, "", "rows", "gone")

    # reading

    def _at(self, table: str, name: str) -> str:
        return f"{self.path}/{table}/part={name}"

    def _bucket(self, key=None):
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.made["buckets"])).cast("long")

    def _read(self, table: str, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self._schemas[table])
        return self.spark.read.schema(self._schemas[table]).option("basePath", f"{self.path}/{table}").parquet(*(self._at(table, n) for n in names))

    def _alive(self, rows: DataFrame) -> DataFrame:
        if not self.made["gone"]:
            return rows
        gone = self._read("gone", [g["name"] for g in self.made["gone"]]).groupBy(F.col(self.key).alias("_g")).agg(F.max("_seq").alias("_s"))
        return rows.join(gone, (F.col(self.key) == F.col("_g")) & (F.col("_s") > F.col("_seq")), "left_anti")

    def read(self) -> DataFrame:
        """The rows in force."""
        return self._alive(self._read("rows", [p["name"] for p in self.made["parts"]])).drop("_seq", "part", "_bucket")

    def folders(self, values: list[int]) -> DataFrame:
        """The rows in force in these folders of a table that has them by a column; others are not read."""
        return self._alive(self._read("rows", [p["name"] for p in self.made["parts"]]).where(F.col("_bucket").isin(values))).drop("_seq", "part", "_bucket")

    def lookup(self, keys: list | DataFrame) -> DataFrame:
        """The rows in force whose keys are among these. Where folders are of keys, only those that hold such keys are read."""
        rows = self._read("rows", [p["name"] for p in self.made["parts"]])
        if self.made["by"]:
            if isinstance(keys, DataFrame):
                return self._alive(rows.join(keys.select(self.key).distinct(), self.key, "left_semi")).drop("_seq", "part", "_bucket")
            return self._alive(rows.where(F.col(self.key).isin([k for k in keys if k is not None]))).drop("_seq", "part", "_bucket")
        if isinstance(keys, DataFrame):
            wanted = keys.select(self.key).where(F.col(self.key).isNotNull())
            here = [r.b for r in wanted.select(self._bucket().alias("b")).distinct().collect()]  # there are as many as folders at most
            found = rows.where(F.col("_bucket").isin(here)).join(wanted.distinct(), self.key, "left_semi")
        else:
            keys = list(dict.fromkeys(k for k in keys if k is not None))
            if len(keys) > LISTED:
                return self.lookup(self.spark.createDataFrame([(k,) for k in keys], self._schemas["gone"].split(",")[0]))
            here = F.array(*(self._bucket(F.lit(k).cast(dict(rows.dtypes)[self.key])) for k in keys)) if keys else F.array().cast("array<bigint>")  # folded, so folders are pruned
            found = rows.where(F.array_contains(here, F.col("_bucket")) & F.col(self.key).isin(keys))
        return self._alive(found).drop("_seq", "part", "_bucket")
