"""Shared plumbing of the training-data operators: scratch tables and column helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for every operator that works on words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a record batch that goes to a Python worker.
ARROW_ROWS = 2048
_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and executors are in the driver's process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _local:
        _local[key] = "file://" + tempfile.mkdtemp(prefix="lodewell-")
    return _local[key]


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    Results are lazy and may read them later, so they go when the driver exits,
    or earlier by drop().
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lodewell/{tag}-{uuid.uuid4().hex}"
        self._n, self._saved = 0, []
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Writes a table and reads it again. Python stages in it get record batches of few rows, whatever the session's setting."""
        at, conf, key = self.path(name), self.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(key)
        conf.set(key, ARROW_ROWS)
        try:
            df.write.option("compression", codec).parquet(at)
        finally:
            conf.set(key, before)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        self._saved.append(out)
        return out

    def keep(self, *needed: DataFrame) -> None:
        """Deletes all tables that were saved but those needed on."""
        for df in self._saved:
            if not any(df is x for x in needed):
                self.drop(df)
        self._saved = list(needed)

    def drop(self, df: DataFrame | None = None) -> None:
        at = self.root if df is None else df._scratch_path
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the session has ended: the folder's owner clears it
            pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shuffled(rows: DataFrame) -> DataFrame:
    """rows, of which there may be as many as the input has: their joins shuffle both sides, none goes to the driver to be broadcast."""
    return rows.hint("merge")


def no_null(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def held_out(doc_id: str | Column, fold: int, of: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id is never held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(of)) == fold, F.lit(False))


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 512) -> Callable:
    """run over record batches of at most so many rows, for mapInArrow. Workers live on between tasks: what run leaves goes back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped
