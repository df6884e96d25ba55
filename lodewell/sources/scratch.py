"""The folder for tables that queries leave to one another: shared by driver and executors, gone with the application."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def local(spark: SparkSession) -> bool:
    """Whether executors are in the driver's process, and so share its folders."""
    return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    key = spark.sparkContext.applicationId
    if key not in _own:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at:
            _own[key] = f"{at.rstrip('/')}/lodewell-{key}-{uuid.uuid4().hex[:8]}"
            atexit.register(_drop, spark, _own[key])
        elif local(spark):
            base = tempfile.mkdtemp(prefix="lodewell-")
            atexit.register(shutil.rmtree, base, True)
            _own[key] = f"file://{base}"
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own[key]


def _drop(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def saved(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table: lineage ends there, and sizes are those of its files (a checkpoint's are estimates, which grow exponentially over rounds of joins)."""
    spark, at = df.sparkSession, f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._scratch_path = at
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that saved() wrote, once nothing reads them any more."""
    for df in tables:
        _drop(df.sparkSession, df._scratch_path)
