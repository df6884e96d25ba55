"""Files as tables: a recursive listing with the indexer's filters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never entered, and the first bytes of executables (ELF, Mach-O of both widths and orders, fat and class files).
SKIPPED = ["target", ".git", "vendor", "node_modules", "Library", "Applications", ".Trash"]
MAGIC = ["7F454C46", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE"]
MAX_BYTES = 1_048_576


def folder_allowed(rel_path: Column) -> Column:
    """Whether no folder of a path is hidden or to be skipped. Hidden files are allowed."""
    parts = F.split(rel_path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return ~F.exists(folders, lambda p: p.startswith(".") | p.isin(SKIPPED))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def is_binary(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    return (F.length(head) == 8) & head.isin(MAGIC)


def within(size: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Whether a file isn't too large; one of just so many bytes is not."""
    return size <= max_bytes


def scan(spark: SparkSession, root: str, extensions: list[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """(rel_path, mtime_ns, size, content) of the files that are to be indexed; content is only read where it is used.

    Times are of milliseconds. Unreadable files are an error of the job that reads them. Spark's
    own listing leaves out names that begin with a dot or an underscore: those files are listed
    by the driver and read by tasks.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).unionByName(unlisted(spark, base))
    plain = F.regexp_replace("path", "^[a-z0-9+.-]+:/*", "/")
    home = "/" + base.split(":", 1)[-1].lstrip("/") + "/"
    rel = F.substring(plain, F.lit(len(home) + 1), F.length(plain))
    files = files.where(within(F.col("length"), max_bytes)).withColumn("rel_path", rel)
    files = files.where(folder_allowed(F.col("rel_path")) & extension(F.col("rel_path")).isin(extensions))
    return files.select("rel_path", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"), "content")


def unlisted(spark: SparkSession, root: str) -> DataFrame:
    """The same columns for the files that Spark's sources pass over by their names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, todo = [], [at]
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    while todo:
        for s in fs.listStatus(todo.pop()):
            name = s.getPath().getName()
            if s.isDirectory():
                if not name.startswith(".") and name not in SKIPPED:
                    todo.append(s.getPath())
            elif name.startswith((".", "_")):
                found.append((s.getPath().toString(), s.getModificationTime(), s.getLen()))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            content = []
            for p in pdf.path:
                store, own = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", p))
                with store.open_input_stream(own) as f:
                    content.append(f.read())
            yield pdf.assign(content=content)

    rows = spark.createDataFrame(found, "path string, ms long, length long").select("path", F.timestamp_millis("ms").alias("modificationTime"), "length")
    return rows.mapInPandas(read, "path string, modificationTime timestamp, length long, content binary")


def readable(files: DataFrame) -> DataFrame:
    """(rel_path, text, ...) of files that are neither executables nor invalid UTF-8."""
    files = files.where(~is_binary(F.col("content")) & F.is_valid_utf8(F.col("content").cast("string")))
    return files.withColumn("text", F.decode("content", "UTF-8")).drop("content")
