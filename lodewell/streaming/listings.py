"""Successive listings of a folder as a stream of changes: additions, changes, deletions, expiry.

The state of a path is what its last listing said. Paths are dealt to buckets by a hash, and a bucket's
are one value in the state store (RocksDB), since a call of the store for each path takes longer than
all else. There are event-time timers for when the bucket's paths were last seen: a path that no
listing has renewed by then is gone. With no grace that is the first later listing without it, a
deletion; with a time to live it is the expiry of a cached entry. Nothing is compared but the rows of
a listing with their own states, and the state goes on from the checkpoint after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LISTING = "rel_path string, mtime_ns long, size long, listed_at timestamp"
CHANGE = "rel_path string, change string, mtime_ns long, size long, at_ms long"
STATE = "rel_path array<string>, mtime_ns array<long>, size array<long>, at_ms array<long>"
#: Some hundred paths of a million, some 10 MB of a thousand million. A checkpoint holds with one number only.
BUCKETS = 4096
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Seen(StatefulProcessor):
    """The last listings of a bucket's paths; `grace` milliseconds after its own a path is gone, if it hasn't been listed again."""

    def __init__(self, grace: int):
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def _known(self) -> dict[str, tuple[int, int, int]]:
        """(mtime_ns, size, at_ms) by path."""
        if not self.last.exists():
            return {}
        paths, *stamps = self.last.get()
        return dict(zip(paths, zip(*stamps, strict=True), strict=True))

    def _keep(self, known: dict[str, tuple[int, int, int]]) -> None:
        if known:
            self.last.update((list(known), *map(list, zip(*known.values(), strict=True))))
        else:
            self.last.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        known, out, own = self._known(), [], []
        due = {at for _, _, at in known.values()}
        for pdf in rows:
            at = pdf.listed_at.to_numpy().astype("datetime64[ns]").astype("int64") // 1_000_000
            own += zip(at.tolist(), pdf.mtime_ns.tolist(), pdf["size"].tolist(), pdf.rel_path.tolist(), strict=True)
        for at, mtime, size, path in sorted(own):
            before = known.get(path)
            if before is not None and at < before[2]:
                continue  # a listing that came late says nothing new
            if before is None or (mtime, size) != before[:2]:
                out.append((path, "new" if before is None else "changed", mtime, size, at))
            known[path] = (mtime, size, at)
        now = {at for _, _, at in known.values()}
        for at in due - now:
            self.handle.deleteTimer(at + self.grace)
        for at in now - due:
            self.handle.registerTimer(at + self.grace)
        self._keep(known)
        if out:
            yield pd.DataFrame(out, columns=["rel_path", "change", "mtime_ns", "size", "at_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        known, due = self._known(), expiredTimerInfo.getExpiryTimeInMs()
        gone = [(path, "deleted", mtime, size, due) for path, (mtime, size, at) in known.items() if at + self.grace == due]
        if gone:
            for path, *_ in gone:
                del known[path]
            self._keep(known)
            yield pd.DataFrame(gone, columns=["rel_path", "change", "mtime_ns", "size", "at_ms"])

    def close(self) -> None:
        pass


def changes(listings: DataFrame, grace: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(rel_path, change, mtime_ns, size, at_ms) of a stream of LISTING: new, changed or deleted.

    A path is deleted once a listing is known that is `grace` milliseconds or more (at least one)
    later than the last that had it. Rows without a path or a time are left out; of two rows of a
    path in one listing the larger stamps count. Unchanged paths give no row.
    """
    rows = listings.where("rel_path is not null and listed_at is not null").fillna(-1, ["mtime_ns", "size"])
    rows = rows.withWatermark("listed_at", "0 seconds")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("rel_path"), F.lit(buckets)).cast("int"))
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Seen(grace), outputStructType=CHANGE, outputMode="append", timeMode="eventtime")


def follow_listings(spark: SparkSession, source: str, checkpoint: str, table: str, grace: int = 1, per_batch: int | None = 1) -> None:
    """Takes in the listings (Parquet files) that have come to a folder, in the order of their files, and appends the changes to a table of Parquet files; goes on from the checkpoint. A listing has to be in one batch: a file, or with per_batch None all the files that have come since the last time."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    reader = spark.readStream.schema(LISTING)
    rows = (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(source)
    out = changes(rows, grace).writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    out.trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, table: str) -> DataFrame:
    """(rel_path, mtime_ns, size): the paths that are there by the changes of a table."""
    rows = spark.read.schema(CHANGE).parquet(table)
    last = rows.groupBy("rel_path").agg(F.max_by(F.struct("change", "mtime_ns", "size"), F.struct("at_ms", (F.col("change") != "deleted").alias("there"))).alias("x"))
    return last.where("x.change <> 'deleted'").select("rel_path", "x.mtime_ns", "x.size")
