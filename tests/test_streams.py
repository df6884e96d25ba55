"""Listings as a stream: deletions, expiry, restarts."""

import pandas as pd
from pyspark.sql import functions as F

from lodewell.streaming import listings as L


def put(spark, at, rows, when):
    df = spark.createDataFrame(rows, "rel_path string, mtime_ns long, size long").withColumn("listed_at", F.timestamp_millis(F.lit(when)))
    df.select("rel_path", "mtime_ns", "size", "listed_at").coalesce(1).write.mode("append").parquet(f"{at}/in")


def run(spark, at, grace=1):
    L.follow_listings(spark, f"{at}/in", f"{at}/log", f"{at}/out", grace)
    return sorted((r.at_ms, r.rel_path, r.change) for r in spark.read.schema(L.CHANGE).parquet(f"{at}/out").collect())


def test_deletions_and_restart(spark, tmp_path):
    put(spark, tmp_path, [("a", 1, 1), ("b", 1, 1), ("c", 1, 1), (None, 1, 1), ("n", None, None)], 1000)
    put(spark, tmp_path, [("a", 1, 1), ("b", 2, 1), ("d", 1, 1), ("d", 1, 1), ("n", None, None)], 2000)
    first = [(1000, "a", "new"), (1000, "b", "new"), (1000, "c", "new"), (1000, "n", "new"), (1001, "c", "deleted"), (2000, "b", "changed"), (2000, "d", "new")]
    assert run(spark, tmp_path) == first
    put(spark, tmp_path, [("d", 1, 1), ("c", 5, 5)], 3000)  # the state goes on from the checkpoint
    assert run(spark, tmp_path) == sorted([*first, (2001, "a", "deleted"), (2001, "b", "deleted"), (2001, "n", "deleted"), (3000, "c", "new")])
    assert sorted(map(tuple, L.current(spark, f"{tmp_path}/out").collect())) == [("c", 5, 5), ("d", 1, 1)]
    assert len(run(spark, tmp_path)) == 11  # nothing new: nothing more


def test_time_to_live(spark, tmp_path):
    """An entry that was last seen just so long ago stays, one that was a millisecond before that goes."""
    put(spark, tmp_path, [("old", 1, 1)], 1_000)
    put(spark, tmp_path, [("edge", 1, 1)], 1_001)
    put(spark, tmp_path, [("new", 1, 1)], 6_001)
    assert [x for x in run(spark, tmp_path, grace=5_001) if x[2] == "deleted"] == [(6_001, "old", "deleted")]


def test_listing_of_many_files(spark, tmp_path):
    """Paths that share a bucket keep their own times, and one listing may be in many files."""
    for when, rows in ((1000, range(0, 300)), (2000, range(100, 400)), (3000, range(200, 500))):
        df = spark.createDataFrame([(f"p{i}", 1 + (i % 50 == 0) * when, 1) for i in rows], "rel_path string, mtime_ns long, size long").withColumn("listed_at", F.timestamp_millis(F.lit(when)))
        df.repartition(5).write.mode("append").parquet(f"{tmp_path}/in")
        L.follow_listings(spark, f"{tmp_path}/in", f"{tmp_path}/log", f"{tmp_path}/out", per_batch=None)
    got = sorted((r.at_ms, r.rel_path, r.change) for r in spark.read.schema(L.CHANGE).parquet(f"{tmp_path}/out").collect())
    want = [(1000, f"p{i}", "new") for i in range(300)] + [(2000, f"p{i}", "new") for i in range(300, 400)] + [(3000, f"p{i}", "new") for i in range(400, 500)]
    want += [(2000, f"p{i}", "changed") for i in range(100, 300, 50)] + [(3000, f"p{i}", "changed") for i in range(200, 400, 50)]
    assert got == sorted(want + [(1001, f"p{i}", "deleted") for i in range(100)] + [(2001, f"p{i}", "deleted") for i in range(100, 200)])


def test_calls_of_the_store_are_by_bucket():
    """However many paths a bucket has, it is one value that is read and written, with a timer for each time of listing."""
    calls, held, timers = [], {}, set()

    class Store:
        def exists(self):
            return "v" in held

        def get(self):
            calls.append("get")
            return held["v"]

        def update(self, v):
            calls.append("update")
            held["v"] = v

        def clear(self):
            held.clear()

    class Handle:
        getValueState = lambda self, name, schema: Store()
        registerTimer = lambda self, t: timers.add(t)
        deleteTimer = lambda self, t: timers.remove(t)

    class Expired:
        getExpiryTimeInMs = lambda self: 1001

    seen = L.Seen(1)
    seen.init(Handle())
    listing = lambda ids, when: pd.DataFrame({"rel_path": [f"p{i}" for i in ids], "mtime_ns": 1, "size": 1, "listed_at": pd.Timestamp(when, unit="ms")})
    assert sum(len(x) for x in seen.handleInputRows((0,), iter([listing(range(1000), 1000)]), None)) == 1000
    assert calls == ["update"] and timers == {1001}
    assert list(seen.handleInputRows((0,), iter([listing(range(600), 2000)]), None)) == [] and timers == {1001, 2001}
    gone = [x for pdf in seen.handleExpiredTimer((0,), None, Expired()) for x in pdf.rel_path]
    assert sorted(gone) == sorted(f"p{i}" for i in range(600, 1000)) and calls == ["update"] + ["get", "update"] * 2 and len(held["v"][0]) == 600
