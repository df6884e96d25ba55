import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodewell.llm import kdtree


def test_laws(spark, docs_of, tmp_path):
    r = random.Random(1)
    rows = [(i, "x" * int(r.paretovariate(0.8) * 20), r.choice(["en", "en", "de", None]), "src0" if r.random() < 0.4 else f"src{r.randrange(9)}") for i in range(3000)]
    rows = [(i, t[:30000], a, b) for i, t, a, b in rows] + [(5000 + i, "copy", "en", "src0") for i in range(1500)] + [(9000, None, None, None), (None, "", "fr", "src1")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = kdtree.op2_kdtree_sharding(spark, str(tmp_path)).collect()
    size = {i: len((t or "").encode()) + 16 for i, t, _, _ in rows}
    text = {i: t or "" for i, t, _, _ in rows}
    assert len(got) == len(rows)
    total = [0] * 40
    slots = [[] for _ in range(40)]
    for x in got:
        assert x.size == size[x.doc_id] and x.text_crc32 == zlib.crc32(text[x.doc_id].encode())
        total[x.shard] += x.size
        slots[x.shard].append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    mean = sum(total) / 40
    assert max(total) - mean <= 0.02 * mean + 30016 and mean - min(total) <= 0.02 * mean + 30016


@pytest.mark.parametrize("heavy", [[1_000_000], [400_000, 300_000, 45_000, 40_000, 38_000]])
def test_heavy_rows_leave_no_shard_empty(spark, docs_of, tmp_path, heavy):
    """A text of half the table, and texts that are over an even share once larger ones are taken out."""
    r = random.Random(7)
    rows = [(i, "x" * r.randint(1, 800), r.choice(["en", "de"]), f"src{r.randrange(5)}") for i in range(2500)]
    rows += [(9000 + i, "y" * n, "en", "src1") for i, n in enumerate(heavy)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = kdtree.op2_kdtree_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    total, slots = [0] * 40, [[] for _ in range(40)]
    for x in got:
        total[x.shard] += x.size
        slots[x.shard].append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    alone = {x.shard for x in got if x.doc_id >= 9000}
    assert len(alone) == len(heavy) and all(len(slots[s]) == 1 for s in alone)
    rest = [t for s, t in enumerate(total) if s not in alone]
    mean = sum(rest) / len(rest)
    assert max(rest) - mean <= 0.02 * mean + 816 and mean - min(rest) <= 0.02 * mean + 816


def test_medians_and_widest(spark):
    """Against a plain k-d tree: with unit sizes and a power of two of shards splits are exact medians of the widest dimension."""
    rows = [(i, float(i % 97), float((i * 7) % 13)) for i in range(1024)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.id: r.shard for r in kdtree.shard(df, {"x": F.col("x"), "y": F.col("y")}, F.lit(1), shards=4, tolerance=0.0).collect()}
    counts = [list(got.values()).count(s) for s in range(4)]
    assert counts == [256] * 4
    low = sorted(x for i, x, _ in rows if got[i] < 2)
    high = sorted(x for i, x, _ in rows if got[i] >= 2)
    assert low[-1] <= high[0]  # the first split is along x


def test_small(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert kdtree.op2_kdtree_sharding(spark, f"{tmp_path}/e").count() == 0
    docs_of([(1, "a"), (1, "a"), (2, None)]).write.parquet(f"{tmp_path}/s/documents.parquet")
    assert len(kdtree.op2_kdtree_sharding(spark, f"{tmp_path}/s").collect()) == 3
    df = docs_of([(i, "abc") for i in range(100)])
    assert kdtree.shard(df, {"n": F.col("doc_id")}, F.lit(10), target_bytes=100).agg(F.count_distinct("shard")).first()[0] == 10


def plain_tree(rows, k):
    """Shards of (key..., size, id) rows by a k-d tree in memory: widest dimension, weighted quantile, down to k shards."""
    if k == 1 or not rows:
        return [rows] if k == 1 else [[]] * k
    dims = len(rows[0]) - 2
    d = max(range(dims), key=lambda i: (max(r[i] for r in rows) - min(r[i] for r in rows), -i))
    rows = sorted(rows, key=lambda r: r[d])
    need, upto, at = sum(r[-2] for r in rows) * (k // 2) / k, 0, 0
    while at < len(rows) and upto < need:
        upto += rows[at][-2]
        at += 1
    if at and upto - need > rows[at - 1][-2] / 2:  # nearer to the row's begin
        at -= 1
    return plain_tree(rows[:at], k // 2) + plain_tree(rows[at:], k - k // 2)


@pytest.mark.parametrize("shards", [2, 7, 40])
def test_against_a_plain_tree(spark, shards):
    r = random.Random(shards)
    xs, ys = r.sample(range(10**6), 1500), r.sample(range(3 * 10**6), 1500)  # no coordinate twice, so there are no ties to part
    rows = [(i, float(x), float(y), r.randint(1, 50)) for i, (x, y) in enumerate(zip(xs, ys, strict=True))]
    df = spark.createDataFrame(rows, "id long, x double, y double, size long")
    got = {x.id: x.shard for x in kdtree.shard(df, {"x": F.col("x"), "y": F.col("y")}, F.col("size"), shards=shards, tolerance=0.0).collect()}
    lo, hi = {c: min(x[c] for x in rows) for c in (1, 2)}, {c: max(x[c] for x in rows) for c in (1, 2)}
    scaled = [(*(int((x[c] - lo[c]) / (hi[c] - lo[c]) * kdtree.TOP) for c in (1, 2)), x[3], x[0]) for x in rows]
    want = {x[-1]: n for n, part in enumerate(plain_tree(scaled, shards)) for x in part}
    assert got == want


def test_target_bytes_is_never_exceeded(spark, docs_of):
    r = random.Random(3)
    rows = [(i, "x" * r.choice([1, 5, 50, 400])) for i in range(700)] + [(1000 + i, "same") for i in range(500)] + [(5000, "z" * 9000)]
    df = docs_of(rows).withColumns({c: F.lit("own") for c in ("shard", "slot", "d", "t", "a", "z", "step", "need", "key", "bin")})
    out = kdtree.shard(df, {"n": F.col("doc_id"), "l": F.length("text")}, F.length("text"), target_bytes=2000)
    got = out.groupBy("shard").agg(F.sum(F.length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert all(x.b <= 2000 or x.n == 1 for x in got) and len(got) <= 2.5 * sum(len(t) for _, t in rows) / 2000
    assert sorted(x.shard for x in got) == list(range(len(got))) and {(x.d, x.t, x.key) for x in out.collect()} == {("own",) * 3}


def test_ranks(spark, docs_of):
    from lodewell.llm._common import Scratch

    names = [None, "", "http://a.example/very/long/shared/prefix/1", "http://a.example/very/long/shared/prefix/2", "é", "z", "z"] + [f"domain0.{i}" for i in range(40)]
    rows = [(i, "t", None, n) for i, n in enumerate(names * 2)]
    got = kdtree.with_rank(docs_of(rows), "rank", "source", Scratch(spark, "t")).collect()
    order = sorted({n.encode() for n in names if n is not None})
    assert len(got) == len(rows) and all(x["rank"] == (-1 if x.source is None else order.index(x.source.encode())) for x in got)
