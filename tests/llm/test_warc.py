import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lodewell.llm import warc
from lodewell.llm._common import Scratch

M = "\r\n\r\nWARC/1.1\r\n"


def pages():
    fake = M + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello" + M
    big = "é" * 600
    rows = [(0, "http://a/", "plain"), (1, None, None), (2, "u", ""), (3, "u\r\nContent-Length: 0", fake), (4, "u", "x" + M), (5, "u", big), (6, "u", big), (9, "u", big), (7, "u", fake + big + fake), (8, "u", "\r\n\r\n\r\n"), (10, "u", "small"), (11, "u", "small"), (12, "u", M * 40), (9, "u", big), (None, "u", big), (13, "u", "tail\r\n\r\n")]
    # a false record whose length leads exactly to the next true one
    inner = f"{M}WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"
    return [*rows, (14, "u", "lead" + inner), (15, "u", "end")]


@pytest.mark.parametrize("codec,parts,block,few", [("none", 1, None, 10**6), ("gzip", 3, None, 0), ("none", 1, 300, 0)])
def test_round_trip(spark, tmp_path, monkeypatch, codec, parts, block, few):
    monkeypatch.setattr(warc, "FEW_PARTS", few)
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1).repartition(parts) if parts > 1 else spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/w"
    warc.write(warc.records(warc.with_revisits(df)), path, codec)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if block:
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)  # records lie across file parts
        recs = warc.read(spark, path).withColumn("text", F.col("content").cast("string")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(recs) == len(pages()) and all(r.complete for r in recs)
    stored = sorted(r.text.removeprefix(warc.HTTP) for r in recs if "WARC-Type: response" in r["head"])
    big = "é" * 600
    want = [h or "" for _, _, h in pages() if h != big] + [big, big]  # the id 9 is there twice
    assert stored == sorted(want)
    raw = b"".join((gzip.decompress(p.read_bytes()) if codec == "gzip" else p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert raw.count(b"WARC/1.1\r\n") > len(pages())  # there was magic inside payloads
    by_file = {}
    for p in (tmp_path / "w").glob("part-*"):
        by_file[p.name] = gzip.decompress(p.read_bytes()) if codec == "gzip" else p.read_bytes()
    for r in recs:
        assert by_file[r.file.rsplit("/", 1)[-1]][r["at"] :].startswith(b"WARC/1.1\r\n")


def test_query(spark, tmp_path):
    spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in warc.op5_warc(spark, str(tmp_path)).collect()), key=str)
    first = {}
    for i, _, h in pages():
        if h and len(h.encode()) >= 1000 and i is not None:
            first[h] = max(i, first.get(h, i))
    want = []
    for i, _, h in pages():
        raw = (h or "").encode()
        f = first.get(h)
        again = f is not None and i != f
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", f if again else None))
    assert got == sorted(want, key=str)


def test_broken_and_empty(spark, tmp_path):
    (tmp_path / "b").mkdir()
    good = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    (tmp_path / "b" / "a.warc").write_bytes((good + "WARC/1.1\r\nno length\r\n\r\nxx\r\n\r\n" + good).encode())
    (tmp_path / "b" / "short.warc").write_bytes(good.replace("2", "50", 1).encode())
    (tmp_path / "b" / "none.warc").write_bytes(b"")
    recs = warc.read(spark, f"{tmp_path}/b").collect()
    assert sorted((r.file.rsplit("/", 1)[-1], r["at"], r.complete) for r in recs) == [("a.warc", 0, True), ("short.warc", 0, False)]
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op5_warc(spark, str(tmp_path)).count() == 0


def test_pointer_jumping(spark):
    """Against following the chain, over random successors."""
    import random

    r = random.Random(5)
    rows, want = [], set()
    for f in range(6):
        at = sorted(r.sample(range(1, 4000), 150))
        at = [0, *at]
        nxt = {a: (at[i + 1] if r.random() < 0.5 and i + 1 < len(at) else r.choice([x for x in at[i + 1 : i + 6]] or [9999]) if r.random() < 0.9 else a + 1) for i, a in enumerate(at)}
        rows += [(str(f), i, a, nxt[a]) for i, a in enumerate(at)]
        x = 0
        while x in nxt:
            want.add((str(f), x))
            x = nxt[x]
    df = spark.createDataFrame(rows, "file string, pos long, at long, next long")
    assert {(x.file, x["at"]) for x in warc.reachable(df, Scratch(spark, "t")).collect()} == want


def test_files_packed_otherwise_between_scans(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i} " + M * (i % 4)) for i in range(60)], "page_id long, url string, html string")
    warc.write(warc.records(warc.with_revisits(df.repartition(12))), f"{tmp_path}/w")
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", 1)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        recs = warc.read(spark, f"{tmp_path}/w")
        spark.conf.set("spark.sql.files.minPartitionNum", 64)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 64)
        got = sorted(r.text.removeprefix(warc.HTTP) for r in recs.select(F.col("content").cast("string").alias("text")).collect())
    finally:
        for k in ("minPartitionNum", "openCostInBytes", "maxPartitionBytes"):
            spark.conf.unset(f"spark.sql.files.{k}")
    assert got == sorted(f"page {i} " + M * (i % 4) for i in range(60))


def test_records_that_are_not_read_are_noticed(spark, tmp_path, monkeypatch):
    spark.createDataFrame(pages(), "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    whole = warc.read
    monkeypatch.setattr(warc, "read", lambda *a, **k: whole(*a, **k).where("at > 0"))
    with pytest.raises(RuntimeError, match="records read of"):
        warc.op5_warc(spark, str(tmp_path))


def test_strict_and_version_1_0(spark, tmp_path):
    def record(minor, body, extra=""):
        return f"WARC/1.{minor}\r\nWARC-Type: response\r\n{extra}Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"

    (tmp_path / "v").mkdir()
    inner = "\r\n\r\nWARC/1.0\r\nContent-Length: 1\r\n\r\nx"
    old = record(0, "one") + record(0, "two" + inner) + record(0, "three")
    mixed = record(1, "a") + record(0, "b" + inner) + record(1, "c\r\n\r\nWARC/1.2\r\n") + record(0, "")
    (tmp_path / "v" / "old.warc").write_bytes(old.encode())
    (tmp_path / "v" / "mixed.warc.gz").write_bytes(b"".join(gzip.compress(x.encode()) for x in (mixed[:50], mixed[50:])))
    recs = warc.read(spark, f"{tmp_path}/v", strict=True).withColumn("text", F.col("content").cast("string")).collect()
    by = {}
    for r in sorted(recs, key=lambda r: r["at"]):
        by.setdefault(r.file.rsplit("/", 1)[-1], []).append(r.text)
        assert r.complete and "WARC-Type: response" in r["head"]
    assert by == {"old.warc": ["one", "two" + inner, "three"], "mixed.warc.gz": ["a", "b" + inner, "c\r\n\r\nWARC/1.2\r\n", ""]}

    for i, bad in enumerate(("junk" + old, old + "WARC/1.2\r\nContent-Length: 1\r\n\r\nx\r\n\r\n", old + "more", old.replace("Content-Length: 3", "Content-Size: 3", 1))):
        (tmp_path / f"bad{i}").mkdir()
        (tmp_path / f"bad{i}" / "x.warc").write_bytes(bad.encode())
        with pytest.raises(ValueError, match="bytes after the last record"):
            warc.read(spark, f"{tmp_path}/bad{i}", strict=True)

    pages = spark.createDataFrame([(1, "u", "x" * 1000), (2, "u", "x" * 1000)], "page_id long, url string, html string")
    warc.write(warc.records(warc.with_revisits(pages), minor=0), f"{tmp_path}/w")
    got = warc.resolved(warc.read(spark, f"{tmp_path}/w", warc.payload, strict=True)).collect()
    assert sorted((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in got) == [(1, "revisit", 1000, 2), (2, "response", 1000, None)]


def test_clashing_columns(spark):
    rows = [(i, "u", "y" * 1000, "mine", 7) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _first string, _n int").withColumns({"_digest": F.lit("d"), "record_type": F.lit("old")})
    got = sorted(warc.with_revisits(df).collect())
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None)] and {(r["_first"], r["_n"], r["_digest"]) for r in got} == {("mine", 7, "d")}
