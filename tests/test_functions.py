import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewell.functions import hashing as H
from lodewell.functions import text as T
from lodewell.functions import vectors as V
from lodewell.operators import retrieval


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'array<double>'}" for k, v in values.items()))
    return row.select(column).first()[0]


def test_hashes(spark):
    fnv = lambda s: one(spark, H.fnv1a(F.col("s")), s=s)
    assert fnv("") == "cbf29ce484222325" and fnv("hello") == "a430d84680aabd0b"
    assert fnv("fn foo() {}") != fnv("fn bar() {}") and fnv("é日") == fnv("é日")
    h = 5381
    for b in "a/béx" .encode():
        h = (h * 33 + b) % (1 << 64)
    assert one(spark, H.chunk_id(F.col("p"), F.col("n"), F.col("k")), p="a/", n="bé", k="x") == f"{h:016x}"


def test_f16(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.standard_normal(300) * 10.0 ** r.integers(-8, 5, 300), [0.0, -0.0, 65504, 65519.99, 65520, -70000, 6e-8, 2.9e-8, 1e-9]])
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select(V.f16(F.col("x"))).collect()
    with np.errstate(over="ignore"):
        assert [g[0] for g in got] == [float(v) for v in x.astype(np.float16).astype(float)]


def test_vectors(spark):
    assert one(spark, V.dot(F.col("a"), F.col("b")), a=[1.0, 2.0, 3.0], b=[4.0, 5.0]) == 14
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 0
    assert one(spark, V.l2_normalize(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, V.l2_normalize(F.col("a")), a=[0.0]) == [0.0]


def test_kinds(spark):
    tags = [*T.KINDS, *T.LEGACY, "no_such"]
    df = spark.createDataFrame([(t,) for t in tags], "t string").select("t", T.kind_from_tag(F.col("t")).alias("k"))
    got = {r.t: (r.k, r.s) for r in df.withColumn("s", T.kind_shown(F.col("k"))).collect()}
    assert got["type_decl"] == ("type_decl", "type") and got["block_mapping"] == ("block_mapping", "mapping") and got["no_such"][0] == "function" and got["struct_item"][0] == "struct"


@pytest.mark.parametrize("tail", ["", "x", "é", "日本", "😀😀", "a😀"])
def test_embed_text(spark, tail):
    for n in range(1994, 2003):
        s = "a" * n + tail * 3
        assert one(spark, T.embed_text(F.col("s")), s=s) == s.encode()[:2000].decode("utf-8", "ignore")


def test_preview(spark):
    assert one(spark, T.preview(F.col("s")), s="a" * 299 + "é" * 9) == "a" * 299 + "é"


def test_sanitize(spark):
    assert one(spark, T.sanitize_query(F.col("s")), s='foo_bar "x" AND (b*) é -') == '"foo_bar" "x" "AND" "b" "é"'


DOCS = ["the cat sat", "foo bar baz", "foo_bar again foo bar", "bar foo", "café au lait", "cafe noir cat cat", "x", "The CAT and the dog of the house", "Ünder the bridge"]


@pytest.mark.parametrize("query", ["cat", "the cat", "foo_bar", "foo_bar cat", "cafe", "CAFÉ", "cat cat", "_", "foo _", "", "zzz", "of_the", "bar foo", "a AND b"])
def test_bm25_is_fts5_s(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(name, source)")
    rows = [(i, f"n{i % 3} cat" if i == 6 else f"n{i % 3}", d) for i, d in enumerate(DOCS)]
    con.executemany("insert into t(rowid, name, source) values (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "id int, name string, source string")
    match = one(spark, T.sanitize_query(F.col("s")), s=query)
    want = {}
    if match:
        want = {i: -s for i, s in con.execute("select rowid, bm25(t) from t where t match ?", (match,))}
    got = {r.id: r.bm25 for r in retrieval.bm25(df, "id", ["name", "source"], query).collect()}
    assert got == pytest.approx(want, rel=1e-9)
