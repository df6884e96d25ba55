import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from lodewell.llm import resample


def features(text, n=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, n=1, buckets=10000, percent=10, least=20, seed=2024):
    """(id, n_features, weight, score) of each document, and the ids that are drawn, in order."""
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for x in texts for f in features(x, n)[1]) for texts in ([x for _, x in docs], target))
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    rows, can = [], []
    for i, text in docs:
        words, fs = features(text, n)
        w = sum(gain[of(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
        if len(words) >= least:
            can.append((-rows[-1][3], i is not None, i or 0))
    return rows, [x[2] if x[1] else None for x in sorted(can)[: percent * len(can) // 100]]


EDGES = [(None, "a b c " * 9), (None, "a b c " * 9), (7, None), (8, ""), (9, "!!! \t ."), (10, "É é Straße ١٢ A-B_c " * 11), (11, "long words here " * 20_000), (12, "x y"), (12, "x y"), (13, "same text with copies " * 8)]


@pytest.mark.parametrize("n,buckets,percent,least", [(1, 10000, 10, 20), (2, 37, 50, 1), (3, 1, 100, 0)])
def test_against_plain(spark, n, buckets, percent, least):
    docs = EDGES + [(100 + i, f"word{i % 7} the of and in {'zu und ' * (i % 5)} w{i}" * (1 + i % 4)) for i in range(120)] + [(500 + i, "same text with copies " * 8) for i in range(90)]
    target = ["the of word3 word3", None, "und zu", ""]
    df = spark.createDataFrame([(*d, "x", 5, 1) for d in docs], "doc_id long, text string, b string, score long, rank int").repartition(5)
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, n=n, buckets=buckets, least_words=least).collect()
    want, drawn = plain(docs, target, n, buckets, percent, least)
    key = lambda r: str(r)
    assert sorted(((r.id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(want, key=key)
    assert [r.id for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, len(drawn) + 1))


def test_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    got = resample.resample(some, none, percent=100, least_words=1).collect()
    assert sorted(r["rank"] for r in got) == [1, 2] and {(r.id, r.n_features, r.weight, r.score) for r in got} == set(plain([(1, "a b"), (2, "c")], [])[0])


def test_target_like_documents_are_preferred(spark):
    docs = [(i, ("alpha beta gamma delta " if i % 4 == 0 else "rho sigma tau phi ") * 10) for i in range(400)]
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("alpha beta gamma delta " * 50,)], "text string")).collect()
    drawn = [r.id for r in got if r["rank"]]
    assert len(drawn) == 40 and sum(i % 4 == 0 for i in drawn) >= 36


def test_query_against_sql_and_its_plan(spark):
    at, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as from '{at}/{t}.parquet'")
    cur = con.execute(resample.OP12_SQL)
    names = [d[0] for d in cur.description]
    out = resample.op12_importance_resampling(spark, at)
    assert sorted(tuple(r) for r in out.select(*names).collect()) == sorted(cur.fetchall())
    plan = resample.spread(spark.createDataFrame([([1, 2],)], "b array<int>")).select(resample.weight("b", list(range(10000))).alias("w"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "split(" not in plan  # the gains are one literal
