import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lodewell.llm import winnow

P = winnow.PRIME


def brute(text, k=winnow.K, w=winnow.WINDOW):
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    n = [(v - (1 << 64) if (v := xxhash.xxh64_intdigest(x.encode(), 42)) >> 63 else v) % P for x in words]
    poly = lambda a: sum(x * pow(winnow.BASE, len(a) - 1 - i, P) for i, x in enumerate(a)) % P
    g = [poly(n[i : i + k]) for i in range(len(n) - k + 1)] if len(n) >= k else [poly(n)]
    out = []
    for i in range(max(1, len(g) - w + 1)):
        win = g[i : i + w]
        j = max(p for p in range(len(win)) if win[p] == min(win))  # the rightmost
        if (win[j], i + j) not in out:
            out.append((win[j], i + j))
    return out


TEXTS = [None, "", " ", "one", "One two THREE", "a b c d e", "x " * 60, " ".join(random.Random(1).choice("abc") for _ in range(200)), "Émile " * 3 + " ".join(map(str, range(90)))]


@pytest.mark.parametrize("k,w", [(5, 16), (1, 1), (4, 3), (6, 5)])
def test_against_brute_force(spark, docs_of, k, w):
    got = winnow.winnow(docs_of(list(enumerate(TEXTS))), "text", "c", k, w).select("doc_id", "c", winnow.places("c").alias("p")).collect()
    for r in got:
        assert [(c >> 31, p) for c, p in zip(r.c, r.p, strict=True)] == brute(TEXTS[r.doc_id], k, w), r.doc_id


def test_query(spark, docs_of, tmp_path):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS * 3)] + [(6, "one"), (None, "first of all")]
    docs_of(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = winnow.op8_winnowing(spark, str(tmp_path)).collect()
    ring = sorted(((i is not None, i or 0, t or "") for i, t in rows), key=lambda x: (x[0], x[1], x[2].encode()))
    want = []
    for j, (has, i, t) in enumerate(ring):
        nxt = ring[(j + 1) % len(ring)][2]
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        a, b, c = ({x for x, _ in brute(s)} for s in (t, e, nxt))
        like = lambda x, y: len(x & y) / len(x | y)
        hexed = lambda s: "".join(f"{x:08x}" for x, _ in brute(s))
        want.append((str(i if has else None), len(t), hashlib.sha256(e.encode()).hexdigest(), hexed(t), hexed(e), round(like(a, b), 9), round(like(a, c), 9)))
    for r in got:
        places = [sum(r.steps[: i + 1]) for i in range(len(r.steps))]
        assert any(places == [p for _, p in brute(t)] and "".join(f"{h:08x}" for h, _ in brute(t)) == r.fingerprint for _, t in rows)
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    docs_of([]).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert winnow.op8_winnowing(spark, f"{tmp_path}/e").count() == 0
    docs_of([(1, "alone here")]).write.parquet(f"{tmp_path}/o/documents.parquet")
    assert winnow.op8_winnowing(spark, f"{tmp_path}/o").first().near_next == 1.0


def test_guarantee():
    """Texts that share k + w - 1 words share a chosen hash from them."""
    r = random.Random(4)
    for _ in range(20):
        shared = [str(r.random()) for _ in range(winnow.K + winnow.WINDOW - 1)]
        texts = [" ".join([*(str(r.random()) for _ in range(r.randint(0, 60))), *shared, *(str(r.random()) for _ in range(r.randint(0, 60)))]) for _ in range(2)]
        a, b = ({h for h, _ in brute(t)} for t in texts)
        assert a & b


@pytest.mark.parametrize("n", [1, 2, 5, 30, 200])
def test_ranges(spark, docs_of, n):
    r = random.Random(n)
    rows = [(r.randrange(-500, 500), f"t{i}") for i in range(300)] + [(None, "none"), (None, "also none")]
    docs = docs_of(rows).withColumn("mine", F.col("text"))
    got = winnow.with_next(docs, "doc_id", {"text": "after"}, buckets=n).collect()
    ring = sorted(((i is not None, i or 0, t) for i, t in rows), key=lambda x: (x[0], x[1], x[2]))
    want = {t: ring[(j + 1) % len(ring)][2] for j, (_, _, t) in enumerate(ring)}
    assert {x.text: x.after for x in got} == want and len(got) == len(rows) and all(x.mine == x.text for x in got)
    ends = sorted({r.randrange(1000) for _ in range(n)})
    x = spark.range(-1, 1001)
    assert all(y.u == sum(e < y.id for e in ends) for y in x.select("id", winnow._upto(F.col("id"), ends, "bigint").alias("u")).collect())


def test_very_long_text(spark, docs_of):
    text = " ".join(f"w{i % 997}" for i in range(200_000))
    got = winnow.winnow(docs_of([(1, text)]).withColumn("own", F.lit("x")), "text", "c").first()
    assert [(c >> 31) for c in got.c] == [h for h, _ in brute(text)] and got.own == "x"
