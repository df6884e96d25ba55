import hashlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lodewell.llm import mixing


def fill(budget, caps, weights):
    """Shares by repeated proportional division, whole tokens by largest remainder."""
    full, left = {}, budget
    while True:
        open_ = [k for k in caps if k not in full and weights[k]]
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if caps[k] * total <= weights[k] * left]
        if not over:
            break
        for k in over:
            full[k] = caps[k]
        left = budget - sum(full.values())
    share = {k: Fraction(left * weights[k], total) for k in open_} if open_ else {}
    out = {k: 0 for k in caps} | full | {k: int(v) for k, v in share.items()}
    rest = left - sum(int(v) for v in share.values()) if open_ else 0
    for k in sorted(share, key=lambda k: (-(share[k] - int(share[k])), k))[: max(0, rest)]:
        out[k] += 1
    return out


@pytest.mark.parametrize("budget,epochs", [(0, 2), (7, 1), (100, 1), (333, 2), (5000, 3), (10**6, 4)])
def test_budgets(spark, budget, epochs):
    leaves = [("a", "x", "1", 10), ("a", "x", "2", 300), ("a", "y", "1", 50), ("b", "x", "1", 1), ("b", "z", "9", 2), ("c", "x", "1", 400)]
    w = {"a": 5, "b": 3, "c": 0, "x": 2, "y": 1, "z": 1}
    df = spark.createDataFrame(leaves, "d string, l string, s string, tokens long")
    got = mixing.budgets(df, ["d", "l", "s"], [mixing.weight_of("d", w), mixing.weight_of("l", w), F.lit(1)], budget, epochs)
    got = {tuple(r[:3]): r.given for r in got.collect()}
    cap = {x[:3]: x[3] * epochs for x in leaves}

    def under(*path):
        return sum(c for k, c in cap.items() if k[: len(path)] == path)

    want = {}
    for d, b in fill(budget, {d: under(d) for d in "abc"}, w).items():
        ls = {k[1] for k in cap if k[0] == d}
        for lang, b2 in fill(b, {x: under(d, x) for x in ls}, w).items():
            ss = {k[2] for k in cap if k[:2] == (d, lang)}
            want |= {(d, lang, s): v for s, v in fill(b2, {s: under(d, lang, s) for s in ss}, defaultdict(lambda: 1)).items()}
    assert got == want


def test_stream(spark, docs_of):
    rows = [(i, "w " * (i % 5), "en" if i % 3 else None, "src0") for i in range(60)] + [(3, "w w", "en", "src0"), (None, "w", "en", "src0"), (70, None, "de", None)]
    levels, weights = mixing.source_tree()
    docs = docs_of(rows).withColumn("take", F.lit("clash"))
    got = mixing.mix(docs, levels, weights, budget=220, max_epochs=3).collect()
    by = defaultdict(list)
    for r in got:
        by[r.domain, r.lang, r.source].append(r)
    assert sum(r["take"] for r in got) == 220
    for leaf, own in by.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):  # the prefix of a stream, without gaps
            assert r.start == at
            at += r["take"]
        keys = [(r.epoch, hashlib.md5(f"42:{r.epoch}:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()) for r in sorted(own, key=lambda r: r.start)]
        assert keys == sorted(keys), leaf
    assert mixing.mix(docs_of([]), levels, weights).count() == 0
    assert mixing.mix(docs, levels, weights, budget=0).count() == 0


def test_invariants_of_divide(spark):
    import random

    r, rows = random.Random(1), []
    for node in range(60):
        budget = r.choice([0, 1, 7, 100, 5000])
        for child in range(r.randint(1, 6)):
            rows.append((node, f"c{child}", r.choice([0, 0, 1, 2, 5]), r.choice([0, 1, 10, 1000]), budget))
    got = mixing.divide(spark.createDataFrame(rows, "p int, c string, weight long, cap long, budget long"), ["p"], "c").collect()
    by = defaultdict(list)
    for x in got:
        assert 0 <= x.given <= x.cap and (x.weight > 0 or x.given == 0)
        by[x.p].append(x)
    for own in by.values():
        assert sum(x.given for x in own) == min(own[0].budget, sum(x.cap for x in own if x.weight))
        assert {x.c: x.given for x in own} == fill(own[0].budget, {x.c: x.cap for x in own}, {x.c: x.weight for x in own})


def test_zero_weights_below_go_to_the_nodes_siblings(spark):
    leaves = [("a", "x", 100), ("a", "y", 100), ("b", "x", 500), ("b", "z", 1)]
    df = spark.createDataFrame(leaves, "d string, l string, tokens long")
    got = mixing.budgets(df, ["d", "l"], [F.lit(1), mixing.weight_of("l", {"x": 0})], 150, 1)
    assert {tuple(r[:2]): r.given for r in got.collect()} == {("a", "x"): 0, ("a", "y"): 100, ("b", "x"): 0, ("b", "z"): 1}
    none = mixing.budgets(df, ["d", "l"], [F.lit(0), F.lit(1)], 150, 1)
    assert {r.given for r in none.collect()} == {0}


def test_clashing_columns(spark, docs_of):
    levels, weights = mixing.source_tree()
    docs = docs_of([(1, "a b c", "en", "src1"), (2, "d e " * 20000, "en", "src1")]).withColumns({c: F.lit(c) for c in ("_all", "_given", "_key", "_range", "_ahead", "tokens", "given", "cap", "budget", "weight")})
    got = mixing.mix(docs, levels, weights).collect()
    assert len(got) == 2 and all(r[c] == c for r in got for c in ("_all", "_key", "_range", "tokens", "given", "cap"))


@pytest.mark.parametrize("domains,langs", [({"domain0": 0, "domain1": 3}, {"en": 5, "de": 0}), ({"domain0": 1, "domain1": 0, "domain2": 0, "domain3": 0}, {"en": 0})])
def test_zero_weights_against_sql(spark, domains, langs):
    import duckdb

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}/documents.parquet'")
    cur = con.execute(mixing.mixing_sql(domains, langs))
    names = [d[0] for d in cur.description]
    got = [tuple(r) for r in mixing.op1_mixing(spark, at, domains, langs).select(*names).collect()]
    assert sorted(got) == sorted(cur.fetchall()) and got
