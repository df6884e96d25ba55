import random

import xxhash

from lodewell.llm import simhash
from lodewell.llm._common import Scratch


def brute_print(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(items, d):
    root = {i: i for i, _ in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, f in items:
        for j, g in items:
            if bin(f ^ g).count("1") <= d:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_fingerprint():
    for text in (None, "", " \n", "One", "one TWO", "a b c d e f", "É é A b  c\td " * 50):
        assert simhash.fingerprint(text) == brute_print(text)


def test_links_and_long_lists(spark):
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(40)]
    prints = {0}
    for s in seeds:
        prints.add(s)
        for _ in range(25):
            x = s
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
            prints.add(x)
    items = list(enumerate(prints))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in items]
    fps = spark.createDataFrame(signed, "rep long, fp long")
    own = {f: i for i, f in signed}
    from lodewell.llm._common import Scratch
    from lodewell.llm._graph import connected_components

    for d in (0, 1, 2):
        want = components(items, d)
        for limit in (2, 1000):
            by = {f: f for f in own} | {x.node: x.root for x in connected_components(simhash.links(fps.select("fp"), d, limit), Scratch(spark, "t")).collect()}
            least = {}
            for f, root in by.items():
                least[root] = min(least.get(root, own[f]), own[f])
            assert {own[f]: least[root] for f, root in by.items()} == want


def test_rows(spark, docs_of, tmp_path):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (7, base.upper()), (9, None), (11, " "), (12, "other text here now"), (5, base), (None, base)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.component_id, r.fingerprint) for r in simhash.op3_simhash_near_dedup(spark, str(tmp_path)).collect())
    print_ = f"{brute_print(base):016x}"
    assert got == sorted([("5", 5, print_), ("5", 5, print_), ("7", 5, print_), ("None", 5, print_), ("9", 9, "0" * 16), ("11", 9, "0" * 16), ("12", 12, f"{brute_print('other text here now'):016x}")])
    kept = simhash.drop_near_duplicates(docs_of(rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["12", "5", "9", "None"]
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_index_and_counts(spark):
    """The index: pairs that meet are those that share four bytes of the prefix, as often as they can choose them."""
    r = random.Random(9)
    base = r.getrandbits(64)
    prints = {base}
    while len(prints) < 60:
        x = base
        for p in r.sample(range(8), r.randint(1, 5)):
            x ^= r.randint(1, 255) << 8 * p
        prints.add(x)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    fps = spark.createDataFrame(signed, "fp long")
    order = simhash.position_order(fps)
    assert sorted(order) == list(range(8))
    prefix, posts = order[:6], simhash.lists(fps, order[:6])
    got = {}
    for x in posts.alias("x").join(posts.alias("y"), "key").where("x.fp < y.fp").selectExpr("x.fp as a", "y.fp as b").collect():
        got[x.a, x.b] = got.get((x.a, x.b), 0) + 1
    want = {}
    for (a,) in signed:
        for (b,) in signed:
            m = sum((a >> 8 * p & 255) == (b >> 8 * p & 255) for p in prefix)
            if a < b and m >= 4:
                want[a, b] = {4: 1, 5: 5, 6: 15}[m]
    assert got == want and set(want.values()) == {1, 5, 15}


def test_null_ids_link(spark, docs_of, monkeypatch):
    """A chain of two links whose middle has no id is one component, whatever the middle's text is."""
    prints = {"a": 0, "middle": 0b11, "z": 0b1111, "alone": 255 << 40, "near": 255 << 40 | 1}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.selectExpr("doc_id as id", "xxhash64(text) as tk", "case text " + " ".join(f"when '{k}' then {v}L" for k, v in prints.items()) + " end as fp"))
    got = simhash.near_duplicates(docs_of([(1, "a"), (None, "middle"), (2, "z"), (None, "alone"), (None, "near"), (None, "near")])).collect()
    assert sorted((str(r.id), r.fp, str(r.component_id)) for r in got) == sorted([("1", 0, "1"), ("None", 3, "1"), ("2", 15, "1"), ("None", 255 << 40, "None"), *[("None", 255 << 40 | 1, "None")] * 2])


def test_brute_force_and_clashes(spark, docs_of):
    from pyspark.sql import functions as F

    r = random.Random(4)
    base = [" ".join(f"w{r.randint(0, 500)}" for _ in range(n)) for n in (60, 300, 1200, 30000)]
    rows, n = [], 0
    for text in base:
        words = text.split(" ")
        for k in range(8):
            own = list(words)
            for _ in range(k):
                own[r.randrange(len(own))] = f"x{r.randint(0, 9)}"
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one"), (3, rows[10][1]), (3, rows[3][1]), (5, rows[5][1])]
    want = components(list(enumerate(brute_print(t) for _, t in rows)), 2)
    least = {}
    for i, root in want.items():
        least[root] = min(least.get(root, rows[i][0]), rows[i][0])
    docs = docs_of(rows).withColumns({c: F.lit("own") for c in ("fp", "tk", "root", "component_id", "id", "key")})
    got = sorted((x.id, x.component_id) for x in simhash.near_duplicates(docs).collect())
    assert got == sorted((rows[i][0], least[root]) for i, root in want.items())
    kept = simhash.drop_near_duplicates(docs).collect()
    assert len(kept) == len(least) and {x.fp for x in kept} == {"own"}
    prints = {brute_print(x.text) for x in kept}
    assert len(prints) == len(kept)


def test_nothing_that_grows_is_broadcast(spark, docs_of, monkeypatch):
    """Tables of fingerprints and links go to the driver on the way to a broadcast, and grow with the input."""
    plans, real = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(self, df, *a))[1])
    docs = docs_of([(i, f"{'one two three four five six seven ' * 40}{i % 7}") for i in range(60)] + [(99, None)])
    got = [simhash.near_duplicates(docs), simhash.drop_near_duplicates(docs.select("doc_id", "text"))]
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in got]
    assert got[0].count() == 61 and len(plans) > 8
    assert not any("BroadcastHashJoin" in p for p in plans)
