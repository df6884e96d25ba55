import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewell.operators import chunking, graph, incremental, retrieval


def communities(spark, vectors):
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "id string, vector array<double>")
    edges = graph.symmetric(graph.knn(df, 8, "id", "vector"))
    return {r.id: r.community for r in graph.leiden(edges, df.select("id")).collect()}


def test_leiden_cases(spark):
    assert communities(spark, {"only": (1, 0)}) == {"only": 0}
    two = communities(spark, {"a0": (1, 0), "a1": (0.94, 0.342), "a2": (0.94, -0.342), "b0": (-1, 0), "b1": (-0.94, 0.342), "b2": (-0.94, -0.342)})
    assert len({two[f"a{i}"] for i in range(3)}) == 1 and len({two[f"b{i}"] for i in range(3)}) == 1 and two["a0"] != two["b0"]
    unit = lambda d: (math.cos(math.radians(d)), math.sin(math.radians(d)))
    three = communities(spark, {f"{c}{o}": unit(c + o) for c in (0, 120, 240) for o in (-10, 0, 10)})
    assert sorted(np.bincount(list(three.values()))) == [3, 3, 3] and all(three[f"{c}-10"] == three[f"{c}10"] for c in (0, 120, 240))
    assert set(communities(spark, {f"s{i}": (1, 0) for i in range(10)}).values()) == {0}


def planted(spark, groups=3, size=7):
    """Groups that are cliques, each tied to the next by an edge that is not worth joining for."""
    rows = [(g * size + i, g * size + j, 1.0) for g in range(groups) for i in range(size) for j in range(i)]
    rows = [(b, a, w) for a, b, w in rows] + [(g * size, (g + 1) * size, 0.0001) for g in range(groups - 1)]
    return spark.createDataFrame(rows, "src long, dst long, sim double").coalesce(1), spark.range(groups * size).coalesce(1)


def test_one_end_whatever_a_task_may_hold(spark):
    edges, nodes = planted(spark)
    for in_task in (graph.IN_TASK, 0):
        got = graph.leiden(edges, nodes, in_task=in_task).collect()
        assert {r.id: r.community for r in got} == {i: i // 7 for i in range(21)}


def test_few_turns_for_what_no_task_holds(spark, monkeypatch):
    """Nodes move in blocks, each one task's, whose communities are whole; so turns don't grow in number with the graph. A turn saves a table or two."""
    turns, real = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, tag: (turns.append(tag), real(df, tag))[1])
    edges, nodes = planted(spark, 60, 8)
    got = graph.leiden(edges, nodes, in_task=300).collect()
    assert {r.id: r.community for r in got} == {i: i // 8 for i in range(480)} and len(turns) <= 30


def test_parts_of_a_chain():
    order = np.random.default_rng(5).permutation(1000)
    got = graph._parts(1002, order[:-1][order[:-1] < 1000], order[1:])
    assert (got[:1000] == 0).all() and got[1000] == 1000 and got[1001] == 1001


def test_moves_by_joins_end_where_nothing_gains(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 60")
    nodes, edges = v.select(F.col("vec_id").alias("id")), graph.symmetric(graph.knn(v, 5)).where("sim > 0").coalesce(1).persist()
    coarse = graph.moved(edges, nodes).persist()
    assert graph.move_options(edges, coarse).isEmpty() and graph.cpm_quality(edges, coarse).first()[0] > 0
    gains = graph.move_gain(edges, coarse).where(F.col("gain") > graph.MIN_GAIN)
    assert gains.isEmpty()  # by the other way to work it out
    for in_task in (graph.IN_TASK, 0):
        sub = {r.id: r.community for r in graph.refined(edges, coarse, in_task=in_task).collect()}
        own = {r.id: r.community for r in coarse.collect()}
        near = [(r.src, r.dst, r.sim) for r in edges.collect() if own[r.src] == own[r.dst]]
        groups, whole = {}, {}
        for i, x in sub.items():
            groups.setdefault(x, set()).add(i)
            whole.setdefault(own[i], set()).add(i)
        assert len(sub) == 60 and len(groups) < 60
        for g in groups.values():
            assert len({own[i] for i in g}) == 1
            rest = whole[own[next(iter(g))]] - g
            out = sum(w for a, b, w in near if (a in g) != (b in g))
            assert len(g) == 1 or out >= graph.GAMMA * len(g) * len(rest) - 1e-9  # well connected


def test_refinement_keeps_a_running_sum():
    """Against sums over sets, anew for every option."""
    import random
    from collections import defaultdict

    def plain(part, coarse):
        sub, group = list(range(len(part.near))), [{v} for v in range(len(part.near))]
        for v in sorted(range(len(part.near)), key=lambda v: ([coarse.index(c) for c in coarse][v], v)):
            if len(group[sub[v]]) > 1 or sub[v] != v:
                continue
            every, pull = {u for u in range(len(part.near)) if coarse[u] == coarse[v]}, defaultdict(float)
            for u, w in part.near[v].items():
                if u in every and sub[u] != v:
                    pull[sub[u]] += w
            options = []
            for s, w in pull.items():
                joined = group[s] | {v}
                rest = every - joined
                cut = sum(x for y in joined for u, x in part.near[y].items() if u in rest)
                if w - part.gamma * len(group[s]) > graph.MIN_GAIN and cut >= part.gamma * len(joined) * len(rest):
                    options.append((w - part.gamma * len(group[s]), -s))
            if options:
                s = -max(options)[1]
                group[s].add(v)
                group[v] = set()
                sub[v] = s
        return sub

    for seed in range(30):
        r = random.Random(seed)
        n = r.randint(2, 40)
        edges = [(a, b, r.randint(1, 16) / 16) for a in range(n) for b in range(a) if r.random() < 0.3]
        part = graph.Partition(n, edges, 0.0625)
        coarse = part.moved()
        assert part.refined(coarse) == plain(part, coarse)


def test_leiden_properties(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 120")
    edges = graph.symmetric(graph.knn(v, 6)).where("sim > 0.15").persist()
    got = graph.leiden(edges, v.select(F.col("vec_id").alias("id"))).persist()
    names = {r.community for r in got.collect()}
    assert names == set(range(len(names))) and got.count() == 120
    part = {r.id: r.component for r in graph.components(edges, v.select(F.col("vec_id").alias("id"))).collect()}
    by = {}
    for r in got.collect():
        by.setdefault(r.community, set()).add(part[r.id])
    assert all(len(x) == 1 for x in by.values())  # inside connected components


def test_tables_of_nodes_are_not_broadcast(spark, monkeypatch):
    """They grow with the graph, and a broadcast goes through the driver."""
    plans, real = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, tag: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, tag))[1])
    edges, nodes = planted(spark)
    got = graph.leiden(edges, nodes)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert {r.id: r.community for r in got.collect()} == {i: i // 7 for i in range(21)}
    assert len(plans) > 4 and not any("BroadcastHashJoin" in p for p in plans)


def test_knn_over_blocks(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 90")
    assert sorted(map(tuple, graph.knn(v, 5, block=20).select("src", "dst", "rank").collect())) == sorted(map(tuple, graph.knn(v, 5).select("src", "dst", "rank").collect()))


def test_knn_deals_vectors_to_strips_and_shares(spark):
    """No pair of blocks is shuffled; equal vectors, nulls, not-a-number and repeated ids come out as by brute force."""
    r = np.random.default_rng(2)
    rows = [(f"n{i % 290}", [float(x) for x in r.integers(-1, 2, 3)]) for i in range(300)] + [("none", None), ("nan", [float("nan")] * 3)]
    v = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(3)
    near = graph.knn(v, 4, block=16)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    want = []
    for i, a in [(i, rows[i][1]) for i in range(10, 290)]:
        best = sorted((-float(np.dot(a, b)), j) for j, b in rows[:300] if j != f"n{i}")[:4]
        want += [(f"n{i}", j, -s, n) for n, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, near.where("src <> 'nan' and cast(substring(src, 2) as int) >= 10").collect())) == sorted(want)


def test_mmr():
    rel, vecs, ids = np.array([0.9, 0.89, 0.5]), np.array([[1.0, 0], [1.0, 0.01], [0, 1.0]]), ["a", "b", "c"]
    order = lambda lam, k=3: [ids[i] for i, _ in retrieval.mmr_order(rel, vecs, ids, k, lam)]
    assert order(1.0) == ["a", "b", "c"] and order(0.5) == ["a", "c", "b"] and order(0.8, 1) == ["a"]
    assert [i for i, _ in retrieval.mmr_order(np.array([0.5, 0.5]), np.zeros((2, 2)), ["b", "a"], 2, 0.8)] == [1, 0]
    assert retrieval.mmr_order(np.array([]), np.zeros((0, 2)), [], 3, 0.8) == []


def test_classify(spark):
    schema = "rel_path string, mtime_ns long, size long"
    disk = spark.createDataFrame([("main.rs", 5, 12), ("lib.rs", 7, 3), ("mod.rs", 9, 3)], schema)
    known = spark.createDataFrame([("gone.rs", 1, 1), ("lib.rs", 7, 3), ("mod.rs", 9, 4)], schema)
    assert {r.rel_path: r.state for r in incremental.classify(disk, known).collect()} == {"main.rs": "new", "gone.rs": "deleted", "lib.rs": "unchanged", "mod.rs": "changed"}


def test_expire_keeps_the_cutoff(spark):
    df = spark.createDataFrame([(1, 99), (2, 100), (3, 101)], "id int, t long")
    assert [r.id for r in incremental.expire(df, "t", F.lit(100)).collect()] == [2, 3]


def test_markdown(spark):
    text = "before\n\n# One\r\nbody\n#tag\nx\n#\n```\n# fenced\n```\n## Empty\n\n# \n"
    df = spark.createDataFrame([("a.md", text), ("b.md", ""), ("c.md", "# only\n")], "path string, text string")
    got = {}
    for r in chunking.markdown_sections(df, "path", "text").orderBy("path", "ord").collect():
        got.setdefault(r.path, []).append((r.name, r.source))
    assert [n for n, _ in got["a.md"]] == ["(preamble)", "One", "tag", "fenced", "Empty"] and got["a.md"][1][1] == "# One\nbody" and "b.md" not in got and got["c.md"] == [("only", "# only")]
    assert [(n, s) for _, n, s in chunking.chunks("a.md", text)] == got["a.md"]


def test_code():
    from lodewell.plans import catalogue

    SOURCES = {p.replace("/@", "").replace("@", ""): t.replace("@", "").replace("$", "p") for p, t in catalogue.SOURCES.items()}  # noqa: N806
    got = {p: [(k, n) for k, n, _ in chunking.chunks(p, t)] for p, t in SOURCES.items()}
    assert got["a/lib.rs"] == [("struct", "P"), ("impl", "(anonymous)"), ("function", "new"), ("impl", "(anonymous)"), ("function", "clone")]
    assert got["a/m.py"] == [("class", "A"), ("function", "f"), ("function", "g"), ("function", "h")]
    assert got["a/m.go"] == [("type_decl", "A"), ("type_decl", "B"), ("method", "F"), ("function", "G")]
    assert [n for _, n in got["a/c.yaml"]] == ["a", "b", "c", "d", "e"]
    assert got["a/BUILD"] == [("expression", "load"), ("expression", "rule"), ("expression", "rule"), ("function", "m")]
    assert got["a/x.ts"] == []
    assert chunking.chunks("x.py", "def broken(") == []
    hurt = "import os\n\n@deco\n@other\ndef f():\n    return 1\n\ndef broken(:\n    pass\n\nclass C:\n    def g(self):\n        return [1]\n\nif x:\n    def h():\n        pass\nelse:\n    y = 1\n"
    assert [n for _, n, _ in chunking.chunks("x.py", hurt)] == ["f", "C", "g", "h"] and chunking.chunks("x.py", hurt)[0][2].endswith("return 1")
    go = dict((n, s) for _, n, s in chunking.chunks("m.go", SOURCES["a/m.go"]))
    assert go["A"] == go["B"] and go["A"].startswith("type (") and go["A"].endswith(")")


@pytest.mark.parametrize("path,lang", [("a/BUILD", "starlark"), ("WORKSPACE.bazel", "starlark"), ("x.yml", "yaml"), ("x.RS", None), ("rs", None)])
def test_language(path, lang):
    assert chunking.language(path) == lang
