import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewell.operators import graph, proximity
from lodewell.plans import catalogue
from lodewell.sources.vectors import VectorIndex


def ids_of(df, query="query", id_col="id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[query], set()).add(r[id_col])
    return out


def recall(got, want):
    return sum(len(got.get(q, set()) & x) for q, x in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_batch_against_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(proximity, "PASS", 7)  # several passes
    r = np.random.default_rng(1)
    rows = [(str(i) if kind == "string" else i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(300)] + [(("null" if kind == "string" else 900), None)]  # many ties
    v = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<float>").repartition(5)
    own = rows[:30]
    q = spark.createDataFrame([*own, rows[-1]], f"query {kind}, embedding array<float>")
    for same in (True, False):
        got = proximity.batch_topk(q, v, 6, same=same).collect()
        want = []
        for i, a in own:
            best = sorted((-float(np.dot(a, b)), j) for j, b in rows if b is not None and (same or i != j))[:6]
            want += [(i, j, -s, k) for k, (s, j) in enumerate(best, 1)]
        assert sorted(map(tuple, got)) == sorted(want)
    assert proximity.batch_topk(q.limit(0), v, 3).count() == 0 and proximity.batch_topk(q, v.limit(0), 3).count() == 0


def test_descent_against_all_pairs(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    near = proximity.descent(v, 32).collect()
    exact = ids_of(graph.knn(v, 32), "src", "dst")
    got = {}
    for r in near:
        got.setdefault(r.src, set()).add(r.dst)
    assert recall(got, exact) >= 0.95 and all(len(x) == 32 for x in got.values()) and all(r.src != r.dst for r in near)
    small = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)] + [(9, None)], "vec_id long, embedding array<double>")
    assert ids_of(proximity.descent(small, 3), "src", "dst") == ids_of(graph.knn(small.where("vec_id < 9"), 3), "src", "dst")
    crowd = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(700)], "vec_id long, embedding array<double>")  # equal vectors
    assert all(r.sim == 1.0 for r in proximity.descent(crowd, 4).collect())


def test_descent_shuffles_found_links_once(spark):
    """By src, which serves pairs, ranks and lists; of a record batch a pair goes on once."""
    rows = [(1, 2, 0.5), (1, 2, 0.25), (1, 3, 0.5), (1, 4, 0.75), (2, 1, 0.5)]
    kept = proximity._kept(spark.createDataFrame(rows, "src long, dst long, sim double"), 2)
    assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r.id: sorted((x.sim, x.dst) for x in r.found) for r in kept.collect()} == {1: [(0.5, 2), (0.75, 4)], 2: [(0.5, 1)]}
    import pyarrow as pa

    group = ([1, 2, 3], [True, False, False], [-9.0, -9.0, 0.9], [1.0, 0.0, 0.8, 0.6, 0.0, 1.0])
    batch = pa.RecordBatch.from_arrays([pa.array([group[c]] * 2, pa.list_(t)) for c, t in enumerate((pa.int64(), pa.bool_(), pa.float64(), pa.float32()))], names=["u", "new", "least", "v"])
    got = [r for b in proximity._pairs(1)([batch]) for r in b.to_pylist()]
    assert [(r["src"], r["dst"], round(r["sim"], 6)) for r in got] == [(1, 2, 0.8), (2, 1, 0.8)]


def test_index_as_queried(spark):
    """Every vector whose id is divisible by 50 as a query: 0.9 of the ten nearest or more, from a fifth of the vectors or less."""
    at = "/root/testdata/sf0.1"
    got, want = catalogue.QUERIES["ann_topk"](spark, at), catalogue.QUERIES["vector_topk"](spark, at)
    assert recall(ids_of(got, "query", "vec_id"), ids_of(want, "query", "vec_id")) >= 0.95
    index = catalogue.vector_index(spark, at)
    found = index.search_batch(catalogue.fiftieth(spark, at), 10, vector_col="embedding")
    assert found.groupBy("query").agg(F.first("touched").alias("t")).agg(F.avg("t")).first()[0] <= 0.2 * 2000


def test_insert_remove_compact(spark, tmp_path, monkeypatch):
    import lodewell.sources.vectors as stored

    monkeypatch.setattr(stored, "FLAT", 0)  # added nodes are linked by walks
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id % 50 = 0").withColumnRenamed("id", "query")
    exact = lambda rows: ids_of(proximity.batch_topk(q, rows, 10, "query", "id", "vector"))
    index = VectorIndex.build(v.where("id % 5 <> 0"), "id", "vector", str(tmp_path / "ix"))
    first = VectorIndex(spark, index.path, version=index.version)
    index.insert(v.where("id % 5 = 0"))
    assert index.rows().count() == 500 == index.made["n"] and first.rows().count() == 400  # readers of the version before see that
    assert recall(ids_of(index.search_batch(q, 10)), exact(v)) >= 0.9
    index.remove(v.where("id % 10 = 3").select("id"))
    left = v.where("id % 10 <> 3")
    got = ids_of(index.search_batch(q, 10))
    assert recall(got, exact(left)) >= 0.9 and not any(i % 10 == 3 for x in got.values() for i in x) and index.made["n"] == 450
    moved = spark.createDataFrame([(7, [float(x) for x in -np.array(v.where("id = 7").first().vector)])], "id long, vector array<float>")  # the same id elsewhere
    index.insert(moved)
    assert index.made["n"] == 450 and index.rows().where("id = 7").count() == 1
    one = index.search_batch(moved.withColumnRenamed("id", "query"), 1).first()
    assert one.id == 7 and one.score == pytest.approx(1.0, abs=1e-5)
    index.compact()
    assert len(index.made["parts"]) == 1 and index.rows().count() == 450 and index.vacuum() > 0
    again = VectorIndex(spark, index.path)
    assert recall(ids_of(again.search_batch(q, 10)), exact(left.where("id <> 7").union(moved))) >= 0.9
    assert again.edges().where("src % 10 = 3 or dst % 10 = 3").count() == 0


def test_small_indexes(spark, tmp_path):
    none = spark.createDataFrame([], "id string, vector array<float>")
    index = VectorIndex.build(none, "id", "vector", str(tmp_path / "e"))
    some = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("n", None)], "id string, vector array<float>")
    ask = spark.createDataFrame([(1, [1.0, 0.2]), (2, None)], "query int, vector array<double>")
    assert index.search_batch(ask, 3).count() == 0 and index.nearest(ask, 3).count() == 0
    index.insert(some)
    assert [tuple(r)[:2] for r in index.search_batch(ask, 3).orderBy("rank").collect()] == [(1, "a"), (1, "b")]
    assert [r.id for r in index.search([0.1, 1.0], 2).collect()] == ["b", "a"]
    index.remove(some.select("id"))
    assert index.search_batch(ask, 3).count() == 0 and index.made["n"] == 0


def test_a_search_reads_the_lists_that_it_walks_through(spark, tmp_path):
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 16)) * 8
    rows = [(int(i), [float(x) for x in centres[i % 40] + r.standard_normal(16)]) for i in range(2000)]
    index = VectorIndex.build(spark.createDataFrame(rows, "id long, vector array<float>"), "id", "vector", str(tmp_path))
    seen = []
    stored = index._stored
    index._stored = lambda lists=None: (seen.extend(lists or []), stored(lists))[1]
    assert {x.id % 40 for x in index.search(rows[3][1], 10).collect()} == {3}
    assert 0 < len(set(seen)) <= 0.5 * len(index.lists)
    files = stored([index.lists[0]]).inputFiles()
    assert len([f for f in files if f"list={index.lists[0]}" in f]) >= 1
