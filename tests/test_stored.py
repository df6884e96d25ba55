"""Stored indexes: the inverted index against a scan of the corpus, vector lists against exact search, versions, locks and the registry."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewell.config import Settings
from lodewell.embedder import HashingEmbedder
from lodewell.errors import StorageError
from lodewell.functions import hashing as H
from lodewell.functions import vectors as V
from lodewell.operators import retrieval
from lodewell.sources.index import Index
from lodewell.sources.lexical import LexicalIndex
from lodewell.sources.registry import Registry, path_key

TEXTS = [("a", "one", "of the people of the land"), ("b", "of", "the of"), ("c", None, "Of_the THE of the"), ("d", "", ""), ("e", "x", None), ("f", "und von", "von und von " * 30), ("g", "of of of", "of of")]


@pytest.fixture(scope="module")
def lexical(spark, tmp_path_factory):
    docs = spark.createDataFrame(TEXTS, "id string, name string, source string")
    return docs, LexicalIndex.build(docs, "id", ["name", "source"], str(tmp_path_factory.mktemp("lex")))


@pytest.mark.parametrize("query", ["the", "of the", "of_the", "of_of", "of_of_of", "of the of", "und_von von", "nothing", "", "_", "the nothing"])
def test_lexical_against_a_scan(spark, lexical, query):
    docs, index = lexical
    rows = lambda df: [(r[0], round(r[1], 9)) for r in df.collect()]
    assert rows(index.search(query)) == rows(retrieval.bm25(docs, "id", ["name", "source"], query))
    assert rows(index.search(query, 2)) == rows(retrieval.bm25(docs, "id", ["name", "source"], query, 2))


def test_lexical_reads_its_terms_only(spark, lexical):
    docs, index = lexical
    plan = index.search("people")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(term" in plan or "EqualTo(term,people)" in plan
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, retrieval.postings(docs, "id", ["name", "source"]).collect()))
    empty = LexicalIndex.build(docs.limit(0), "id", ["name", "source"], index.path + "-empty")
    assert empty.search("the").count() == 0 and empty.postings().count() == 0


def test_postings_are_made_where_documents_are_read(spark, monkeypatch):
    import lodewell.sources.lexical as lex

    monkeypatch.setattr(lex, "TOKENS", 9)
    docs = spark.createDataFrame([*TEXTS, ("h", "the", "the " * 300)], "id string, name string, source string").coalesce(1)
    some = lex.pieces(docs, "id", ["name", "source"])
    assert "hashpartitioning" not in some._jdf.queryExecution().executedPlan().toString()
    got = {(r.term, i): (n, p) for r in some.collect() for i, n, p in zip(r.ids, r.lens, r.places, strict=True)}
    want, size = {}, {}
    for i, a, b in [*TEXTS, ("h", "the", "the " * 300)]:
        words = [(x or "").lower().replace("_", " ").split() for x in (a, b)]
        size[i] = sum(map(len, words))
        for pos, w in enumerate([*words[0], None, *words[1]]):
            if w:
                want.setdefault((w, i), []).append(pos)
    assert got == {k: (size[k[1]], p) for k, p in want.items()}


def scores(df):
    return [(r[0], round(r[1], 9)) for r in df.collect()]


def test_segments_against_a_rebuild(spark, tmp_path):
    """Random additions, replacements and removals: what is found is what an index of the texts left finds."""
    r = random.Random(11)
    text = lambda: " ".join(r.choice(["the", "of", "und", "a", "b", "c"]) for _ in range(r.randrange(12)))
    schema = "id string, name string, source string"
    held = {f"d{i}": (text(), text()) for i in range(60)}
    frame = lambda of: spark.createDataFrame([(k, *v) for k, v in of.items()], schema)
    index = LexicalIndex.build(frame(held), "id", ["name", "source"], str(tmp_path / "ix"))
    first, before = LexicalIndex(spark, index.path, index.version), scores(index.search("the of"))
    for turn in range(5):
        new = {f"d{r.randrange(80)}": (text(), text()) for _ in range(4)}
        gone = [k for k in r.sample(sorted(held), 3) if k not in new]
        index.update(frame(new), spark.createDataFrame([(k,) for k in gone], "id string"))
        held = {k: v for k, v in held.items() if k not in gone} | new
        if turn == 2:
            assert index.made["gone"]
    assert len(index.made["segments"]) < 6  # small ones were merged
    docs = frame(held)
    for x in (index, LexicalIndex(spark, index.path)):
        assert (x.docs, x.tokens) == (len(held), sum(len(f"{a} {b}".split()) for a, b in held.values()))
        for query in ("the", "the of", "of_the", "und_und a", "nothing"):
            assert scores(x.search(query)) == scores(retrieval.bm25(docs, "id", ["name", "source"], query)), query
            assert scores(x.search(query, 3)) == scores(retrieval.bm25(docs, "id", ["name", "source"], query, 3)), query
        assert sorted(map(tuple, x.postings().collect())) == sorted(map(tuple, retrieval.postings(docs, "id", ["name", "source"]).collect()))
    assert scores(first.search("the of")) == before  # a reader of the first version sees that
    index.merge([s["name"] for s in index.made["segments"]])
    assert len(index.made["segments"]) == 1 and not index.made["gone"] and index.vacuum() > 0
    assert scores(index.search("the of", 5)) == scores(retrieval.bm25(docs, "id", ["name", "source"], "the of", 5))
    index.update(frame({}), docs.select("id"))
    assert index.docs == index.tokens == 0 and index.search("the").count() == 0


def test_an_update_writes_its_own_postings(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text")
    index = LexicalIndex.build(docs, "doc_id", ["source", "text"], str(tmp_path))
    size = lambda: {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet")}
    before = size()
    two = spark.createDataFrame([(3, "src1", "some new words of the third"), (9001, "src2", "words of a new one")], "id long, source string, text string")
    index.update(two)
    after = size()
    assert all(after[f] == n for f, n in before.items())
    new = {f: n for f, n in after.items() if f not in before}
    named = {s["name"] for s in index.made["segments"][1:]}
    assert all(any(f"seg={n}" in f for n in named) for f in new) and sum(n for f, n in new.items() if "/blocks/" in f) < 0.1 * sum(n for f, n in before.items() if "/blocks/" in f)
    changed = docs.withColumnRenamed("doc_id", "id").where("id <> 3").union(two)
    assert scores(index.search("words of", 5)) == scores(retrieval.bm25(changed, "id", ["source", "text"], "words of", 5))


def test_blocks_that_cannot_be_among_the_best_are_not_read(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, "", "the " * (9 if i % 400 == 7 else 1) + " ".join(f"w{r.randrange(500)}" for _ in range(5 if i % 400 == 7 else r.randrange(30, 90)))) for i in range(8000)]
    docs = spark.createDataFrame(rows, "id long, name string, source string").repartition(4)
    index = LexicalIndex.build(docs, "id", ["name", "source"], str(tmp_path))
    seen = []
    least = index.least_impact
    index.least_impact = lambda *a: (seen.append(least(*a)), seen[-1])[1]
    assert scores(index.search("the", 10)) == scores(retrieval.bm25(docs, "id", ["name", "source"], "the", 10))
    blocks = index._of("blocks", ["the"])
    assert seen[0] is not None and blocks.count() >= 60 and blocks.where(F.col("impact") >= seen[0]).count() < 0.5 * blocks.count()
    plan = blocks.where(F.col("impact") >= seen[0])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(impact" in plan  # the files' statistics decide
    for query, n in (("w7", 3), ("w7 the", 4), ("the the", 12), ("the", 8000)):
        assert scores(index.search(query, n)) == scores(retrieval.bm25(docs, "id", ["name", "source"], query, n))


def chunks_of(index):
    return sorted(r.name for r in index.table("chunks").collect())


def test_versions_lock_and_rollback(spark, tmp_path, monkeypatch):
    root = tmp_path / "ws"
    root.mkdir()
    (root / "a.py").write_text("def alpha():\n    return 1\n")
    settings = Settings()
    settings.search.min_score = 0.0
    index = Index(spark, str(tmp_path / "ix"), HashingEmbedder(16), settings)
    index.reindex(str(root))
    first = index.manifest()
    index.add_note("a note")
    second = index.manifest()
    assert {k for k in second if second[k] != first.get(k)} == {"notes"}  # nothing else is written again
    assert index.lexical().search("alpha").count() == 1

    (tmp_path / "ix" / ".lock").write_text("")
    with pytest.raises(StorageError, match="is running"):
        index.reindex(str(root))
    os.utime(tmp_path / "ix" / ".lock", (1, 1))  # of a driver that died long ago
    (root / "a.py").write_text("def beta():\n    return 22\n")
    assert index.reindex(str(root))["changed"] == 1 and chunks_of(index) == ["beta"] and not (tmp_path / "ix" / ".lock").exists()

    before = index.manifest()
    index.vacuum()
    files = lambda: sorted(os.path.join(d, x) for d, _, fs in os.walk(tmp_path / "ix") for x in fs if x.endswith(".parquet"))
    held = files()
    monkeypatch.setattr(LexicalIndex, "update", lambda *a: 1 / 0)
    (root / "a.py").write_text("def gamma():\n    return 333\n")
    with pytest.raises(ZeroDivisionError):
        index.reindex(str(root))
    assert index.manifest() == before and chunks_of(index) == ["beta"]
    index.vacuum()
    assert files() == held and chunks_of(index) == ["beta"]  # what the update had written is gone
    monkeypatch.undo()
    made = index.manifest()
    (tmp_path / "ix" / index.version() / "manifest.json").write_text(__import__("json").dumps(made | {"lexical_of": "other"}))
    crc = tmp_path / "ix" / index.version() / ".manifest.json.crc"
    if crc.exists():
        crc.unlink()
    assert index.lexical().search("beta").count() == 1 and index.manifest()["lexical_of"] == made["chunks"]  # rebuilt, as it didn't fit
    assert index.vacuum() >= 1 and chunks_of(index) == ["beta"]


def test_pluggable_similarity(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 3.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in retrieval.vector_topk(v, [1.0, 0.1], 2).collect()] == [2, 1]
    assert [r.vec_id for r in retrieval.vector_topk(v, [1.0, 0.1], 2, similarity=V.cosine).collect()] == [1, 2]


def test_registry(spark, tmp_path):
    assert path_key("/home/x é") == spark.range(1).select(H.path_key(F.lit("/home/x é"))).first()[0]
    registry = Registry(str(tmp_path / "registry"))
    for name in ("a", "b", "c"):
        (tmp_path / name).mkdir()
        at = registry.add(str(tmp_path / name))
        assert os.path.isdir(at) and registry.add(str(tmp_path / name)) == at
    assert len(registry.all()) == 3 and registry.gc() == 0
    os.rmdir(tmp_path / "a" / ".lodewell")
    assert len(registry.all()) == 2 and registry.gc() == 1
    registry.remove(str(tmp_path / "b"))
    assert registry.all() == [str(tmp_path / "c" / ".lodewell")] and not (tmp_path / "b" / ".lodewell").exists()


def test_stream_rewrites_the_buckets_it_has_keys_of(spark, tmp_path):
    from lodewell.streaming.incremental import _manifest, current, stream_rows

    schema = "k long, v string, seq int"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: stream_rows(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, f"{tmp_path}/log", f"{tmp_path}/out", "k", "seq", buckets=8)
    put([(i, "a", 1) for i in range(100)])
    run()
    put([(3, "b", 2), (200, "new", 1), (4, "old", 0)])
    run()
    last, own = _manifest(spark, f"{tmp_path}/out")
    assert last == 1 and sorted(set(own.values())) == [0, 1] and sum(v == 1 for v in own.values()) <= 3
    got = {r.k: r.v for r in current(spark, f"{tmp_path}/out", schema).collect()}
    assert got == {i: "a" for i in range(100)} | {3: "b", 200: "new"}
