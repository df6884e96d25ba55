"""Keyed tables against a dictionary, by what is read and what is written."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodewell.sources.tables import KeyedTable

SCHEMA = "id string, v long"


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_against_a_dictionary(spark, tmp_path, seed):
    r, held = random.Random(seed), {}
    frame = lambda d: spark.createDataFrame(list(d.items()), SCHEMA).coalesce(1)
    keys = lambda ids: spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1)
    t = KeyedTable.create(spark, str(tmp_path), SCHEMA, "id", buckets=4)
    assert t.read().count() == 0 and t.lookup(["k1"]).count() == 0
    t.change(frame({f"k{i}": i for i in range(100)}))
    held = {f"k{i}": i for i in range(100)}
    first, then = KeyedTable(spark, t.path, t.version), dict(held)
    for turn in range(7):
        new = {f"k{r.randrange(130)}": 1000 * turn + i for i in range(r.choice([0, 3, 6]))}
        gone = [f"k{r.randrange(130)}" for _ in range(r.choice([0, 4]))]
        gone = [g for g in gone if g not in new]
        t.change(frame(new), keys(gone + gone))
        held = {k: v for k, v in held.items() if k not in gone} | new
        assert {x.id: x.v for x in t.read().collect()} == held
        ask = ["k1", "k2", "k77", "k125", "nothing", None, "k1"]
        want = {k: held[k] for k in ask if k in held}
        assert {x.id: x.v for x in t.lookup(ask).collect()} == {x.id: x.v for x in t.lookup(keys(ask)).collect()} == want
    assert len(t.made["parts"]) < 7 and {x.id: x.v for x in first.read().collect()} == then
    t.compact()
    assert len(t.made["parts"]) == 1 and not t.made["gone"] and t.vacuum() > 0
    assert {x.id: x.v for x in KeyedTable(spark, t.path).read().collect()} == held
    t.change(None, t.read().select("id"))
    assert t.read().count() == 0


def test_rows_without_a_key_stay(spark, tmp_path):
    t = KeyedTable.create(spark, str(tmp_path), SCHEMA, "id")
    for _ in range(2):
        t.change(spark.createDataFrame([(None, 1), ("a", 2)], SCHEMA))
    assert sorted(map(str, t.read().collect())) == sorted(["Row(id=None, v=1)"] * 2 + ["Row(id='a', v=2)"])


def test_a_change_writes_its_own_rows(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    t = KeyedTable.create(spark, str(tmp_path), "doc_id long, text string", "doc_id")
    t.change(d)
    size = lambda: {os.path.join(x, f): os.path.getsize(os.path.join(x, f)) for x, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet")}
    before = size()
    t.change(d.where("doc_id in (5, 600)").withColumn("text", F.lit("short")), d.where("doc_id = 7"))
    after = size()
    assert all(after[f] == n for f, n in before.items()) and sum(after.values()) - sum(before.values()) < 0.02 * sum(before.values())
    assert t.read().count() == d.count() - 1 and {x.text for x in t.lookup([5, 600, 7]).collect()} == {"short"}
    plan = t.lookup([5])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "array_contains" in plan.split("PartitionFilters: [")[1][:200]
