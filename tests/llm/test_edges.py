"""Every query over documents on a table with nulls, repeated rows, a very long text and columns whose names clash, against the same table without those columns."""

import random

import pytest
from pyspark.sql import functions as F

from lodewell.llm import registry

NAMES = ["id", "word", "words", "key", "score", "rank", "shard", "slot", "size", "piece", "start", "length", "frames", "media", "n_bytes", "fingerprint", "h", "b", "bucket", "seq", "lang_pred", "rejected", "labels", "weight", "n", "value", "root", "node", "c", "t", "x"]
#: What isn't the same for equal tables: numbers of sequences and places in them are free.
FREE = {"op7_best_fit_packing": {"sequence_id", "offset"}}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(8)
    vocabulary = "der die und in von the of and thing house water les gens dans une ville casa agua tierra".split()
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = [(i, text(r.randrange(1, 60)), r.choice(["en", "de", None]), r.choice(["src1", "src2", None])) for i in range(40)]
    rows += [(100, None, "en", "src1"), (101, "", None, None), (102, "123 .. !", "de", "src2"), (103, text(90_000), "en", "src1"), (7, rows[7][1], "en", "src1"), (200, rows[3][1], "de", "src2"), (201, "É漢字 ünïcode 🙂 " * 30, "fr", "src3")]
    out = []
    for clash in (False, True):
        at = tmp_path_factory.mktemp("edges")
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
        df.withColumns({c: F.lit(f"own {c}") for c in NAMES} if clash else {}).coalesce(1).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, "the house of the water"), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        out.append(str(at))
    return out


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in ("op5_warc", "op13_conversation_trie")])
def test_columns_that_clash(spark, tables, name):
    got = []
    for at in tables:
        df = registry.QUERIES[name](spark, at)
        columns = [c for c in df.columns if c not in FREE.get(name, set())]
        got.append(sorted(map(str, df.select(columns).collect())))
        if name not in ("op1_mixing", "op7_best_fit_packing"):
            assert len(got[-1]) == 47  # every row is there, repeated ones too
    assert got[0] == got[1] and got[0]
