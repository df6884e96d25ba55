"""Queries over whole texts, against brute force on long texts."""

import re

from lodewell.plans import catalogue

LONG = "wörter und zeichen, " * 60
TEXTS = ["", "short", LONG, LONG + "a", LONG + "b", "x" * 79 + "yz _end1 (" + LONG + ")"]


def rows_of(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return [r[1] for r in sorted(catalogue.QUERIES[name](spark, str(tmp_path)).collect())]


def fnv1a(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"{h:016x}"


def test_fnv1a_hash(spark, tmp_path):
    got = rows_of(spark, tmp_path, "fnv1a_hash")
    assert got == [fnv1a(t) for t in TEXTS] and len(set(got)) == len(TEXTS)


def test_kernel():
    from lodewell.functions import hashing

    for texts in ([], [""], ["é" * n for n in range(50)], ["a" * 5000, "", *["b" * n for n in range(0, 3000, 7)]]):
        assert [f"{h:016x}" for h in hashing.fnv1a_of([t.encode() for t in texts]).tolist()] == [fnv1a(t) for t in texts]


def test_sanitize_query(spark, tmp_path):
    got = rows_of(spark, tmp_path, "sanitize_query")
    assert got == [" ".join(f'"{w}"' for w in re.findall(r"\w+", t)) for t in TEXTS]
