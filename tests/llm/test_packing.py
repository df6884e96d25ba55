import random
import zlib
from itertools import permutations

import numpy as np
from tokenizers import Tokenizer

from lodewell.llm import packing


def test_ids_are_the_tokenizer_s(spark):
    t = Tokenizer.from_file(packing.default_path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", " ", "\n\n  x\t y  ", "a  b", "x\x1c y", "don't  'll we've\r\n\r\n", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|>", "日本語 テキスト　と", "​   a", "w" * 5000, "é́ ﻿", "1 22\n333  4"]
    words = packing.Words(None)
    for x in texts:
        assert words.ids(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x[:60])


def least_bins(sizes, cap):
    best = len(sizes)
    for p in set(permutations(sizes)):
        bins, room = 1, cap
        for s in p:
            if s > room:
                bins, room = bins + 1, cap
            room -= s
        best = min(best, bins)
    return best


def test_bounds_and_best_fit():
    r = random.Random(2)
    for _ in range(60):
        cap = r.choice([7, 10, 12])
        sizes = np.array([r.randint(1, cap) for _ in range(r.randint(1, 7))])
        bins, offsets, n = packing.best_fit_decreasing(sizes, cap)
        low = packing.lower_bound(*np.unique(sizes, return_counts=True), cap)
        assert low <= least_bins(sizes.tolist(), cap) <= n
        for b in range(n):
            own = sorted(zip(offsets[bins == b], sizes[bins == b], strict=True))
            at = 0
            for o, s in own:
                assert o == at
                at += s
            assert at <= cap
    assert packing.lower_bound(np.array([6]), np.array([10]), 10) == 10  # more than the sum says


def test_query(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_PIECES", 120)  # several partitions and rounds
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(900, None), (901, ""), (902, "word " * 9000), (900, None), (None, "x")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op7_best_fit_packing(spark, str(tmp_path)).collect()
    t, want, total = Tokenizer.from_file(packing.default_path("byte_bpe_50k.json")), [], []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        at, piece = 0, 0
        while at < len(ids):
            n = (len(ids) - 1) % 2048 + 1 if at == 0 else 2048
            want.append((str(i), piece, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            total.append(n)
            at, piece = at + n, piece + 1
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    bound = packing.lower_bound(*np.unique(total, return_counts=True), 2048)
    assert bound <= len(seqs) <= bound + 2
    docs_of([]).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert packing.op7_best_fit_packing(spark, f"{tmp_path}/e").count() == 0


def test_repeated_rows_are_parted(spark, docs_of, monkeypatch):
    """A third of all pieces are one row: no partition packs them all, and the result is as good as the bound allows."""
    from pyspark.sql import functions as F

    from lodewell.llm._common import Scratch

    monkeypatch.setattr(packing, "PARTITION_PIECES", 400)
    rows = [(7, 0, 0, 900, 1)] * 600 + [(i, 0, 0, 1 + i % 700, i) for i in range(1200)]
    parts = spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long").withColumns({"sequence_id": F.lit("old"), "mine": F.lit("kept")})
    scratch = Scratch(spark, "t")
    seen, run = [], packing._repack
    monkeypatch.setattr(packing, "_repack", lambda turn, last, length: seen.append(last) or run(turn, last, length))
    got = packing.pack(parts, scratch).collect()
    assert len(got) == len(rows) and {r.mine for r in got} == {"kept"} and len(seen) > 1
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    first = {r.sequence_id >> 32 for r in got if r.id == 7 and r.sequence_id >> 56 == 0}
    assert len(first) > 3  # the repeated row was in several partitions
    assert len(seqs) <= packing.best_fit_decreasing(np.array([x[3] for x in rows]), 2048)[2] + 3  # as one partition with them all would
