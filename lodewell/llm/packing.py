"""Packing tokenised documents into sequences: best-fit decreasing, certified by lower bounds.

Documents become pieces of at most `length` tokens; pieces are dealt to partitions of bounded
size, and each packs its own by best-fit decreasing. Lower bounds from dual-feasible functions
(the identity, the rounding functions u(k), the thresholds of Fekete and Schepers and their
composition) say how few bins a partition's pieces need. A partition whose bins meet its bound
keeps all but its emptiest bin; one with a gap hands over every bin that has room. What is
handed over is dealt anew, by another hash and to fewer partitions, and packed again, until the
bins in all meet the bound of all pieces, a single partition has repacked the rest, or a turn has
saved no bin.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lexical import spread
from ._common import Scratch, frugal, no_null

TOKENIZER = "byte_bpe_50k"
SEQUENCE, SEPARATOR = 2048, 0
#: Pieces for each partition, and entries of a worker's table of words that it has encoded.
PARTITION_PIECES, CACHE_WORDS = 200_000, 150_000
_PART = re.compile(r"\s*\S+|\s+$")
#: White space on which Python's \s and the tokenizer's differ, or that neither side is sure to share.
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words(dict):
    """Ids as little-endian bytes, by white space and the word after it: no token of this kind of vocabulary spans the end of a word."""

    def __init__(self, path: str | None):
        import tiktoken
        from tokenizers import Tokenizer

        json_path = path or default_path(f"{TOKENIZER}.json")
        self.full = Tokenizer.from_file(json_path)
        with open(re.sub(r"\.json$", ".tiktoken", json_path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        import public_tokenizers

        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        if any(s in part for s in self.special):
            got = self.whole(part)
        else:
            got = np.array(self.fast.encode_ordinary(part), "<u4").tobytes()
        if len(part) < 64:
            self[part] = got
        return got

    def ids(self, text: str) -> bytes:
        """The ids of tokenizers' encode(text, add_special_tokens=False)."""
        if _ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _PART.findall(text)))


@functools.cache
def _words(path: str | None) -> Words:
    return Words(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, separator: int = SEPARATOR, tokenizer_path: str | None = None) -> DataFrame:
    """(id, piece int, start long, length long, ids_crc32 long) for every piece of every document.

    A document is its ids and then the separator's; a null or empty text is the separator
    alone. One of more than `length` ids is cut into pieces of `length`, the first of which
    is the shorter one if it doesn't divide.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _words(tokenizer_path), np.array([separator], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for row, text in enumerate(b.column(1)):
                ids = words.ids(text.as_py()) + end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    size = (n - 1) % length + 1 if at == 0 else length
                    out.append((row, piece, at, size, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)])))
                    at, piece = at + size, piece + 1
            rows, *rest = zip(*out, strict=True) if out else [()] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, rest, kinds)], names=["id", "piece", "start", "length", "ids_crc32"])
        words.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), no_null(text_col).alias("text")).mapInArrow(frugal(run), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins that pieces of these sizes need at least, by dual-feasible functions in exact integer arithmetic."""
    if not len(sizes):
        return 0
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    up = lambda top, bottom: -(-int(top) // int(bottom))
    best = up((sizes * counts).sum(), capacity)
    for t in range(1, capacity // 2 + 1):  # sizes over capacity - t count whole, those below t not at all
        f = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes))
        best = max(best, up((f * counts).sum(), capacity))
    for k in range(1, 65):  # u(k): x where (k+1)x is whole, else floor((k+1)x)/k; scaled by capacity * k
        whole = (k + 1) * sizes % capacity == 0
        u = np.where(whole, sizes * k, (k + 1) * sizes // capacity * capacity)
        best = max(best, up((u * counts).sum(), capacity * k))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each piece's bin and offset, and the number of bins. Bins of equal room are alike: a bit set has the rooms there are."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, n


def _repack(turn: int, last: bool, length: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(sizes, length)
        fill = np.bincount(bins, weights=sizes, minlength=used)
        if last:
            free = np.zeros(used, bool)
        elif used > lower_bound(*np.unique(sizes, return_counts=True), length):
            free = fill < length
        else:
            free = np.arange(used) == int(fill.argmin())
        number = (turn << 56) + (int(key[0]) << 32)
        return pdf.drop(columns="_lw_part").assign(sequence_id=number + bins, offset=offsets, _lw_again=free[bins])

    return run


def pack(parts: DataFrame, scratch: Scratch, length: int = SEQUENCE) -> DataFrame:
    """parts with sequence_id long and offset long: which sequence a piece is in, and where.

    parts has the columns of pieces() (others are kept). Offsets in a sequence run on from 0
    without gaps. Every row is a piece of its own, repeated rows too, which are dealt to
    partitions like others; an empty table gives an empty result. Columns named sequence_id or
    offset are replaced; names beginning with _lw_ are taken.
    """
    parts = parts.drop("sequence_id", "offset")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    counts = parts.groupBy("length").count().collect()  # `length` rows at most
    bound = lower_bound(np.array([r[0] for r in counts]), np.array([r[1] for r in counts]), length)
    waiting, done, fixed, turn, before = parts, None, 0, 0, None
    left = sum(r[1] for r in counts)
    while True:
        n = max(1, -(-left // PARTITION_PIECES)) if turn else max(1, -(-left // (PARTITION_PIECES // 4)))
        salted = waiting.withColumn("_lw_part", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id(), F.lit(turn)), F.lit(n)).cast("int"))
        packed = salted.groupBy("_lw_part").applyInPandas(_repack(turn, n == 1, length), f"{kinds}, sequence_id long, offset long, _lw_again boolean")
        packed = scratch.save(packed, f"packed{turn}")
        kept = packed.where("not _lw_again").drop("_lw_again")
        done = kept if done is None else done.union(kept)
        if n == 1:
            break
        fixed += kept.where("offset = 0").count()
        again = packed.where("_lw_again").agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        left, now = again[0], fixed + again[1]
        if now == bound or not left or (before is not None and now >= before):  # certified, or a turn that has saved nothing
            done = done.union(packed.where("_lw_again").drop("_lw_again"))
            break
        waiting, before, turn = packed.where("_lw_again").select(*parts.columns), now, turn + 1
    return done


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    scratch = Scratch(spark, "packing")
    found = scratch.save(pieces(docs), "pieces")
    return pack(found, scratch).withColumnRenamed("id", "doc_id")
