"""Near-duplicate detection by SimHash with a positional inverted index and count filtering.

A fingerprint of 64 bits is a set of eight (position, byte) tokens. Two fingerprints that
differ in at most d < 8 bits share at least 8 - d of them: the guaranteed minimum. Positions are
ordered by the lengths of their bytes' lists, the shortest first, and the first d + 4 of them are
a fingerprint's prefix: of the tokens that a pair must share, at least four are in it. A list of
one byte would hold a 256th of everything, so the lists that are kept are the intersections of
four tokens of the prefix: 2**32 keys for each choice of four, which stay short at billions of
fingerprints. A pair that shares m tokens of the prefix meets in C(m, 4) lists; so the tally of
the lists in which it meets says how many it shares, tokens outside the prefix are added,
pairs below the minimum go, and the rest are verified by their differing bits.

Equal fingerprints are one entry. A list longer than `list_limit` emits no pairs: its
members are linked through the values one bit away from them, each of which at most 65
fingerprints can share; two fingerprints at distance 2 or less always share one, and all that
share one are within 2 bits, so the links give the same components exactly, in linear space.
A pair that meets in long and short lists may be tallied too low; it is linked by the long one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lexical import spread
from ._common import WORD, Scratch, frugal, no_null, shuffled
from ._graph import connected_components

_WORD = re.compile(WORD.encode())
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_STEP = 1 << 16
#: Tokens of a fingerprint, and tokens that key a list.
BYTES, KEYED = 8, 4


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text; null and wordless texts have 0."""
    words = _WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    if len(words) < shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n, ones = len(words) - shingle_words + 1, np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        part = words[at : at + _STEP + shingle_words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle_words)), strict=False))
        h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
        by = h.view(np.uint8).reshape(-1, 8)
        for p in range(8):
            ones[8 * p : 8 * p + 8] += np.bincount(by[:, p], minlength=256) @ _BITS
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def of_sets(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """SimHash of each of many sets of 64-bit hashes that lie on end; an empty one has 0."""
    size, full = np.diff(off), np.flatnonzero(np.diff(off) > 0)
    out = np.zeros(len(size), np.uint64)
    for i in range(64 if len(full) else 0):
        ones = np.add.reduceat((h >> np.uint64(i) & np.uint64(1)).astype(np.int64), off[full])
        out[full] |= (2 * ones > size[full]).astype(np.uint64) << np.uint64(i)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, tk long, fp long): a hash of the text, and the fingerprint's bits as a signed long. One row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle_words) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["id", "tk", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(no_null(text_col)).alias("tk"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"id {kind}, tk long, fp long")


def _byte(fp: Column, p: int) -> Column:
    return F.shiftright(fp, 8 * p).bitwiseAND(F.lit(255))


def position_order(fps: DataFrame) -> list[int]:
    """Positions by the lengths of their bytes' lists, the shortest on average first."""
    tokens = fps.select(F.posexplode(F.array(*(_byte(F.col("fp"), p) for p in range(BYTES)))).alias("position", "byte"))
    lists = tokens.groupBy("position", "byte").agg(F.count("*").cast("double").alias("n"))  # 2048 at most
    sizes = {r.position: r.n for r in lists.groupBy("position").agg(F.sum(F.col("n") * F.col("n")).alias("n")).collect()}
    return sorted(range(BYTES), key=lambda p: (sizes.get(p, 0), p))


def lists(fps: DataFrame, prefix: list[int]) -> DataFrame:
    """(key, fp): the index, a row for each choice of KEYED positional bytes of the prefix."""
    keys = []
    for k, chosen in enumerate(combinations(prefix, KEYED)):
        key = F.lit(k << 8 * KEYED)
        for i, p in enumerate(chosen):
            key = key.bitwiseOR(F.shiftleft(_byte(F.col("fp"), p), 8 * i))
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def links(fps: DataFrame, max_bits: int = 2, list_limit: int = 32) -> DataFrame:
    """Distinct (fp) -> (a, b): pairs of fingerprints whose links give the exact components. max_bits is 0 to 2."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    fp, order = F.col("fp"), position_order(fps)
    prefix, others = order[: max_bits + KEYED], order[max_bits + KEYED :]
    posts = lists(fps, prefix)
    sizes = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posts = posts.join(shuffled(sizes), "key")
    short, long = posts.where(F.col("n") <= list_limit), posts.where(F.col("n") > list_limit)

    met = shuffled(short.select("key", fp.alias("x"))).join(short.select("key", fp.alias("y")), "key").where(F.col("x") < F.col("y"))
    pairs = met.groupBy("x", "y").agg(F.count("*").alias("met"))
    shared = F.lit(0)
    for m in range(KEYED, len(prefix) + 1):
        shared = F.when(F.col("met") >= comb(m, KEYED), F.lit(m)).otherwise(shared)
    shared = sum(((_byte(F.col("x"), p) == _byte(F.col("y"), p)).cast("int") for p in others), shared)
    pairs = pairs.where(shared >= BYTES - max_bits).where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits)

    out = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))
    if max_bits == 2:
        near = F.array(fp, *(fp.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)))
        stars = long.select("fp").distinct().select("fp", F.explode(near).alias("at"))
        stars = stars.groupBy("at").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
        stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
        out = out.union(stars)
    elif max_bits == 1:
        near = F.array(*(fp.bitwiseAND(F.lit(~(1 << i) if i < 63 else (1 << 63) - 1).cast("long")) for i in range(64)))
        stars = long.select("fp").distinct().select("fp", F.posexplode(near).alias("bit", "at"))
        stars = stars.groupBy("bit", "at").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
        out = out.union(stars.select("a", "b"))  # two fingerprints at most share all bits but one
    return out.distinct()


def _rooted(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, max_bits: int, list_limit: int) -> tuple[DataFrame, DataFrame]:
    """(id, tk, fp) of each row, and (fp, root, component_id) of each fingerprint: its component, and that one's least id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(links(distinct.select("fp"), max_bits, list_limit), scratch)
    named = distinct.join(shuffled(roots), distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = scratch.save(named, "named")
    scratch.keep(prints, named)
    return prints, shuffled(named).join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2, list_limit: int = 32) -> DataFrame:
    """(id, fp, component_id) for each row: texts whose fingerprints link at max_bits or fewer.

    component_id is the least id reachable through links, the row's own included. Null and
    wordless texts have fingerprint zero and link like any other; so do very long ones, which are
    read whole; repeated rows link at distance zero; a row with a null id links like any
    other, and is never the name of its component (null if there is no other id); an empty
    table gives an empty result; no other column of docs is looked at, whatever its name.
    """
    prints, named = _rooted(docs, id_col, text_col, shingle_words, max_bits, list_limit)
    return prints.join(shuffled(named), "fp").select("id", "fp", "component_id")


def hex_print(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2, list_limit: int = 32) -> DataFrame:
    """The rows of docs, one for each group of near duplicates: that with the least id.

    Of different texts with that id, one stays (that with the least hash); of repeated rows, any.
    Rows without an id have no place in that order and stay. All columns are kept; _lw_tk is taken.
    """
    own = docs.where(F.col(id_col).isNotNull())
    prints, named = _rooted(own, id_col, text_col, shingle_words, max_bits, list_limit)
    kept = prints.join(shuffled(named), "fp").groupBy("root").agg(F.min(F.struct("id", "tk")).alias("k"))
    kept = kept.select(F.col("k.id").alias("_lw_id"), F.col("k.tk").alias("_lw_kept"))
    own = own.withColumn("_lw_tk", F.xxhash64(no_null(text_col)))
    own = own.join(shuffled(kept), (F.col(id_col) == F.col("_lw_id")) & (F.col("_lw_tk") == F.col("_lw_kept")), "left_semi")
    return own.dropDuplicates([id_col, "_lw_tk"]).drop("_lw_tk").union(docs.where(F.col(id_col).isNull()))


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), hex_print().alias("fingerprint"), "component_id")
