"""64-bit hashes with wrapping arithmetic.

djb2, which is taken of short names, is a column expression on two 32-bit limbs (whole products
would overflow a long). FNV-1a, which is taken of whole texts, is an Arrow kernel: the texts of a
batch are hashed side by side, a byte of each in a step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def utf8_bytes(c: Column) -> Column:
    """The bytes of a string as an array of longs."""
    pairs = F.split(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "$1,"), ",")
    return F.transform(F.filter(pairs, lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))


def _fold(c: Column, seed: int, step) -> Column:
    first = F.struct(F.lit(seed >> 32).cast("long").alias("hi"), F.lit(seed & MASK).cast("long").alias("lo"))

    def shown(limb: Column) -> Column:
        return F.lpad(F.hex(limb), 8, "0")

    return F.aggregate(utf8_bytes(c), first, lambda h, b: step(h["hi"], h["lo"], b), lambda h: F.lower(F.concat(shown(h["hi"]), shown(h["lo"]))))


def _limbs(hi: Column, lo: Column) -> Column:
    return F.struct(hi.bitwiseAND(F.lit(MASK)).alias("hi"), lo.bitwiseAND(F.lit(MASK)).alias("lo"))


OFFSET, PRIME, FEW = 0xCBF29CE484222325, 0x100000001B3, 12


def fnv1a_of(texts: list[bytes]) -> np.ndarray:
    """FNV-1a of each of many byte strings. What goes on when fewer than FEW are left is done one by one."""
    size = np.array([len(t) for t in texts], np.int64)
    data, start = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    at, h = start[order], np.full(len(texts), OFFSET, np.uint64)
    left = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")  # texts that have a byte i
    with np.errstate(over="ignore"):
        for i, k in enumerate(left.tolist()):
            if k < FEW:
                break
            h[:k] = (h[:k] ^ data[at[:k] + i]) * np.uint64(PRIME)
        else:
            i = len(left)
    for j in range(int(left[i]) if i < len(left) else 0):
        one = int(h[j])
        for b in texts[order[j]][i:]:
            one = (one ^ b) * PRIME & 0xFFFFFFFFFFFFFFFF
        h[j] = one
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1a(c: Column) -> Column:
    """FNV-1a of a string's UTF-8 bytes, as 16 hexadecimal digits; null of null."""

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        there = col.notna()
        got = fnv1a_of([t.encode() for t in col[there]])
        out = pd.Series([None] * len(col), index=col.index, dtype=object)
        out[there] = [f"{x:016x}" for x in got.tolist()]
        return out

    return run(c)


def djb2(*parts: Column) -> Column:
    """djb2 (h * 33 + byte from 5381) of strings on end, as 16 hexadecimal digits."""

    def step(hi: Column, lo: Column, b: Column) -> Column:
        low = lo * 33 + b
        return _limbs(hi * 33 + F.shiftright(low, 32), low)

    return _fold(F.concat(*parts), 5381, step)


def chunk_id(path: Column, name: Column, kind: Column) -> Column:
    """A chunk's identity. Parts are not separated, so chunks of one path, name and kind share it."""
    return djb2(path, name, kind)


def path_key(path: Column) -> Column:
    """The name under which a workspace's path is registered."""
    return djb2(path)
