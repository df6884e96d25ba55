"""Embedders turn texts into unit vectors. The default one hashes tokens: same contract as a model, no semantics."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import EmbedError

BATCH, MAX_TOKENS = 64, 512


class Embedder(Protocol):
    dim: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Counts of tokens, dealt to dimensions and signs by a hash, at length one. A text without tokens has a zero vector in a batch and is an error alone."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    @staticmethod
    def _hash(token: str) -> int:
        h = 0xCBF29CE484222325
        for b in token.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h

    def _one(self, text: str) -> list[float]:
        plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()
        v = [0.0] * self.dim
        for token in re.findall(r"[^\W_]+", plain)[:MAX_TOKENS]:
            h = self._hash(token)
            v[h % self.dim] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    def embed(self, text: str) -> list[float]:
        v = self._one(text)
        if not any(v):
            raise EmbedError("the text has no tokens")
        return v

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]


def embed_column(df: DataFrame, text: str | Column, out: str, embedder: Embedder) -> DataFrame:
    """df with a column of vectors; batches of BATCH texts."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            got: list = []
            for at in range(0, len(s), BATCH):
                got += embedder.embed_batch(list(s.iloc[at : at + BATCH]))
            yield pd.Series(got, dtype=object)

    return df.withColumn(out, run(F.col(text) if isinstance(text, str) else text))
