"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's n-grams are those of 1 to 3 bytes of its lower-cased letters (everything else is a
space), hashed to a fixed number of places; weights are log(1 + count) times the inverse document
frequency over all training texts, and vectors have length one. Each language has a few
centroids, found by spherical k-means on a sample of at most SAMPLE labelled texts; a text has the
language of the centroid with the largest cosine. A text is rejected if its cosine is far
below what sample texts of its own length have with their own language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.lexical import spread
from ._common import frugal, held_out

UND = "und"
PLACES = 1 << 13
#: The only bound on what is learned from: texts of each language that centroids are clustered from, chosen by a hash of the text's id.
SAMPLE, CENTROIDS, TURNS = 400, 4, 8
#: A text is rejected below this share of the first percentile of the sample's cosines at its length.
REJECT_SHARE = 0.5
_KEEP = bytes(b if chr(b).isalpha() and b < 128 or b > 127 else 32 for b in range(256))
_PART = 1 << 20


def counts(text: str) -> np.ndarray:
    """How often each place's n-grams occur in a text."""
    raw = b" " + b" ".join(text.lower().encode().translate(_KEEP).split()) + b" "
    out = np.zeros(PLACES, np.int64)
    for at in range(0, max(1, len(raw) - 2), _PART):
        b = np.frombuffer(raw[at : at + _PART + 2], np.uint8).astype(np.uint32)
        own = min(_PART, len(b))  # n-grams that start in this part
        for n in (1, 2, 3):
            g = np.full(max(0, min(own, len(b) - n + 1)), n, np.uint32)
            for i in range(n):
                g = g * np.uint32(257) + b[i : i + len(g)]
            out += np.bincount((g * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=PLACES)
    return out


def known(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, int]:
    """A text's vector, and the binary logarithm of its length in n-grams."""
    c = counts(text)
    v = np.log1p(c).astype(np.float32) * idf
    norm = float(np.sqrt((v * v).sum()))
    return (v / norm if norm else v), min(31, int(c.sum()).bit_length())


def cluster(x: np.ndarray, k: int = CENTROIDS, turns: int = TURNS) -> np.ndarray:
    """Spherical k-means from the farthest points; clusters that run empty go."""
    centres = [x.sum(axis=0)]
    while len(centres) < min(k, len(x)):
        near = np.max(x @ np.stack([c / max(np.linalg.norm(c), 1e-12) for c in centres]).T, axis=1)
        centres.append(x[int(near.argmin())])
    c = np.stack(centres)
    for _ in range(turns):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) for j in range(len(c)) if (own == j).any()])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    langs: list[str]  #: the language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  #: the least cosine that isn't rejected, by the length's binary logarithm

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and rejection of each text. A text that is null or has no letter is `und`, scored 0 and rejected; so is any if nothing was learned."""
        out: list = [(UND, 0.0, True)] * len(texts)
        some = [i for i, t in enumerate(texts) if known(t)] if self.langs else []
        for at in range(0, len(some), 256):
            rows = some[at : at + 256]
            found = [vector(texts[i], self.idf) for i in rows]
            cosine = np.stack([v for v, _ in found]) @ self.centroids.T
            for i, j, row, (_, size) in zip(rows, cosine.argmax(axis=1), cosine, found, strict=True):
                out[i] = (self.langs[j], float(min(1.0, max(0.0, row[j]))), bool(row[j] < self.floor[size]))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from docs' texts with a language; texts that are null or have no letter don't count."""
    train = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(place, df) sums of a partition; at place -1 its texts."""
        df, n = np.zeros(PLACES, np.int64), 0
        for b in batches:
            for t in b.column(0):
                if known(text := t.as_py()):
                    df += counts(text) > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[df[at], n].astype(np.int64))], names=["place", "df"])

    got = {r.place: r.df for r in train.select("text").mapInArrow(frugal(frequencies), "place int, df long").groupBy("place").agg(F.sum("df").alias("df")).collect()}  # PLACES rows at most
    n, df = got.pop(-1, 0), np.zeros(PLACES)
    df[list(got)] = list(got.values())
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    sizes = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return Model([], np.zeros((0, PLACES), np.float32), idf, np.zeros(32))
    chance = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(False)
    for lang, size in sizes.items():
        wanted = wanted | ((F.col("lang") == lang) & (chance < 1.2 * SAMPLE / size))
    picked = train.where(wanted)

    def centroids(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[[known(t) for t in pdf.text]].sort_values("id", kind="stable").head(SAMPLE)
        if not len(own):
            return pd.DataFrame({"lang": [], "centroid": [], "size": [], "cosine": []}).astype({"lang": str, "size": "int32", "cosine": float})
        found = [vector(t, idf) for t in own.text]
        x = np.stack([v for v, _ in found])
        c = cluster(x)
        near = (x @ c.T).max(axis=1)
        blobs = [r.astype("<f4").tobytes() for r in c]
        return pd.DataFrame({"lang": key[0], "centroid": blobs + [None] * len(near), "size": [0] * len(blobs) + [s for _, s in found], "cosine": [0.0] * len(blobs) + near.tolist()})

    rows = picked.groupBy("lang").applyInPandas(centroids, "lang string, centroid binary, size int, cosine double").collect()  # CENTROIDS + SAMPLE rows a language
    named = sorted((r.lang, bytes(r.centroid)) for r in rows if r.centroid is not None)
    floor, by = np.zeros(32), {}
    for r in rows:
        if r.centroid is None:
            by.setdefault(r["size"], []).append(r.cosine)
    for size in range(32):  # short lengths that the sample hasn't are not rejected, long ones as the longest that it has
        if len(by.get(size, ())) >= 20:
            floor[size] = REJECT_SHARE * np.percentile(by[size], 1)
        elif size:
            floor[size] = floor[size - 1]
    return Model([x for x, _ in named], np.stack([np.frombuffer(c, "<f4") for _, c in named]) if named else np.zeros((0, PLACES), np.float32), idf, floor)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected), one row for each of docs.

    Texts that are null, empty or without letters are `und`, scored 0 and rejected; very long ones are
    read whole. Ids may be null and rows repeated; no other column is looked at, whatever its
    name. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.predict(b.column(1).to_pylist())
            cols = zip(*found, strict=True) if found else [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.bool_()), strict=True))], names=["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"id {kind}, lang_pred string, score double, rejected boolean")


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with _lw_lang: struct<lang string, score double, rejected boolean> of each text, as in identify(). All other columns are kept; _lw_lang is taken."""
    at, kinds = docs.columns.index(text_col), [("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.predict(b.column(at).to_pylist())
            cols = zip(*found, strict=True) if found else [()] * 3
            found = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, "_lw_lang"])

    return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField("_lw_lang", T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))]))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    model = fit(docs.where(~held_out("doc_id", 2, 4)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select(F.col("id").alias("doc_id"), held_out("id", 2, 4).alias("held_out"), "lang_pred", "score", "rejected")
