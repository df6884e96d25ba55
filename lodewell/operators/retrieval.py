"""Lexical, semantic and hybrid retrieval.

Ranks are by the score rounded to nine digits and then by id, so that equal scores have one order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def ranked(df: DataFrame, score: str, id_col: str, n: int | None = None) -> DataFrame:
    df = df.orderBy(F.round(score, 9).desc(), F.col(id_col))
    return df if n is None else df.limit(n)


def candidates(k: int) -> int:
    """How many hits of either kind a search for k results looks at."""
    return max(8 * k, 64)


def _phrase_count(tokens: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    line = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))  # a look-ahead counts occurrences that overlap too
    return F.regexp_count(line, F.lit("(?= " + "  ".join(phrase) + " )"))


def bm25(docs: DataFrame, id_col: str, text_cols: list[str], query: str, n: int | None = None) -> DataFrame:
    """(id, bm25): documents that have every term of the query, best first, without an index.

    A term with an underscore is a phrase, which lies in one column. A term that occurs twice in
    the query counts twice. Two scans of the corpus and no shuffle but that of its statistics, one
    row; sources.lexical has the same over a stored index.
    """
    terms = T.query_terms(query)
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("bm25")).limit(0)
    each = {f"_t{i}": T.tokens(F.coalesce(F.col(c), F.lit(""))) for i, c in enumerate(text_cols)}
    different = [list(p) for p in dict.fromkeys(map(tuple, terms))]
    d = docs.select(id_col, *text_cols).withColumns(each)
    counts = [sum((_phrase_count(F.col(t), p) for t in each), F.lit(0)).alias(f"_f{i}") for i, p in enumerate(different)]
    d = d.select(id_col, sum((F.size(t) for t in each), F.lit(0)).alias("_len"), *counts)
    stats = d.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in range(len(different))))
    return scored(d, stats, id_col, [terms.count(p) for p in different], n)


def scored(d: DataFrame, stats: DataFrame, id_col: str, times: list[int], n: int | None) -> DataFrame:
    """(id, bm25) of d(id, _len, _f0, ...), best first: counts of terms that occur in the query so many times; stats is one row of _n, _avg and _n0, ..."""
    hits = d.where(" and ".join([f"_f{i} > 0" for i in range(len(times))] or ["false"])).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, many in enumerate(times):
        f, has = F.col(f"_f{i}").cast("double"), F.col(f"_n{i}").cast("double")
        idf = F.greatest(F.log((F.col("_n") - has + 0.5) / (has + 0.5)), F.lit(LEAST_IDF))
        score = score + many * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return ranked(hits.select(id_col, score.alias("bm25")), "bm25", id_col, n)


def normalized(hits: DataFrame, score: str = "bm25") -> DataFrame:
    """Scores divided by the best, 0 if that is 0. Takes what a search returns: a bounded list of hits."""
    best = F.max(score).over(Window.partitionBy())
    return hits.withColumn(score, F.when(best == 0, F.lit(0.0)).otherwise(F.col(score) / best))


def postings(docs: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(term, doc, tf): the inverted index."""
    words = F.concat(*(T.tokens(F.coalesce(F.col(c), F.lit(""))) for c in text_cols))
    return docs.select(F.col(id_col).alias("doc"), F.explode(words).alias("term")).groupBy("term", "doc").agg(F.count("*").alias("tf"))


def vector_topk(vectors: DataFrame, query, k: int | None, id_col: str = "vec_id", vector_col: str = "embedding", score: str = "score", similarity: Callable[[Column, Column], Column] = V.dot) -> DataFrame:
    """(id, score): the k nearest by dot product, or another similarity of two vectors; not-a-number is left out."""
    s = vectors.select(id_col, similarity(F.col(vector_col), V.literal(query)).alias(score)).where(~F.isnan(score))
    return ranked(s, score, id_col, k)


def hybrid(semantic: DataFrame, lexical: DataFrame, id_col: str, min_score: float, weight: float) -> DataFrame:
    """(id, cos, bm25, score) of the hits in semantic(id, cos) or lexical(id, bm25); of the former those of at least min_score or with a lexical hit."""
    both = semantic.join(lexical, id_col, "full_outer")
    both = both.where((F.col("cos") >= min_score) | F.col("bm25").isNotNull())
    cos, bm = F.coalesce("cos", F.lit(0.0)), F.coalesce("bm25", F.lit(0.0))
    return both.select(id_col, cos.alias("cos"), bm.alias("bm25"), (weight * bm + (1 - weight) * cos).alias("score"))


def mmr_order(rel: np.ndarray, vectors: np.ndarray, ids: list, k: int, lam: float) -> list[tuple[int, float]]:
    """Places of k candidates in the order of selection, with the value each was selected by."""
    left = sorted(range(len(rel)), key=lambda i: (-round(float(rel[i]), 9), ids[i]))
    if lam >= 1 or len(left) <= 1:
        return [(i, float(rel[i])) for i in left[:k]]
    out, near = [], np.full(len(rel), -np.inf)
    while left and len(out) < k:
        value = rel if not out else lam * rel - (1 - lam) * near
        best = min(left, key=lambda i: (-round(float(value[i]), 9), ids[i]))
        out.append((best, float(value[best])))
        left.remove(best)
        near = np.maximum(near, vectors @ vectors[best])
    return out


def mmr(cands: DataFrame, k: int, lam: float, id_col: str, by: str | None = None, score: str = "score", vector_col: str = "vector") -> DataFrame:
    """Maximal marginal relevance: (by?, id, score, mmr, rank). cands has the candidates of each query (bounded by the search); a null vector is zero."""
    schema = cands.schema
    keys = [by] if by else []
    out = ", ".join([*(f"{c} {schema[c].dataType.simpleString()}" for c in [*keys, id_col]), "score double, mmr double, rank int"])

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = max((len(v) for v in pdf[vector_col] if v is not None), default=1)
        vecs = np.stack([np.zeros(dim) if v is None else np.asarray(v, float) for v in pdf[vector_col]])
        ids = pdf[id_col].tolist()
        got = mmr_order(pdf[score].to_numpy(float), vecs, ids, k, lam)
        rows = pdf.iloc[[i for i, _ in got]]
        return pd.DataFrame({**{c: rows[c].to_numpy() for c in [*keys, id_col]}, "score": rows[score].to_numpy(float), "mmr": [v for _, v in got], "rank": np.arange(1, len(got) + 1, dtype=np.int32)})

    return cands.select(*keys, id_col, score, vector_col).groupBy(*keys).applyInPandas(select, out)

