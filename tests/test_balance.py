"""Splitting and joining communities: bounds, who belongs together, and independence of partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewell.operators import balance


def frame(spark, vectors, labels):
    return spark.createDataFrame([(int(i), [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(vectors, labels, strict=True))], "id long, vector array<double>, community long").coalesce(2)


def test_bounds_and_stable_names(spark):
    g = np.random.default_rng(4)
    v = g.standard_normal((130, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    labels = [0] * 75 + [1] * 35 + [2 + i // 4 for i in range(20)]
    df = frame(spark, v, labels)
    got = {r.id: r.community for r in balance.rebalanced(df, 10, 32).collect()}
    n = np.unique(list(got.values()), return_counts=True)[1]
    assert len(got) == 130 and n.min() >= 10 and n.max() <= 32
    assert all(min(i for i in got if got[i] == c) == c for c in set(got.values()))
    again = {r.id: r.community for r in balance.rebalanced(df.repartition(7), 10, 32).collect()}
    assert again == got


def test_groups_stay_together(spark):
    """Clear groups in one community come apart as groups; a small one joins the one that is most like it."""
    centres = np.eye(6)
    v = [centres[i % 4] + 0.01 * np.sin(np.arange(6) * (i + 1)) for i in range(40)] + [centres[4] + 0.2 * centres[2]] * 3
    df = frame(spark, v, [0] * 40 + [9] * 3)
    parts = balance.split(df, 12)
    got = {}
    for r in parts.collect():
        got.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == [[i for i in range(40) if i % 4 == k] for k in range(4)] + [[40, 41, 42]]
    joined = {r.id: r.community for r in balance.join_small(parts, 4, 13).collect()}
    assert joined[40] == joined[2] and len(set(joined.values())) == 4


@pytest.mark.parametrize("n", [0, 1, 37])
def test_equal_vectors(spark, n):
    df = frame(spark, [[1.0, 0.0]] * n, [5] * n)
    got = balance.rebalanced(df, 3, 10).groupBy("community").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == n and all(r.n <= 10 and (r.n >= 3 or n < 3) for r in got)


def test_vectors_move_a_bounded_number_of_times(spark, monkeypatch):
    """Tables of vectors that are written are as many for many levels of splits and turns of joins as for few; splits in tasks and by all give communities within bounds, whatever the partitions."""
    g = np.random.default_rng(5)
    v = g.standard_normal((400, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tables, real = [], balance.saved
    monkeypatch.setattr(balance, "saved", lambda df, tag: (tables.append("vector" in df.columns and "id" in df.columns), real(df, tag))[1])
    df = frame(spark, v, [0] * 400)
    got = {r.id: r.community for r in balance.rebalanced(df, 5, 12).collect()}
    n = np.unique(list(got.values()), return_counts=True)[1]
    assert len(got) == 400 and n.min() >= 5 and n.max() <= 12 and sum(tables) <= 3
    by_all = {r.id: r.community for r in balance.split(df, 60, 100).collect()}
    assert by_all == {r.id: r.community for r in balance.split(df.repartition(5), 60).collect()}


def test_equal_vectors_by_all(spark):
    """A large group of equal vectors is dealt anew at each turn until a task takes it."""
    got = balance.split(frame(spark, [[1.0, 0.0]] * 90, [5] * 90), 10, 25).groupBy("community").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 90 and all(r.n <= 10 for r in got)
