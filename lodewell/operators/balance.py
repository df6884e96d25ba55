"""Communities of bounded size: large ones are split, small ones are joined to what is most like them, until none is out of bounds.

Labels are least ids, so they don't depend on how rows are partitioned.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.communities import merged, sums
from ..sources.scratch import dropped, saved
from . import proximity

#: The least share of a split's smaller side, below which members are dealt to both sides by a hash; turns in which members go to the side whose mean is nearer.
LEAST_SHARE, TURNS = 0.1, 4
#: Members of a community that a task splits to the end.
IN_TASK = 16_384


def bounds(dim: int, min_snr: float = 2.0, least: int = 10) -> tuple[int, int]:
    """(least, most) members: above dim / min_snr**2 a bundle's members are lost in its noise."""
    return least, int(dim / min_snr**2)


def _named(rows: DataFrame) -> DataFrame:
    """rows with community replaced by the least id of its members."""
    least = rows.groupBy("community").agg(F.min("id").alias("_least"))
    return rows.join(least, "community").drop("community").withColumnRenamed("_least", "community")


def split(vectors: DataFrame, most: int, in_task: int = IN_TASK) -> DataFrame:
    """vectors(id, vector, community) with communities of at most `most` members.

    A bisection: a is the member farthest from the bundle, z the one farthest from a, and members
    are on the side of the nearer of them (by the difference of their products with both to the
    mean's side). A split that leaves less than LEAST_SHARE on a side, as of equal vectors, is by a
    hash of the id. Ids are unique, vectors not null.

    Communities over `in_task` members are bisected together, a turn for all: what is known of a
    community is broadcast (there are few of that size), so vectors stay where they are. The others
    are shuffled once, and split to the end in a task each.
    """
    now, col = saved(_named(vectors.select("id", "vector", "community")), "split"), F.col
    for turn in count():
        large = saved(now.groupBy("community").agg(F.count("*").alias("n")).where(col("n") > max(most, in_task)), "large")
        if large.isEmpty():
            dropped(large)
            break
        here, held = now.join(F.broadcast(large), "community"), [large]

        def known(df: DataFrame, held=held) -> DataFrame:
            held.append(saved(df, "known"))
            return F.broadcast(held[-1])

        mid = known(sums(here).select("community", V.l2_normalize(col("total")).alias("mid")))
        far = lambda of: F.min_by("vector", F.struct(F.round(V.dot(col("vector"), col(of)), 9), col("id")))
        a = known(here.join(mid, "community").groupBy("community").agg(far("mid").alias("a")))
        z = known(here.join(a, "community").groupBy("community").agg(F.first("a").alias("a"), far("a").alias("z")))
        rows = here.join(z, "community").select("id", "community", "vector", F.round(V.dot(col("vector"), col("z")) - V.dot(col("vector"), col("a")), 9).alias("p"))
        mean = known(rows.groupBy("community").agg(F.round(F.avg("p"), 6).alias("mean")))
        sided = rows.join(mean, "community").withColumn("right", col("p") > col("mean")).select("id", "community", "vector", "right")
        for _ in range(TURNS):
            means = sums(sided.withColumn("side", F.struct("community", "right")), "side").select("side.*", F.transform("total", lambda x: x / col("n")).alias("m"))
            both = known(means.groupBy("community").agg(F.max(F.when(col("right"), col("m"))).alias("r"), F.max(F.when(~col("right"), col("m"))).alias("l")))
            nearer = F.round(V.dot(col("vector"), col("r")) - V.dot(col("r"), col("r")) / 2 - V.dot(col("vector"), col("l")) + V.dot(col("l"), col("l")) / 2, 9) > 0
            sided = sided.join(both, "community").select("id", "community", "vector", F.coalesce(nearer, "right").alias("right"))
        share = known(sided.groupBy("community").agg(F.avg(col("right").cast("int")).alias("share")))
        halves = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0  # another deal each turn, as one deal's side is all of a kind by it
        uneven = (col("share") < LEAST_SHARE) | (col("share") > 1 - LEAST_SHARE)
        right = sided.join(share, "community").select("id", "vector", "community", F.when(uneven, halves).otherwise(col("right")).alias("right"))
        rest = now.join(F.broadcast(large), "community", "left_anti").select("id", "vector", "community", F.lit(False).alias("right"))
        parts = saved(right.union(rest), "sides")
        least = known(parts.join(F.broadcast(large), "community", "left_semi").groupBy("community", "right").agg(F.min("id").alias("_least")))
        after = saved(parts.join(least, ["community", "right"], "left").select("id", "vector", F.coalesce("_least", "community").alias("community")), "split")
        dropped(now, parts, *held)
        now = after
    kind = now.schema["id"].dataType.simpleString()
    hashed = now.select("id", "vector", "community", F.xxhash64("id").alias("hash"))
    out = saved(hashed.groupBy("community").applyInPandas(_bisected(most), f"id {kind}, vector array<double>, community {kind}"), "split")
    dropped(now)
    return out


def _bisected(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, hashes, v = pdf["id"].to_numpy(), pdf["hash"].to_numpy(), np.array(pdf["vector"].tolist(), float)
        order = np.argsort(ids, kind="stable")
        ids, hashes, v = ids[order], hashes[order], v[order]
        out, open_ = np.empty(len(ids), ids.dtype), [np.arange(len(ids))]
        while open_:
            own = open_.pop()
            if len(own) <= most:
                out[own] = ids[own[0]]
                continue
            right = _sides(v[own])
            if not LEAST_SHARE <= right.mean() <= 1 - LEAST_SHARE:
                right = np.empty(len(own), bool)
                right[np.lexsort((ids[own], hashes[own]))] = np.arange(1, len(own) + 1) % 2 == 0  # by turns in the hash's order, so halves
            open_ += [own[right], own[~right]]
        return pd.DataFrame({"id": ids, "vector": list(v), "community": out})

    return run


def _sides(v: np.ndarray) -> np.ndarray:
    """Whether each of vectors, in the order of their ids, is on the right side of a bisection."""
    mid = v.sum(0)
    mid = mid / (np.sqrt(mid @ mid) or 1.0)
    a = v[np.argmin(np.round(v @ mid, 9))]
    z = v[np.argmin(np.round(v @ a, 9))]
    p = np.round(v @ z - v @ a, 9)
    right = p > np.round(p.mean(), 6)
    for _ in range(TURNS):
        if right.all() or not right.any():
            break
        r, l = v[right].mean(0), v[~right].mean(0)
        right = np.round(v @ r - r @ r / 2 - v @ l + l @ l / 2, 9) > 0
    return right


def join_small(vectors: DataFrame, least: int, most: int, among: int = 8) -> DataFrame:
    """vectors(id, vector, community) with communities of under `least` members joined to others, where one of at most `most` members comes of it.

    A small community offers itself to the one whose bundle is nearest of those it fits; of offers
    that meet in a community the best goes, so at least one does a turn. The nearest are asked for
    `among` at a time, more where none of them fits.
    """
    own, col = saved(_named(vectors.select("id", "vector", "community")), "members"), F.col
    now = saved(sums(own), "sums")
    moved = saved(now.select("community", col("community").alias("to")), "moved")
    while True:
        have = saved(now.select("community", "n", V.l2_normalize(col("total")).alias("bundle")), "bundles")
        small, many, k, fits = saved(have.where(col("n") < least), "small"), have.count(), among, None
        while not small.isEmpty():
            near = proximity.batch_topk(small.select(col("community").alias("query"), "bundle"), have, min(k, many), "query", "community", "bundle", same=False)
            sizes = have.select("community", "n")
            near = near.join(sizes.toDF("query", "own"), "query").join(sizes, "community").where((col("own") + col("n") <= most) & (col("own") < least))
            fits = saved(near.select(col("query").alias("s"), col("community").alias("t"), (-F.round("score", 9)).alias("far")), "offers")
            if not fits.isEmpty() or k >= many:
                break
            k *= 4
        if fits is None or fits.isEmpty():
            break
        best = fits.groupBy("s").agg(F.min(F.struct("far", F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y"))).alias("o")).select("s", "o.*").select("far", "x", "y").distinct()
        ends = best.select(col("x").alias("c"), F.struct("far", "x", "y").alias("o")).union(best.select(col("y"), F.struct("far", "x", "y")))
        first = ends.groupBy("c").agg(F.min("o").alias("o"))
        go = saved(first.groupBy("o").agg(F.count("*").alias("both")).where("both = 2").select(col("o.y").alias("community"), col("o.x").alias("onto")), "go")  # the best at both ends
        after = saved(merged(now.join(go, "community", "left").select(F.coalesce("onto", "community").alias("community"), "total", "n")), "sums")
        follow = saved(moved.join(go.toDF("to", "onto"), "to", "left").select("community", F.coalesce("onto", "to").alias("to")), "moved")
        dropped(now, have, small, fits, go, moved)
        now, moved = after, follow
    return own.join(moved, "community").select("id", "vector", col("to").alias("community"))


def rebalanced(vectors: DataFrame, least: int, most: int) -> DataFrame:
    """(id, community): communities of `least` to `most` members, named by their least ids. Where most is less than twice least, or too few vectors are left, some may stay under least; none is over most."""
    rows = join_small(split(vectors, most), least, most)
    return _named(rows.select("id", "community")).select("id", "community")
