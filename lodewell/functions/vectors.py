"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(v) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def dot(a: Column, b: Column) -> Column:
    """The sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def f16(x: Column) -> Column:
    """A number rounded to half precision (ties to even), as a double; beyond its range it is infinite."""
    x = x.cast("double")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))).cast("double"), F.lit(-14.0)) - 10)
    near = F.rint(x / step) * step
    return F.when(x == 0, F.lit(0.0)).when(F.abs(near) >= 65520, F.signum(x) * F.lit(float("inf"))).otherwise(near)


def mean_pool(df: DataFrame, group: str, vector: str, mask: Column) -> DataFrame:
    """(group, dim, value): the mean of the vectors that the mask lets in, by dimension."""
    return df.where(mask).select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))
