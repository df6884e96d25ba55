"""Keeping tables up to date: manifests, upserts, deletions, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved


def classify(disk: DataFrame, known: DataFrame, key: str = "rel_path", stamps: tuple[str, ...] = ("mtime_ns", "size")) -> DataFrame:
    """(key, state): new, changed, unchanged or deleted, from the listing and the manifest."""
    old = known.select(key, *(F.col(s).alias(f"_{s}") for s in stamps), F.lit(True).alias("_old"))
    both = disk.select(key, *stamps, F.lit(True).alias("_new")).join(old, key, "full_outer")
    same = F.lit(True)
    for s in stamps:
        same = same & F.col(s).eqNullSafe(F.col(f"_{s}"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return both.select(key, state.alias("state"))


def deleted(known: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    return known.join(disk, key, "left_anti")


def stale(chunks: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows of files that have changed."""
    return chunks.join(files, key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by `order`; of equal ones new rows win."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("_new").desc()))
    return both.withColumn("_r", last).where("_r = 1").drop("_r", "_new")


def probe(inputs: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """inputs with the cached value and whether there was one."""
    found = cache.select(key, value, F.lit(True).alias("_hit"))
    return inputs.join(found, key, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def expire(df: DataFrame, stamp: str, cutoff: Column) -> DataFrame:
    """Rows of at least the cutoff; one exactly at it stays."""
    return df.where(F.col(stamp) >= cutoff)


def assign(df: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """df with column replaced where values has the key."""
    return df.join(values.select(key, F.col(column).alias("_v")), key, "left").withColumn(column, F.coalesce("_v", column)).drop("_v")


def lookup(df: DataFrame, ids: DataFrame | list, key: str) -> DataFrame:
    """Rows whose key is among ids: a list that someone gives, which goes to the scan as a filter, or a table with that column. Unknown and null ids find nothing; one that is given twice finds its rows once."""
    if isinstance(ids, list):
        return df.where(F.col(key).isin([i for i in ids if i is not None]))
    return df.join(ids.select(key), key, "left_semi")


def run_counts(chunks: DataFrame, path: str, content_hash: str, hit: str | None = None) -> DataFrame:
    """(files, chunks, cache_hits): one row of what an update has taken in. Without a column that says so, a hit is a chunk whose content another one has had."""
    hits = F.count_if(hit) if hit else F.count(content_hash) - F.count_distinct(content_hash)
    return chunks.agg(F.count_distinct(path).alias("files"), F.count("*").alias("chunks"), hits.alias("cache_hits"))


def stored_notes(rows: DataFrame, tags: str = "tags", timestamp: str = "timestamp") -> DataFrame:
    """rows as notes: tags are a JSON list, timestamps digits; what isn't is no tag and 0."""
    return rows.withColumns({tags: F.coalesce(F.from_json(tags, "array<string>"), F.array().cast("array<string>")), timestamp: F.coalesce(F.col(timestamp).try_cast("long"), F.lit(0))})


def reindex_positions(df: DataFrame, key: str) -> DataFrame:
    """df with idx, 0 up in the order of the key, by counts of key ranges first."""
    parts = saved(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id()), "positions")  # numbers hold from here on
    parts = parts.withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))  # a row a partition
    ahead = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_a"))
    return parts.join(ahead, "_p").withColumn("idx", F.col("_a") + F.col("_i")).drop("_m", "_p", "_i", "_a")
