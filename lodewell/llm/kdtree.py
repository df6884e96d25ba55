"""Sharding by a k-d tree over metadata, in built-in column functions only.

Every dimension is scaled to 31 bits over the whole table; strings count by their rank among the
table's different values. A node that is to become k shards is split along the dimension in
which its rows spread widest, at the weighted quantile floor(k/2)/k of bytes (the median where k
is even). Either the number of shards is given, and k is shared out from the root down, or the
bytes that a shard may have, and a node is split until it has no more (k is its bytes over
those, rounded up, whatever its parent was to become). Given a number, rows that are larger than an
even shard of the others (there are fewer than shards) are a shard each, beside the tree: inside
of it they would leave shards empty that their share of the bytes had been given. Quantiles are found by histograms: a node's
keys (the coordinate, then a hash of the row, so that equal coordinates can be parted anywhere)
are summed in up to 4096 bins; the bin that holds the quantile is divided again, between the
least and the greatest key in it, until it weighs next to nothing. A pass is one aggregation for all nodes of a level. Nodes are tables, joined to
the rows by their number: the driver only counts them, and no task gathers a node's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, no_null, partitions

BITS = 31
TOP = (1 << BITS) - 1
#: Bins of a node's histogram at most and at least, and those of a level's nodes together.
BINS, LEAST_BINS, ALL_BINS = 4096, 64, 1 << 20


def with_rank(rows: DataFrame, name: str, of: str, scratch: Scratch) -> DataFrame:
    """rows with a long column: how many different values of column `of` are less than its own; null is -1. Names beginning with _lw_ are taken."""
    values = rows.select(F.col(of).alias("_lw_value")).where("_lw_value is not null").distinct()
    values = values.repartitionByRange(partitions(rows.sparkSession), "_lw_value").sortWithinPartitions("_lw_value").withColumn("_lw_m", F.monotonically_increasing_id())
    values = scratch.save(values, "values")  # numbers hold from here on
    values = values.withColumns({"_lw_p": F.shiftright("_lw_m", 33), "_lw_i": F.col("_lw_m").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = values.groupBy("_lw_p").agg(F.count("*").alias("_lw_n"))  # a row a partition
    ahead = counts.select("_lw_p", (F.sum("_lw_n").over(Window.orderBy("_lw_p")) - F.col("_lw_n")).alias("_lw_a"))
    ranks = values.join(ahead, "_lw_p").select("_lw_value", (F.col("_lw_a") + F.col("_lw_i")).alias("_lw_rank"))
    return rows.join(ranks, rows[of] == ranks["_lw_value"], "left").withColumn(name, F.coalesce("_lw_rank", F.lit(-1)).cast("long")).drop("_lw_value", "_lw_rank")


def _key(names: list[str]) -> Column:
    """A row's place along dimension _lw_d: the coordinate, then the row's hash."""
    return F.coalesce(*(F.when(F.col("_lw_d") == i, F.shiftleft(F.col(n), BITS).bitwiseOR(F.col("_lw_hash"))) for i, n in enumerate(names)))


def _cuts(rows: DataFrame, names: list[str], nodes: DataFrame, enough: float, most: int, scratch: Scratch) -> DataFrame:
    """nodes(_lw_node, _lw_d, _lw_lo, _lw_hi, _lw_need) with _lw_t: the key from which on a node's rows are right of the quantile, need bytes being left of it. There are `most` nodes at most."""
    width, found, col = max(LEAST_BINS, min(BINS, ALL_BINS // most)), None, F.col
    step = F.floor((col("_lw_hi") - col("_lw_lo")) / width).cast("long") + 1
    while True:
        at = rows.join(nodes.withColumn("_lw_step", step), "_lw_node").withColumn("_lw_key", _key(names)).where("_lw_key between _lw_lo and _lw_hi")
        hist = at.groupBy("_lw_node", F.floor((col("_lw_key") - col("_lw_lo")) / col("_lw_step")).cast("long").alias("_lw_bin")).agg(F.sum("_lw_size").alias("_lw_own"), F.min("_lw_key").alias("_lw_least"), F.max("_lw_key").alias("_lw_most"))
        hist = hist.withColumn("_lw_upto", F.sum("_lw_own").over(Window.partitionBy("_lw_node").orderBy("_lw_bin")))
        bins = hist.join(nodes.select("_lw_node", "_lw_need"), "_lw_node").where("_lw_upto >= _lw_need and _lw_upto - _lw_own < _lw_need").drop("_lw_need")
        got = nodes.withColumn("_lw_step", step).join(bins, "_lw_node", "left")  # at most one bin a node; none: no bytes are left of the quantile
        below = col("_lw_upto") - col("_lw_own")
        done = col("_lw_bin").isNull() | (col("_lw_own") <= enough) | (col("_lw_least") == col("_lw_most"))
        nearer = col("_lw_need") - below > col("_lw_own") / 2  # the quantile is nearer to the bin's end
        t = F.when(col("_lw_bin").isNull(), col("_lw_lo")).when(nearer, col("_lw_most") + 1).otherwise(col("_lw_least"))
        got = scratch.save(got.select("_lw_node", "_lw_d", col("_lw_least").alias("_lw_lo"), col("_lw_most").alias("_lw_hi"), (col("_lw_need") - below).alias("_lw_need"), F.when(done, t).alias("_lw_t")), "bins")
        own = got.where("_lw_t is not null").select("_lw_node", "_lw_d", "_lw_t")
        found = own if found is None else found.union(own)
        nodes = got.where("_lw_t is null").drop("_lw_t")
        if nodes.isEmpty():
            return found


def shard(rows: DataFrame, dims: dict[str, Column], size: Column, shards: int | None = None, target_bytes: int | None = None, tolerance: float = 0.001) -> DataFrame:
    """rows with shard int (0 up, in the tree's order) and slot long (gapless from 0 in each shard).

    dims: numeric columns by name; null is least. Either the number of shards is given or the
    bytes that none is to exceed. Given a number, shards differ in bytes by about a row and
    `tolerance` of a shard for each level of the tree; a row larger than target_bytes is a shard
    alone. Rows are of their own, repeated ones too. Columns named shard or slot are replaced, all
    others are kept; names beginning with _lw_ are taken. An empty table gives an empty result.
    """
    scratch, col = Scratch(rows.sparkSession, "kdtree"), F.col
    names = [f"_lw_{i}" for i in range(len(dims))]
    rows = rows.withColumns(dict(zip(names, (c.cast("double") for c in dims.values()), strict=True)) | {"_lw_size": size.cast("long"), "_lw_row": F.monotonically_increasing_id()})
    first = held = rows = scratch.save(rows.drop("shard", "slot"), "rows")  # row numbers hold from here on
    ends = rows.agg(F.sum("_lw_size").alias("bytes"), *(f(n).alias(f"{f.__name__}{n}") for n in names for f in (F.min, F.max))).first()
    total = left = ends["bytes"] or 0
    alone = 0
    while shards:  # an even share of what is left gets less with every row that is over it
        even = left / max(1, shards - alone)
        found = rows.where(col("_lw_size") > even).agg(F.count("*"), F.sum("_lw_size")).first()
        left = total - (found[1] or 0)
        if found[0] == alone:
            break
        alone = found[0]
    if alone:
        single = rows.where(col("_lw_size") > even)
        rows, shards, total = rows.where(col("_lw_size") <= even), shards - alone, left
    count = (shards or 1) if target_bytes is None else max(1, -(-total // target_bytes))
    for n in names:
        lo, hi = ends[f"min{n}"], ends[f"max{n}"]
        scaled = F.floor((col(n) - F.lit(lo)) / F.lit((hi - lo) or 1.0) * F.lit(float(TOP))).cast("long") if hi is not None else F.lit(0)
        rows = rows.withColumn(n, F.coalesce(scaled, F.lit(0)).cast("long"))
    rows = rows.withColumns({"_lw_hash": F.xxhash64("_lw_row").bitwiseAND(F.lit(TOP)), "_lw_node": F.lit(1).cast("long"), "_lw_k": F.lit(count).cast("long")})
    level = 0
    while target_bytes is not None or level < (count - 1).bit_length():
        spread = {n: F.max(n) - F.min(n) for n in names}
        stats = rows.groupBy("_lw_node", "_lw_k").agg(F.sum("_lw_size").alias("_lw_bytes"), F.count("*").alias("_lw_rows"), *(f(n).alias(f"{f.__name__}{n}") for n in names for f in (F.min, F.max)), F.greatest(*spread.values(), F.lit(0)).alias("_lw_widest"))
        if target_bytes is not None:
            stats = stats.withColumn("_lw_k", F.when(col("_lw_rows") > 1, F.ceil(col("_lw_bytes") / target_bytes)).otherwise(1))
        d = F.coalesce(*(F.when(col(f"max{n}") - col(f"min{n}") == col("_lw_widest"), i) for i, n in enumerate(names)))
        pick = lambda f: F.coalesce(*(F.when(col("_lw_d") == i, col(f"{f}{n}")) for i, n in enumerate(names)))
        nodes = stats.where("_lw_k > 1").withColumn("_lw_d", d)
        need = col("_lw_bytes") * F.floor(col("_lw_k") / 2) / col("_lw_k")
        nodes = scratch.save(nodes.select("_lw_node", "_lw_d", F.shiftleft(pick("min"), BITS).alias("_lw_lo"), (F.shiftleft(pick("max") + 1, BITS) - 1).alias("_lw_hi"), need.alias("_lw_need")), "nodes")
        if target_bytes is not None and nodes.isEmpty():
            break
        moved = rows.join(_cuts(rows, names, nodes, tolerance * total / count, min(count, 1 << level), scratch), "_lw_node", "left")
        right, half = F.when(_key(names) >= col("_lw_t"), 1).otherwise(0), F.floor(col("_lw_k") / 2).cast("long")
        moved = moved.withColumns({"_lw_node": F.when(col("_lw_d").isNull(), col("_lw_node")).otherwise(2 * col("_lw_node") + right), "_lw_k": F.when(col("_lw_d").isNull(), col("_lw_k")).when(right == 1, col("_lw_k") - half).otherwise(half)})
        rows = scratch.save(moved.drop("_lw_d", "_lw_t"), "level")
        if held is not first:
            scratch.drop(held)
        held, level = rows, level + 1
    leaves = rows.select("_lw_node").distinct()
    leaves = leaves.select("_lw_node", (F.row_number().over(Window.orderBy(F.bin("_lw_node"))) - 1).cast("int").alias("shard"))  # a row a shard
    rows = rows.join(leaves, "_lw_node").withColumn("_lw_sub", F.pmod(F.shiftright("_lw_hash", 8), F.lit(16)))
    subs = rows.groupBy("shard", "_lw_sub").agg(F.count("*").alias("_lw_n"))
    subs = subs.withColumn("_lw_ahead", F.sum("_lw_n").over(Window.partitionBy("shard").orderBy("_lw_sub")) - col("_lw_n")).drop("_lw_n")
    number = F.row_number().over(Window.partitionBy("shard", "_lw_sub").orderBy("_lw_hash", "_lw_row"))
    rows = rows.join(subs, ["shard", "_lw_sub"]).withColumn("slot", (number - 1 + col("_lw_ahead")).cast("long"))
    if alone:
        nth = F.row_number().over(Window.orderBy(col("_lw_size").desc(), "_lw_row")) - 1 + shards  # fewer rows than shards
        rows = rows.unionByName(single.withColumns({"shard": nth.cast("int"), "slot": F.lit(0).cast("long")}), allowMissingColumns=True)
    return rows.drop("_lw_node", "_lw_k", "_lw_size", "_lw_hash", "_lw_row", "_lw_sub", "_lw_ahead", *names)


def op2_kdtree_sharding(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "ranks")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    rows = scratch.save(docs.select("doc_id", size.alias("size"), F.crc32(no_null("text").cast("binary")).alias("text_crc32"), "lang", "source"), "sizes")
    for name in ("lang", "source"):
        rows = with_rank(rows, f"{name}_rank", name, scratch)
    dims = {"lang": F.col("lang_rank"), "source": F.col("source_rank"), "size": F.log2(F.col("size"))}
    out = shard(rows, dims, F.col("size"), shards=shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
