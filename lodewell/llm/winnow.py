"""Document fingerprints by winnowing, in built-in column functions only.

Words become 31-bit numbers; the hash of k words is a polynomial in them modulo the prime
2**31 - 1, rolled by doubling: a run of 2m words is two runs of m. Of each window of w
neighbouring k-grams the least hash is chosen, the rightmost of equals, and kept with its
place. Two texts that share a run of k + w - 1 words share a chosen hash from it, and its
places tell where. Hash and place are one number (hash above, distance from the last place
below), so that the least number is the least hash at the rightmost place.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import no_null, partitions

PRIME, BASE, LAST = (1 << 31) - 1, 1_000_003, (1 << 31) - 1
#: Texts that share K + WINDOW - 1 = 10 words share a mark; about two words in nine have one.
K, WINDOW = 3, 8
#: Text in a range of ids, and ranges at most (beyond 1 TB ranges grow, to 100 MB at 100 TB).
RANGE_BYTES, RANGES_MOST = 1 << 20, 1 << 20


def _shifted(a: Column, by: int, f) -> Column:
    """f of each element and of that `by` places on, where there is one."""
    return F.transform(F.slice(a, F.lit(1), F.greatest(F.size(a) - by, F.lit(0))), lambda x, i: f(x, F.get(a, i + by)))


def _rolled(up: int):
    return lambda x, y: (x * up + y) % PRIME


def _longer(g: Column, a: Column, size: int) -> Column:
    """Hashes of one word more than those of `size` words in g."""
    return F.transform(F.slice(g, F.lit(1), F.greatest(F.size(a) - size, F.lit(0))), lambda x, i: (x * BASE + F.get(a, i + size)) % PRIME)


def winnow(df: DataFrame, text_col: str, out_col: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """df with out_col, array<long>: the chosen (hash << 31 | 2**31 - 1 - place) of the text in order of place.

    Upper and lower case are alike. A text of fewer than k words has one k-gram, of all its words;
    one of fewer than w k-grams has one window, of them all; null and wordless texts have the
    hash 0 at place 0; very long texts are read whole. All other columns are kept; _lw_a, _lw_g and
    _lw_m are taken. An empty table gives an empty result.
    """
    a, g, m = F.col("_lw_a"), F.col("_lw_g"), F.col("_lw_m")
    words = F.array_remove(F.split(F.lower(no_null(text_col)), r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn("_lw_a", F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME))))
    few = F.array(F.aggregate(a, F.lit(0).cast("long"), lambda s, x: (s * BASE + x) % PRIME))
    df, size = df.withColumn("_lw_g", a), 1
    while 2 * size <= k:
        up = pow(BASE, size, PRIME)
        df, size = df.withColumn("_lw_g", _shifted(g, size, _rolled(up))), 2 * size
    while size < k:
        df, size = df.withColumn("_lw_g", _longer(g, a, size)), size + 1
    df = df.withColumn("_lw_g", F.when(F.size(a) < k, few).otherwise(g))
    df = df.withColumn("_lw_g", F.transform(g, lambda x, i: F.shiftleft(x, 31).bitwiseOR(LAST - i.cast("long"))))
    df, size = df.withColumn("_lw_m", g), 1
    while size < window:
        by = min(size, window - size)
        df, size = df.withColumn("_lw_m", _shifted(m, by, lambda x, y: F.least(x, y))), size + by
    chosen = F.when(F.size(g) < window, F.array(F.array_min(g))).otherwise(F.array_distinct(m))
    return df.withColumn(out_col, chosen).drop("_lw_a", "_lw_g", "_lw_m")


def hashes(chosen: str | Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, 31)))


def places(chosen: str | Column) -> Column:
    return F.transform(chosen, lambda x: LAST - x.bitwiseAND(F.lit(LAST)))


def printed(chosen: str | Column) -> Column:
    """The chosen hashes in order, eight hexadecimal digits each."""
    return F.lower(F.array_join(F.transform(chosen, lambda x: F.lpad(F.hex(F.shiftright(x, 31)), 8, "0")), ""))


def steps(chosen: str) -> Column:
    """How far each chosen hash is from the one before (the first: from the text's begin), a byte each: the places, for windows of at most 127."""
    low = lambda x: x.bitwiseAND(F.lit(LAST))
    return F.transform(chosen, lambda x, i: (F.coalesce(low(F.get(F.col(chosen), i - 1)), F.lit(LAST)) - low(x)).cast("tinyint"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two columns of hashes()."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _upto(x: Column, ends: list, kind: str) -> Column:
    """How many of the sorted ends are less than x: a block of them by the blocks' last ones, then inside the block."""
    m = max(1, math.isqrt(len(ends)))
    blocks = [ends[i : i + m] for i in range(0, len(ends), m)]
    table = lambda v, depth: F.from_json(F.lit(json.dumps(v, default=str)), "array<" * depth + kind + ">" * depth)  # noqa: E731  folded into one literal
    block = F.size(F.filter(table([b[-1] for b in blocks], 1), lambda e: e < x))
    inside = F.size(F.filter(F.coalesce(F.get(table(blocks, 2), block), F.array().cast(f"array<{kind}>")), lambda e: e < x))
    return block * m + F.when(block < len(blocks), inside).otherwise(len(ends) - len(blocks) * m)


def with_next(docs: DataFrame, id_col: str, fields: dict[str, str], buckets: int | None = None, derive: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """derive(docs) with columns of the next row in ascending order of the id (after the last: the first).

    fields: new name by column. Rows are dealt to ranges of ids of RANGE_BYTES of the fields' strings
    each, so that tasks keep their size as the table grows; in a range the next row is a window
    function's, and from the end of a range it is the next range's first. Null ids come first; equal
    ids are in order of the fields, and share a range, as do all null ones. derive adds columns to
    rows, and is called for all of them and once more for the first of each range. Names beginning
    with _lw_ are taken, all other columns are kept. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = [f.name for f in docs.schema.fields if f.name in fields and f.dataType.simpleString() == "string"]
    size = docs.agg(*(F.sum(F.octet_length(c)) for c in texts)).first() if texts and not buckets else [0]
    n = buckets or max(partitions(docs.sparkSession), min(RANGES_MOST, -(-sum(x or 0 for x in size) // RANGE_BYTES)))
    ids = docs.where(F.col(id_col).isNotNull()).select(id_col).repartitionByRange(n, id_col)  # by a sample of Spark's
    ends = sorted(r.e for r in ids.groupBy(F.spark_partition_id()).agg(F.max(id_col).alias("e")).collect())[:-1]  # n numbers
    docs = docs.withColumn("_lw_bucket", F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(_upto(F.col(id_col), ends, kind)) if ends else F.lit(0))
    order = Window.partitionBy("_lw_bucket").orderBy(id_col, *fields)
    own = derive(docs).withColumn("_lw_next", F.lead(F.struct(*fields)).over(order))

    least = docs.groupBy("_lw_bucket").agg(F.min(F.struct(F.col(id_col).isNotNull().alias("f"), F.col(id_col).alias("i"))).alias("m"))
    first = F.broadcast(least.select(F.col("_lw_bucket").alias("_lw_of"), "m"))  # n rows
    heads = docs.join(first, (F.col("_lw_bucket") == F.col("_lw_of")) & F.col(id_col).eqNullSafe(F.col("m.i")), "left_semi")
    heads = derive(heads).groupBy("_lw_bucket").agg(F.min(F.struct(*fields)).alias("_lw_head"))
    ring = Window.orderBy("_lw_bucket")  # n rows
    following = least.select("_lw_bucket", F.lag("_lw_bucket").over(ring).alias("p"), F.max("_lw_bucket").over(Window.partitionBy()).alias("z"))
    following = following.select("_lw_bucket", F.coalesce("p", "z").alias("_lw_before"))
    heads = heads.join(following, "_lw_bucket").select(F.col("_lw_before").alias("_lw_bucket"), "_lw_head")
    both = own.join(heads, "_lw_bucket", "left").withColumn("_lw_next", F.coalesce("_lw_next", "_lw_head"))
    return both.withColumns({new: F.col(f"_lw_next.{old}") for old, new in fields.items()}).drop("_lw_bucket", "_lw_next", "_lw_head")


def op8_winnowing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", no_null("text").alias("text"))

    def marked(d: DataFrame) -> DataFrame:  # five bytes a mark are dealt out
        d = winnow(d, "text", "marks")
        return d.withColumns({"steps": steps("marks"), "own": F.transform("marks", lambda x: F.shiftright(x, 31).cast("int"))}).drop("marks")

    docs = with_next(docs, "doc_id", {"text": "next_text", "own": "next"}, derive=marked)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    docs = docs.withColumn("n_chars", F.char_length("text"))
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)))
    docs = winnow(docs, "edited", "other")
    docs = docs.withColumns({f"_{k}": F.array_distinct(k) for k in ("own", "next")} | {"_other": hashes("other").cast("array<int>")})
    return docs.select(
        "doc_id", F.col("n_chars").cast("long"), F.sha2("edited", 256).alias("edited_sha256"), F.lower(F.array_join(F.transform("own", lambda x: F.lpad(F.hex(x), 8, "0")), "")).alias("fingerprint"),
        printed("other").alias("edited_fingerprint"), likeness(F.col("_own"), F.col("_other")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"), "steps",
    )
