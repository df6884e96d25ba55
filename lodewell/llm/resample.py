"""Importance resampling towards a target corpus, in built-in column functions.

Features of a text are its runs of 1 to n words, hashed into buckets. The gain of a bucket is how
much likelier it is in the target than in the documents (logarithm of the smoothed shares, in
thousandths); a document's weight is the mean gain of its features. Documents are drawn without
replacement with chances in proportion to exp(weight / 1000): seeded Gumbel noise is added to
each weight, and the highest sums are drawn.

Scoring explodes nothing: higher-order functions make each document's array of buckets, and
its weight is one aggregate over element_at of an array literal with the gains of all buckets
(their number is a parameter, so the literal's size is). Only sums by bucket are shuffled, and,
for the draw, the rows at or above the score that the last one drawn has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lexical import spread
from ._common import Scratch, no_null, partitions

#: A word: neither ASCII punctuation nor white space nor a control character.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20


def words(text: str | Column) -> Column:
    """The words of a text in lower case (A-Z only); null has none."""
    return F.regexp_extract_all(F.translate(no_null(text), UPPER, LOWER), F.lit(WORD), F.lit(0))


def feature_buckets(text: str | Column, n: int = 1, buckets: int = BUCKETS) -> Column:
    """array<int>: the bucket of every run of 1 to n consecutive words, repeats included: crc32 of the words joined by one space."""
    found = words(text)

    def of(run: Column) -> Column:
        return F.pmod(F.crc32(run.cast("binary")), F.lit(buckets)).cast("int")

    runs = [found]
    for k in range(2, n + 1):  # each run of k - 1 words with the word behind it; nothing in a lambda refers to a whole array
        many = F.greatest(F.size(found) - k + 1, F.lit(0))
        runs.append(F.zip_with(F.slice(runs[-1], F.lit(1), many), F.slice(found, F.lit(k), many), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.transform(F.concat(*runs) if n > 1 else found, of)


def bucket_counts(rows: DataFrame, buckets_col: str, name: str) -> DataFrame:
    """(bucket, name): features in each bucket. Sums are made in every task first, so at most a row a bucket and task is shuffled."""
    return rows.select(F.explode(buckets_col).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, from raw(bucket, s) and target(bucket, t): floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))). The driver gets a row a bucket."""
    both = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(raw, "bucket", "left").join(target, "bucket", "left")
    both = both.select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    found = both.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # one row
    return [r.gain for r in sorted(found.collect(), key=lambda r: r.bucket)]


def weight(buckets_col: str | Column, gain: list[int]) -> Column:
    """The floored mean of the gains of an array of buckets; 0 for an empty one."""
    at = F.col(buckets_col) if isinstance(buckets_col, str) else buckets_col
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one array literal
    total = F.aggregate(at, F.lit(0).cast("long"), lambda s, b: s + F.element_at(table, b + 1))
    many = F.size(at).cast("long")
    return F.when(many > 0, F.call_function("div", total - F.pmod(total, many), many)).otherwise(F.lit(0)).cast("long")


def noise(id_col: str | Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256 of `seed:id`; a null id is empty."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(rows: DataFrame, score: str, id_col: str, percent: int, among: Column, scratch: Scratch) -> DataFrame:
    """rows with rank: 1, 2, ... for the floor(percent * n / 100) highest scores of the n rows that `among` holds for, ties to the smaller id; null for others.

    Counts by score (integers of a narrow range) say which score the last one drawn has. Rows from it
    up are dealt out by ranges of (score, id, row), so equal scores and ids are dealt out too, and
    numbered by the counts of ranges before. rows has to be a written table. Rows of one score and
    id are ranked in any order; null ids come first. A rank column is replaced; names
    beginning with _lw_ are taken.
    """
    col, can = F.col, F.coalesce(among, F.lit(False))
    rows = rows.drop("rank").withColumn("_lw_can", can)
    by = rows.where("_lw_can").groupBy(score).agg(F.count("*").alias("_lw_n"))  # a row a score
    k = (by.agg(F.sum("_lw_n")).first()[0] or 0) * percent // 100
    if k == 0:
        return rows.withColumn("rank", F.lit(None).cast("long")).drop("_lw_can")
    upto = F.sum("_lw_n").over(Window.orderBy(col(score).desc()))
    least = by.withColumn("_lw_upto", upto).where(col("_lw_upto") - col("_lw_n") < k).agg(F.min(score)).first()[0]
    chosen = col("_lw_can") & (col(score) >= least)
    parts = rows.where(chosen).withColumn("_lw_row", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), col(score).desc(), col(id_col), col("_lw_row"))
    parts = parts.sortWithinPartitions(col(score).desc(), col(id_col), col("_lw_row")).withColumn("_lw_m", F.monotonically_increasing_id())
    parts = scratch.save(parts, "drawn")  # numbers hold from here on
    parts = parts.withColumns({"_lw_p": F.shiftright("_lw_m", 33), "_lw_i": col("_lw_m").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = parts.groupBy("_lw_p").agg(F.count("*").alias("_lw_n"))  # a row a range
    before = counts.select("_lw_p", (F.sum("_lw_n").over(Window.orderBy("_lw_p")) - col("_lw_n")).alias("_lw_a"))
    place = col("_lw_a") + col("_lw_i") + 1
    ranked = parts.join(before, "_lw_p").withColumn("rank", F.when(place <= k, place)).drop("_lw_row", "_lw_m", "_lw_p", "_lw_i", "_lw_a")
    return rows.where(~chosen).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked).drop("_lw_can")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, n: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank), one row for each of docs, drawn towards the texts of target.

    Whole texts are read; null and empty ones have no feature, the weight 0 and are never drawn
    where least_words is over 0. Ids may be null (noise of an empty id) and rows repeated: each
    is a row of its own, with the same noise. Other columns are not looked at, whatever their
    names. With an empty target all gains are those of an even one; with no documents the result
    is empty.
    """
    scratch, many = Scratch(docs.sparkSession, "resample"), f"at least {least_words}"
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    longer = F.size("b") >= least_words if n == 1 else F.size(words("text")) >= least_words
    rows = rows.select("id", feature_buckets("text", n, buckets).alias("b"), "text").select("id", "b", longer.alias(many))
    rows = scratch.save(rows, "buckets")
    goal = spread(target.select(F.col(target_col).alias("text"))).select(feature_buckets("text", n, buckets).alias("b"))
    gain = gains(bucket_counts(rows, "b", "s"), bucket_counts(goal, "b", "t"), buckets)
    scored = rows.select("id", F.size("b").cast("long").alias("n_features"), weight("b", gain).alias("weight"), many)
    scored = scratch.save(scored.withColumn("score", F.col("weight") + noise("id", seed)), "scores")
    scratch.keep(scored)
    return draw(scored, "score", "id", percent, F.col(many), scratch).select("id", "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs, goal = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, goal).withColumnRenamed("id", "doc_id")


#: The table of crc32, worked out: eight steps of shifts and xor a value.
TABLE_SQL = "tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t)"


def crc_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text's UTF-8 bytes, where t is TABLE_SQL's table."""
    byte = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::int::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {byte}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::bigint)"


OP12_SQL = rf"""with {TABLE_SQL},
w as (select doc_id, row_number() over () r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') w from documents),
g as (select unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')) x from benchmark),
f as (select r, unnest(w) x from w),
v as (select x, {crc_sql("x")} % {BUCKETS} b from (select x from f union select x from g), tab),
s as (select b, count(*) s from f join v using (x) group by 1), t as (select b, count(*) t from g join v using (x) group by 1),
n as (select i b, coalesce(s, 0)::double s, coalesce(t, 0)::double t, coalesce(sum(s) over (), 0)::double ss, coalesce(sum(t) over (), 0)::double tt from range({BUCKETS}) k(i) left join s on s.b = i left join t on t.b = i),
gain as (select b, floor(1000 * ln((t + 1) * (ss + {BUCKETS}) / ((s + 1) * (tt + {BUCKETS}))))::bigint gain from n),
m as (select r, sum(gain)::bigint total, count(*) many from f join v using (x) join gain using (b) group by 1),
d as (select doc_id, len(w)::bigint n_features, case when many > 0 then (total - ((total % many) + many) % many) // many else 0 end::bigint as weight, ('0x' || left(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 8))::bigint h from w left join m using (r)),
e as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from d),
o as (select *, row_number() over (partition by n_features >= {LEAST_WORDS} order by score desc, doc_id) i, count(*) over (partition by n_features >= {LEAST_WORDS}) n from e)
select doc_id, n_features, weight, score, case when n_features >= {LEAST_WORDS} and i <= {PERCENT} * n // 100 then i end as rank from o"""
