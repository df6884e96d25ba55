"""A stored inverted index in segments: an update writes its own documents, a search reads its own terms.

A segment is a Parquet table of blocks, in folders by a hash of the term: up to BLOCK postings of one
term (documents, their lengths, counts and positions), with the most that one of them can
contribute to a score. Blocks of a term lie by that bound, so a search for the best n documents of a
term finds what the n-th best scores from the first blocks, and reads those that could beat it (by
the files' statistics of row groups and pages). Segments are never changed: what is removed or
replaced is named in tombstones, counts of documents by term come with a segment as differences,
and segments of like size are merged, which drops what is dead. The last manifest says what is in
force; readers of one before see what it named until vacuum().

Positions run through the columns of a document with a gap between columns; phrases are
neighbouring positions.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval
from ..operators.retrieval import B, K1
from .manifests import Manifests
from .scratch import dropped, saved

#: Text for each folder, postings of a block, and segments of like size (within as many times) that are merged.
BUCKET_BYTES, BLOCK, TIER = 128 << 20, 128, 4
#: Tokens of the documents whose postings are put together before they are dealt out (a longer document is put together alone).
TOKENS = 1 << 21
#: What scores that rank alike may differ by, and a bound from what it is of.
ALIKE, ROUNDING = 1e-9, 1e-12


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a table of one small file would else be one task's."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df._jdf.queryExecution().toRdd().getNumPartitions() < least else df


def pieces(docs: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(term, ids, lens, places): the postings of documents that a task reads together, up to BLOCK of a term in a row. Null texts are empty; ids are unique.

    A document's postings are made where it is read, and what is shuffled is a row for many of a frequent term.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    lists = [T.tokens(F.coalesce(F.col(c), F.lit(""))) for c in text_cols]
    d = docs.select(F.col(id_col).alias("id"), *(t.alias(f"_t{i}") for i, t in enumerate(lists)))
    gap = F.array(F.lit(None).cast("string"))
    words = F.concat(*(x for i in range(len(lists)) for x in ([gap] if i else []) + [F.col(f"_t{i}")]))
    size = sum((F.size(f"_t{i}") for i in range(len(lists))), F.lit(0))
    return d.select("id", size.cast("int").alias("size"), words.alias("words")).mapInArrow(_pieces, f"term string, ids array<{kind}>, lens array<int>, places array<array<int>>")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        part = np.cumsum(pc.list_value_length(whole.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)) // TOKENS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]
        for at, end in pairwise(cuts):
            b = whole.slice(at, end - at)
            many = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, doc = b.column(2).flatten(), np.repeat(np.arange(b.num_rows), many)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            flat, doc, pos = flat.filter(pa.array(there)).dictionary_encode(), doc[there], pos[there]
            if not len(doc):
                continue
            code = flat.indices.to_numpy()
            order = np.lexsort((doc, code))  # stable: places stay in order
            code, doc, pos = code[order], doc[order], pos[order].astype(np.int32)
            one = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])  # where a posting begins
            code_, doc = code[one], doc[one]
            new = np.r_[True, code_[1:] != code_[:-1]]
            nth = np.arange(len(one)) - np.maximum.accumulate(np.where(new, np.arange(len(one)), 0))
            starts = np.flatnonzero(nth % BLOCK == 0)
            places = pa.ListArray.from_arrays(pa.array(np.r_[one, len(pos)].astype(np.int32)), pa.array(pos))
            cut, doc = pa.array(np.r_[starts, len(one)].astype(np.int32)), pa.array(doc)
            lists = [pa.ListArray.from_arrays(cut, x) for x in (b.column(0).take(doc), b.column(1).take(doc), places)]
            yield pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(code_[starts])), *lists], names=["term", "ids", "lens", "places"])


class LexicalIndex:
    """BM25 search over a stored index, by default its last version, else the one named."""

    def __init__(self, spark: SparkSession, path: str, version: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._manifests = Manifests(spark, self.path)
        self.made = self._manifests.read(version)
        self.kind, self.buckets = self.made["kind"], self.made["buckets"]
        self.schemas = {
            "blocks": f"term string, impact double, ids array<{self.kind}>, lens array<int>, tfs array<int>, places array<array<int>>, seq int, seg string, bucket int",
            "terms": "term string, df long, seg string, bucket int",
            "docs": f"id {self.kind}, size int, terms array<string>, seq int, seg string",
            "gone": f"id {self.kind}, seq int, seg string",
        }

    @property
    def docs(self) -> int:
        return self.made["docs"]

    @property
    def tokens(self) -> int:
        return self.made["tokens"]

    @property
    def version(self) -> str:
        return self.made["name"]

    # writing

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_cols: list[str], path: str) -> LexicalIndex:
        """Writes the index of docs, whose ids are unique. An empty table gives an index that finds nothing. One at this path is replaced."""
        spark = docs.sparkSession
        size = docs.agg(*(F.sum(F.octet_length(c)) for c in text_cols)).first()
        buckets = max(16, -(-sum(x or 0 for x in size) // BUCKET_BYTES))
        manifests = Manifests(spark, path)
        made = manifests.put({"segments": [], "gone": [], "docs": 0, "tokens": 0, "seq": 0, "buckets": buckets, "kind": docs.schema[id_col].dataType.simpleString(), "columns": text_cols})
        index = cls(spark, path, made["name"])
        index.update(docs.withColumnRenamed(id_col, "id"))
        return index

    def update(self, docs: DataFrame, removed: DataFrame | None = None) -> None:
        """Adds docs(id, the text columns), in place of those with their ids, and removes those of removed(id). Written are their postings and tombstones."""
        seq, name, columns = self.made["seq"] + 1, uuid.uuid4().hex, self.made["columns"]
        docs = spread(docs.select("id", *columns))
        words = [T.tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns]
        own = docs.select("id", *(w.alias(f"_t{i}") for i, w in enumerate(words)))
        size = sum((F.size(f"_t{i}") for i in range(len(words))), F.lit(0))
        own = own.select("id", size.cast("int").alias("size"), F.array_distinct(F.concat(*(f"_t{i}" for i in range(len(words))))).alias("terms"), F.lit(seq).alias("seq"))
        own.sortWithinPartitions("id").write.parquet(self._at("docs", name))
        own = self._read("docs", [name])
        gone, out = None, {"docs": 0, "tokens": 0}
        if self.made["segments"]:
            ids = own.select("id") if removed is None else own.select("id").union(removed.select("id"))
            gone = saved(self._alive(self._read("docs")).join(ids.distinct(), "id", "left_semi").select("id", "size", "terms"), "gone")
            out = gone.agg(F.count("*").alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens")).first().asDict()
            if out["docs"]:
                gone.select("id", F.lit(seq).alias("seq")).write.parquet(self._at("gone", name))
        now = own.agg(F.count("*").alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens")).first()
        if not now.docs and not out["docs"] and self.made["segments"]:
            return
        df = own.select(F.explode("terms").alias("term"), F.lit(1).alias("n"))
        df = df if gone is None else df.union(gone.select(F.explode("terms"), F.lit(-1)))
        self._write_terms(df.groupBy("term").agg(F.sum("n").alias("df")), name)
        avg = now.tokens / max(1, now.docs)
        self._write_blocks(pieces(docs, "id", columns), name, seq, avg, now.tokens)
        if gone is not None:
            dropped(gone)
        made = dict(self.made)
        made["segments"] = [*made["segments"], {"name": name, "docs": now.docs, "tokens": now.tokens, "avg": avg, "seq": seq}]
        made["gone"] = [*made["gone"], {"name": name, "seq": seq}] if out["docs"] else made["gone"]
        self.made = self._manifests.put(made | {"docs": made["docs"] + now.docs - out["docs"], "tokens": made["tokens"] + now.tokens - out["tokens"], "seq": seq}, self.made["name"])
        self._merge()

    def _merge(self) -> None:
        """Merges TIER segments of like size, as long as there are so many."""
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in self.made["segments"]:
                tiers.setdefault(int(math.log(max(1, s["docs"]), TIER)), []).append(s)
            some = next((own for _, own in sorted(tiers.items()) if len(own) >= TIER), None)
            if some is None:
                return
            self.merge([s["name"] for s in some])

    def merge(self, names: list[str]) -> None:
        """Writes these segments as one, without what is dead in them."""
        seq, name = self.made["seq"] + 1, uuid.uuid4().hex
        self._alive(self._read("docs", names)).select("id", "size", "terms", F.lit(seq).alias("seq")).sortWithinPartitions("id").write.parquet(self._at("docs", name))
        now = self._read("docs", [name]).agg(F.count("*").alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens")).first()
        self._write_terms(self._read("terms", names).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), name)
        avg = now.tokens / max(1, now.docs)
        alive = self._alive(self._exploded(self._read("blocks", names)))
        self._write_blocks(alive.select("term", F.array("id").alias("ids"), F.array("size").alias("lens"), F.array("places").alias("places")), name, seq, avg, now.tokens)
        kept = [s for s in self.made["segments"] if s["name"] not in names]
        segments = [*kept, {"name": name, "docs": now.docs, "tokens": now.tokens, "avg": avg, "seq": seq}]
        gone = [g for g in self.made["gone"] if any(s["seq"] < g["seq"] for s in segments)]
        self.made = self._manifests.put(self.made | {"segments": segments, "gone": gone, "seq": seq}, self.made["name"])

    def vacuum(self) -> int:
        """Deletes what the version in force doesn't name; says how much."""
        keep = {self.version, "blocks", "terms", "docs", "gone", *(f"seg={s['name']}" for s in [*self.made["segments"], *self.made["gone"]])}
        return self._manifests.vacuum(keep, "", "blocks", "terms", "docs", "gone")

    def _at(self, table: str, name: str) -> str:
        return f"{self.path}/{table}/seg={name}"

    def _write_terms(self, df: DataFrame, name: str) -> None:
        rows = df.withColumn("bucket", self._bucket(F.col("term"), self.buckets)).repartition(self._tasks(0), "bucket")
        rows.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(self._at("terms", name))

    def _tasks(self, tokens: int) -> int:
        return max(1, min(max(self.spark.sparkContext.defaultParallelism, self.buckets), 1 + tokens // 10_000))

    def _write_blocks(self, postings: DataFrame, name: str, seq: int, avg: float, tokens: int) -> None:
        """Postings, in pieces(), are dealt out by ranges of (folder, term, first document), so a frequent term is many tasks'."""
        rows = postings.select(self._bucket(F.col("term"), self.buckets).alias("bucket"), "term", F.element_at("ids", 1).alias("id"), "ids", "lens", "places")
        rows = rows.repartitionByRange(self._tasks(tokens), "bucket", "term", "id").sortWithinPartitions("bucket", "term", "id").drop("id")
        blocks = rows.mapInArrow(_blocks(avg, seq), f"bucket int, term string, impact double, ids array<{self.kind}>, lens array<int>, tfs array<int>, places array<array<int>>, seq int")
        blocks.sortWithinPartitions("bucket", "term", F.col("impact").desc()).write.option("parquet.page.row.count.limit", 64).partitionBy("bucket").parquet(self._at("blocks", name))

    # reading

    @staticmethod
    def _bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    def _read(self, table: str, names: list[str] | None = None) -> DataFrame:
        names = [s["name"] for s in self.made["gone" if table == "gone" else "segments"]] if names is None else names
        if not names:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).option("basePath", f"{self.path}/{table}").parquet(*(self._at(table, n) for n in names))

    def _alive(self, rows: DataFrame) -> DataFrame:
        """rows(id, seq, ...) without those that a later tombstone names."""
        if not self.made["gone"]:
            return rows
        gone = self._read("gone").groupBy(F.col("id").alias("_g")).agg(F.max("seq").alias("_s"))
        return rows.join(gone, (F.col("id") == F.col("_g")) & (F.col("_s") > F.col("seq")), "left_anti")

    def _of(self, table: str, terms: list[str] | None) -> DataFrame:
        rows = self._read(table)
        if terms is None:
            return rows
        here = F.array(*(self._bucket(F.lit(t), self.buckets) for t in terms))  # folded, so folders are pruned
        return rows.where(F.array_contains(here, F.col("bucket")) & F.col("term").isin(terms))

    @staticmethod
    def _exploded(blocks: DataFrame, places: bool = True) -> DataFrame:
        """(term, id, size, tf, seq[, places]) of blocks."""
        names = ["ids", "lens", "tfs"] + ["places"] * places
        one = blocks.select("term", "seq", F.explode(F.arrays_zip(*names)).alias("x"))
        return one.select("term", "seq", F.col("x.ids").alias("id"), F.col("x.lens").alias("size"), F.col("x.tfs").alias("tf"), *([F.col("x.places").alias("places")] * places))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, doc, tf), of these terms or all."""
        return self._alive(self._exploded(self._of("blocks", terms), places=False)).select("term", F.col("id").alias("doc"), F.col("tf").cast("long").alias("tf"))

    def search(self, query: str, n: int | None = None, id_col: str = "id") -> DataFrame:
        """(id, bm25): documents that have every term of the query, best first.

        A term with an underscore is a phrase, which lies in one column. A term that occurs twice
        in the query counts twice. A query without terms finds nothing.
        """
        terms = T.query_terms(query)
        words = sorted({w for p in terms for w in p})
        different = [list(p) for p in dict.fromkeys(map(tuple, terms))]
        if n and len(different) == 1 and len(words) == len(different[0]) == 1:
            return self._best(words[0], len(terms), n).withColumnRenamed("id", id_col)
        phrased = any(len(p) > 1 for p in different)
        found = self._alive(self._exploded(self._of("blocks", words or [""]), places=phrased))
        at = {w: F.first(F.when(F.col("term") == w, F.col("places")), ignorenulls=True).alias(f"_p{i}") for i, w in enumerate(words) if any(len(p) > 1 and w in p for p in different)}
        tf = {w: F.coalesce(F.sum(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"_c{i}") for i, w in enumerate(words)}
        d = found.groupBy("id").agg(F.first("size").alias("_len"), *tf.values(), *at.values())

        def shifted(by: int):
            return lambda x: x - by

        def count(phrase: list[str]) -> Column:
            where = [words.index(w) for w in phrase]
            if len(phrase) == 1:
                return F.col(f"_c{where[0]}")
            places = F.col(f"_p{where[0]}")
            for k, i in enumerate(where[1:], 1):
                places = F.array_intersect(places, F.transform(F.col(f"_p{i}"), shifted(k)))
            return F.when(places.isNull(), F.lit(0)).otherwise(F.size(places))

        d = d.select("id", "_len", *(count(p).alias(f"_f{i}") for i, p in enumerate(different)))
        stats = d.agg(F.lit(float(self.docs)).alias("_n"), F.lit(self.tokens / max(1, self.docs)).alias("_avg"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in range(len(different))))
        return retrieval.scored(d, stats, "id", [terms.count(p) for p in different], n).withColumnRenamed("id", id_col)

    def _best(self, word: str, times: int, n: int) -> DataFrame:
        """The best n documents of one word, from the blocks that may have one of them."""
        df = self._of("terms", [word]).agg(F.sum("df")).first()[0] or 0
        avg = self.tokens / max(1, self.docs)
        blocks = self._of("blocks", [word])
        stats = self.spark.range(1).select(F.lit(float(self.docs)).alias("_n"), F.lit(avg).alias("_avg"), F.lit(df).alias("_n0"))

        def scored(some: DataFrame) -> DataFrame:
            d = self._alive(self._exploded(some, places=False)).select("id", F.col("size").alias("_len"), F.col("tf").alias("_f0"))
            return retrieval.scored(d, stats, "id", [times], n)

        least = self.least_impact(word, times, n, df, scored)
        return scored(blocks if least is None else blocks.where(F.col("impact") >= least))

    def least_impact(self, word: str, times: int, n: int, df: int, scored) -> float | None:
        """The bound that a block needs for one of the n best: the n-th best score of the blocks with the highest bounds, over what a bound counts for. None: all are read."""
        blocks, many = self._of("blocks", [word]), 2 * -(-n // BLOCK) + 2
        heads = blocks.select("impact").orderBy(F.col("impact").desc()).limit(many).collect()
        if len(heads) < many:
            return None
        found = scored(blocks.where(F.col("impact") >= heads[-1].impact)).agg(F.count("*"), F.min("bm25")).first()
        if found[0] < n:
            return None
        avg = self.tokens / max(1, self.docs)
        longer = max([1.0, *(avg / s["avg"] for s in self.made["segments"] if s["avg"])])  # bounds were worked out with a segment's own average; a contribution grows by less than that does
        idf = max(math.log((self.docs - df + 0.5) / (df + 0.5)), retrieval.LEAST_IDF)
        return (found[1] - ALIKE) / (times * idf * longer) * (1 - ROUNDING)


def _blocks(avg: float, seq: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own = pa.array(np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)))
            bucket, term, (ids, size, places) = b.column(0).take(own), b.column(1).take(own), (b.column(i).flatten() for i in range(2, 5))
            n = len(ids)
            new = np.r_[True, pc.not_equal(term.slice(1), term.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)] if n > 1 else np.array([True])
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            starts = np.flatnonzero((np.arange(n) - first) % BLOCK == 0)
            tf = pc.list_value_length(places)
            f, lens = tf.to_numpy(zero_copy_only=False).astype(float), size.to_numpy(zero_copy_only=False).astype(float)
            most = np.maximum.reduceat(f * (K1 + 1) / (f + K1 * (1 - B + B * lens / (avg or 1.0))), starts)
            cut, at = pa.array(np.r_[starts, n].astype(np.int32)), pa.array(starts)
            lists = [pa.ListArray.from_arrays(cut, x) for x in (ids, size, tf, places)]
            yield pa.RecordBatch.from_arrays([bucket.take(at), term.take(at), pa.array(most), *lists, pa.array(np.full(len(starts), seq, np.int32))], names=["bucket", "term", "impact", "ids", "lens", "tfs", "places", "seq"])

    return run
