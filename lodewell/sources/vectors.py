"""A stored index of vectors: a proximity graph whose nodes lie in lists around centroids.

A node is a row with its vector and links to near nodes; its row is in the folder of the list of its
nearest centroid. A search begins at the nodes next to the centroids nearest to a query and follows
links: of the `beam` best nodes seen, those not yet followed are, until all have been. A table of
queries is searched at once, a turn being one join of the nodes that come next with the folders that
hold them, so a search reads the lists that it walks through, not the table.

Centroids are fitted on a sample of at most SAMPLE vectors, every vector is in the index. Links
come from neighbour descent. Rows that are added are linked by a search of their own, and the nodes
that they link to get a link back; removed ones stay as waypoints that no search returns. Both are
written as new rows beside the old ones (a later row of a node counts), until compact() writes
what is in force anew, with links past the removed nodes. What is in force is said by the last
manifest, which one rename puts in place, so a search sees all of an update or none.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import proximity
from .manifests import Manifests
from .scratch import dropped, saved

SAMPLE = 200_000
#: Links that a node is given, times of those that it may gather, best nodes that a search keeps, nodes that it follows a turn.
DEGREE, GATHERED, BEAM, WIDTH = 16, 2, 16, 6
#: Lists whose middle nodes a search begins from, and the beam by which added nodes find their links.
ENTRIES, ADDED = 8, 96
#: Vectors up to which nearest() scans them all, exactly, in one pass: a walk's turns would take longer.
FLAT = proximity.PASS


class VectorIndex:
    """An index at a path: by default its last version, else the manifest of that name."""

    def __init__(self, spark: SparkSession, path: str, similarity: Callable[[Column, Column], Column] = V.dot, version: str | None = None):
        self.spark, self.path, self.similarity = spark, path.rstrip("/"), similarity
        self._manifests = Manifests(spark, self.path)
        self.made = self._manifests.read(version)
        rows = spark.read.parquet(f"{self.path}/{self.made['lists']}").orderBy("list").collect()  # about the square root of the vectors
        self.lists, self.centroids = [r.list for r in rows], np.array([r.centroid for r in rows], float) if rows else np.zeros((0, 0))
        self.first = [r.first for r in rows]
        self.schema = f"id {self.made['kind']}, vector array<float>, links array<struct<score: double, id: {self.made['kind']}, list: int>>, gone boolean, seq int, list int"

    # versions

    def _commit(self, parts: list[str], n: int) -> None:
        """Puts a manifest with these folders of n nodes in force, next to the one that this index was opened at."""
        self.made = self._manifests.put({"parts": parts, "lists": self.made["lists"], "kind": self.made["kind"], "n": n}, self.made["name"])

    @property
    def version(self) -> str:
        return self.made["name"]

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.repartition(max(1, min(len(self.lists) or 1, 4096)), "list").sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{self.path}/nodes/part={name}")
        return name

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str, vector_col: str, path: str, lists: int | None = None, seed: int = 7, degree: int = DEGREE) -> VectorIndex:
        """Writes the index of vectors(id, vector); null vectors are left out, ids are to be unique. An index at this path is replaced."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark, path = vectors.sparkSession, path.rstrip("/")
        kind = vectors.schema[id_col].dataType.simpleString()
        rows = saved(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where("vector is not null"), "vectors")
        n = rows.count()
        k = max(1, min(lists or round(math.sqrt(n)), n))
        points = rows.withColumn("features", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
        if k == 1 and n:
            centres = [[float(x) for x in rows.first().vector]]  # all are in one list
        elif n:
            picked = points.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / n)))
            centres = [[float(x) for x in c] for c in KMeans(k=k, seed=seed, maxIter=10).fit(picked if not picked.isEmpty() else points).clusterCenters()]
        else:
            centres = []
        placed = saved(_placed(rows, np.array(centres, float), kind), "placed")
        near = _linked(rows, n, degree)
        ends = near.join(placed.select(F.col("id").alias("dst"), "list"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("o"), "dst", "list", "sim"))).alias("x"))
        links = ends.select("id", F.transform("x", lambda x: F.struct(x["sim"].alias("score"), x["dst"].alias("id"), x["list"].alias("list"))).alias("links"))
        nodes = placed.join(links, "id", "left").select("id", "vector", "links", F.lit(False).alias("gone"), F.lit(0).alias("seq"), "list")
        made, known = uuid.uuid4().hex, f"lists-{uuid.uuid4().hex}"
        nodes.repartition(max(1, min(k, 4096)), "list").sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{path}/nodes/part={made}")
        medoid = placed.groupBy("list").agg(F.min_by("id", F.struct("far", "id")).alias("first"))
        spark.createDataFrame(list(enumerate(centres)), "list int, centroid array<double>").join(medoid, "list").coalesce(1).write.parquet(f"{path}/{known}")  # a row a list
        name = Manifests(spark, path).put({"parts": [made], "lists": known, "kind": kind, "n": n})["name"]
        dropped(rows, placed)
        return cls(spark, path, version=name)

    # reading

    def _stored(self, lists: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schema + ", part string").option("basePath", f"{self.path}/nodes").parquet(*(f"{self.path}/nodes/part={p}" for p in self.made["parts"])).drop("part")
        return rows if lists is None else rows.where(F.col("list").isin(lists))

    def rows(self) -> DataFrame:
        """The nodes in force: (id, vector, links, list)."""
        return self._latest(self._stored()).where("not gone").drop("gone", "seq")

    def _latest(self, rows: DataFrame, *keys: str) -> DataFrame:
        if len(self.made["parts"]) == 1:
            return rows
        last = F.row_number().over(Window.partitionBy("list", "id", *keys).orderBy(F.col("seq").desc()))
        return rows.withColumn("_r", last).where("_r = 1").drop("_r")

    def edges(self) -> DataFrame:
        """(src, dst, sim): the links between nodes in force."""
        rows = self.rows()
        ends = rows.select(F.col("id").alias("src"), F.explode("links").alias("x")).select("src", F.col("x.id").alias("dst"), F.col("x.score").alias("sim"))
        return ends if len(self.made["parts"]) == 1 else ends.join(rows.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "sim")

    def nearest(self, queries: DataFrame, k: int, query_col: str = "query", vector_col: str = "vector", flat: int = FLAT) -> DataFrame:
        """(query, id, score, rank): the k nearest of each row of queries: by a scan of all vectors where there are at most `flat`, else by search_batch()."""
        if self.made["n"] <= flat and self.similarity is V.dot:
            rows = queries.select(F.col(query_col).alias("query"), F.col(vector_col).alias("vector"))
            return proximity.batch_topk(rows, self.rows(), k, "query", "id", "vector").select("query", "id", "score", "rank")
        return self.search_batch(queries, k, query_col, vector_col).drop("touched")

    def search_batch(self, queries: DataFrame, k: int, query_col: str = "query", vector_col: str = "vector", beam: int = BEAM, width: int = WIDTH, same: bool = True) -> DataFrame:
        """(query, id, score, rank, touched): approximately the k nearest of each row of queries, and how many nodes were scored for it.

        Queries are of their own; same=False leaves out a node whose id is the query's. One with a
        null vector finds nothing. Ties go to the smaller id. beam is at least k.
        """
        kind, beam = self.made["kind"], max(beam, k + (not same))
        place = f"struct<id: {kind}, list: int>"
        none = F.array().cast(f"array<struct<o: double, id: {kind}, list: int, score: double, gone: boolean, done: boolean, links: array<{place}>>>")
        rows = queries.select(F.col(query_col).alias("query"), F.transform(vector_col, lambda x: x.cast("double")).alias("q")).where("q is not null")
        state = saved(self._entered(rows).select("query", "q", none.alias("beam"), F.col("next").alias("seen"), "next", F.lit(True).alias("going")), "beam")
        while True:
            ask = state.select("query", "q", F.explode("next").alias("n")).select("query", "q", "n.list", "n.id")
            here = [r.list for r in ask.select("list").distinct().collect()]  # there are as many as lists at most
            if not here and state.where("going").isEmpty():
                break
            after = state.drop("next").withColumn("found", none)
            if here:
                met = self._latest(self._stored(here).join(ask, ["list", "id"]), "query").withColumn("score", self.similarity(F.col("vector"), F.col("q")))
                links = F.coalesce(F.transform("links", lambda x: F.struct(x["id"].alias("id"), x["list"].alias("list"))), F.array().cast(f"array<{place}>"))
                met = met.where(~F.isnan("score")).select("query", F.struct((-F.round("score", 9)).alias("o"), "id", "list", "score", "gone", F.lit(False).alias("done"), links.alias("links")).alias("x"))
                after = state.drop("next").join(met.groupBy("query").agg(F.collect_list("x").alias("found")), "query", "left")
            after = after.withColumn("beam", F.slice(F.array_sort(F.concat("beam", F.coalesce("found", none))), 1, beam))
            after = after.withColumn("chosen", F.slice(F.filter("beam", lambda x: ~x["done"]), 1, width))
            followed = F.transform("beam", lambda x: x.withField("done", x["done"] | F.exists("chosen", lambda c: (c["id"] == x["id"]) & (c["list"] == x["list"]))))
            after = after.withColumn("next", F.array_except(F.flatten(F.transform("chosen", lambda x: x["links"])), "seen"))
            after = saved(after.select("query", "q", followed.alias("beam"), F.concat("seen", "next").alias("seen"), "next", (F.size("chosen") > 0).alias("going")), "beam")
            dropped(state)
            state = after
        out = state.select("query", F.size("seen").alias("touched"), F.explode(F.filter("beam", lambda x: ~x["gone"])).alias("x")).select("query", "x.id", "x.score", "touched")
        if not same:
            out = out.where("query <> id")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "id"))
        return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "id", "score", "rank", "touched")

    def search(self, query, k: int, beam: int = BEAM) -> DataFrame:
        """(id, score): approximately the k nearest to one vector, best first."""
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query int, vector array<double>")
        return self.search_batch(one, k, beam=beam).orderBy("rank").select("id", "score")

    def _entered(self, rows: DataFrame) -> DataFrame:
        """rows(query, q) with next: the nodes by which a search begins, those next to the ENTRIES nearest centroids."""
        first, lists, centres = self.first, self.lists, self.centroids
        kind = self.made["kind"]
        to = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
        place = pa.struct([("id", to), ("list", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    own = b.slice(i, 256)
                    far = _far(proximity.matrix(own.column(1)), centres)
                    near = np.argsort(far, axis=1, kind="stable")[:, :ENTRIES]
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([[{"id": first[x], "list": lists[x]} for x in r] for r in near.tolist()], pa.list_(place))], names=["query", "q", "next"])

        schema = f"query {rows.schema['query'].dataType.simpleString()}, q array<double>, next array<struct<id: {kind}, list: int>>"
        return rows.mapInArrow(run, schema) if lists else rows.withColumn("next", F.array().cast(f"array<struct<id: {kind}, list: int>>"))

    # changes

    def insert(self, vectors: DataFrame, id_col: str = "id", vector_col: str = "vector", degree: int = DEGREE) -> None:
        """Adds vectors(id, vector), or replaces those whose ids are there. Written are their rows and those of the nodes that they link to."""
        rows = saved(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where("vector is not null"), "added")
        if rows.isEmpty():
            return
        if not self.lists:
            self.__init__(self.spark, self.path, self.similarity, VectorIndex.build(rows, "id", "vector", self.path).version)
            return
        seq, kind = len(self.made["parts"]), self.made["kind"]
        placed = saved(_placed(rows, self.centroids, kind).drop("far"), "placed")
        many = rows.count()
        if self.made["n"] <= FLAT:
            old = proximity.batch_topk(rows.select(F.col("id").alias("query"), "vector"), self.rows(), degree, "query", "id", "vector", same=False)
        else:
            old = self.search_batch(rows, degree, "id", "vector", beam=ADDED, same=False)
        old = old.select(F.col("query").alias("src"), F.col("id").alias("dst"), "score")
        old = old.join(rows.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "score")  # what is replaced is found by its new vector
        among = _linked(rows, many, degree).select("src", "dst", F.col("sim").alias("score"))
        links = saved(old.union(among), "links")
        both = links.union(links.select("dst", "src", "score")).toDF("id", "to", "score").distinct()
        where = placed.select("id", "list").union(self.rows().select("id", "list").join(links.select(F.col("dst").alias("id")).distinct(), "id", "left_semi").join(rows, "id", "left_anti"))
        where = saved(where, "where")
        ends = both.join(where.select(F.col("id").alias("to"), F.col("list").alias("at")), "to").groupBy("id").agg(F.collect_list(F.struct("score", F.col("to").alias("id"), F.col("at").alias("list"))).alias("more"))
        had = self.rows().join(where.join(placed, "id", "left_anti"), ["id", "list"]).select("id", "vector", "links", "list")
        now = had.unionByName(placed.select("id", "vector", F.array().cast(had.schema["links"].dataType).alias("links"), "list")).join(ends, "id", "left")
        best = F.reverse(F.array_sort(F.array_distinct(F.concat(F.coalesce("links", F.array().cast(had.schema["links"].dataType)), F.coalesce("more", F.array().cast(had.schema["links"].dataType))))))
        now = now.select("id", "vector", F.slice(best, 1, GATHERED * degree).alias("links"), F.lit(False).alias("gone"), F.lit(seq).alias("seq"), "list")
        moved = self.rows().join(placed.select("id", F.col("list").alias("to")), "id").where("list <> to")  # a replaced node's row in another list
        now = now.unionByName(moved.select("id", "vector", "links", F.lit(True).alias("gone"), F.lit(seq).alias("seq"), "list"))
        replaced = self.rows().join(placed.select("id"), "id", "left_semi").count()
        self._commit([*self.made["parts"], self._write(now)], self.made["n"] + many - replaced)
        dropped(rows, placed, links, where)

    def remove(self, ids: DataFrame) -> None:
        """Removes the nodes of ids(id). Their rows stay as waypoints until compact()."""
        gone = saved(self.rows().join(ids.select("id"), "id", "left_semi").select("id", "vector", "links", F.lit(True).alias("gone"), F.lit(len(self.made["parts"])).alias("seq"), "list"), "removed")
        many = gone.count()
        if many:
            self._commit([*self.made["parts"], self._write(gone)], self.made["n"] - many)
        dropped(gone)

    def compact(self, degree: int = DEGREE) -> None:
        """Writes what is in force as one part. Links to removed nodes go on to the nodes that those linked to, the best of them by score."""
        every = saved(self._latest(self._stored()), "nodes")
        live, gone = every.where("not gone"), every.where("gone").select(F.col("id").alias("g"), F.col("list").alias("gl"), F.col("links").alias("past"))
        ends = live.select("id", "list", "vector", F.explode("links").alias("x")).select("id", "list", "vector", F.col("x.id").alias("g"), F.col("x.list").alias("gl"))
        past = ends.join(gone, ["g", "gl"]).select("id", "list", "vector", F.explode("past").alias("x")).select("id", "list", "vector", F.col("x.id").alias("to"), F.col("x.list").alias("tl")).where("id <> to").distinct()
        other = live.select(F.col("id").alias("to"), F.col("list").alias("tl"), F.col("vector").alias("w"))
        more = past.join(other, ["to", "tl"]).withColumn("score", self.similarity(F.col("vector"), F.transform("w", lambda x: x.cast("double"))))
        kept = live.select("id", "list", F.explode("links").alias("x")).select("id", "list", "x.score", F.col("x.id").alias("to"), F.col("x.list").alias("tl")).join(other.select("to", "tl"), ["to", "tl"])
        both = kept.select("id", "list", "to", "tl", "score").unionByName(more.select("id", "list", "to", "tl", "score")).groupBy("id", "list", "to", "tl").agg(F.max("score").alias("score"))
        links = both.groupBy("id", "list").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("score", F.col("to").alias("id"), F.col("tl").alias("list"))))), 1, GATHERED * degree).alias("links"))
        now = live.drop("links").join(links, ["id", "list"], "left").select("id", "vector", "links", "gone", F.lit(0).alias("seq"), "list")
        self._commit([self._write(now)], self.made["n"])
        dropped(every)

    def vacuum(self) -> int:
        """Deletes what the manifest in force doesn't name; says how much."""
        return self._manifests.vacuum({self.made["name"], self.made["lists"], "nodes", *(f"part={p}" for p in self.made["parts"])}, "", "nodes")


def _far(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, less what is the same for all of a row's."""
    return (centres**2).sum(1)[None, :] - 2 * m @ centres.T


def _placed(rows: DataFrame, centres: np.ndarray, kind: str) -> DataFrame:
    """rows(id, vector) with list, the nearest centroid's, and far, how far it is."""
    if not len(centres):
        return rows.withColumn("list", F.lit(0)).withColumn("far", F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                far = _far(proximity.matrix(b.column(1)), centres)
                at = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(far[np.arange(len(at)), at])], names=["id", "vector", "list", "far"])

    return rows.mapInArrow(run, f"id {kind}, vector array<float>, list int, far double")


def _linked(rows: DataFrame, n: int, degree: int) -> DataFrame:
    """(src, dst, sim): each row's links among rows(id, vector): exactly while one pass compares all, else by descent (whose nearer half is found better)."""
    if n <= proximity.PASS:
        return proximity.batch_topk(rows.select(F.col("id").alias("query"), "vector"), rows, degree, "query", "id", "vector", same=False).select(F.col("query").alias("src"), F.col("id").alias("dst"), F.col("score").alias("sim"))
    return proximity.descent(rows, 2 * degree, "id", "vector").where(F.col("rank") <= degree).select("src", "dst", "sim")
