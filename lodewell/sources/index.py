"""The index of a workspace: tables and indexes that an update adds to, put in force as one.

A version is a small manifest that says at which of their own versions the keyed tables (chunks,
files, cached embeddings, notes), the chunks' inverted index and their vector index are, and where
the chunks' communities; the last one is in force. An update writes beside what is there: the rows
that change, their postings, their vectors and links. Then it puts a new manifest in force by one
rename, so a reader or a crash sees either all of an update or none; what a failed update has
written is named by no version and goes with the next vacuum. Updates lock the index before they
begin, so a second one fails at once. All file access is through Spark's file systems.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import Settings
from ..embedder import Embedder, HashingEmbedder, embed_column
from ..errors import NotFound, StorageError
from ..functions import hashing as H
from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking, graph, incremental, retrieval
from . import scan
from .lexical import LexicalIndex
from .tables import KeyedTable
from .vectors import VectorIndex

LOCK_HOURS = 24
#: Parts of the vector index, one an update, from which on an update writes it as one.
PARTS = 8
TABLES = {"chunks": schemas.CHUNK, "vectors": schemas.VECTOR, "files": schemas.FILE, "cache": schemas.CACHE, "notes": schemas.NOTE, "communities": schemas.COMMUNITY}
#: Chunks are stored without their communities, which any update may change.
STORED = {"chunks": "id string, kind string, name string, source_path string, source string"}
KEYS = {"chunks": "id", "files": "rel_path", "cache": "content_hash", "notes": "id"}


class Index:
    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, settings: Settings | None = None, similarity: Callable = V.dot):
        self.spark, self.path = spark, path.rstrip("/")
        self.embedder, self.settings = embedder or HashingEmbedder(), settings or Settings()
        self.similarity = similarity  # of two columns of vectors, higher is nearer
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # versions

    def _versions(self) -> list[str]:
        at = self._path(self.path)
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in names if n.startswith("v-"))

    def version(self) -> str | None:
        return max(self._versions(), default=None)

    def manifest(self, version: str | None = None) -> dict[str, str]:
        """The folder of each table of a version, by default of the one in force."""
        version = version or self.version()
        if version is None:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/{version}/manifest.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def vectors(self) -> VectorIndex | None:
        """The chunks' vector index, as of the version in force."""
        at = self.manifest().get("vectors")
        return None if at is None else VectorIndex(self.spark, f"{self.path}/vectors", self.similarity, at)

    def keyed(self, name: str) -> KeyedTable | None:
        at = self.manifest().get(name)
        return None if at is None else KeyedTable(self.spark, f"{self.path}/tables/{name}", at)

    def table(self, name: str) -> DataFrame:
        at = self.manifest().get(name)
        if at is None:
            return self.spark.createDataFrame([], TABLES[name])
        if name == "vectors":
            return self.vectors().rows().select("id", "vector")
        if name == "communities":
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/data/{at}")
        rows = self.keyed(name).read()
        return rows.join(self.table("communities"), "id", "left").select("id", "kind", "name", "source_path", "source", "community_id") if name == "chunks" else rows

    def lexical(self) -> LexicalIndex | None:
        """The chunks' inverted index; built anew if it doesn't fit the chunks."""
        made = self.manifest()
        if "chunks" not in made:
            return None
        if made.get("lexical_of") != made["chunks"]:
            self.commit(relex=True)
            made = self.manifest()
        return LexicalIndex(self.spark, f"{self.path}/lexical", made["lexical"])

    @contextlib.contextmanager
    def _locked(self) -> Iterator[None]:
        """Holds the index for one update; a lock of over LOCK_HOURS is one of a driver that died."""
        at = self._path(f"{self.path}/.lock")
        if self._fs.exists(at) and time.time() - self._fs.getFileStatus(at).getModificationTime() / 1000 > LOCK_HOURS * 3600:
            self._fs.delete(at, False)
        if not self._fs.createNewFile(at):
            raise StorageError(f"another update of {self.path} is running")
        try:
            yield
        finally:
            self._fs.delete(at, False)

    def commit(self, changes: dict[str, tuple[DataFrame | None, DataFrame | None]] | None = None, vectors: VectorIndex | None = None, lexical: LexicalIndex | None = None, communities: DataFrame | None = None, relex: bool = False) -> str:
        """A new version with these changes (rows to put in, keys to take out) of keyed tables, these states of the indexes and these communities; the rest is as it was. Chunks without an inverted index get one, and a new one if relex."""
        now = self.version()
        made, id_ = self.manifest(now), uuid.uuid4().hex
        new, staged = f"v-{int(now[2:]) + 1 if now else 1:012d}", f"{self.path}/.staged-{id_}"
        try:
            for name, (rows, gone) in (changes or {}).items():
                table = KeyedTable(self.spark, f"{self.path}/tables/{name}", made[name]) if name in made else KeyedTable.create(self.spark, f"{self.path}/tables/{name}", STORED.get(name, TABLES[name]), KEYS[name])
                table.change(rows, gone)
                made[name] = table.version
            if vectors is not None:
                made["vectors"] = vectors.version
            if communities is not None:
                communities.select("id", "community_id").write.parquet(f"{self.path}/data/communities-{id_}")
                made["communities"] = f"communities-{id_}"
            if lexical is None and "chunks" in made and (relex or "lexical" not in made):
                chunks = KeyedTable(self.spark, f"{self.path}/tables/chunks", made["chunks"]).read()
                lexical = LexicalIndex.build(chunks, "id", ["name", "source"], f"{self.path}/lexical")
            if lexical is not None:
                made |= {"lexical": lexical.version, "lexical_of": made["chunks"]}
            out = self._fs.create(self._path(f"{staged}/manifest.json"))
            out.write(bytearray(json.dumps(made).encode()))
            out.close()
            if self._fs.exists(self._path(f"{self.path}/{new}")):
                raise StorageError("another update came between")
            if not self._fs.rename(self._path(staged), self._path(f"{self.path}/{new}")):
                raise StorageError("the version can't be put in force")
        except BaseException:
            self._fs.delete(self._path(staged), True)
            raise
        return new

    def vacuum(self) -> int:
        """Deletes versions before the current one, and what only they or failed updates have; says how many versions."""
        old, made = self._versions()[:-1], set(self.manifest().values())
        for name in old:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        data = self._path(f"{self.path}/data")
        for x in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if x.getPath().getName() not in made:
                self._fs.delete(x.getPath(), True)
        for part in (self.vectors(), self.lexical(), *map(self.keyed, KEYS)):
            if part is not None:
                part.vacuum()
        return len(old)

    # indexing

    def reindex(self, root: str) -> dict[str, int]:
        """Brings the index up to date with the files under root: only new and changed files are read, only unknown chunks embedded."""
        s = self.settings.index
        listing = scan.scan(self.spark, root, s.extensions, s.max_file_bytes)
        return self.apply(listing)

    def apply(self, listing: DataFrame) -> dict[str, int]:
        """The same for a listing (rel_path, mtime_ns, size, content) of all files there are. Fails at once if another update is running."""
        with self._locked():
            return self._apply(listing)

    def _apply(self, listing: DataFrame) -> dict[str, int]:
        known, cache = self.table("files"), self.keyed("cache")
        state = incremental.classify(listing.drop("content"), known).where("state <> 'unchanged'").persist()
        counts = {r.state: r["count"] for r in state.groupBy("state").count().collect()}
        if not counts and self.version() is not None:
            state.unpersist()
            return {"new": 0, "changed": 0, "deleted": 0, "chunks": 0, "cache_hits": 0}
        fresh = listing.join(state.where("state <> 'deleted'"), "rel_path", "left_semi")
        found = chunking.chunk_files(scan.readable(fresh).select(F.col("rel_path").alias("source_path"), "text"))
        found = found.withColumn("id", H.chunk_id(F.col("source_path"), F.col("name"), F.col("kind")))
        found = found.withColumn("content_hash", H.fnv1a(T.embed_input(T.kind_shown(F.col("kind")), F.col("name"), F.col("source_path"), F.col("embed_text"))))
        last = F.row_number().over(Window.partitionBy("id").orderBy(F.col("ord").desc()))
        found = found.withColumn("_r", last).where("_r = 1").drop("_r")  # of chunks with one identity the last
        found = found.persist()
        had = self.table("cache") if cache is None else cache.lookup(found)  # folders that hold none of these are not read
        probed = incremental.probe(found, had, "content_hash", "vector").persist()
        missed = embed_column(probed.where("not hit").drop("vector", "hit"), T.embed_input(T.kind_shown(F.col("kind")), F.col("name"), F.col("source_path"), F.col("embed_text")), "vector", self.embedder).persist()
        new = probed.where("hit").drop("hit").unionByName(missed)

        gone = state.select(F.col("rel_path").alias("source_path"))
        chunks, index, lexical = self.keyed("chunks"), self.vectors(), self.lexical()
        stale = self.spark.createDataFrame([], "id string") if chunks is None else chunks.read().join(gone, "source_path", "left_semi").select("id").join(new.select("id"), "id", "left_anti").persist()
        fresh_cache = missed.select("content_hash", "vector", F.lit(int(time.time())).alias("created_at")).dropDuplicates(["content_hash"])
        changes = {"chunks": (new, stale), "files": (fresh.select("rel_path", "mtime_ns", "size"), state.where("state = 'deleted'").select("rel_path")), "cache": (fresh_cache, None)}
        if lexical is not None:
            lexical.update(new.select("id", "name", "source"), stale)
        if index is None:
            index = VectorIndex.build(new, "id", "vector", f"{self.path}/vectors")
        else:
            index.remove(stale)
            index.insert(new.select("id", "vector"))
            if len(index.made["parts"]) > PARTS:
                index.compact()
        index.similarity = self.similarity
        labels = None
        if index.made["n"]:
            labels = graph.leiden(graph.symmetric(index.edges()), index.rows().select("id")).withColumnRenamed("community", "community_id")
        stats = {**{k: counts.get(k, 0) for k in ("new", "changed", "deleted")}, **{k: v for k, v in incremental.run_counts(probed, "source_path", "content_hash", "hit").first().asDict().items() if k != "files"}}
        self.commit(changes, index, lexical, labels)
        for df in (state, found, probed, missed, stale):
            df.unpersist()
        return stats

    def gc_cache(self, days: int = 30, now: int | None = None) -> int:
        """Drops cached vectors older than so many days; says how many."""
        old = self.table("cache")
        kept = incremental.expire(old, "created_at", F.lit((now or int(time.time())) - days * 86400))
        gone = old.join(kept.select("content_hash"), "content_hash", "left_anti").select("content_hash").persist()
        many = gone.count()
        if many:
            self.commit({"cache": (None, gone)})
        gone.unpersist()
        return many

    # search

    def candidates(self, query: str, top_k: int, weight: float, prefix: str | None = None, query_prefix: str = "") -> DataFrame:
        """The chunks that a search for k looks at, with score and vector. prefix filters after they are chosen, so fewer than k may be left."""
        lexical_index = self.lexical() if weight > 0 else None
        chunks, index = self.table("chunks"), self.vectors()
        q = self.embedder.embed_batch([query_prefix + query])[0]
        n = retrieval.candidates(top_k)
        if index is None:
            semantic, vectors = self.spark.createDataFrame([], "id string, cos double"), self.table("vectors")
        else:
            if index.lists and index.centroids.shape[1] != len(q):
                raise StorageError(f"the index has vectors of {index.centroids.shape[1]} dimensions, the embedder of {len(q)}: reindex")
            asked = self.spark.createDataFrame([(0, [float(x) for x in q])], "query int, vector array<double>")
            semantic, vectors = index.nearest(asked, n).select("id", F.col("score").alias("cos")), index.rows().select("id", "vector")
        lexical = retrieval.normalized(lexical_index.search(query, n)) if lexical_index is not None else self.spark.createDataFrame([], "id string, bm25 double")
        rows = retrieval.hybrid(semantic, lexical, "id", self.settings.search.min_score, weight).join(chunks, "id")
        if prefix:
            rows = rows.where(F.col("source_path").startswith(prefix))
        return rows.join(vectors, "id", "left")

    def search(self, query: str, top_k: int | None = None, prefix: str | None = None, mmr_lambda: float | None = None, bm25_weight: float | None = None, query_prefix: str = "code: ") -> DataFrame:
        """Chunks with rank and score, best first."""
        return search_workspaces({"": self}, query, top_k, prefix, mmr_lambda, bm25_weight, query_prefix).drop("workspace")

    # notes

    def add_note(self, text: str, tags: list[str] | None = None, now: int | None = None) -> str:
        now = int(time.time()) if now is None else now
        row = self.spark.createDataFrame([(text, tags or [], now, self.embedder.embed_batch([text])[0])], "text string, tags array<string>, timestamp long, vector array<float>")
        row = row.withColumn("id", H.djb2(F.col("text"), F.col("timestamp").cast("string"), F.lit("note")))
        self.commit({"notes": (row, None)})
        return row.first().id

    def find_notes(self, query: str, top_k: int = 5) -> DataFrame:
        """Notes by similarity, without a threshold."""
        q = self.embedder.embed_batch([query])[0]
        s = self.table("notes").withColumn("score", self.similarity(F.col("vector"), V.literal(q)))
        best = retrieval.ranked(s, "score", "id", top_k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "id"))).drop("vector")

    def require(self) -> None:
        if self.version() is None:
            raise NotFound(f"no index at {self.path}")


def search_workspaces(indexes: dict[str, Index], query: str, top_k: int | None = None, prefix: str | None = None, mmr_lambda: float | None = None, bm25_weight: float | None = None, query_prefix: str = "code: ") -> DataFrame:
    """Chunks of several indexes (by workspace) with rank and score, best first: candidates of all are pooled and selected from together."""
    some = next(iter(indexes.values()))
    s = some.settings.search
    k, lam, weight = (own if given is None else given for given, own in ((top_k, s.top_k), (mmr_lambda, s.mmr_lambda), (bm25_weight, s.bm25_weight)))
    rows = None
    for name, index in indexes.items():
        own = index.candidates(query, k, weight, prefix, query_prefix).withColumn("workspace", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.withColumn("key", F.concat_ws("\n", "workspace", "id")).persist()
    if rows.isEmpty():
        ranked = some.spark.createDataFrame([], "key string, score double, mmr double, rank int")
    else:
        ranked = retrieval.mmr(rows, k, lam, "key", vector_col="vector")
    return ranked.join(rows.drop("score", "vector"), "key").drop("key").withColumn("kind", T.kind_shown(F.col("kind"))).orderBy("rank")
