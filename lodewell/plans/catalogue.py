"""Queries over the engine's operators, with their DuckDB equivalents.

Sources are the documents, embeddings, conversations, events and pages tables, read as chunks,
vectors, notes, cache entries and paths. Floats are rounded to six digits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import formatting
from ..functions import hashing as H
from ..functions import text as T
from ..functions import vectors as V
from ..operators import balance, chunking, graph, incremental, proximity, retrieval
from ..sources import scan
from ..sources.communities import CommunityStore
from ..sources.lexical import LexicalIndex, spread
from ..sources.scratch import scratch_dir
from ..sources.tables import KeyedTable
from ..sources.vectors import VectorIndex

QUERIES: dict = {}
_indexes: dict[tuple[str, str], str] = {}  # stored indexes of an application, by what they are of
ORACLE_SQL: dict[str, str] = {}
WEIGHT, MIN_SCORE, TOP, LAMBDA = 0.5, 0.2, 5, 0.8
N = retrieval.candidates(TOP)


def query(f):
    QUERIES[f.__name__] = f
    return f


def sql(name: str, text: str) -> None:
    ORACLE_SQL[name] = text


def read(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def six(c: str | Column) -> Column:
    return F.round(c, 6) + 0.0


def query_vector(vectors: DataFrame) -> list[float]:
    return [float(x) for x in vectors.where("vec_id = 0").select("embedding").first()[0]]


# vectors

Q0 = "(select embedding from embeddings where vec_id = 0)"


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"


def norm_sql(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: x::double * x::double)))"


def six_sql(x: str) -> str:
    return f"round({x}, 6) + 0.0"


@query
def vector_topk(spark, at):
    v = read(spark, at, "embeddings")
    return proximity.batch_topk(fiftieth(spark, at), v, 10).withColumn("score", six("score"))


sql("vector_topk", f"""select q.vec_id as query, v.vec_id, {six_sql(dot_sql('q.embedding', 'v.embedding'))} as score, row_number() over (partition by q.vec_id order by round({dot_sql('q.embedding', 'v.embedding')}, 9) desc, v.vec_id)::int as rank
from embeddings q, embeddings v where q.vec_id % 50 = 0 qualify rank <= 10""")


@query
def dot_scores(spark, at):
    v = read(spark, at, "embeddings")
    return v.select("vec_id", six(V.dot(F.col("embedding"), V.literal(query_vector(v)))).alias("score"))


sql("dot_scores", f"select vec_id, {six_sql(dot_sql('embedding', Q0))} as score from embeddings")


@query
def cosine_scores(spark, at):
    v = read(spark, at, "embeddings")
    return v.select("vec_id", six(V.cosine(F.col("embedding"), V.literal(query_vector(v)))).alias("score"))


sql("cosine_scores", f"select vec_id, {six_sql(f'{dot_sql("embedding", Q0)} / ({norm_sql("embedding")} * {norm_sql(Q0)})')} as score from embeddings")


@query
def l2_normalize(spark, at):
    big = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    v = read(spark, at, "embeddings").withColumn("big", big)
    return v.select("vec_id", six(V.norm(F.col("big"))).alias("norm"), six(V.norm(V.l2_normalize(F.col("big")))).alias("unit_norm"), six(F.element_at(V.l2_normalize(F.col("big")), 1)).alias("first"))


sql("l2_normalize", f"""with b as (select vec_id, list_transform(embedding, lambda x: x::double * (label + 1)) big from embeddings), n as (select *, {norm_sql("big")} n from b)
select vec_id, {six_sql("n")} as norm, {six_sql("sqrt(list_sum(list_transform(big, lambda x: (x / n) * (x / n))))")} as unit_norm, {six_sql("big[1] / n")} as first from n""")


@query
def mean_pool(spark, at):
    pooled = V.mean_pool(read(spark, at, "embeddings"), "label", "embedding", F.col("vec_id") % 3 != 0)
    return pooled.select("label", F.col("dim").cast("int").alias("dim"), six("value").alias("value"))


sql("mean_pool", f"select label, (i - 1)::int as dim, {six_sql('avg(x::double)')} as value from (select label, unnest(embedding) x, unnest(range(1, 65)) i from embeddings where vec_id % 3 <> 0) group by all")


@query
def f16_roundtrip(spark, at):
    v = read(spark, at, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    return v.select("vec_id", F.col("dim").cast("int").alias("dim"), F.col("x").cast("double").alias("value"), V.f16(F.col("x")).alias("half"))


sql("f16_roundtrip", """with e as (select vec_id, unnest(embedding)::double x, unnest(range(0, 64))::int as dim from embeddings),
s as (select *, pow(2.0, greatest(floor(log2(abs(nullif(x, 0)))), -14.0) - 10) step from e)
select vec_id, dim, x as value, case when x = 0 then 0.0 else round_even(x / step, 0) * step end as half from s""")

# graph

KNN = f"""k as (select a.vec_id src, b.vec_id dst, {dot_sql("a.embedding", "b.embedding")} sim from embeddings a, embeddings b where a.vec_id <> b.vec_id
  qualify row_number() over (partition by a.vec_id order by round(sim, 9) desc, b.vec_id) <= 32),
s as (select least(src, dst) src, greatest(src, dst) dst, greatest(max(sim), 0.0) sim from k group by all)"""
BOTH = "w as (select src, dst, sim from s union all select dst, src, sim from s)"


def edges(spark, at) -> DataFrame:
    return graph.symmetric(graph.knn(read(spark, at, "embeddings")))


def labels(spark, at) -> DataFrame:
    return read(spark, at, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("community"))


@query
def knn_graph(spark, at):
    return graph.knn(read(spark, at, "embeddings")).select("src", "dst", six("sim").alias("sim"), "rank")


sql("knn_graph", f"with {KNN} select src, dst, {six_sql('sim')} as sim, row_number() over (partition by src order by round(sim, 9) desc, dst)::int as rank from k")


@query
def knn_graph_symmetric(spark, at):
    return edges(spark, at).withColumn("sim", six("sim"))


sql("knn_graph_symmetric", f"with {KNN} select src, dst, {six_sql('sim')} as sim from s")


@query
def knn_descent(spark, at):
    """The neighbour graph without comparing all with all: its recall against knn_graph is tested."""
    return proximity.descent(read(spark, at, "embeddings"), 32).select("src", "dst", six("sim").alias("sim"), F.col("rank").cast("int").alias("rank"))


@query
def graph_contract(spark, at):
    return graph.contract(edges(spark, at), labels(spark, at)).withColumn("weight", six("weight"))


sql("graph_contract", f"with {KNN} select least(x.label, y.label) as a, greatest(x.label, y.label) as b, {six_sql('2 * sum(sim)')} as weight from s join embeddings x on s.src = x.vec_id join embeddings y on s.dst = y.vec_id where x.label <> y.label group by 1, 2")


@query
def community_sizes(spark, at):
    return graph.sizes(labels(spark, at))


sql("community_sizes", "select label as community, count(*) as n from embeddings group by 1")


@query
def local_move_gain(spark, at):
    return graph.move_gain(edges(spark, at), labels(spark, at)).withColumn("gain", six("gain"))


sql("local_move_gain", f"""with {KNN}, {BOTH}, n as (select label c, count(*) n from embeddings group by 1),
p as (select w.src id, e.label c, sum(sim) w from w join embeddings e on w.dst = e.vec_id group by all),
g as (select e.vec_id id, e.label own, p.c, p.w - 0.05 * n.n gain0, coalesce(max(case when p.c = e.label then p.w end) over (partition by e.vec_id), 0) - 0.05 * (o.n - 1) stay
  from embeddings e join n o on e.label = o.c left join p on p.id = e.vec_id left join n on n.c = p.c),
h as (select id, own, c, case when c <> own then gain0 - stay end gain from g)
select id, own, case when gain is not null then c end as best, {six_sql("gain")} as gain from h qualify row_number() over (partition by id order by round(gain, 9) desc nulls last, c) = 1""")


@query
def cpm_quality(spark, at):
    return graph.cpm_quality(edges(spark, at), labels(spark, at)).select(six("quality").alias("quality"))


sql("cpm_quality", f"with {KNN} select {six_sql('(select coalesce(sum(sim), 0) from s join embeddings x on s.src = x.vec_id join embeddings y on s.dst = y.vec_id where x.label = y.label) - 0.05 * (select sum(n * (n - 1) / 2) from (select count(*) n from embeddings group by label))')} as quality")


@query
def dense_relabel(spark, at):
    return graph.dense_relabel(labels(spark, at))


sql("dense_relabel", "with f as (select label, row_number() over (order by min(vec_id)) - 1 d from embeddings group by 1) select vec_id as id, d as community from embeddings join f using (label)")


@query
def leiden(spark, at):
    return graph.leiden(edges(spark, at), read(spark, at, "embeddings").select(F.col("vec_id").alias("id")))


def vector_index(spark, at) -> VectorIndex:
    """The stored index of the embeddings, built by an application's first query that needs it."""
    key = (spark.sparkContext.applicationId, f"{at}#vectors")
    if key not in _indexes:
        path = f"{scratch_dir(spark)}/vectors-{len(_indexes)}"
        VectorIndex.build(read(spark, at, "embeddings"), "vec_id", "embedding", path)
        _indexes[key] = path
    return VectorIndex(spark, _indexes[key])


def fiftieth(spark, at) -> DataFrame:
    """The queries of searches: every vector whose id is divisible by 50."""
    return read(spark, at, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding")


@query
def ann_topk(spark, at):
    """By the proximity graph."""
    got = vector_index(spark, at).search_batch(fiftieth(spark, at), 10, vector_col="embedding")
    return got.select("query", F.col("id").alias("vec_id"), six("score").alias("score"), "rank")


@query
def index_remove_remap(spark, at):
    return incremental.reindex_positions(read(spark, at, "embeddings").where("vec_id % 5 <> 0").select("vec_id"), "vec_id")


sql("index_remove_remap", "select vec_id, row_number() over (order by vec_id) - 1 as idx from embeddings where vec_id % 5 <> 0")


@query
def community_bundles(spark, at):
    b = graph.bundles(read(spark, at, "embeddings"), "label")
    return b.select("community", "n", F.posexplode("bundle").alias("dim", "x")).select("community", "n", F.col("dim").cast("int").alias("dim"), six("x").alias("value"))


BUNDLE = "d as (select label, unnest(embedding)::double x, unnest(range(0, 64))::int dim from embeddings), u as (select label, dim, sum(x) s, count(*) n from d group by all), b as (select label, dim, n, s / sqrt(sum(s * s) over (partition by label)) v from u)"
sql("community_bundles", f"with {BUNDLE} select label as community, n, dim, {six_sql('v')} as value from b")


@query
def bundle_routing_topk(spark, at):
    v = read(spark, at, "embeddings")
    return graph.routed_topk(v, query_vector(v), 10, 3, "label").withColumn("score", six("score"))


sql("bundle_routing_topk", f"""with {BUNDLE}, r as (select b.label, sum(b.v * q.x) s from b join (select unnest({Q0})::double x, unnest(range(0, 64))::int dim) q using (dim) group by 1 order by round(s, 9) desc, label limit 3)
select vec_id, {six_sql("s")} as score from (select vec_id, {dot_sql("embedding", Q0)} s from embeddings where label in (select label from r)) order by round(s, 9) desc, vec_id limit 10""")


@query
def zero_shot_labels(spark, at):
    """Each community's nearest term: the first vector of each label stands for a term's."""
    v = read(spark, at, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    terms = first.select(F.concat(F.lit("term"), F.col("label").cast("string")).alias("label"), "vector")
    return graph.labelled(graph.bundles(v, "label"), terms).withColumn("score", six("score"))


sql("zero_shot_labels", f"""with {BUNDLE}, t as (select 'term' || label as name, unnest(arg_min(embedding, vec_id))::double x, unnest(range(0, 64))::int dim from embeddings group by label),
s as (select b.label community, t.name, sum(b.v * t.x) s from b join t using (dim) group by all)
select community, name as label, {six_sql("s")} as score from s qualify row_number() over (partition by community order by round(s, 9) desc, name) = 1""")


@query
def workspace_keys(spark, at):
    return read(spark, at, "documents").select("doc_id", H.path_key(F.concat(F.lit("/home/"), F.col("source"), F.lit("/"), F.col("lang"))).alias("key"))


@query
def community_hubs(spark, at):
    return graph.hubs(edges(spark, at), labels(spark, at))


sql("community_hubs", f"with {KNN}, {BOTH} select x.label as community, w.src as hub, count(*) as degree from w join embeddings x on w.src = x.vec_id join embeddings y on w.dst = y.vec_id where x.label = y.label group by 1, 2 qualify row_number() over (partition by x.label order by count(*) desc, w.src) = 1")


@query
def shard_rebalance(spark, at):
    return graph.rebalance(labels(spark, at), 64 * 12)


sql("shard_rebalance", "select label as community, count(*) as n, case when count(*) > 64 * 12 / 4.0 then 'split' when count(*) < 10 then 'merge' else 'keep' end as action from embeddings group by 1")


@query
def communities_rebalanced(spark, at):
    """Labels as communities, split and joined until none is out of bounds: how many vectors there are, and how many are in communities that are."""
    v = read(spark, at, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.col("label").cast("long").alias("community"))
    least, most = balance.bounds(64, 1.5)
    sizes = graph.sizes(balance.rebalanced(v, least, most))
    return sizes.agg(F.sum("n").alias("vectors"), F.sum(F.when(F.col("n").between(least, most), 0).otherwise(F.col("n"))).alias("out_of_bounds"))


sql("communities_rebalanced", "select count(*) as vectors, 0::bigint as out_of_bounds from embeddings")


@query
def adaptive_gamma(spark, at):
    return graph.adaptive_gamma(edges(spark, at)).select(six("gamma").alias("gamma"))


sql("adaptive_gamma", f"with {KNN} select {six_sql('0.8 * avg(sim)')} as gamma from s")

# lexical retrieval

TOK = "regexp_extract_all(lower(strip_accents({})), '[\\p{{L}}\\p{{N}}]+')"
DOC = f"d as (select doc_id, {TOK.format('source')} a, {TOK.format('text')} b, len(a) + len(b) l from documents)"


def bm25_sql(terms: list[str], n: int | None = N, name: str = "h") -> str:
    """CTEs d and then name(doc_id, bm25) for single words."""
    tf = ", ".join(f"len(list_filter(list_concat(a, b), lambda t: t = '{t}')) f{i}" for i, t in enumerate(terms))
    score = " + ".join(f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / av))" for i in range(len(terms)))
    return f"""{DOC}, f{name} as (select doc_id, l, {tf} from d),
g{name} as (select count(*)::double n, avg(l) av, {", ".join(f"count(*) filter (f{i} > 0)::double n{i}" for i in range(len(terms)))} from f{name}),
{name} as (select doc_id, {score} bm25 from f{name}, g{name} where {" and ".join(f"f{i} > 0" for i in range(len(terms)))} order by round(bm25, 9) desc, doc_id{f" limit {n}" if n else ""})"""


def lexical_index(spark, at) -> LexicalIndex:
    """The stored index of the documents' sources and texts: built by the first query of an application that needs it, read by the others."""
    key = (spark.sparkContext.applicationId, at)
    if key not in _indexes:
        path = f"{scratch_dir(spark)}/lexical-{len(_indexes)}"
        LexicalIndex.build(read(spark, at, "documents"), "doc_id", ["source", "text"], path)
        _indexes[key] = path
    return LexicalIndex(spark, _indexes[key])


def lexical(spark, at, words: str, n: int | None) -> DataFrame:
    return lexical_index(spark, at).search(words, n, "doc_id")


@query
def postings(spark, at):
    return lexical_index(spark, at).postings()


sql("postings", f"with {DOC} select term, doc_id as doc, count(*) as tf from (select doc_id, unnest(list_concat(a, b)) term from d) group by all")


@query
def bm25_scan(spark, at):
    """Without an index: two scans of the corpus."""
    return retrieval.bm25(read(spark, at, "documents"), "doc_id", ["source", "text"], "und von", 40).withColumn("bm25", six("bm25"))


sql("bm25_scan", f"with {bm25_sql(['und', 'von'], 40)} select doc_id, {six_sql('bm25')} as bm25 from h")


@query
def bm25_and(spark, at):
    return lexical(spark, at, "und von", 40).withColumn("bm25", six("bm25"))


sql("bm25_and", f"with {bm25_sql(['und', 'von'], 40)} select doc_id, {six_sql('bm25')} as bm25 from h")


@query
def bm25_common_term(spark, at):
    return lexical(spark, at, "the", 40).select("doc_id", (F.round("bm25", 12) + 0.0).alias("bm25"))


sql("bm25_common_term", f"with {bm25_sql(['the'], 40)} select doc_id, round(bm25, 12) + 0.0 as bm25 from h")


@query
def bm25_normalized(spark, at):
    return retrieval.normalized(lexical(spark, at, "und von", 40)).withColumn("bm25", six("bm25"))


sql("bm25_normalized", f"with {bm25_sql(['und', 'von'], 40)} select doc_id, {six_sql('bm25 / max(bm25) over ()')} as bm25 from h")


@query
def bm25_phrase(spark, at):
    return lexical(spark, at, "of_the", 40).withColumn("bm25", six("bm25"))


sql("bm25_phrase", f"""with {DOC}, f as (select doc_id, l, len(list_filter(list_zip(a, a[2:]), lambda z: z[1] = 'of' and z[2] = 'the')) + len(list_filter(list_zip(b, b[2:]), lambda z: z[1] = 'of' and z[2] = 'the')) f from d),
g as (select count(*)::double n, avg(l) av, count(*) filter (f > 0)::double k from f)
select doc_id, {six_sql("s")} as bm25 from (select doc_id, greatest(ln((n - k + 0.5) / (k + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / av)) s from f, g where f > 0 order by round(s, 9) desc, doc_id limit 40)""")

# hybrid retrieval


def parts(spark, at) -> tuple[DataFrame, DataFrame]:
    """The best N of either kind: (doc_id, cos), (doc_id, bm25)."""
    v = read(spark, at, "embeddings").withColumnRenamed("vec_id", "doc_id")
    q = [float(x) for x in v.where("doc_id = 0").select("embedding").first()[0]]
    return retrieval.vector_topk(v, q, N, "doc_id", "embedding", "cos"), retrieval.normalized(lexical(spark, at, "und von", N))


def merged(spark, at) -> DataFrame:
    return retrieval.hybrid(*parts(spark, at), "doc_id", MIN_SCORE, WEIGHT)


HYB = f"""{bm25_sql(["und", "von"], N, "h0")}, h as (select doc_id, bm25 / max(bm25) over () bm25 from h0),
c0 as (select vec_id doc_id, {dot_sql("embedding", Q0)} cos from embeddings), c as (select * from c0 order by round(cos, 9) desc, doc_id limit {N}),
m as (select doc_id, coalesce(c.cos, 0.0) cos, coalesce(h.bm25, 0.0) bm25, {WEIGHT} * coalesce(h.bm25, 0.0) + {1 - WEIGHT} * coalesce(c.cos, 0.0) score from c full join h using (doc_id) where c.cos >= {MIN_SCORE} or h.bm25 is not null)"""


@query
def candidate_union(spark, at):
    a, b = parts(spark, at)
    return a.select("doc_id").union(b.select("doc_id")).distinct()


sql("candidate_union", f"with {HYB} select doc_id from c union select doc_id from h")


@query
def hits_intersect(spark, at):
    a, b = parts(spark, at)
    return a.select("doc_id").intersect(b.select("doc_id"))


sql("hits_intersect", f"with {HYB} select doc_id from c intersect select doc_id from h")


@query
def threshold_bypass(spark, at):
    return merged(spark, at).select("doc_id", six("cos").alias("cos"), six("bm25").alias("bm25"))


sql("threshold_bypass", f"with {HYB} select doc_id, {six_sql('cos')} as cos, {six_sql('bm25')} as bm25 from m")


@query
def hybrid_search(spark, at):
    docs = read(spark, at, "documents").select("doc_id", "lang", "source")
    return retrieval.ranked(merged(spark, at).join(docs, "doc_id"), "score", "doc_id", TOP).select("doc_id", "lang", "source", six("cos").alias("cos"), six("bm25").alias("bm25"), six("score").alias("score"))


sql("hybrid_search", f"with {HYB} select doc_id, lang, source, {six_sql('cos')} as cos, {six_sql('bm25')} as bm25, {six_sql('score')} as score from m join documents using (doc_id) order by round(m.score, 9) desc, doc_id limit {TOP}")


@query
def prefix_postfilter(spark, at):
    docs = read(spark, at, "documents").select("doc_id", "source")
    return merged(spark, at).join(docs, "doc_id").where(F.col("source").startswith("src1")).select("doc_id", "source", six("score").alias("score"))


sql("prefix_postfilter", f"with {HYB} select doc_id, source, {six_sql('score')} as score from m join documents using (doc_id) where starts_with(source, 'src1')")


@query
def hybrid_search_filtered(spark, at):
    docs = read(spark, at, "documents").select("doc_id", "source")
    found = merged(spark, at).join(docs, "doc_id").where(F.col("source").startswith("src1"))
    return retrieval.ranked(found, "score", "doc_id", TOP).select("doc_id", "source", six("score").alias("score"))


sql("hybrid_search_filtered", f"with {HYB} select doc_id, source, {six_sql('score')} as score from m join documents using (doc_id) where starts_with(source, 'src1') order by round(m.score, 9) desc, doc_id limit {TOP}")


def mmr_sql(k: int) -> str:
    out = f"{HYB}, v as (select m.doc_id, m.score rel, coalesce(e.embedding, list_transform(range(64), lambda i: 0.0::float)) v from m left join embeddings e on e.vec_id = m.doc_id),\ns1 as (select doc_id, v, rel, rel mmr, 1 rank from v order by round(rel, 9) desc, doc_id limit 1)"
    for i in range(2, k + 1):
        near = f"max({dot_sql('v.v', 's.v')})"
        out += f""",
s{i} as (select * from s{i - 1} union all (select v.doc_id, any_value(v.v), any_value(v.rel), {LAMBDA} * any_value(v.rel) - {round(1 - LAMBDA, 9)} * {near} mmr, {i} from v, s{i - 1} s where v.doc_id not in (select doc_id from s{i - 1})
  group by v.doc_id order by round({LAMBDA} * any_value(v.rel) - {round(1 - LAMBDA, 9)} * {near}, 9) desc, v.doc_id limit 1))"""
    return out


@query
def mmr_rerank(spark, at):
    v = read(spark, at, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    got = retrieval.mmr(merged(spark, at).join(v, "doc_id", "left"), TOP, LAMBDA, "doc_id")
    return got.select("doc_id", six("score").alias("score"), six("mmr").alias("mmr"), "rank")


sql("mmr_rerank", f"with {mmr_sql(TOP)} select doc_id, {six_sql('rel')} as score, {six_sql('mmr')} as mmr, rank::int as rank from s{TOP}")


def shown(spark, at) -> DataFrame:
    docs = read(spark, at, "documents").select("doc_id", F.col("lang").alias("kind"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("source_path"), F.col("text").alias("source"))
    own = read(spark, at, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("community_id"))
    best = retrieval.ranked(merged(spark, at).select("doc_id", "score"), "score", "doc_id", 2 * TOP)
    best = best.withColumn("rank", F.row_number().over(retrieval.Window.orderBy(F.round("score", 9).desc(), "doc_id")))
    return best.join(docs, "doc_id").join(own, "doc_id", "left")


SHOWN = f"{HYB}, t as (select doc_id, score, row_number() over (order by round(score, 9) desc, doc_id) rank from m order by rank limit {2 * TOP}), r as (select t.*, d.lang kind, 'doc' || doc_id::varchar as name, d.source source_path, d.text source, e.label community_id from t join documents d using (doc_id) left join embeddings e on e.vec_id = t.doc_id), g as (select *, min(rank) over (partition by community_id) seen from r)"


@query
def group_by_community(spark, at):
    return formatting.by_community(shown(spark, at)).select("doc_id", F.coalesce("community_id", F.lit(-1)).alias("community_id"), F.col("seen").cast("int").alias("seen"), F.col("rank").cast("int").alias("rank"))


sql("group_by_community", f"with {SHOWN} select doc_id, coalesce(community_id, -1)::bigint as community_id, seen::int as seen, rank::int as rank from g")


@query
def format_results(spark, at):
    return formatting.grouped(shown(spark, at))


sql("format_results", f"""with {SHOWN} select rtrim(string_agg(case when rank = seen and community_id is not null then '── Community ' || community_id || ' ──' || chr(10) else '' end || printf('[%.2f] %s `%s` — %s', score, kind, name, source_path) || chr(10) || left(source, 300) || chr(10) || chr(10), '' order by seen, rank), chr(10) || ' ') as text from g""")


@query
def format_flat(spark, at):
    return formatting.flat(shown(spark, at))


sql("format_flat", f"""with {SHOWN} select '{formatting.FLAT_BANNER}' || chr(10) || chr(10) || rtrim(string_agg(printf('--- %s `%s` in %s (Relevance: %.2f) ---', kind, name, source_path, score) || chr(10) || source || chr(10) || chr(10), '' order by rank), chr(10) || ' ') as text from g""")

# notes


@query
def notes_topk(spark, at):
    v = read(spark, at, "embeddings")
    return retrieval.vector_topk(v, query_vector(v), TOP).withColumn("score", six("score"))


sql("notes_topk", f"select vec_id, {six_sql('s')} as score from (select vec_id, {dot_sql('embedding', Q0)} s from embeddings) order by round(s, 9) desc, vec_id limit {TOP}")


@query
def notes_scan(spark, at):
    c = read(spark, at, "conversations")
    stored = c.select("conv_id", "turn", "text", F.when(F.col("turn") % 5 == 4, F.lit("[broken")).otherwise(F.to_json(F.array("role"))).alias("tags"), F.when(F.col("turn") % 7 == 6, F.lit("x")).otherwise((F.col("conv_id") * 100 + F.col("turn")).cast("string")).alias("stamp"))
    return incremental.stored_notes(stored, "tags", "stamp").select("conv_id", "turn", "text", F.array_join("tags", ", ").alias("tags"), F.col("stamp").alias("timestamp"))


sql("notes_scan", "select conv_id, turn, text, case when turn % 5 = 4 then '' else role end as tags, case when turn % 7 = 6 then 0 else conv_id * 100 + turn end as timestamp from conversations")

# scalar functions

BYTES = "list_transform(regexp_extract_all(hex({0}), '..'), lambda x: ('0x' || x)::int::hugeint)"


def hash_sql(text: str, seed: int, step: str) -> str:
    folded = f"list_reduce({BYTES.format(f'encode({text})')}, lambda h, b: {step}, {seed}::hugeint)"
    return f"lpad(lower(hex(({folded})::ubigint)), 16, '0')"


@query
def fnv1a_hash(spark, at):
    return spread(read(spark, at, "documents").select("doc_id", "text")).select("doc_id", H.fnv1a(F.col("text")).alias("hash"))


sql("fnv1a_hash", f"select doc_id, {hash_sql('text', 0xCBF29CE484222325, 'xor(h, b) * 1099511628211::hugeint % 18446744073709551616::hugeint')} as hash from documents")


sql("workspace_keys", f"select doc_id, {hash_sql("('/home/' || source || '/' || lang)", 5381, '(h * 33 + b) % 18446744073709551616::hugeint')} as key from documents")


def first_word() -> Column:
    return F.regexp_extract("text", r"^\S+", 0)


@query
def djb2_chunk_id(spark, at):
    return read(spark, at, "documents").select("doc_id", H.chunk_id(F.col("source"), first_word(), F.col("lang")).alias("id"))


sql("djb2_chunk_id", f"select doc_id, {hash_sql('(source || regexp_extract(text, $$^[^ \\t\\n\\f\\r]+$$) || lang)', 5381, '(h * 33 + b) % 18446744073709551616::hugeint')} as id from documents")


@query
def sanitize_query(spark, at):
    return spread(read(spark, at, "documents").select("doc_id", "text")).select("doc_id", T.sanitize_query(F.col("text")).alias("query"))


sql("sanitize_query", r"""select doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: x <> ''), lambda x: '"' || x || '"'), ' ') as query from documents""")


@query
def embed_input(spark, at):
    d = read(spark, at, "documents")
    return d.select("doc_id", F.md5(T.embed_input(T.kind_shown(F.lit("type_decl")), first_word(), F.col("source"), F.col("text")).cast("binary")).alias("md5"))


sql("embed_input", r"select doc_id, md5('type ' || regexp_extract(text, '^[^ \t\n\f\r]+') || ' in ' || source || chr(10) || chr(10) || text) as md5 from documents")


@query
def embed_text_cap(spark, at):
    cut = T.embed_text(F.col("text"))
    return read(spark, at, "documents").select("doc_id", F.octet_length(cut).alias("n_bytes"), F.md5(cut.cast("binary")).alias("md5"))


sql("embed_text_cap", """with p as (select doc_id, text, list_max(list_filter(range(greatest(least(length(text), 2000) - 1500, 0), least(length(text), 2000) + 1), lambda i: strlen(left(text, i)) <= 2000)) n from documents)
select doc_id, strlen(left(text, n))::int as n_bytes, md5(left(text, n)) as md5 from p""")


@query
def preview(spark, at):
    return read(spark, at, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


sql("preview", "select doc_id, left(text, 300) as preview from documents")
TAGS = [*T.KINDS, *T.LEGACY, "unheard_of"]
#: Stored kinds of TAGS, and how they are shown, written by hand.
STORED = [
    ("function", "function"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("impl", "impl"), ("class", "class"), ("method", "method"), ("type_decl", "type"), ("block_mapping", "mapping"), ("expression", "expression"), ("section", "section"),
    ("function", "function"), ("function", "function"), ("function", "function"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("impl", "impl"), ("class", "class"), ("method", "method"), ("type_decl", "type"), ("type_decl", "type"), ("block_mapping", "mapping"), ("expression", "expression"),
    ("function", "function"),
]


@query
def kind_normalize(spark, at):
    """Every tag there is, and an unknown one, by turns."""
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (F.col("doc_id") % len(TAGS) + 1).cast("int"))
    return read(spark, at, "documents").select("doc_id", tag.alias("tag")).select("doc_id", "tag", T.kind_from_tag(F.col("tag")).alias("kind")).withColumn("shown", T.kind_shown(F.col("kind")))


sql("kind_normalize", "select doc_id, tag, kind, shown from documents join (values " + ", ".join(f"({i}, '{t}', '{k}', '{s}')" for i, (t, (k, s)) in enumerate(zip(TAGS, STORED, strict=True))) + f") t(i, tag, kind, shown) on doc_id % {len(TAGS)} = i")


@query
def json_extract(spark, at):
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(5))
    return read(spark, at, "events").select("event_id", k.alias("k"))


sql("json_extract", "select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 5) as k from events")

# chunking


@query
def markdown_sections(spark, at):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("## "), x)).otherwise(x))
    d = spread(read(spark, at, "documents").select("doc_id", "text")).select("doc_id", F.array_join(lines, "\n").alias("md"))
    s = chunking.markdown_sections(d, "doc_id", "md")
    return s.select("doc_id", F.col("ord").cast("int").alias("ord"), F.md5(F.col("name").cast("binary")).alias("name"), F.md5(F.col("source").cast("binary")).alias("source"), F.md5(F.col("embed_text").cast("binary")).alias("embed_text"))


sql("markdown_sections", r"""with l as (select doc_id, unnest(a) line, unnest(range(len(a))) pos, len(a) n from (select doc_id, string_split(text, chr(10)) a from documents)),
x as (select doc_id, pos, case when pos % 3 = 1 then '## ' || line else line end line, n from l), y as (select * from x where not (pos = n - 1 and line = '')),
h as (select *, case when starts_with(line, '#') and trim(ltrim(line, '#')) <> '' then trim(ltrim(line, '#')) end head from y),
o as (select *, count(head) over (partition by doc_id order by pos) ord from h),
s as (select doc_id, ord, coalesce(max(head), '(preamble)') name, string_agg(line, chr(10) order by pos) source from o group by all), e as (select *, regexp_replace(source, '^\s+|\s+$', '', 'g') embed_text from s)
select doc_id, ord::int as ord, md5(name) as name, md5(source) as source, md5(embed_text) as embed_text from e where embed_text <> ''""")
#: Files by kind; @ stands for a document's id, $ for its source.
SOURCES = {
    "a/lib@.rs": "pub struct P@ { x: u8 }\nimpl P@ {\n    fn new() -> Self { P@ { x: 1 } }\n}\nimpl Clone for P@ { fn clone(&self) -> P@ { P@ { x: 0 } } }\n",
    "a/m@.py": "class A@:\n    def f(self):\n        def g():\n            return '$'\n        return g\n\n\ndef h@():\n    pass\n",
    "a/m@.go": "package m\n\ntype (\n\tA@ struct{ x int }\n\tB@ int\n)\n\nfunc (a A@) F() int { return a.x }\n\nfunc G@() {}\n",
    "a/c@.yaml": "a@:\n  b: 1\n  c:\n    d: $\ne: 2\n",
    "a/@/BUILD": 'load(":x.bzl", "y")\nrule(name = "$")\nrule(name = "q@")\n\ndef m@():\n    pass\n',
    "a/r@.md": "intro\n# One @\ntext\n```\n# in a fence\n```\n#tag\n",
    "a/x@.ts": "export const x = @;\n",
}


@query
def chunk_files(spark, at):
    """A file of source code for each document, whose kind and names go by its id and source."""
    d = read(spark, at, "documents").select(F.col("doc_id").cast("string").alias("i"), "source", (F.col("doc_id") % len(SOURCES) + 1).cast("int").alias("n"))
    of = lambda all_: F.replace(F.replace(F.element_at(F.array(*map(F.lit, all_)), F.col("n")), F.lit("@"), F.col("i")), F.lit("$"), F.col("source"))
    return chunking.chunk_files(spread(d.select(of(SOURCES).alias("source_path"), of(SOURCES.values()).alias("text"))))


#: What a parser finds in SOURCES, written by hand: path, kind, name and where in the text each chunk begins and ends.
CHUNKS = [
    ("a/lib@.rs", "struct", "P@", "pub struct P@ { x: u8 }"),
    ("a/lib@.rs", "impl", "(anonymous)", "impl P@ {\n    fn new() -> Self { P@ { x: 1 } }\n}"),
    ("a/lib@.rs", "function", "new", "fn new() -> Self { P@ { x: 1 } }"),
    ("a/lib@.rs", "impl", "(anonymous)", "impl Clone for P@ { fn clone(&self) -> P@ { P@ { x: 0 } } }"),
    ("a/lib@.rs", "function", "clone", "fn clone(&self) -> P@ { P@ { x: 0 } }"),
    ("a/m@.py", "class", "A@", "class A@:\n    def f(self):\n        def g():\n            return '$'\n        return g"),
    ("a/m@.py", "function", "f", "def f(self):\n        def g():\n            return '$'\n        return g"),
    ("a/m@.py", "function", "g", "def g():\n            return '$'"),
    ("a/m@.py", "function", "h@", "def h@():\n    pass"),
    ("a/m@.go", "type_decl", "A@", "type (\n\tA@ struct{ x int }\n\tB@ int\n)"),
    ("a/m@.go", "type_decl", "B@", "type (\n\tA@ struct{ x int }\n\tB@ int\n)"),
    ("a/m@.go", "method", "F", "func (a A@) F() int { return a.x }"),
    ("a/m@.go", "function", "G@", "func G@() {}"),
    ("a/c@.yaml", "block_mapping", "a@", "a@:\n  b: 1\n  c:\n    d: $"),
    ("a/c@.yaml", "block_mapping", "b", "b: 1"),
    ("a/c@.yaml", "block_mapping", "c", "c:\n    d: $"),
    ("a/c@.yaml", "block_mapping", "d", "d: $"),
    ("a/c@.yaml", "block_mapping", "e", "e: 2"),
    ("a/@/BUILD", "expression", "load", 'load(":x.bzl", "y")'),
    ("a/@/BUILD", "expression", "rule", 'rule(name = "$")'),
    ("a/@/BUILD", "expression", "rule", 'rule(name = "q@")'),
    ("a/@/BUILD", "function", "m@", "def m@():\n    pass"),
    ("a/r@.md", "section", "(preamble)", "intro"),
    ("a/r@.md", "section", "One @", "# One @\ntext\n```"),
    ("a/r@.md", "section", "in a fence", "# in a fence\n```"),
    ("a/r@.md", "section", "tag", "#tag"),
]


def text_sql(x: str) -> str:
    """A string as SQL, control characters by their codes."""
    return "(" + " || ".join(f"'{p}'" if p >= " " else f"chr({ord(p)})" for p in re.split(r"([\n\t])", x.replace("'", "''")) if p) + ")"


sql("chunk_files", "with t as (select * from (values " + ", ".join(f"({i}, {list(SOURCES).index(c[0])}, {', '.join(map(text_sql, c))})" for i, c in enumerate(CHUNKS)) + ") t(i, n, source_path, kind, name, source)), "
    + "f as (select i, doc_id, " + ", ".join(f"replace(replace(t.{c}, '@', doc_id::varchar), '$', d.source) {c}" for c in ("source_path", "kind", "name", "source")) + f" from documents d join t on d.doc_id % {len(SOURCES)} = n) "
    + "select source_path, (row_number() over (partition by source_path order by i) - 1)::int as ord, kind, name, source, source as embed_text from f")


@query
def leiden_groups(spark, at):
    """Documents of eight ids in a row are all tied to one another, and the last of them to the next eight by less than it is worth."""
    d = read(spark, at, "documents").select(F.col("doc_id").alias("src"))
    inner = d.select("src", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("by")).where("src % 8 + by < 8").select("src", (F.col("src") + F.col("by")).alias("dst"), F.lit(1.0).alias("sim"))
    ties = inner.union(d.where("src % 8 = 7").select("src", F.col("src") + 1, F.lit(0.0001)))
    return graph.leiden(ties.join(d.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst", "sim"), d.withColumnRenamed("src", "id"))


sql("leiden_groups", "select doc_id as id, (dense_rank() over (order by doc_id // 8) - 1)::bigint as community from documents")


@query
def scan_filter_paths(spark, at):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    pages = read(spark, at, "pages").select("page_id", F.concat(path, F.element_at(F.array(*map(F.lit, [".md", ".py", ".exe", "/target/a.rs", "/.git/b.py", "/.hidden.md"])), (F.col("page_id") % 6 + 1).cast("int"))).alias("path"))
    return pages.where(scan.folder_allowed(F.col("path")) & scan.extension(F.col("path")).isin("md", "py", "rs"))


sql("scan_filter_paths", r"""with p as (select page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || (['.md', '.py', '.exe', '/target/a.rs', '/.git/b.py', '/.hidden.md'])[page_id % 6 + 1] as path from pages),
f as (select *, string_split(path, '/') s from p)
select page_id, path from f where len(list_filter(s[:-2], lambda x: starts_with(x, '.') or x in ('target', '.git', 'vendor', 'node_modules', 'Library', 'Applications', '.Trash'))) = 0 and regexp_extract(path, '[^/]\.([^./]+)$', 1) in ('md', 'py', 'rs')""")


@query
def filter_max_bytes(spark, at):
    return read(spark, at, "documents").where(scan.within(F.col("n_chars"), 5000)).select("doc_id", "n_chars")


sql("filter_max_bytes", "select doc_id, n_chars from documents where n_chars <= 5000")

# upkeep


def manifests(spark, at) -> tuple[DataFrame, DataFrame]:
    d = read(spark, at, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), "doc_id", F.col("n_chars").alias("size"))
    known = d.where("doc_id % 10 <> 0").select("rel_path", F.lit(1).cast("long").alias("mtime_ns"), "size")
    disk = d.where("doc_id % 11 <> 0").select("rel_path", F.when(F.col("doc_id") % 13 == 0, 2).otherwise(1).cast("long").alias("mtime_ns"), F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return disk, known


MAN = "k as (select doc_id::varchar rel_path, 1 mtime_ns, n_chars size from documents where doc_id % 10 <> 0), f as (select doc_id::varchar rel_path, case when doc_id % 13 = 0 then 2 else 1 end mtime_ns, case when doc_id % 7 = 0 then n_chars + 1 else n_chars end size from documents where doc_id % 11 <> 0)"


@query
def classify_files(spark, at):
    return incremental.classify(*manifests(spark, at))


sql("classify_files", f"with {MAN} select rel_path, case when k.size is null then 'new' when f.size is null then 'deleted' when k.size = f.size and k.mtime_ns = f.mtime_ns then 'unchanged' else 'changed' end as state from k full join f using (rel_path)")


@query
def deleted_files_anti(spark, at):
    disk, known = manifests(spark, at)
    return incremental.deleted(known, disk, "rel_path").select("rel_path")


sql("deleted_files_anti", f"with {MAN} select rel_path from k anti join f using (rel_path)")


@query
def stale_ids(spark, at):
    d = read(spark, at, "documents")
    return incremental.stale(d, d.where("n_chars > 5000").select("source").distinct(), "source").select("doc_id")


sql("stale_ids", "select doc_id from documents where source in (select source from documents where n_chars > 5000)")


@query
def lookup_by_ids(spark, at):
    """Those of a list and those of a table: the documents that are labelled as toxic."""
    d = read(spark, at, "documents").select("doc_id", "lang", "source")
    listed = incremental.lookup(d, [3, 7, 11, 500, 999_999_999, 3], "doc_id").withColumn("by", F.lit("list"))
    return listed.union(incremental.lookup(d, read(spark, at, "labels").where("toxic = 1"), "doc_id").withColumn("by", F.lit("table")))


sql("lookup_by_ids", "select doc_id, lang, source, 'list' as by from documents where doc_id in (3, 7, 11, 500, 999999999) union all select doc_id, lang, source, 'table' from documents where doc_id in (select doc_id from labels where toxic = 1)")


@query
def embed_cache_probe(spark, at):
    d = read(spark, at, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("content_hash"))
    cache = d.where("doc_id % 2 = 0").groupBy("content_hash").agg(F.min("doc_id").alias("value"))
    return incremental.probe(d, cache, "content_hash", "value").withColumn("value", F.coalesce("value", F.lit(-1)))


sql("embed_cache_probe", "with d as (select doc_id, md5(text) as content_hash from documents), c as (select content_hash, min(doc_id) as value from d where doc_id % 2 = 0 group by 1) select doc_id, content_hash, coalesce(value, -1) as value, value is not null as hit from d left join c using (content_hash)")


@query
def upsert_last_wins(spark, at):
    d = read(spark, at, "documents").select("doc_id", F.col("n_chars").alias("value"), F.lit(1).alias("seq"))
    new = d.where("doc_id % 3 = 0").select("doc_id", (F.col("value") + 1000).alias("value"), F.lit(2).alias("seq"))
    more = new.where("doc_id % 6 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "value", "seq")
    return incremental.upsert(d, new.union(more), "doc_id", "seq")


sql("upsert_last_wins", "select doc_id, case when doc_id % 3 = 0 then n_chars + 1000 else n_chars end as value, case when doc_id % 3 = 0 then 2 else 1 end::int as seq from documents union all select doc_id + 1000000, n_chars + 1000, 2 from documents where doc_id % 6 = 0")


@query
def keyed_changes(spark, at):
    """A stored table after insertions, replacements and deletions, read as it is and once its parts are one."""
    d = read(spark, at, "documents").select("doc_id", "source", F.col("n_chars").alias("value"))
    keyed_changes.runs += 1
    t = KeyedTable.create(spark, f"{scratch_dir(spark)}/keyed-{keyed_changes.runs}", "doc_id long, source string, value long", "doc_id")
    t.change(d)
    t.change(d.where("doc_id % 3 = 0").withColumn("value", F.col("value") + 1000), d.where("source = 'src1'").select("doc_id"))  # what is put in stays, though its key is taken out too
    t.change(d.where("doc_id % 7 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000), d.where("source = 'src2'").select("doc_id"))
    before = t.read().withColumn("state", F.lit("parts"))
    t.compact()
    return before.union(t.read().withColumn("state", F.lit("one")))


keyed_changes.runs = 0
sql("keyed_changes", """with a as (select doc_id, source, case when doc_id % 3 = 0 then n_chars + 1000 else n_chars end as value from documents where (doc_id % 3 = 0 or source <> 'src1') and source <> 'src2'
union all select doc_id + 1000000, source, n_chars from documents where doc_id % 7 = 0)
select *, 'parts' as state from a union all select *, 'one' from a""")


@query
def delete_files_anti(spark, at):
    d = read(spark, at, "documents").select("doc_id", "source")
    return incremental.deleted(d, d.where("source in ('src1', 'src2')").select("source").distinct(), "source")


sql("delete_files_anti", "select doc_id, source from documents where source not in ('src1', 'src2')")


@query
def assign_communities(spark, at):
    d = read(spark, at, "documents").select("doc_id", F.lit(None).cast("int").alias("community_id"))
    return incremental.assign(d, read(spark, at, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("community_id")), "doc_id", "community_id").fillna(-1, ["community_id"])


sql("assign_communities", "select doc_id, coalesce(label, -1) as community_id from documents left join embeddings on vec_id = doc_id")


@query
def cache_gc(spark, at):
    e = read(spark, at, "events").select("event_id", "ts")
    last = e.agg(F.max("ts")).first()[0]
    return incremental.expire(e, "ts", F.lit(last).cast("timestamp_ntz") - F.expr("interval 15 days")).select("event_id")


sql("cache_gc", "select event_id from events where ts >= (select max(ts) from events) - interval 15 days")


@query
def table_counts(spark, at):
    names = ["documents", "embeddings", "conversations", "events", "pages"]
    out = None
    for name in names:
        own = read(spark, at, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = own if out is None else out.union(own)
    return out


sql("table_counts", " union all ".join(f"select '{n}' as name, count(*) as n from {n}" for n in ["documents", "embeddings", "conversations", "events", "pages"]))


@query
def index_stats(spark, at):
    d = read(spark, at, "documents")
    return incremental.run_counts(d.select("source", F.md5(F.col("text").cast("binary")).alias("hash")), "source", "hash")


sql("index_stats", "select count(distinct source) as files, count(*) as chunks, count(*) - count(distinct md5(text)) as cache_hits from documents")


@query
def stream_incremental(spark, at):
    """The documents' ids and languages, taken in as a stream of files, the last row of each id kept."""
    from ..streaming.incremental import current, stream_rows

    base = f"{scratch_dir(spark)}/stream-{stream_incremental.runs}"
    stream_incremental.runs += 1
    d = read(spark, at, "documents").select("doc_id", "lang", F.lit(1).alias("seq"))
    d.repartition(2).write.parquet(f"{base}/in")
    d.where("doc_id % 4 = 0").select("doc_id", F.lit("xx").alias("lang"), F.lit(2).alias("seq")).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream_rows(spark, f"{base}/in", d.schema, f"{base}/log", f"{base}/out", "doc_id", "seq")
    return current(spark, f"{base}/out", d.schema).select("doc_id", "lang")


stream_incremental.runs = 0
sql("stream_incremental", "select doc_id, case when doc_id % 4 = 0 then 'xx' else lang end as lang from documents")


@query
def stream_listings(spark, at):
    """Two listings of the documents' files as a stream: what is new, changed and deleted, and when that is known."""
    from ..streaming import listings

    stream_listings.runs += 1
    base, (disk, known) = f"{scratch_dir(spark)}/listings-{stream_listings.runs}", manifests(spark, at)
    for when, rows in ((1000, known), (2000, disk)):
        rows.select("rel_path", "mtime_ns", "size", F.timestamp_millis(F.lit(when)).alias("listed_at")).write.mode("append").parquet(f"{base}/in")
        listings.follow_listings(spark, f"{base}/in", f"{base}/log", f"{base}/out", per_batch=None)  # a listing is read and written by many tasks
    return spark.read.schema(listings.CHANGE).parquet(f"{base}/out").select("rel_path", "change", "at_ms")


stream_listings.runs = 0
sql("stream_listings", f"""with {MAN} select rel_path, 'new' as change, 1000::bigint as at_ms from k union all
select rel_path, case when k.size is null then 'new' when f.size is null then 'deleted' else 'changed' end, case when f.size is null then 1001 else 2000 end from k full join f using (rel_path) where k.size is null or f.size is null or k.size <> f.size or k.mtime_ns <> f.mtime_ns""")


@query
def routed_batch(spark, at):
    """Every query's ten nearest in the three communities whose bundles are nearest to it, from vectors stored by community."""
    routed_batch.runs += 1
    v = read(spark, at, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("community"))
    store = CommunityStore.build(v, f"{scratch_dir(spark)}/routed-{routed_batch.runs}")
    return store.search_batch(fiftieth(spark, at).withColumnRenamed("embedding", "vector"), 10, 3).select("query", F.col("id").alias("vec_id"), six("score").alias("score"), "rank")


routed_batch.runs = 0
sql("routed_batch", f"""with {BUNDLE}, q as (select vec_id query, unnest(embedding)::double x, unnest(range(0, 64))::int dim from embeddings where vec_id % 50 = 0),
z as (select query, label, sum(b.v * q.x) s from b join q using (dim) group by all), r as (select query, label, row_number() over (partition by query order by round(s, 9) desc, label) n from z)
select query, v.vec_id, {six_sql(dot_sql('e.embedding', 'v.embedding'))} as score, row_number() over (partition by query order by round({dot_sql('e.embedding', 'v.embedding')}, 9) desc, v.vec_id)::int as rank
from r join embeddings e on e.vec_id = query join embeddings v on v.label = r.label where n <= 3 qualify rank <= 10""")


@query
def bundle_updates(spark, at):
    """Bundles after vectors have come, gone and moved, kept by sums."""
    bundle_updates.runs += 1
    v = read(spark, at, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("community"))
    store = CommunityStore.build(v.where("id % 4 <> 0"), f"{scratch_dir(spark)}/bundles-{bundle_updates.runs}")
    store.change(v.where("id % 4 = 0"), v.where("id % 7 = 1").select("id"))
    store.change(v.where("id % 11 = 3 and (id % 7 <> 1 or id % 4 = 0)").withColumn("community", F.pmod(F.col("community") + 1, F.lit(10))))
    return store.bundles().select("community", "n", F.posexplode("bundle").alias("dim", "x")).select("community", "n", F.col("dim").cast("int").alias("dim"), six("x").alias("value"))


bundle_updates.runs = 0
sql("bundle_updates", f"""with m as (select vec_id, embedding, case when vec_id % 11 = 3 then (label + 1) % 10 else label end::bigint community from embeddings where vec_id % 7 <> 1 or vec_id % 4 = 0),
d as (select community, unnest(embedding)::double x, unnest(range(0, 64))::int dim from m), u as (select community, dim, sum(x) s, count(*) n from d group by all)
select community, n, dim, {six_sql('s / sqrt(sum(s * s) over (partition by community))')} as value from u""")
