"""Mixing sources to target weights: hierarchical token budgets over a tree of sources.

Built-in functions only. Levels (say domain, language, source) make a tree whose leaves hold
documents. A node's budget is divided among its children by weight, none above what its
documents can give (their tokens times max_epochs): what a child can't use goes to its
siblings in proportion, and only what none of them can use counts against the node itself,
so its own siblings get it. (Each level's division sees the capacity of whole subtrees, which
gives the same as passing shortages up.) Whole tokens are dealt by largest remainder. A node of
weight 0 gets nothing, nor does anything below it, and it has no capacity to give: if that
leaves a node without children to give to, its own siblings get its budget.

A leaf's stream is its documents in the order of a seeded hash, once for each epoch, each epoch
in another order; the leaf gives the prefix of the stream that has its budget's tokens, its
last document cut where the budget ends. Places in the stream are running sums: over hash
ranges (4096 for each leaf and epoch, added up first) and inside a range, so no task sorts a
leaf's rows together however hot the leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, Scratch, no_null

NONE = "(none)"


def word_count(text_col: str = "text") -> Column:
    return F.size(F.regexp_extract_all(no_null(text_col), F.lit(WORD), F.lit(0))).cast("long")


def weight_of(name: str | Column, weights: dict[str, int], default: int = 1) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return reduce(lambda c, x: c.when(name == x[0], F.lit(x[1])), weights.items(), F.when(F.lit(False), F.lit(0))).otherwise(F.lit(default))


def divide(children: DataFrame, parents: list[str], name: str, budget: str = "budget") -> DataFrame:
    """children(parents..., name, weight, cap, budget) with `given`: the node's budget divided among its children.

    weight is a whole number of at least 0, cap a long of at least 0, and 0 <= given <= cap.
    Children are in order of cap / weight: those filled to their cap are the first of that
    order; the rest share by weight. Children of weight 0 come last and get nothing; if all
    weights are 0, nobody gets anything.
    """
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    node, ratio = Window.partitionBy(*parents), F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    before = node.orderBy("_r", name).rowsBetween(Window.unboundedPreceding, -1)
    c = children.withColumn("_r", ratio)
    c = c.withColumns({"_c": F.coalesce(F.sum("cap").over(before), F.lit(0)), "_w": F.sum("weight").over(node) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    full = (F.col("weight") > 0) & (exact("cap") * F.col("_w").cast("decimal(10,0)") <= F.col("weight").cast("decimal(10,0)") * (exact(budget) - exact("_c")))
    c = c.withColumn("_full", full)
    c = c.withColumns({"_left": F.col(budget) - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(node), "_u": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(node)})
    top, bottom = exact("_left") * F.col("weight").cast("decimal(10,0)"), F.nullif(F.col("_u").cast("decimal(10,0)"), F.lit(0).cast("decimal(10,0)"))
    c = c.withColumns({"_share": F.when(F.col("_full"), F.col("cap")).otherwise(F.coalesce(F.floor(top / bottom).cast("long"), F.lit(0))), "_part": F.when(F.col("_full") | (F.col("weight") == 0), F.lit(-1)).otherwise(F.coalesce(top % bottom, F.lit(-1)))})
    c = c.withColumns({"_rest": F.least(F.col("_left"), F.col("_left") - F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_share"))).over(node)), "_i": F.row_number().over(node.orderBy(F.col("_part").desc(), name))})
    more = (~F.col("_full")) & (F.col("weight") > 0) & (F.col("_i") <= F.col("_rest"))
    given = F.col("_share") + F.when(more, 1).otherwise(0)
    return c.withColumn("given", given).select(*children.columns, "given")


def budgets(leaves: DataFrame, levels: list[str], weights: list[Column], budget: int | None, max_epochs: int) -> DataFrame:
    """leaves(levels..., tokens) -> (levels..., tokens, given). budget None: as many tokens as there are. A null weight counts as 0."""
    weights = [F.greatest(F.coalesce(w.cast("long"), F.lit(0)), F.lit(0)) for w in weights]
    alive = reduce(lambda a, w: a & (w > 0), weights, F.lit(True))
    leaves = leaves.withColumn("cap", F.when(alive, F.col("tokens") * max_epochs).otherwise(F.lit(0)).cast("long"))
    total = F.lit(budget).cast("long") if budget is not None else F.sum("tokens").over(Window.partitionBy())
    top = leaves.withColumn("budget", total)
    for i, level in enumerate(levels):
        path = levels[: i + 1]
        nodes = top.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max("budget").alias("budget")).withColumn("weight", weights[i])
        nodes = divide(nodes, levels[:i], level).select(*path, "given")
        top = top.drop("budget").join(nodes, path).withColumnRenamed("given", "budget")
    return top.select(*levels, "tokens", F.col("budget").alias("given"))


def mix(docs: DataFrame, levels: dict[str, Column], weights: list[Column], budget: int | None = None, max_epochs: int = 4, seed: int = 42, id_col: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """docs' rows as often as the mixture takes them, with columns for the levels, n_tokens, epoch, start and take.

    levels: a column for each level by name, from the root down (null: "(none)"). start is the
    place in the leaf's stream of the document's first token, take how many of its n_tokens
    are in the prefix. Documents without tokens are not taken. Repeated rows are documents of their
    own; equal ids have equal places in the hash order, ties are in no fixed order; a null id is
    hashed like the word null. Columns of docs named like a level, n_tokens, epoch, start or take
    are replaced, all others are kept; names beginning with _lw_ are taken. A very long text is a
    document like others. An empty table, or a budget of 0, gives an empty result. Rows are written
    once with their counts, so texts are parsed once.
    """
    names = list(levels)
    docs = docs.withColumns({k: F.coalesce(c.cast("string"), F.lit(NONE)) for k, c in levels.items()} | {"n_tokens": word_count() if tokens is None else tokens})
    scratch = Scratch(docs.sparkSession, "mixing")
    docs = scratch.save(docs.where("n_tokens > 0"), "rows")
    leaves = docs.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    given = scratch.save(budgets(leaves, names, weights, budget, max_epochs).where("given > 0"), "budgets")

    rows = docs.join(given.withColumnsRenamed({"tokens": "_lw_all", "given": "_lw_given"}), names)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("_lw_given") - 1) / F.col("_lw_all")).cast("int"))))
    rows = rows.withColumn("_lw_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")))
    rows, part = rows.withColumn("_lw_range", F.substring("_lw_key", 1, 3)), [*names, "epoch", "_lw_range"]
    ranges = rows.groupBy(*part).agg(F.sum("n_tokens").alias("_lw_sum"))
    ahead = Window.partitionBy(*names, "epoch").orderBy("_lw_range").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows
    ranges = ranges.select(*part, F.coalesce(F.sum("_lw_sum").over(ahead), F.lit(0)).alias("_lw_ahead"))
    inside = Window.partitionBy(*part).orderBy("_lw_key", id_col).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(ranges, part).withColumn("start", F.col("epoch") * F.col("_lw_all") + F.col("_lw_ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    rows = rows.withColumn("take", F.least("n_tokens", F.col("_lw_given") - F.col("start"))).where("take > 0")
    return rows.drop("_lw_all", "_lw_given", "_lw_key", "_lw_range", "_lw_ahead")


DOMAIN_WEIGHTS, LANG_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2}, {"en": 5, "de": 2, "fr": 2}


def source_tree(domains: dict[str, int] = DOMAIN_WEIGHTS, langs: dict[str, int] = LANG_WEIGHTS) -> tuple[dict[str, Column], list[Column]]:
    """The tree of table documents, and its weights: four domains by the source's number, then languages, then sources."""
    number = F.regexp_extract(no_null("source"), r"([0-9]+)$", 1)
    domain = F.when(number != "", F.concat(F.lit("domain"), F.pmod(F.substring(number, -9, 9).cast("int"), F.lit(4)).cast("string")))
    weights = [weight_of("domain", domains), weight_of("lang", langs), F.lit(1)]
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}, weights


def op1_mixing(spark, sf_dir: str, domains: dict[str, int] = DOMAIN_WEIGHTS, langs: dict[str, int] = LANG_WEIGHTS) -> DataFrame:
    levels, weights = source_tree(domains, langs)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", word_count().alias("words"))
    return mix(docs, levels, weights, tokens=F.col("words")).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch", "start", "take")


def _cases(name: str, weights: dict[str, int]) -> str:
    return f"case {name} " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + " else 1 end"


def _level_sql(parents: list[str], name: str, weight: str, at: int) -> str:
    path = ", ".join([*parents, name])
    node = f"partition by {', '.join(parents)}" if parents else ""
    return f"""
n{at} as (select {path}, sum(cap)::hugeint cap, max(budget)::hugeint budget, ({weight})::hugeint weight from t{at} group by {path}),
a{at} as (select *, coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) c,
    sum(weight) over ({node}) - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0) w
  from n{at} window o as ({node} order by case when weight > 0 then cap::double / weight::double else 'inf'::double end, {name})),
f{at} as (select *, weight > 0 and cap * w <= weight * (budget - c) as is_full from a{at}),
l{at} as (select *, budget - sum(case when is_full then cap else 0 end) over ({node}) left_, sum(case when is_full then 0 else weight end) over ({node}) u from f{at}),
s{at} as (select *, case when is_full then cap else coalesce((left_ * weight)::hugeint // nullif(u, 0)::hugeint, 0) end share, case when is_full or weight = 0 then -1 else (left_ * weight)::hugeint % u::hugeint end part from l{at}),
g{at} as (select *, left_ - sum(case when is_full then 0 else share end) over ({node}) rest, row_number() over ({node} order by part desc, {name}) i from s{at}),
b{at} as (select {path}, share + case when not is_full and weight > 0 and i <= rest then 1 else 0 end given from g{at}),
t{at + 1} as (select t{at}.* exclude (budget), b{at}.given budget from t{at} join b{at} using ({path})),"""


def mixing_sql(domains: dict[str, int], langs: dict[str, int]) -> str:
    """DuckDB SQL of op1_mixing with these weights."""
    domain, lang = _cases("domain", domains), _cases("lang", langs)
    return (
        r"""
with d as (select doc_id, coalesce('domain' || (right(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), ''), 9)::bigint % 4)::varchar, '(none)') as domain,
    coalesce(lang, '(none)') as lang, coalesce(source, '(none)') as source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint n_tokens from documents),
leaf as (select domain, lang, source, sum(n_tokens)::bigint tokens from d group by all having sum(n_tokens) > 0),"""
        + f"\nt0 as (select *, case when {domain} > 0 and {lang} > 0 then tokens * 4 else 0 end cap, sum(tokens) over () budget from leaf),"
        + _level_sql([], "domain", domain, 0)
        + _level_sql(["domain"], "lang", lang, 1)
        + _level_sql(["domain", "lang"], "source", "1", 2)
        + r"""
r as (select d.*, tokens, budget::bigint given, unnest(range(0, ((budget - 1) // tokens)::bigint + 1))::int epoch from d join t3 using (domain, lang, source) where n_tokens > 0 and budget > 0),
k as (select *, md5('42:' || epoch || ':' || coalesce(doc_id::varchar, 'null')) as key from r),
p as (select *, epoch * tokens + coalesce(sum(n_tokens) over (partition by domain, lang, source, epoch order by key, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from k)
select doc_id, domain, lang, source, n_tokens, epoch, start::bigint as start, least(n_tokens, given - start)::bigint as take from p where start < given"""
    )


OP1_SQL = mixing_sql(DOMAIN_WEIGHTS, LANG_WEIGHTS)
