"""A training-corpus pipeline over table documents: five stages, each one operator of lodewell.llm.

Every stage takes all rows that the one before it kept and returns the columns of documents; the
last returns the packed pieces. Rows are documents of their own, nulls included: a null text has
no language and goes at the first stage; a null id, source or language is a value like others
(near_dedup keeps rows without an id, and of different texts with one id the one in each group).
Columns beyond those of documents are kept by all stages but the last; names beginning with _lw_
are taken. Very long texts are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm import jaccard, langid, mixing, packing, substring
from lodewell.llm._common import Scratch, table

#: The share of the tokens left that the mixture has, in thousandths.
MIXTURE = 800


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; one without a label is given what was found. Centroids are learned from the labelled ones."""
    model = langid.fit(docs)
    found = langid.with_language(docs, model)
    lang = F.coalesce("lang", F.col("_lw_lang.lang"))
    return found.where("not _lw_lang.rejected").withColumn("lang", lang).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word Jaccard similarity of 0.8 or more), that with the least id.

    Candidates come from SimHash's positional index and, beyond its reach, from lists by the members of exact prefixes of the sets; all are verified by whole sets.
    """
    return jaccard.drop_near_duplicates(docs).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that occur twice; a document that has nothing else goes."""
    kept = substring.remove_repeats(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the tree's weights, each at most once, for MIXTURE thousandths of the tokens. A document that the budget would cut stays whole."""
    levels, _ = mixing.source_tree()
    total = docs.agg(F.sum(mixing.word_count())).first()[0] or 0
    names = {k: f"_lw_{k}" for k in levels}
    weights = [mixing.weight_of("_lw_domain", mixing.DOMAIN_WEIGHTS), mixing.weight_of("_lw_lang", mixing.LANG_WEIGHTS), F.lit(1)]
    taken = mixing.mix(docs, {names[k]: c for k, c in levels.items()}, weights, budget=total * MIXTURE // 1000, max_epochs=1)
    return taken.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as can be."""
    scratch = Scratch(spark, "pipeline-packing")
    return packing.pack(scratch.save(packing.pieces(docs), "pieces"), scratch).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]
#: Fingerprints, suffix trees and tokens are not for SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents, each result written and read again as the next one's input."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
