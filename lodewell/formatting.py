"""Results as text. Rows come with rank, score, kind (as shown), name, source_path, source and community_id."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as T

#: Fixed texts of the output formats.
FLAT_BANNER = "Relevant Workspace Context (RAG):"
NO_HITS, NO_CHUNKS, NO_NOTES = "No matching chunks found.", "No chunks indexed yet. Run index_workspace first.", "No notes yet. Use note_to_self to save one."


def _head(community: Column | None = None) -> Column:
    shown = F.lit("") if community is None else F.when(community.isNotNull(), F.concat(F.lit(" [community "), community.cast("string"), F.lit("]"))).otherwise("")
    return F.concat(F.format_string("[%.2f]", F.col("score")), shown, F.lit(" "), F.col("kind"), F.lit(" `"), F.col("name"), F.lit("` — "), F.col("source_path"))


def _joined(rows: DataFrame, text: Column, *order: str) -> DataFrame:
    """One row of one string: texts in order. Results of a search are bounded by its k."""
    parts = rows.select(F.struct(*order, text.alias("_text")).alias("s")).agg(F.array_sort(F.collect_list("s")).alias("a"))
    return parts.select(F.rtrim(F.regexp_replace(F.array_join(F.transform("a", lambda x: x["_text"]), ""), r"\s+$", "")).alias("text"))


def by_community(rows: DataFrame) -> DataFrame:
    """rows with seen, the rank at which their community comes up first."""
    return rows.withColumn("seen", F.min("rank").over(Window.partitionBy("community_id")))


def grouped(rows: DataFrame) -> DataFrame:
    """Chunks of a community together, under its header, communities in the order in which they come up."""
    rows = by_community(rows)
    first = (F.col("rank") == F.col("seen")) & F.col("community_id").isNotNull()
    header = F.when(first, F.concat(F.lit("── Community "), F.col("community_id").cast("string"), F.lit(" ──\n"))).otherwise("")
    return _joined(rows, F.concat(header, _head(), F.lit("\n"), T.preview(F.col("source")), F.lit("\n\n")), "seen", "rank")


def flat(rows: DataFrame) -> DataFrame:
    text = F.concat(F.lit("--- "), F.col("kind"), F.lit(" `"), F.col("name"), F.lit("` in "), F.col("source_path"), F.format_string(" (Relevance: %.2f) ---\n", F.col("score")), F.col("source"), F.lit("\n\n"))
    out = _joined(rows, text, "rank")
    return out.select(F.when(F.col("text") == "", "").otherwise(F.concat(F.lit(FLAT_BANNER + "\n\n"), "text")).alias("text"))


def tool(rows: DataFrame) -> DataFrame:
    out = _joined(rows, F.concat(_head(F.col("community_id")), F.lit("\n"), T.preview(F.col("source")), F.lit("\n\n")), "rank")
    return out.select(F.when(F.col("text") == "", NO_HITS).otherwise(F.col("text")).alias("text"))


def notes(rows: DataFrame) -> DataFrame:
    """rows: rank, score, tags, timestamp, text."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" ["), F.array_join("tags", ", "), F.lit("]"))).otherwise("")
    return _joined(rows, F.concat(F.format_string("[%.2f]", F.col("score")), tags, F.format_string(" (ts: %d) ", F.col("timestamp")), F.col("text"), F.lit("\n\n")), "rank")


FORMATS = {"grouped": grouped, "flat": flat, "tool": tool}


def hook_response(event: str, context: str | None) -> str:
    out: dict = {"continue": True}
    if context:
        out["hookSpecificOutput"] = {"hookEventName": event, "additionalContext": context}
    return json.dumps(out, ensure_ascii=False)
