"""Repeated passages by prefix-partitioned suffix trees over sampled suffixes.

A window of `window` words repeats if its words start somewhere else too. Of every window, the
prefix of `PREFIX` words with the least hash (the leftmost of equals) is its anchor: equal
windows have equal anchors at equal places, and neighbouring windows share theirs, so the
suffixes that start at anchors (about one in fourteen) stand for all. Suffixes are partitioned by
that prefix; a prefix that occurs once has a tree of one leaf and goes. What is left of a
prefix are its contexts: the words around the anchor in which its windows lie. Equal contexts
(in two 64-bit hashes, of the anchor and of all words) are one, counted. If a prefix has a single
context that occurs more than once, its tree is one path and all its windows repeat. Else its
contexts' words are fetched and go, with those of other prefixes, to a group of bounded memory,
whose suffixes are named by their nodes in the tree at depths 1, 2, 4, ..., `window` (sorting
pairs of names doubles the depth): a node at the full depth over two or more occurrences is a
repeat.

A prefix with more than `GROUP_CONTEXTS` different contexts is too large for a group and gets longer,
step by step: its windows are halved by where in them the anchor lies, and each half has in
common the anchor and the words that all its windows have around it. That is the longer prefix;
what shares it is a group if it is small enough, else it is halved again. At the end the
prefix is a whole window, and a group one path, which is counted by its words and never gathered.
Windows that overlap join into maximal repeats of each document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lexical import spread
from ._common import WORD, Scratch, frugal, no_null, partitions
from ._words import Rolling, leftmost_min, slices, word_hashes, words

_U = np.uint64
_WORD = re.compile(WORD)
PREFIX, GROUP_CONTEXTS, TASK_CONTEXTS = 8, 4096, 60_000


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), no_null(text_col))


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(id, tk, at, n, d, anchor, ctx): for each run of windows of a text (id, tk) that share an anchor, where they start, how many, how far on the anchor is, and hashes of the anchor's prefix and of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, off in slices(batches, 2):
            s, e, ptr = words(buf, off)
            sizes = np.diff(ptr)
            if not len(s) or sizes.max() < window:
                continue
            roll = Rolling(word_hashes(buf, s, e))
            n = len(s)
            h = roll.runs(np.arange(n - PREFIX + 1), np.arange(PREFIX, n + 1))
            least = leftmost_min(h, window - PREFIX + 1)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            start = np.flatnonzero(np.arange(n - window + 1) + window <= ptr[1:][doc[: n - window + 1]])
            at = least[start]
            cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            lo, size = start[cut], np.diff(np.r_[cut, len(start)])
            d = doc[lo]
            take = pa.array(d)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array((lo - ptr[d]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array((at[cut] - lo).astype(np.int32)), pa.array(h[at[cut]].view(np.int64)), pa.array(roll.runs(lo, lo + size + window - 1).view(np.int64))],
                names=["id", "tk", "at", "n", "d", "anchor", "ctx"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "tk", "text").mapInArrow(run, f"id {kind}, tk long, at int, n int, d int, anchor long, ctx long")


def node_names(ids: np.ndarray, depth: int) -> np.ndarray:
    """For each place of a sequence its node of the suffix tree at that depth: equal where the next `depth` ids are, and in their order."""
    name, at = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while at < depth:
        step = min(at, depth - at)
        both = name[:-step] * (int(name.max()) + 1) + name[step:]
        name, at = np.unique(both, return_inverse=True)[1].astype(np.int64), at + step
    return name


#: A context, or some of its windows: those in which the anchor lies lo to hi - 1 words on. key: a hash of the words that they all have.
CONTEXT = "anchor long, ctx long, many long, n int, d int, lo int, hi int, key long, words string"
_NAMES = [x.split()[0] for x in CONTEXT.split(", ")]


def _own(n: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of a context's windows whose anchor is lo to hi - 1 words on, and how many there are (0 or less: none)."""
    first = np.maximum(0, d - hi + 1)
    return first, np.minimum(n, d - lo + 1) - first


def _trees(window: int):
    """CONTEXT rows of whole groups -> (anchor, ctx, mask): bit i says that the context's window i words on repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows or not sum(b.num_rows for b in rows):
            return
        t = pa.Table.from_batches(rows).combine_chunks()
        named = lambda t: [t.column(k).to_numpy() for k in _NAMES[:7]]
        anchor, ctx, many, n, d, lo, hi = named(t)
        first = np.unique(np.stack([anchor, ctx, lo]), axis=1, return_index=True)[1]  # repeated rows of documents give a context twice
        t = t.take(pa.array(first)).combine_chunks()
        anchor, ctx, many, n, d, lo, hi = named(t)
        start, n = _own(n, d, lo, hi)
        for _, buf, off in slices(iter(t.select(["words"]).to_batches()), 0, 1 << 40):
            s, e, ptr = words(buf, off)
            node = node_names(word_hashes(buf, s, e), window)
            own = np.repeat(np.arange(len(n)), n)
            step = start[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            name = node[ptr[own] + step]
            deep = np.bincount(name, weights=many[own], minlength=int(node.max()) + 1)[name] > 1
            mask = np.bitwise_or.reduceat(np.where(deep, np.int64(1) << step, 0), np.cumsum(n) - n)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ctx), pa.array(mask)], names=["anchor", "ctx", "mask"])

    return run


def _halves(window: int):
    """CONTEXT rows -> those of both halves of their windows, with longer prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, off in slices(batches, len(_NAMES) - 1):
            s, e, ptr = words(buf, off)
            roll = Rolling(word_hashes(buf, s, e))
            n, d, lo, hi = (b.column(k).to_numpy() for k in ("n", "d", "lo", "hi"))
            mid = (lo + hi) // 2
            for low, high in ((lo, mid), (mid, hi)):
                there = np.flatnonzero(_own(n, d, low, high)[1] > 0)
                at, low, high = ptr[there] + d[there], low[there], high[there]
                key = roll.runs(at - low, at - high + window + 1)
                take = pa.array(there)
                columns = dict(zip(b.schema.names, (c.take(take) for c in b.columns), strict=True)) | {"lo": pa.array(low), "hi": pa.array(high), "key": pa.array(key.view(np.int64))}
                yield pa.RecordBatch.from_arrays([columns[k] for k in _NAMES], names=_NAMES)

    return run


def _contexts(window: int):
    """(text, want: array<struct<anchor, ctx, many, at, n, d>>) -> a CONTEXT row for each context."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, want in zip(b.column(0), b.column(1), strict=True):
                own = _WORD.findall(text.as_py())
                for x in want.as_py():
                    out.append((x["anchor"], x["ctx"], x["many"], x["n"], x["d"], 0, window - PREFIX + 1, x["anchor"], " ".join(own[x["at"] : x["at"] + x["n"] + window - 1])))
            cols = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_NAMES)

    return run


def _masks(parts: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """CONTEXT rows of all prefixes -> (anchor, ctx, mask), from trees of groups whose prefixes are as long as they need to be."""
    prefix, out = ["anchor", "lo", "key"], None

    def more(masks: DataFrame) -> None:
        nonlocal out
        out = masks if out is None else out.union(masks)

    while True:
        sizes = parts.groupBy(*prefix).agg(F.count("*").alias("_n"))
        large = scratch.save(sizes.where(F.col("_n") > GROUP_CONTEXTS).select(*prefix), "large")
        done = large.isEmpty()
        small = parts if done else parts.join(large, prefix, "left_anti")
        groups = max(partitions(parts.sparkSession), -(-parts.count() // TASK_CONTEXTS))
        more(small.repartition(groups, *prefix).mapInArrow(_trees(window), "anchor long, ctx long, mask long"))
        if done:
            return out
        rest = scratch.save(parts.join(large, prefix, "left_semi"), "rest")
        whole = rest.where("hi - lo = 1").withColumn("window", F.array_join(F.slice(F.split("words", " "), F.col("d") - F.col("lo") + 1, F.lit(window)), " "))
        twice = whole.groupBy("anchor", "lo", "window").agg(F.sum("many").alias("_n")).where("_n > 1").drop("_n")
        more(whole.join(twice, ["anchor", "lo", "window"], "left_semi").select("anchor", "ctx", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("d") - F.col("lo")).alias("mask")))
        parts = scratch.save(rest.where("hi - lo > 1").mapInArrow(frugal(_halves(window)), CONTEXT), "halves")


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int = 35) -> DataFrame:
    """docs(id, tk, text) -> (id, tk, marks array<struct<at int, mask long>>): bit i of a mask says that the window at word at + i starts elsewhere too."""
    if not PREFIX <= window <= PREFIX + 62:
        raise ValueError(f"window must be {PREFIX} to {PREFIX + 62}")
    runs = scratch.save(anchors(docs, window), "anchors")
    shared = runs.groupBy("anchor").agg(F.count("*").alias("_n"), F.min("ctx").alias("_lo"), F.max("ctx").alias("_hi")).where("_n > 1")
    shared = scratch.save(shared.select("anchor", (F.col("_lo") == F.col("_hi")).alias("same")), "prefixes")  # written, so that the joins' sides are both plain and a hot prefix can be split
    hits = scratch.save(runs.join(shared, "anchor"), "shared")
    scratch.drop(runs)

    mixed = hits.where("not same").groupBy("anchor", "ctx").agg(F.count("*").alias("many"), F.min(F.struct("id", "tk", "at", "n", "d")).alias("w"))
    want = mixed.groupBy(F.col("w.id").alias("id"), F.col("w.tk").alias("tk"))
    want = want.agg(F.collect_list(F.struct("anchor", "ctx", "many", "w.at", "w.n", "w.d")).alias("want"))  # as many as the text has anchors
    texts = docs.join(want, (docs.id.eqNullSafe(want.id)) & (docs.tk == want.tk)).select(docs.text, "want")
    parts = scratch.save(texts.mapInArrow(frugal(_contexts(window)), CONTEXT), "words")
    masks = scratch.save(_masks(parts, scratch, window).where("mask <> 0").groupBy("anchor", "ctx").agg(F.bit_or("mask").alias("mask")), "masks")

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n"))
    marks = hits.where("same").select("id", "tk", "at", (bit - 1).alias("mask"))
    marks = marks.union(hits.where("not same").join(masks, ["anchor", "ctx"]).select("id", "tk", "at", "mask"))
    marks = scratch.save(marks.groupBy("id", "tk").agg(F.collect_set(F.struct("at", "mask")).alias("marks")), "marks")  # as many as the text has anchors
    scratch.keep(marks)
    return marks


def covered(n_words: int, marks: list[dict] | None, window: int) -> np.ndarray:
    """Which of a text's words lie in a repeated window."""
    edge = np.zeros(n_words + 1, np.int64)
    for x in marks or ():
        mask, at = x["mask"], x["at"]
        while mask:
            low = mask & -mask
            i = at + low.bit_length() - 1
            run = (~(mask // low) & (mask // low + 1)).bit_length() - 1  # windows in a row
            edge[i] += 1
            edge[i + run - 1 + window] -= 1
            mask &= ~(((1 << run) - 1) << (low.bit_length() - 1))
    return np.cumsum(edge[:-1]) > 0


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """docs with a column _lw_marks, the repeated windows of its text as in repeated_windows(), null if there are none.

    All columns of docs stay as they are; names beginning with _lw_ are taken. A null text
    has no words; a very long one is read whole. Repeated rows are occurrences of their own, and a
    null id is one like others. An empty table gives an empty result.
    """
    keyed = docs.withColumn("_lw_key", _key(id_col, text_col))
    found = repeated_windows(keyed.select(F.col(id_col).alias("id"), F.col("_lw_key").alias("tk"), no_null(text_col).alias("text")), Scratch(docs.sparkSession, "substring"), window)
    found = found.select(F.col("id").alias("_lw_id"), F.col("tk").alias("_lw_tk"), F.col("marks").alias("_lw_marks"))
    same = keyed[id_col].eqNullSafe(F.col("_lw_id")) & (F.col("_lw_key") == F.col("_lw_tk"))
    return keyed.join(found, same, "left").drop("_lw_id", "_lw_tk", "_lw_key")


def cut(text: str, marks: list[dict] | None, window: int) -> tuple[str, int, int]:
    """A text without its repeated words and the white space after each run of them, its words, and those removed."""
    if not marks:
        return text, len(_WORD.findall(text)), 0
    spots = [m.span() for m in _WORD.finditer(text)]
    gone = covered(len(spots), marks, window)
    edges = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
    out, at = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(text[at : spots[a][0]])
        at = spots[b][0] if b < len(spots) else len(text)
    return "".join([*out, text[at:]]), len(spots), int(gone.sum())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """docs with the words of repeated windows taken out of the text; a text that had words and keeps none goes, with its row.

    Nulls and texts without repeats stay as they are. The columns are those of docs.
    """
    found, names = marked(docs, id_col, text_col, window), docs.columns

    text_at, marks_at = found.columns.index(text_col), found.columns.index("_lw_marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, left = [], []
            for t, marks in zip(b.column(text_at), b.column(marks_at), strict=True):
                text, n, gone = cut(t.as_py(), marks.as_py(), window) if marks.is_valid else (t.as_py(), 1, 0)
                texts.append(text)
                left.append(n > gone)
            columns = [pa.array(texts, c.type) if i == text_at else c for i, c in enumerate(b.columns) if i != marks_at]
            yield pa.RecordBatch.from_arrays(columns, names=[n for i, n in enumerate(b.schema.names) if i != marks_at]).filter(pa.array(left, pa.bool_()))

    return found.mapInArrow(frugal(run), found.drop("_lw_marks").schema).select(*names)


def op4_substring_dedup(spark, sf_dir: str, window: int = 35) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, sha = [], [], []
            for text, marks in zip(b.column(1), b.column(2), strict=True):
                own, marks = _WORD.findall(text.as_py() or ""), marks.as_py()
                total.append(len(own))
                if marks:
                    gone = covered(len(own), marks, window)
                    own = [w for w, x in zip(own, gone.tolist(), strict=True) if not x]
                removed.append(total[-1] - len(own))
                sha.append(hashlib.sha256(" ".join(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return marked(docs, window=window).select("doc_id", "text", "_lw_marks").mapInArrow(frugal(digest), "doc_id long, n_words long, n_removed long, kept_sha256 string")
