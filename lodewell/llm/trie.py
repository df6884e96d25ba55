"""Prefix trie of conversations by an LCP-aware external mergesort.

A conversation is a sequence of turns, of which only digests (16 bytes of role and text) and word
counts travel. Sequences are dealt out by ranges of (sequence, id), so a group of equal
conversations is dealt out too. A task sorts the record batches of its range into runs that carry
the length of the prefix that each sequence shares with the one before (LCP), and merges the runs
by a loser tree: of two heads that share more and less with the last one out, the former is less
and nothing is compared; only heads that share equally much are compared, behind what they share.
The merged stream comes with its LCPs, from which a stack of open nodes is kept: what is deeper
than the LCP is finished and emitted with its counts.

A range can't finish the nodes on its first and on its last path: others may have members of
them. Those nodes (two paths a range) are partial rows; those of FAN ranges together are
merged by the same stack, again and again until one group is left. Ids that end in a finished node are
hashed as they come; those that end in a partial one leave in pieces, hashed in order once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, frugal, no_null, partitions
from .resample import TABLE_SQL, crc_sql

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of digests that a range is to hold, ranges that are merged at once, rows of a run, ids in a piece.
RANGE_BYTES, FAN, RUN, PIECE = 16 << 20, 64, 4096, 8192
NONE = hashlib.sha256().hexdigest()


# sequences


def turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, key array<binary>, n_words array<long>): each conversation's digests and word counts, by turn.

    Null turns come first; turns of one number are ordered by their digests. A null role or text
    is empty. Rows without an id belong to no conversation. Repeated rows are turns of their own,
    other columns are not looked at, very long texts are read whole. A conversation's digests (some
    30 bytes a turn) have to fit a task.
    """
    text = no_null(text_col)
    digest = F.unhex(F.md5(F.concat(F.octet_length(no_null(role_col)).cast("string"), F.lit(":"), no_null(role_col), text).cast("binary")))
    at = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("t"), digest.alias("d"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("w")).alias("x"))
    own = at.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return own.select("conv_id", F.col("x.d").alias("key"), F.col("x.w").alias("n_words"))


def rebuilt(convs: DataFrame, every: int = 20, shared: int = 4) -> DataFrame:
    """The same with the first h turns replaced by those of conversation c - c % every; h = crc32 of the id's digits modulo `shared`."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared)).cast("int")
    first = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_b"), *(F.slice(c, 1, shared - 1).alias(f"_{c}") for c in ("key", "n_words")))
    both = convs.join(first, convs.conv_id - convs.conv_id % every == F.col("_b"), "left").withColumn("_h", h)

    def spliced(c: str):
        head = F.coalesce(F.slice(f"_{c}", F.lit(1), F.col("_h")), F.array().cast(convs.schema[c].dataType))
        return F.concat(head, F.slice(c, F.col("_h") + 1, F.size(c)))

    return both.select("conv_id", *(spliced(c).alias(c) for c in ("key", "n_words")))


# runs and their merge


def shared_prefix(a: list, b: list, at: int = 0) -> int:
    """The length of what a and b have in common, if they are known to share `at` places."""
    end = min(len(a), len(b))
    while at < end and a[at] == b[at]:
        at += 1
    return at


def run_of(items: list[tuple]) -> list[list]:
    """Items (key, id, words) in order, each with the LCP with the one before: [lcp, key, id, words]."""
    out, last = [], None
    for key, i, words in sorted(items, key=lambda x: (x[0], x[1])):
        out.append([0 if last is None else shared_prefix(last, key), key, i, words])
        last = key
    return out


class LoserTree:
    """Merges runs. Every head's lcp is with the last item out, so a comparison begins where two heads may first differ."""

    def __init__(self, runs: list[list[list]]):
        self.runs = [iter(r) for r in runs]
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.heads = [next(r, None) for r in self.runs] + [None] * (self.size - len(runs))
        self.compared = 0
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for n in range(self.size - 1, 0, -1):
            winners[n], self.losers[n] = self.match(winners[2 * n], winners[2 * n + 1])
        self.winner = winners[1] if self.size > 1 else 0

    def match(self, x: int, y: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads. The loser's lcp is with the winner from then on."""
        a, b = self.heads[x], self.heads[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if a[0] != b[0]:  # the one that shares more with the last item out is less, and what the other shares with it is as before
            return (x, y) if a[0] > b[0] else (y, x)
        at = shared_prefix(a[1], b[1], a[0])
        self.compared += at - a[0] + 1
        p, q = a[1][at : at + 1], b[1][at : at + 1]
        if (p, a[2]) <= (q, b[2]):
            b[0] = at
            return x, y
        a[0] = at
        return y, x

    def __iter__(self) -> Iterator[list]:
        while (head := self.heads[self.winner]) is not None:
            yield head
            x = self.winner
            self.heads[x] = next(self.runs[x], None)  # its lcp is with its predecessor, the item just out
            n = (self.size + x) // 2
            while n:
                x, self.losers[n] = self.match(x, self.losers[n])
                n //= 2
            self.winner = x


# nodes

NODE = "part boolean, grp long, ord long, depth int, path binary, parent binary, conv_id long, parent_conv_id long, n_convs long, n_words long, n_children long, n_leaves long, saved long, ends string"
NAMES = [x.split()[0] for x in NODE.split(", ")]
KINDS = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
PARENT, PARENT_CONV = NAMES.index("parent"), NAMES.index("parent_conv_id")
PARTIAL = ["grp", "ord", "depth", "path", "conv_id", "n_convs", "n_words", "n_children", "n_leaves", "saved"]


class Open:
    """A node that may have further members. `first`: it is on the first path, and so partial whatever comes."""

    __slots__ = ("conv", "convs", "depth", "ends", "first", "in_pieces", "leaves", "n", "path", "pending", "saved", "words")

    def __init__(self, depth: int, path: bytes, words: int, first: bool):
        self.depth, self.path, self.words, self.first = depth, path, words, first
        self.conv, self.convs, self.n, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.in_pieces, self.pending = [], False, []

    def meet(self, conv: int, convs: int) -> None:
        self.convs += convs
        if self.conv is None or conv < self.conv:
            self.conv = conv


class Stack:
    """Open nodes from the root down; rows: what is finished."""

    def __init__(self, group: int, sums: bool, whole: bool = False):
        self.group, self.sums, self.whole = group, sums, whole  # sums: members are counted where they end, not all along their path
        self.open: list[Open] = []
        self.rows: list[list] = []
        self.partial: list[Open] = []
        self.n_pieces, self.on_first = 0, not whole

    def push(self, path: bytes, words: int) -> None:
        self.open.append(Open(len(self.open), path, words, self.on_first))

    def piece(self, x: Open) -> None:
        """The ids that x holds, as a row of their own."""
        if x.ends:
            self.rows.append([None, self.group, self.n_pieces, x.depth, x.path, *[None] * 8, ",".join(map(str, x.ends))])
            self.n_pieces, x.ends, x.in_pieces = self.n_pieces + 1, [], True

    def close(self, left: int, at_end: bool = False) -> None:
        """Takes nodes off until so many are open. They are finished, but those of the first path, and of the last one at the end of what is not whole."""
        while len(self.open) > left:
            x = self.open.pop()
            up = self.open[-1] if self.open else None
            self.on_first = False
            if self.sums and up:
                up.meet(x.conv, x.convs)
            if x.first or at_end and not self.whole:
                self.piece(x)
                self.partial.append(x)
                for row in x.pending:
                    row[PARENT] = x.path  # whose least id isn't known here
                self.rows += x.pending
                continue
            for row in x.pending:
                row[PARENT_CONV] = x.conv
            self.rows += x.pending
            if x.in_pieces:
                self.piece(x)
            leaves, saved = x.leaves or 1, x.saved + (x.convs - 1) * x.words
            ends = None if x.in_pieces else hashlib.sha256(",".join(map(str, x.ends)).encode()).hexdigest()
            row = [False, None, None, x.depth, x.path if x.in_pieces else None, None, x.conv, None, x.convs, None, x.n, leaves, saved, ends]
            if up is None:
                self.rows.append(row)
                continue
            up.n, up.leaves, up.saved = up.n + 1, up.leaves + leaves, up.saved + saved
            if up.first:
                row[PARENT] = up.path
                self.rows.append(row)
            else:
                up.pending.append(row)

    def done(self) -> list[list]:
        """All rows that are left. Partial nodes are in the order of the trie: the first path down, then what is on the last one only."""
        self.close(0, at_end=True)
        for i, x in enumerate(sorted(self.partial, key=lambda x: (not x.first, x.depth))):
            self.rows.append([True, self.group, i, x.depth, x.path, None, x.conv, None, x.convs, x.words, x.n, x.leaves, x.saved, None])
        return self.rows

    def full(self) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= RUN:
            yield _batch(self.rows)
            self.rows = []


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(KINDS), KINDS, strict=True)], names=NAMES)


def _ranged(batches: Iterator[pa.RecordBatch], run: int, piece: int) -> Iterator[pa.RecordBatch]:
    """A range of (conv_id, key, n_words) as rows of NODE: finished nodes, partial ones (part), and pieces of the ids that end in a node (part null)."""
    runs, rows = [], []
    for b in batches:
        rows += zip(*(b.column(i).to_pylist() for i in (1, 0, 2)), strict=True)
        while len(rows) >= run:
            runs.append(run_of(rows[:run]))
            del rows[:run]
    if rows:
        runs.append(run_of(rows))
    if not runs:
        return
    stack = Stack(TaskContext.get().partitionId(), sums=True)
    stack.push(b"", 0)
    for lcp, key, conv, words in LoserTree(runs):
        stack.close(lcp + 1)
        for d in range(len(stack.open) - 1, len(key)):
            stack.push(hashlib.md5(stack.open[-1].path + key[d]).digest(), words[d])
        end = stack.open[-1]
        stack.on_first = False
        end.meet(conv, 1)
        end.ends.append(conv)
        if len(end.ends) >= piece:
            stack.piece(end)
        yield from stack.full()
    yield _batch(stack.done())


def _merged(batches: Iterator[pa.RecordBatch], whole: bool, fan: int) -> Iterator[pa.RecordBatch]:
    """Partial nodes of ranges or groups, by (grp, ord), as rows of NODE for each `fan` of them. whole: there are no others, so all are finished."""
    stack = None
    for b in batches:
        for g, _, depth, path, conv, convs, words, n, leaves, saved in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if stack is None or g // fan != stack.group:
                if stack:
                    yield _batch(stack.done())
                stack = Stack(g // fan, sums=False, whole=whole)
            if len(stack.open) <= depth or stack.open[depth].path != path:
                stack.close(depth)
                stack.push(path, words)
            x = stack.open[depth]
            x.meet(conv, convs)
            x.n, x.leaves, x.saved, x.in_pieces = x.n + n, x.leaves + leaves, x.saved + saved, True
            yield from stack.full()
    if stack:
        yield _batch(stack.done())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, digest) of the pieces of ids, which come in order."""
    path, digest, out = None, None, []
    for b in batches:
        for p, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if digest and p == path:
                digest.update(b"," + text.encode())
                continue
            if digest:
                out.append((path, digest.hexdigest()))
            path, digest = p, hashlib.sha256(text.encode())
    if digest:
        out.append((path, digest.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["path", "digest"])


def _with(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the value that table has for their key; rows without a key are not shuffled."""
    found = rows.where(F.col(key).isNotNull()).join(table, key, "left")
    return found.unionByName(rows.where(F.col(key).isNull()).withColumn(value, F.lit(None).cast(table.schema[value].dataType)))


def trie(convs: DataFrame, ranges: int | None = None, fan: int = FAN, run: int = RUN, piece: int = PIECE) -> DataFrame:
    """One row a node of the trie over convs(conv_id, key, n_words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the least of the node's members (conversations that begin with its turns), n_leaves
    counts the nodes without children below it (itself, if it has none), saved_tokens is what sharing
    its turns and those below saves, ends_sha256 the SHA-256 of the comma-joined ids, in order, that
    end in it. ranges: how many tasks merge, by default by the bytes of digests. Ids are to be unique. The root is there if there is a conversation; an empty
    table gives an empty result.
    """
    spark, col = convs.sparkSession, F.col
    scratch = Scratch(spark, "trie")
    convs = scratch.save(convs.select(col("conv_id").cast("long").alias("conv_id"), "key", "n_words"), "sequences")
    if ranges is None:
        ranges = max(partitions(spark), -(-(convs.agg(F.sum(F.size("key") + 4)).first()[0] or 0) * 16 // RANGE_BYTES))
    made = scratch.save(convs.repartitionByRange(ranges, "key", "conv_id").mapInArrow(frugal(lambda b: _ranged(b, run, piece), RUN), NODE), "ranges")
    nodes, parts = made.where("not part"), made.where("part")
    while (groups := parts.agg(F.max("grp")).first()[0]) is not None:
        whole = groups < fan
        dealt = parts.select(PARTIAL).repartition(max(1, min(partitions(spark), groups // fan + 1)), F.floor(col("grp") / fan)).sortWithinPartitions("grp", "ord")
        level = scratch.save(dealt.mapInArrow(frugal(lambda b, whole=whole: _merged(b, whole, fan), RUN), NODE), "merged")
        nodes, parts = nodes.unionByName(level.where("not part")), level.where("part")
        if whole:
            break
    pieces = made.where("part is null").repartition(partitions(spark), "path").sortWithinPartitions("path", "grp", "ord")
    ends = scratch.save(pieces.select("path", "ends").mapInArrow(frugal(_hashed, RUN), "path binary, digest string"), "ends")
    nodes = _with(nodes, ends, "path", "digest")
    partial = nodes.where("path is not null").select(col("path").alias("parent"), col("conv_id").alias("above"))
    out = _with(nodes, partial, "parent", "above")
    return out.select("conv_id", col("depth").cast("long").alias("depth"), F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", col("saved").alias("saved_tokens"), F.coalesce("ends", "digest", F.lit(NONE)).alias("ends_sha256"))


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP13_SQL = rf"""with recursive {TABLE_SQL},
o as (select conv_id, list((coalesce(role, ''), coalesce(text, '')) order by turn nulls first, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) x from conversations where conv_id is not null group by 1),
c as (select o.conv_id, {crc_sql("o.conv_id::varchar")} % 4 h, coalesce(b.x[1:({crc_sql("o.conv_id::varchar")} % 4)], []) || o.x[({crc_sql("o.conv_id::varchar")} % 4) + 1:] x from o left join o b on b.conv_id = o.conv_id - o.conv_id % 20, tab),
p as (select conv_id, len(x) n, x[1:d] x, d from (select conv_id, x, unnest(range(0, len(x) + 1)) d from c)),
n as (select x, d, min(conv_id) conv_id, count(*) n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '') ends,
  case when d = 0 then 0 else len(regexp_extract_all(x[d][2], '{WORD}')) end words from p group by 1, 2),
k as (select x[1:d - 1] x, d - 1 d, count(*) n_children from n where d > 0 group by 1, 2),
m as (select n.*, coalesce(n_children, 0) n_children, (n_convs - 1) * words saved from n left join k on n.x = k.x and n.d = k.d),
s as (select x[1:e] x, e d, sum(saved) saved, count(*) filter (n_children = 0) n_leaves from (select *, unnest(range(0, d + 1)) e from m) group by 1, 2)
select m.conv_id, m.d::bigint depth, u.conv_id parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved::bigint saved_tokens, sha256(m.ends) ends_sha256
from m join s on m.x = s.x and m.d = s.d left join m u on u.x = m.x[1:m.d - 1] and u.d = m.d - 1"""
