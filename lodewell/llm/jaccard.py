"""Near duplicates by the Jaccard similarity of five-word shingles: SimHash's positional index, an exact prefix index, verification.

A text is the set of its five-word shingles (lower case; fewer words are one shingle). Texts whose
SimHash fingerprints over these sets link in the positional index (simhash.links) are candidates:
copies and nearly equal texts. At a similarity of 0.8 fingerprints of 64 bits lie 4 to 14 bits
apart, where eight bytes guarantee no shared one, so the rest come from prefixes: with all members
in one fixed order, the first n - ceil(0.8 n) + 1 of a set of n hold the first member that it has
in common with any set at 0.8 or more. Lists of texts by member of their prefixes therefore
hold every such pair; those whose sizes, places and parity bits leave 0.8 possible are verified by
whole sets, for which only the texts of these pairs are read again, turn by turn. Any order gives
the same result; rare members first makes lists short, so the members that are frequent in a sample
of SAMPLE texts come last.

Lists of over `list_limit` texts give no pairs at first: in them texts are verified against leaders,
drawn anew each turn, as long as one pair in TWENTIETH or more is a link. What is then left,
pairs of different components of which one at least is not the largest, is compared whole in the
same way, so no link is lost. Set members are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words, simhash
from ._common import Scratch, frugal, no_null
from ._graph import connected_components

SHINGLE, ROWS, BANDS, LEADERS, TWENTIETH = 5, 5, 30, 8, 20
#: Texts and members that the order of members is drawn from, and how often a member is in them at least.
SAMPLE, FREQUENT, OFTEN = 1 << 14, 1 << 16, 4
#: Words of 64 parity bits of a set: those compared while lists are met, and the most that pairs are compared by before their sets are read.
PARITY, WIDEST = 8, 1024
_U = np.uint64
_SEEDS = _words.mix(np.arange(1, 2 * ROWS * BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)).reshape(2, -1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, text after text, and the offsets of the texts."""
    starts, ends, at = _words.words(buf, off)
    roll = _words.Rolling(_words.word_hashes(buf, starts, ends))
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    owner = np.repeat(np.arange(len(n)), count)
    s = at[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    h = roll.runs(s, np.minimum(s + k, at[owner + 1]))
    order = np.lexsort((h, owner))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])  # owner is in order already
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(n)))]).astype(np.int64)


def band_keys(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of BANDS MinHash keys for each text; texts without words share theirs. For estimates: candidates don't come from them."""
    full = np.flatnonzero(np.diff(off) > 0)
    out = np.zeros((len(off) - 1, BANDS), _U)
    for band in range(BANDS):
        key = np.full(len(off) - 1, band, _U)
        for i in range(band * ROWS, band * ROWS + ROWS):
            if len(full):
                key[full] = _words.mix(key[full] * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat((h ^ _SEEDS[0, i]) * (_SEEDS[1, i] | _U(1)), off[full]))
        out[:, band] = key
    return out


def _lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.view(np.int64)))


def prefixes(h: np.ndarray, off: np.ndarray, often: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(0.8 n) + 1 members of each set, in order of how often they are in a sample (often, in order, and times), then by value; and their offsets."""
    n = np.diff(off)
    owner, weight = np.repeat(np.arange(len(n)), n), np.zeros(len(h), np.int64)
    if len(often) and len(h):
        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
        weight = np.where(often[at] == h, times[at], 0)
    order = np.lexsort((h, weight, owner))
    count = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
    to = np.concatenate([[0], np.cumsum(count)])
    return h[order][np.repeat(off[:-1] - to[:-1], count) + np.arange(to[-1])], to


def parity(h: np.ndarray, off: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """PARITY words for each set, or so many: whether an odd number of members falls on a bit. Two sets differ in as many members as bits, or more."""
    n = np.diff(off)
    bits = 64 * (np.full(len(n), PARITY) if words is None else words)
    to = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(to[:-1], n) + (_words.mix(h) % np.repeat(bits, n).astype(_U)).astype(np.int64)
    odd = (np.bincount(at, minlength=to[-1]) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(_U)


def widths(n: np.ndarray) -> np.ndarray:
    """Words of parity for sets of n members: a bit a member or more, WIDEST at most. Powers of two, so halves of the wider of two can be laid on each other."""
    return np.minimum(PARITY << np.ceil(np.log2(np.maximum(n / (64 * PARITY), 1))).astype(np.int64), WIDEST)


def _sketches(often: np.ndarray, times: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, buf, off in _words.slices(iter([b]), 2):
                h, at = shingle_sets(buf, off)
                prints = pa.array(simhash.of_sets(h, at).view(np.int64))
                odd = _lists(parity(h, at), np.arange(part.num_rows + 1) * PARITY)
                words = widths(np.diff(at))
                wide = _lists(parity(h, at, words), np.concatenate([[0], np.cumsum(words)]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(at)), prints, odd, wide, _lists(*prefixes(h, at, often, times))], names=["id", "seq", "n", "fp", "odd", "wide", "prefix"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, buf, off in _words.slices(iter([b]), 1):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(*shingle_sets(buf, off))], names=["seq", "set"])


def sequence(text_col: str) -> Column:
    """A hash of the text's words in order, in lower case: equal for copies."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(no_null(text_col)), r"[\x20\x09-\x0D]+", " ")))


def similar(x: Column, y: Column) -> Column:
    """Whether two sets' Jaccard similarity is 0.8 or more, in whole numbers."""
    both = F.size(F.array_intersect(x, y))
    return 9 * both >= 4 * (F.size(x) + F.size(y))


def _likely(na: str, nb: str) -> Column:
    """Whether sizes leave 0.8 possible."""
    return 5 * F.least(na, nb) >= 4 * F.greatest(na, nb)


def _placed(na: str, nb: str, i: str, j: str) -> Column:
    """Whether 0.8 is possible if the first common member of sets of na and nb has places i and j in them."""
    return _likely(na, nb) & (9 * F.least(F.col(na) - F.col(i), F.col(nb) - F.col(j)) >= 4 * (F.col(na) + F.col(nb)))


def _xor(x: Column, y: Column) -> Column:
    return x.bitwiseXOR(y)


def _close(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts (seq, n, wide) that sizes and parity bits leave possible: few others are left to be verified."""
    x, y = (own.select(F.col("seq").alias(k), F.col("n").alias(f"n{k}"), F.col("wide").alias(f"w{k}")) for k in "ab")
    words = F.least(F.size("wa"), F.size("wb"))  # of likely sizes, one has twice the other's at most
    laid = (F.when(F.size(w) > words, F.zip_with(F.slice(w, 1, words), F.slice(w, words + 1, words), _xor)).otherwise(F.col(w)) for w in ("wa", "wb"))
    differ = F.aggregate(F.zip_with(*laid, _xor), F.lit(0), lambda n, w: n + F.bit_count(w))
    return pairs.join(x, "a").join(y, "b").where(_likely("na", "nb") & (9 * differ <= F.col("na") + F.col("nb"))).select("a", "b")


def _links(pairs: DataFrame, texts: DataFrame, names: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) at 0.8 or more, by whole sets of their texts (id, text), which are found by id before words are looked at."""
    if pairs.isEmpty():
        return pairs
    wanted = scratch.save(pairs.select(F.col("a").alias("seq")).union(pairs.select("b")).distinct().join(names, "seq").select("seq", "id"), "wanted")
    read = texts.join(wanted.select("id").distinct(), "id", "left_semi").select("id", sequence("text").alias("seq"), F.lower("text").alias("text"))
    sets = read.join(wanted, ["seq", "id"], "left_semi").select("seq", "text").mapInArrow(frugal(_sets), "seq long, set array<long>")
    sets = scratch.save(sets.dropDuplicates(["seq"]), "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return scratch.save(both.where(similar(F.col("x"), F.col("y"))).select("a", "b"), "links")


def _pairs(x: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of (a, b, na, nb) whose sizes leave 0.8 possible."""
    x = x.where((F.col("a") != F.col("b")) & _likely("na", "nb"))
    return x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _led(longs: DataFrame, largest: int, turn: int) -> DataFrame:
    """Pairs of texts (seq, n, root, posts) in long lists with leaders of their lists that have other roots, LEADERS for a text, drawn anew each turn.

    Texts of the largest component are only leaders: what is to join it is compared from its own side.
    """
    draw = lambda c, i: F.xxhash64(c, F.lit(turn * 4 + i))
    posts = longs.select("seq", "n", "root", F.explode("posts.key").alias("key"))
    lead = posts.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.array(*(F.min_by(F.struct("seq", "n", "root"), draw("seq", i)) for i in range(4))).alias("l"))
    lead = lead.where("r <> s").select("key", "l")  # of lists that are not one component
    met = posts.where(F.col("root") != largest).join(lead, "key")
    met = met.select("seq", "n", F.filter("l", lambda x: x["root"] != F.col("root")).alias("l")).where(F.size("l") > 0)
    own = met.groupBy("seq", "n").agg(F.array_distinct(F.flatten(F.collect_set("l"))).alias("l"))  # four for each list of its prefix at most
    own = own.select("seq", "n", F.explode(F.slice(F.array_sort(F.transform("l", lambda x: F.struct(draw(x["seq"], 0).alias("h"), x["seq"].alias("seq"), x["n"].alias("n")))), 1, LEADERS)).alias("l"))
    return _pairs(own.select(F.col("seq").alias("a"), F.col("n").alias("na"), F.col("l.seq").alias("b"), F.col("l.n").alias("nb")))


def _rest(longs: DataFrame, largest: int) -> DataFrame:
    """All pairs of texts (seq, n, root, odd, posts) of different components that a long list holds and sizes, places and parity bits leave possible."""
    posts = longs.select("seq", "n", "root", "odd", F.explode("posts").alias("post")).select("post.key", "post.place", "seq", "n", "root", "odd")
    apart = posts.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
    posts = posts.join(apart, "key")
    x = posts.where(F.col("root") != largest).select("key", *(F.col(c).alias(f"{c}_a") for c in ("place", "seq", "n", "root", "odd")))
    y = posts.select(F.col("key").alias("key_b"), *(F.col(c).alias(f"{c}_b") for c in ("place", "seq", "n", "root", "odd")))
    differ = sum(F.bit_count(F.col("odd_a")[i].bitwiseXOR(F.col("odd_b")[i])) for i in range(PARITY))
    once = (F.col("root_b") == largest) | (F.col("seq_a") < F.col("seq_b"))
    found = x.join(y, (F.col("key") == F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & once & _placed("n_a", "n_b", "place_a", "place_b") & (9 * differ <= F.col("n_a") + F.col("n_b")))
    return found.select(F.least("seq_a", "seq_b").alias("a"), F.greatest("seq_a", "seq_b").alias("b")).distinct()


def _near_prints(names: DataFrame) -> DataFrame:
    """Pairs of texts (seq, n, fp) whose fingerprints are equal or link in the positional index: of each fingerprint its first text with the others, and with those of fingerprints it links to."""
    first = names.groupBy("fp").agg(F.min(F.struct("seq", "n")).alias("f"))
    equal = names.join(first, "fp").select(F.col("seq").alias("a"), F.col("n").alias("na"), F.col("f.seq").alias("b"), F.col("f.n").alias("nb"))
    x, y = (first.select(F.col("fp").alias(k), F.col("f.seq").alias(f"s{k}"), F.col("f.n").alias(f"n{k}")) for k in "ab")
    linked = simhash.links(first.select("fp"), 2).join(x, "a").join(y, "b").select(F.col("sa").alias("a"), "na", F.col("sb").alias("b"), "nb")
    return _pairs(equal.union(linked))


def _frequent(texts: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The members that are most often in a sample of some SAMPLE texts, FREQUENT at most, and how often. Only the order of members depends on it, no result."""
    part = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(max(1, texts.count() // SAMPLE))) == 0
    lower = texts.select(F.lit(0).cast("long").alias("seq"), F.lower("text").alias("text"))
    sets = lower.where(part).dropDuplicates(["text"]).mapInArrow(frugal(_sets), "seq long, set array<long>")
    members = sets.select(F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("times")).where(F.col("times") >= OFTEN)
    top = scratch.save(members.orderBy(F.desc("times"), "h").limit(FREQUENT), "frequent").toArrow()
    h, times = top["h"].to_numpy().astype(np.int64).view(_U), top["times"].to_numpy()
    order = np.argsort(h)
    return h[order], times[order]


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_limit: int = 32) -> DataFrame:
    """(seq, id, root): each distinct word sequence, its least id, and its component's name, for texts linked at 0.8 or more."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), no_null(text_col).alias("text"))
    sketches = frugal(_sketches(*_frequent(texts, scratch)))
    rows = scratch.save(texts.select("id", sequence("text").alias("seq"), F.lower("text")).mapInArrow(sketches, f"id {kind}, seq long, n long, fp long, odd array<long>, wide array<long>, prefix array<long>"), "sketches")
    names = scratch.save(rows.groupBy("seq").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("fp").alias("fp")), "names")
    own = scratch.save(rows.select("seq", "n", "odd", "wide", "prefix").dropDuplicates(["seq"]), "own")  # equal in copies
    scratch.keep(names, own)
    posts = own.select("seq", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("place", "key"))
    sizes = posts.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    lists = scratch.save(posts.join(sizes, "key"), "lists")
    short, long = lists.where(F.col("size") <= list_limit), lists.where(F.col("size") > list_limit)
    longs = long.groupBy("seq").agg(F.collect_list(F.struct("key", "place")).alias("posts"))  # a prefix at most
    longs = scratch.save(own.select("seq", "n", "odd").join(longs, "seq"), "long")
    x = short.select("key", F.col("seq").alias("a"), F.col("n").alias("na"), F.col("place").alias("i"))
    y = short.select(F.col("key").alias("key_b"), F.col("seq").alias("b"), F.col("n").alias("nb"), F.col("place").alias("j"))
    met = x.join(y, (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & _placed("na", "nb", "i", "j"))
    heads = long.groupBy("key").agg(F.min(F.struct("seq", "n")).alias("f"))
    led = long.join(heads, "key").groupBy("seq").agg(F.min("n").alias("na"), F.min("f").alias("f"))  # the least of the first members of its lists
    led = _pairs(led.select(F.col("seq").alias("a"), "na", F.col("f.seq").alias("b"), F.col("f.n").alias("nb")))
    every = scratch.save(_close(met.select("a", "b").distinct(), own), "every")
    first = every.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    tried = scratch.save(_near_prints(names).union(led).distinct(), "tried")
    pairs = scratch.save(first.union(_close(tried, own)).distinct(), "pairs")
    own = scratch.save(own.select("seq", "n", "wide"), "wide")
    scratch.keep(names, own, longs, every, tried, pairs)
    roots, turn, last = None, 0, longs.isEmpty()
    while True:
        found = _links(pairs, texts, names, scratch)
        few = TWENTIETH * found.count() <= tried.count()
        if roots is not None:
            found = found.union(roots.select("node", "root"))
        roots = scratch.save(connected_components(found, scratch), "roots")
        scratch.keep(names, own, longs, every, pairs, roots)
        turn += 1
        if last and turn > 1:
            break
        at = longs.join(roots, longs.seq == roots.node, "left").select("seq", "n", F.coalesce("root", "seq").alias("root"), "odd", "posts")
        top = at.groupBy("root").count().orderBy(F.desc("count"), "root").first()
        if turn == 1:  # the pairs of short lists that are still apart
            rest = every.join(pairs, ["a", "b"], "left_anti").join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
            rest = rest.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
            more = rest if last else rest.union(_led(at, top.root, turn)).distinct()
        else:
            last = few
            more = _rest(at, top.root) if last else _led(at, top.root, turn)
        tried = scratch.save(more, "tried")
        pairs = scratch.save(_close(tried, own), "pairs")
    named = scratch.save(names.join(roots, names.seq == roots.node, "left").select("seq", "id", F.coalesce("root", "seq").alias("root")), "named")
    scratch.keep(named)
    return named


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_limit: int = 32) -> DataFrame:
    """The rows of docs, one for each component of near duplicates: that with the least id.

    Rows without an id have no place in that order and stay. Texts without words are copies; of
    repeated rows, and of different texts with one id and one sequence of words, any stays. All
    columns are kept; names beginning with _lw_ are taken. An empty table gives an empty result.
    """
    own = docs.where(F.col(id_col).isNotNull())
    least = components(own, id_col, text_col, list_limit).groupBy("root").agg(F.min(F.struct("id", "seq")).alias("k"))
    kept = least.select(F.col("k.id").alias("_lw_id"), F.col("k.seq").alias("_lw_kept"))
    own = own.withColumn("_lw_seq", sequence(text_col))
    own = own.join(kept, (F.col(id_col) == F.col("_lw_id")) & (F.col("_lw_seq") == F.col("_lw_kept")), "left_semi")
    return own.dropDuplicates([id_col, "_lw_seq"]).drop("_lw_seq").union(docs.where(F.col(id_col).isNull()))
