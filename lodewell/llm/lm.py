"""An interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Counting: tasks sum n-grams in chunks and deal them to hash buckets as packed arrays; a
bucket's task merges its arrays by sorting and writes one file of sorted 64-bit hashes with
counts to the shared folder. Contexts of very frequent words (above 1/buckets of all tokens,
so fewer of them than buckets) are spread over all buckets by the following word.
The number of buckets follows the input's bytes, so that a bucket's arrays have a bounded
size. Scoring maps the files (pages are read as they are touched; where the shared folder
is no file system path they are first fetched), looks n-grams up by binary search and sums
log10 probabilities.

    p(w | u) = max(c(uw) - D(c(uw)), 0) / c(u.) + (D1 n1(u) + D2 n2(u) + D3 n3(u)) / c(u.) * p(w)
    p(w) = max(k(w) - D'(k(w)), 0) / k(.) + (D'1 m1 + D'2 m2 + D'3 m3) / k(.) / (V + 1)

with k(w) the number of different words before w, and the discounts from counts of counts. A
text's first word has a start mark as its context; its end is a token. Unknown words share
the probability of one more word of the vocabulary. Hashes have 64 bits; their collisions
are not resolved.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lexical import spread
from ._common import Scratch, held_out, no_null, partitions
from ._words import LOWER, mix, slices, word_hashes, words

_U = np.uint64
END, START = _U(0x1B873593CC9E2D51), _U(0x52DCE729DA3ED5F3)
#: Bytes of text for each bucket, and tokens that a task sums before it deals them out.
BUCKET_BYTES, CHUNK_TOKENS = 16 << 20, 1 << 21


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts, each text's end included, and the index of each text's first token."""
    buf = LOWER[buf]
    s, e, ptr = words(buf, off)
    at = ptr + np.arange(len(ptr))
    out = np.full(at[-1], END, _U)
    here = np.ones(at[-1], bool)
    here[at[1:] - 1] = False
    out[here] = word_hashes(buf, s, e)
    return out, at


def before(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each token's context: the token before it, or the start mark."""
    u = np.empty_like(h)
    u[1:] = h[:-1]
    u[at[:-1]] = START
    return u


def pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * _U(0xC2B2AE3D27D4EB4F) + w)


def _chunks(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens, and which are the first of a text, some millions at a time."""
    hs, firsts, n = [], [], 0
    for _, buf, off in slices(batches, column):
        h, at = tokens(buf, off)
        first = np.zeros(len(h), bool)
        first[at[:-1]] = True
        hs.append(h)
        firsts.append(first)
        n += len(h)
        if n >= CHUNK_TOKENS:
            yield np.concatenate(hs), np.concatenate(firsts)
            hs, firsts, n = [], [], 0
    if n:
        yield np.concatenate(hs), np.concatenate(firsts)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[cut], np.add.reduceat(counts, cut)


def _deal(bucket: np.ndarray, n: int, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket that has entries: the columns' bytes."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n + 1))
    some = np.flatnonzero(cut[1:] > cut[:-1])
    blobs = [[c[order[cut[b] : cut[b + 1]]].tobytes() for b in some] for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", *"xyz"[: len(columns)]])


def _put(base: str, name: str, **arrays: np.ndarray) -> None:
    """A file of a JSON line, padded to 4096 bytes, and arrays. A second attempt writes the same again; a rename makes it whole."""
    head, at, body = {}, 4096, []
    for k, a in arrays.items():
        head[k] = [a.dtype.str, len(a), at]
        body.append(a.tobytes())
        body.append(b"\0" * (-len(body[-1]) % 8))
        at += len(body[-1]) + len(body[-2])
    store, path = fs.FileSystem.from_uri(base)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{os.getpid()}-{os.urandom(4).hex()}"
    with store.open_output_stream(part) as f:
        f.write(json.dumps(head).encode().ljust(4096) + b"".join(body))
    store.move(part, f"{path}/{name}")


_open: dict[str, dict[str, np.ndarray]] = {}


def _get(base: str, name: str) -> dict[str, np.ndarray]:
    """A file's arrays, memory-mapped."""
    if (key := f"{base}/{name}") not in _open:
        store, path = fs.FileSystem.from_uri(base)
        at = f"{path}/{name}"
        if not isinstance(store, fs.LocalFileSystem):
            with tempfile.NamedTemporaryFile() as own:  # its name goes at once, its pages stay mapped
                with store.open_input_stream(at) as f:
                    while part := f.read(1 << 24):
                        own.write(part)
                own.flush()
                raw = np.memmap(own.name, np.uint8, "r")
        else:
            raw = np.memmap(at, np.uint8, "r")
        head = json.loads(bytes(raw[:4096]))
        _open[key] = {k: raw[o : o + np.dtype(d).itemsize * n].view(d) for k, (d, n, o) in head.items()}
    return _open[key]


def _find(base: str, kind: str, files: dict, n: int, keys: np.ndarray, bucket: np.ndarray, *fields: str) -> list[np.ndarray]:
    """The fields' values for the keys, 0 where there is none."""
    out = [np.zeros(len(keys)) for _ in fields]
    order = np.lexsort((keys, bucket))
    cut = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in set(np.flatnonzero(cut[1:] > cut[:-1]).tolist()) & files[kind]:
        own, file = order[cut[b] : cut[b + 1]], _get(base, f"{kind}-{b}")
        have = file["keys"]
        if len(have):
            at = np.minimum(np.searchsorted(have, keys[own]), len(have) - 1)
            hit = have[at] == keys[own]
            for o, f in zip(out, fields, strict=True):
                o[own[hit]] = file[f][at[hit]]
    return out


def _discounts(n: np.ndarray) -> list[float]:
    """D1, D2, D3+ from how many n-grams have counts 1 to 4; 0.5, 1, 1.5 where those are too few for the estimate."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if min(n1, n2, n3, n4) <= 0:
        return [0.0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [0.0, *(min(max(x, 0.01), k + 0.99) for k, x in enumerate(d))]


@dataclass(frozen=True)
class KneserNey:
    """A model fitted on a column of texts; null texts are empty ones. An empty table gives a model that knows no word."""

    base: str  #: the folder of the arrays
    buckets: int
    files: dict[str, frozenset[int]]  #: buckets that have a file, by kind
    hot: np.ndarray  #: contexts spread over the buckets, sorted
    hot_sums: np.ndarray  #: their c(u.), n1(u), n2(u), n3(u)
    train_tokens: int
    vocabulary: int
    links: int  #: k(.)
    d1: list[float]  #: discounts of the lower order
    d2: list[float]  #: discounts of the higher order
    floor: float  #: what every word has at least, an unknown one too

    @classmethod
    def fit(cls, texts: DataFrame, text_col: str = "text") -> KneserNey:
        spark = texts.sparkSession
        scratch = Scratch(spark, "lm")
        base = f"{scratch.root}/arrays"
        texts = texts.select(no_null(text_col).alias("text"))
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(partitions(spark), -(-size // BUCKET_BYTES))
        often = max(1000, size // 8 // n)

        def unigrams(batches):
            for h, _ in _chunks(batches):
                keys, c = np.unique(h, return_counts=True)
                yield _deal((keys % _U(n)).astype(np.int64), n, keys, c.astype(np.int64))

        def keep_unigrams(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            keys, c = _summed(np.frombuffer(b"".join(pdf.x), _U), np.frombuffer(b"".join(pdf.y), np.int64))
            _put(base, f"uni-{key[0]}", keys=keys, c=c)
            return pd.DataFrame({"own": [key[0]], "n": [c.sum()], "v": [len(keys)], "hot": [keys[c > often].tobytes()]})

        got = texts.mapInArrow(unigrams, "bucket int, x binary, y binary").groupBy("bucket").applyInPandas(keep_unigrams, "own int, n long, v long, hot binary").collect()  # a row a bucket; under 8 * buckets words are hot
        total, vocabulary = sum(r.n for r in got), sum(r.v for r in got)
        hot = np.sort(np.frombuffer(b"".join(r.hot for r in got), _U))

        def home(u: np.ndarray, w: np.ndarray) -> np.ndarray:
            return np.where(np.isin(u, hot), mix(w) % _U(n), mix(u) % _U(n)).astype(np.int64)

        def bigrams(batches):
            for h, first in _chunks(batches):
                ids, at = np.unique(h, return_inverse=True)
                last = np.empty_like(at)
                last[1:] = at[:-1]
                last[first] = len(ids)
                ids = np.r_[ids, START]
                both, c = np.unique(last * len(ids) + at, return_counts=True)
                del h, first, at, last
                u, w = ids[both // len(ids)], ids[both % len(ids)]
                yield _deal(home(u, w), n, u, w, c.astype(np.int32))

        def keep_bigrams(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            u, w = (np.frombuffer(b"".join(pdf[k]), _U) for k in "xy")
            c = np.frombuffer(b"".join(pdf.z), np.int32).astype(np.int64)
            order = np.lexsort((w, u))
            u, w, c = u[order], w[order], c[order]
            cut = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
            u, w, c = u[cut], w[cut], np.add.reduceat(c, cut)
            keys = pair(u, w)
            order = np.argsort(keys)
            big = c > 254
            _put(base, f"bi-{key[0]}", keys=keys[order], c=np.where(big, 255, c)[order].astype(np.uint8))
            own = np.sort(keys[big])
            _put(base, f"big-{key[0]}", keys=own, c=c[big][np.argsort(keys[big])])
            cut = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            sums = [np.add.reduceat(x, cut) for x in (c, c == 1, c == 2, c > 2)]
            there = np.isin(u[cut], hot)
            _put(base, f"ctx-{key[0]}", keys=(k := u[cut][~there])[o := np.argsort(k)], **{f"s{i}": s[~there][o].astype(np.int64 if i == 0 else np.int32) for i, s in enumerate(sums)})
            of = [int((c == k).sum()) for k in (1, 2, 3, 4)]
            after, k = np.unique(w, return_counts=True)
            deal = _deal((after % _U(n)).astype(np.int64), n, after, k.astype(np.int32)).to_pandas()
            deal["own"], deal["of"], deal["first"], deal["hot"], deal["sums"] = key[0], [of, *[[0] * 4] * (len(deal) - 1)], np.arange(len(deal)) == 0, b"", b""
            deal.loc[0, "hot"], deal.loc[0, "sums"] = u[cut][there].tobytes(), np.stack(sums)[:, there].astype(np.int64).tobytes()
            return deal

        parts = texts.mapInArrow(bigrams, "bucket int, x binary, y binary, z binary").groupBy("bucket").applyInPandas(keep_bigrams, "bucket int, x binary, y binary, own int, of array<long>, first boolean, hot binary, sums binary")
        parts = scratch.save(parts, "continuations", "none")

        def keep_continuations(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            keys, k = _summed(np.frombuffer(b"".join(pdf.x), _U), np.frombuffer(b"".join(pdf.y), np.int32).astype(np.int64))
            _put(base, f"cont-{key[0]}", keys=keys, k=k)
            return pd.DataFrame({"own": [key[0]], "k": [k.sum()], "of": [[int((k == i).sum()) for i in (1, 2, 3, 4)] + [int((k > 2).sum())]]})

        conts = parts.select("bucket", "x", "y").groupBy("bucket").applyInPandas(keep_continuations, "own int, k long, of array<long>").collect()
        firsts = parts.where("first").select("own", "of", "hot", "sums").collect()  # a row a bucket
        sums: dict[int, np.ndarray] = {}
        for r in firsts:
            us = np.frombuffer(r.hot, _U)
            for u, s in zip(us.tolist(), np.frombuffer(r.sums, np.int64).reshape(4, -1).T, strict=True):
                sums[u] = sums.get(u, 0) + s
        scratch.drop(parts)
        of2 = np.sum([r.of for r in firsts], axis=0) if firsts else np.zeros(4)
        of1 = np.sum([r.of for r in conts], axis=0) if conts else np.zeros(5)
        d1 = _discounts(of1)
        k = sum(r.k for r in conts)
        spare = (d1[1] * of1[0] + d1[2] * of1[1] + d1[3] * of1[4]) / k if k else 1.0
        own = frozenset(r.own for r in firsts)
        files = {"uni": frozenset(r.own for r in got), "cont": frozenset(r.own for r in conts), "bi": own, "big": own, "ctx": own}
        return cls(base=base, buckets=n, files=files, hot=hot, train_tokens=total, vocabulary=vocabulary, d2=_discounts(of2), d1=d1, links=k, floor=float(spare) / (vocabulary + 1), hot_sums=np.array([sums.get(int(u), np.zeros(4)) for u in hot], float).reshape(-1, 4))

    def _home(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.where(np.isin(u, self.hot), mix(w) % _U(self.buckets), mix(u) % _U(self.buckets)).astype(np.int64)

    def log10(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For tokens of texts: how often each is in the training texts, and its log10 probability."""
        n = self.buckets
        ids, of = np.unique(h, return_inverse=True)
        home = (ids % _U(n)).astype(np.int64)
        (c,) = _find(self.base, "uni", self.files, n, ids, home, "c")
        (k,) = _find(self.base, "cont", self.files, n, ids, home, "k")
        d = np.array(self.d1)[np.minimum(k, 3).astype(int)]
        p1 = np.maximum(k - d, 0) / max(1, self.links) + self.floor
        u, at_u = np.unique(before(h, at), return_inverse=True)
        s = _find(self.base, "ctx", self.files, n, u, (mix(u) % _U(n)).astype(np.int64), "s0", "s1", "s2", "s3")
        if len(self.hot):
            i = np.minimum(np.searchsorted(self.hot, u), len(self.hot) - 1)
            hit = self.hot[i] == u
            for j in range(4):
                s[j][hit] = self.hot_sums[i[hit], j]
        both, of_both = np.unique(at_u * len(ids) + of, return_inverse=True)
        iu, iw = both // max(1, len(ids)), both % max(1, len(ids))
        keys, home = pair(u[iu], ids[iw]), self._home(u[iu], ids[iw])
        (c2,) = _find(self.base, "bi", self.files, n, keys, home, "c")
        if (big := c2 == 255).any():
            c2[big] = _find(self.base, "big", self.files, n, keys[big], home[big], "c")[0]
        d = np.array(self.d2)[np.minimum(c2, 3).astype(int)]
        all_u = s[0][iu]
        spare = (self.d2[1] * s[1] + self.d2[2] * s[2] + self.d2[3] * s[3])[iu]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(all_u > 0, np.maximum(c2 - d, 0) / all_u + spare / all_u * p1[iw], p1[iw])
        return c[of], np.log10(p)[of_both]

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_tokens, n_known, train_tokens, base_score, score), one row for each of docs.

        A null or empty text is its end alone; a very long one is read whole. Ids may be null and rows
        repeated; no other column is looked at, whatever its name. An empty table gives an empty result.
        """
        model, most = self, float(self.train_tokens + self.vocabulary + 1)

        def run(batches):
            for b, buf, off in slices(batches, 1, 1 << 23):
                h, at = tokens(buf, off)
                c, lp = model.log10(h, at)
                total = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  no text is without a token
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.diff(at)), pa.array(total((c > 0).astype(np.int64))), pa.array(np.full(b.num_rows, model.train_tokens, np.int64)), pa.array(total(np.log10((c + 1) / most))), pa.array(total(lp))],
                    names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

        kind = docs.schema[id_col].dataType.simpleString()
        return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    model = KneserNey.fit(docs.where(~held_out("doc_id", 2, 7)))
    out = model.score(docs.select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), held_out("id", 2, 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.expr("pow(10D, -score / n_tokens)").alias("perplexity"))
