import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lodewell.llm import lm

W = re.compile(r"[^\x20\x09-\x0D]+")


def toks(text):
    return W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [0]


def brute(train, texts):
    uni, bi = Counter(), Counter()
    for t in train:
        own = toks(t)
        uni.update(own)
        bi.update(zip([1, *own], own, strict=False))
    n, v = sum(uni.values()), len(uni)
    left, follow = Counter(w for _, w in bi), defaultdict(list)
    for (u, _), c in bi.items():
        follow[u].append(c)

    def discounts(counts):
        of = Counter(counts)
        if min(of[i] for i in (1, 2, 3, 4)) == 0:
            return [0, 0.5, 1, 1.5]
        y = of[1] / (of[1] + 2 * of[2])
        d = [1 - 2 * y * of[2] / of[1], 2 - 3 * y * of[3] / of[2], 3 - 4 * y * of[4] / of[3]]
        return [0, *(min(max(x, 0.01), k + 0.99) for k, x in enumerate(d))]

    d2, d1 = discounts(bi.values()), discounts(left.values())
    k = sum(left.values())
    floor = (sum(d1[min(c, 3)] for c in left.values()) / k if k else 1) / (v + 1)
    out = []
    for t in texts:
        own, base, score = toks(t), 0, 0
        for u, w in zip([1, *own], own, strict=False):
            base += math.log10((uni[w] + 1) / (n + v + 1))
            p = (max(left[w] - d1[min(left[w], 3)], 0) / k if k else 0) + floor
            if u in follow:
                c, total = bi[u, w], sum(follow[u])
                p = max(c - d2[min(c, 3)], 0) / total + sum(d2[min(x, 3)] for x in follow[u]) / total * p
            score += math.log10(p)
        out.append((len(own), sum(uni[w] > 0 for w in own), n, base, score))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_brute_force(spark, docs_of, tmp_path, monkeypatch, hot):
    if hot:  # every second word is frequent: contexts are spread over all buckets
        monkeypatch.setattr(lm, "max", lambda *a: 2 if a[0] == 1000 else max(*a), raising=False)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 4000)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in rows[:120]] + [(500, None), (501, ""), (502, "a " * 700), (503, "Ünseen wørds only"), (None, "The end")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    want = brute([t for i, t in rows if not held(i)], [t for _, t in rows])
    got = {r.doc_id: r for r in lm.op10_kneser_ney(spark, str(tmp_path)).collect()}
    for (i, _), (n, known, total, base, score) in zip(rows, want, strict=True):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held(i))
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_empty(spark, docs_of):
    model = lm.KneserNey.fit(docs_of([]))
    assert model.score(docs_of([])).count() == 0
    r = model.score(docs_of([(1, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
