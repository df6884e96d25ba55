import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodewell.llm import substring

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=35):
    seen, own = Counter(), []
    for i, text in rows:
        words = W.findall(text or "")
        own.append((i, words))
        seen.update(tuple(words[j : j + window]) for j in range(len(words) - window + 1))
    out = []
    for i, words in own:
        gone = [False] * len(words)
        for j in range(len(words) - window + 1):
            if seen[tuple(words[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((i, len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 4)))
    some = [[word() for _ in range(r.choice([34, 35, 36, 50, 90]))] for _ in range(4)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.choice([0, 3, 34, 35, 60, 200]))]
        for p in r.sample(some, r.randint(0, 2)):
            at = r.randint(0, len(words))
            cut = r.randint(0, 3)
            words[at:at] = p[cut:]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "x " * 300), (n + 3, rows[0][1]), (0, rows[0][1]), (None, rows[1][1])]


@pytest.mark.parametrize("limit", [4096, 6, 1])
def test_brute_force(spark, docs_of, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(substring, "GROUP_CONTEXTS", limit)  # 1: every mixed prefix gets longer up to whole windows
    rows = corpus(limit, 60)
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in substring.op4_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_extra_columns(spark, docs_of):
    empty = docs_of([])
    assert substring.marked(empty).count() == 0
    passage = " ".join(f"w{i}" for i in range(60))
    d = docs_of([(1, f"one two\n{passage}\nthree"), (2, f"{passage}"), (3, None), (4, "clean text")]).withColumnRenamed("source", "marks")
    got = {r.doc_id: r for r in substring.remove_repeats(d).collect()}
    assert set(got) == {1, 3, 4} and got[1].text == "one two\nthree" and got[4].text == "clean text" and "marks" in got[1]


def test_prefixes_lengthen(spark, docs_of, monkeypatch):
    """Many copies of a text with changed words: their prefixes have many contexts, and grow until groups fit."""
    from lodewell.llm._common import Scratch

    r = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(80):
        own = list(base)
        for _ in range(r.randint(1, 3)):
            own[r.randrange(len(own))] = f"c{i}-{r.random()}"
        rows.append((i, " ".join(own)))
    rows += [(100, None), (101, ""), (102, " ".join(f"z{i % 700}" for i in range(60_000)))]
    monkeypatch.setattr(substring, "GROUP_CONTEXTS", 8)
    steps, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, *a: steps.append(name) or save(self, df, name, *a))
    docs = docs_of(rows).withColumns({c: F.lit("own") for c in ("id", "tk", "marks", "anchor", "key")})
    found = substring.marked(docs).collect()
    assert steps.count("halves") >= 3 and all(x.anchor == "own" for x in found)
    removed = {x.doc_id: int(substring.covered(len(W.findall(x.text or "")), x["_lw_marks"], 35).sum()) for x in found}
    seen = Counter(tuple(ws[j : j + 35]) for _, t in rows for ws in [W.findall(t or "")] for j in range(len(ws) - 34))
    for i, t in rows:
        ws, gone = W.findall(t or ""), set()
        for j in range(len(ws) - 34):
            if seen[tuple(ws[j : j + 35])] > 1:
                gone.update(range(j, j + 35))
        assert removed[i] == len(gone), i
