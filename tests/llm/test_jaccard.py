import random
import re

import numpy as np

import corpus_pipeline
from lodewell.llm import jaccard

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = W.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(x, y):
    return not (x or y) or 10 * len(x & y) >= 8 * len(x | y)


def corpus(groups=12, copies=6, seed=4):
    """Clean texts, near copies of them by a few words changed, texts that share half, and texts of few words."""
    r = random.Random(seed)
    text = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    rows = []
    for _ in range(groups):
        base = text(r.randint(60, 300))
        rows.append(" ".join(base))
        for _ in range(copies):
            x = list(base)
            for at in r.sample(range(len(x)), max(1, len(x) // r.choice([30, 45, 80]))):
                x[at] = f"z{r.randrange(500)}"
            rows.append("  ".join(x).upper() if r.random() < 0.3 else " ".join(x))
        rows.append(" ".join(base[: len(base) // 2] + text(len(base) // 2)))
        rows.append(" ".join(text(120)))
    return list(enumerate([*rows, "one two three", "One  two three", "one two", None, " ", ""]))


def brute(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, x in sets.items():
        for j in range(i):
            if near(x, sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def test_stage_drops_near_copies_and_keeps_clean_texts(spark, docs_of):
    rows = corpus()
    want = brute(rows)
    kept = corpus_pipeline.near_dedup(spark, docs_of(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert len(set(want.values())) < len(rows) - 40  # there are near copies


def test_long_lists(spark, docs_of):
    rows = corpus(3, 30)
    want = brute(rows)
    for limit in (2, 8, 1000):
        kept = jaccard.drop_near_duplicates(docs_of(rows), list_limit=limit)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_sets():
    texts = ["A b c d e f", "", "x", "é é é é é é é", "a b c d e f"]
    raw = [t.lower().encode() for t in texts]
    h, off = jaccard.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.diff(off).tolist() == [len(shingles(t)) for t in texts]
    assert (h[off[0] : off[1]] == h[off[4] : off[5]]).all()
    keys = jaccard.band_keys(h, off)
    assert (keys[0] == keys[4]).all() and (keys[0] != keys[2]).all()


def test_ids(spark, docs_of):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (7, base.upper()), (5, base), (5, "another text of that id"), (None, base), (None, None)]
    kept = jaccard.drop_near_duplicates(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), str(r.text)[:7]) for r in kept) == [("5", "another"), ("5", "word0 w"), ("None", "None"), ("None", "word0 w")]
    assert jaccard.drop_near_duplicates(docs_of([])).count() == 0


def test_no_link_is_lost_in_long_lists(spark, docs_of):
    """Pairs in a crowd of texts that share most of their words but are under 0.8 to all but their partners; all lists are long."""
    r = random.Random(7)
    base, rows = [f"w{i}" for i in range(200)], []
    for k in range(60):
        one = list(base)
        for at in r.sample(range(0, 200, 5), 5):
            one[at] = f"u{k}x{at}"
        two = list(one)
        for at in r.sample([i for i in range(0, 200, 5) if two[i][0] == "w"], 3):
            two[at] = f"v{k}x{at}"
        rows += [" ".join(one), " ".join(two)]
    rows = list(enumerate(rows))
    want = brute(rows)
    assert 50 < len(set(want.values())) < 100
    for limit in (1, 32):
        got = {r.id: r.root for r in jaccard.components(docs_of(rows), list_limit=limit).collect()}
        least = {}
        for i, root in got.items():
            least[root] = min(least.get(root, i), i)
        assert {i: least[root] for i, root in got.items()} == want


def test_prefixes_meet():
    """Any two sets at 0.8 or more have a member in common in their prefixes, whatever the order; parity bits never differ in more places than sets do."""
    r = random.Random(1)
    for n in (1, 2, 3, 4, 5, 9, 10, 37, 200):
        for _ in range(30):
            x = {r.getrandbits(64) for _ in range(n)}
            y = set(r.sample(sorted(x), max(1, n - r.randint(0, n // 5)))) | {r.getrandbits(64) for _ in range(r.randint(0, n // 8))}
            both = np.array([*sorted(x), *sorted(y)], np.uint64)
            off = np.array([0, len(x), len(x) + len(y)])
            often = np.sort(np.array(r.sample(sorted(x), max(1, n // 3)), np.uint64))
            h, to = jaccard.prefixes(both, off, often, np.arange(5, 5 + len(often)))
            assert not near(x, y) or set(h[: to[1]].tolist()) & set(h[to[1] :].tolist())
            a, b = jaccard.parity(both, off).reshape(2, -1)
            assert int(np.bitwise_count(a ^ b).sum()) <= len(x ^ y)


def test_sets_are_read_for_likely_pairs_only(spark, docs_of, monkeypatch):
    """Long texts that share two thirds of their shingles meet in lists, but parity bits part them before whole sets are read and joined."""
    r, read, save = random.Random(3), [], jaccard.Scratch.save
    base, rows = [f"w{i}" for i in range(900)], []
    for k in range(40):
        at = 20 * k
        rows.append(base[:at] + [f"u{k}x{i}" for i in range(175)] + base[at + 175 :])
    for k in (3, 17):
        two = list(rows[k])
        for at in r.sample(range(0, 900, 10), 8):
            two[at] = f"v{k}x{at}"
        rows.append(two)
    rows = list(enumerate(map(" ".join, rows)))

    def counted(self, df, name, *more):
        out = save(self, df, name, *more)
        read.extend([out.count()] if name == "sets" else [])
        return out

    monkeypatch.setattr(jaccard.Scratch, "save", counted)
    want = brute(rows)
    assert 30 < len(set(want.values())) <= 40  # neighbours and the planted two
    for limit in (4, 32):
        del read[:]
        kept = jaccard.drop_near_duplicates(docs_of(rows), list_limit=limit)
        assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want.values()))
        assert 0 < max(read) <= 12, (limit, read)


def test_close_drops_no_link(spark):
    """Parity bits of any two widths: no pair at 0.8 or more goes, and pairs far from it do, whichever of the two is wider."""
    r, rows, pairs, likely = random.Random(5), [], [], set()
    for n in (1, 5, 60, 505, 512, 513, 540, 1020, 1030, 3000, 70000):
        x = [r.getrandbits(64) for _ in range(n)]
        for lost, more in ((0, 0), (n // 10, n // 9), (0, n // 4), (n // 5, 0), (n // 2, n // 2)):
            y = x[lost:] + [r.getrandbits(64) for _ in range(more)]
            a, b = len(rows), len(rows) + 1
            rows += [x, y]
            pairs += [(a, b), (b, a)]
            if near(set(x), set(y)):
                likely |= {(a, b), (b, a)}
    n = np.array([len(x) for x in rows])
    wide = jaccard.widths(n)
    assert (wide & (wide - 1) == 0).all() and (64 * wide >= np.minimum(n, 64 * jaccard.WIDEST)).all() and set(wide.tolist()) >= {8, 16, 32, 64, jaccard.WIDEST}
    odd = jaccard.parity(np.concatenate([np.array(x, np.uint64) for x in rows]), np.concatenate([[0], np.cumsum(n)]), wide).view(np.int64)
    own = [(i, int(n[i]), x.tolist()) for i, x in enumerate(np.split(odd, np.cumsum(wide)[:-1]))]
    found = jaccard._close(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(own, "seq long, n long, wide array<long>"))
    found = {(x.a, x.b) for x in found.collect()}
    assert likely <= found
    assert not any((a, b) in found for a, b in pairs if n[a] > 50 and 10 * len(set(rows[a]) & set(rows[b])) < 5 * len(set(rows[a]) | set(rows[b])))
