import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from lodewell.llm import trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(convs):
    """Rows of the trie over {id: [(role, text), ...]}."""
    members, kids = defaultdict(list), defaultdict(set)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
            if d:
                kids[tuple(convs[c][: d - 1])].add(tuple(convs[c][:d]))
    leaves, saved = {}, {}
    for x in sorted(members, key=len, reverse=True):
        own = (len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        leaves[x] = sum(leaves[k] for k in kids[x]) or 1
        saved[x] = own + sum(saved[k] for k in kids[x])
    return sorted(((m[0], len(x), members[x[:-1]][0] if x else None, len(m), len(kids[x]), leaves[x], saved[x], hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(x)).encode()).hexdigest()) for x, m in members.items()), key=str)


def rebuilt(rows, every=20, shared=4):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    out = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        out[c] = own.get(c - c % every, [])[:h] + x[h:]
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "own", 3) for r in rows], "conv_id long, turn long, role string, text string, key string, n_words int").repartition(3)


def found(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


@pytest.mark.parametrize("ranges,fan,run,piece", [(1, 64, 4096, 8192), (7, 2, 5, 3), (40, 3, 1, 1), (64, 64, 17, 50)])
def test_against_plain(spark, ranges, fan, run, piece):
    """Long equal groups, prefixes of one another, empty and long conversations, over ranges, levels of merging and pieces of ids."""
    r, rows = random.Random(ranges), []
    for c in range(300):
        many = r.choice([0, 1, 2, 3, 5])
        rows += [(c, t, r.choice(["user", None]), r.choice(["a b", "c", "", None, "d e f"])) for t in range(many)]
    rows += [(c, t, "user", "the same words") for c in range(1000, 1150) for t in range(2)]
    rows += [(c, 0, "user", "alone") for c in range(3001, 3010)]  # without conversation 3000
    rows += [(5, 2**40, "x", "later"), (6, None, None, None), (None, 1, "a", "b"), (2000, 0, "user", "w " * 50_000)] + [(2001, t, "user", f"turn {t % 7}") for t in range(400)]
    rows += [(c, t, "user", f"turn {t % 7}") for c in (2002, 2003) for t in range(200 + c - 2002)]
    want = rebuilt(rows)
    got = trie.trie(trie.rebuilt(trie.turns(conversations(spark, rows))), ranges, fan, run, piece)
    assert found(got) == plain(want)
    assert any(not x for x in want.values())  # a conversation may be rebuilt without turns


def test_small_tables(spark):
    assert trie.trie(trie.rebuilt(trie.turns(conversations(spark, [])))).count() == 0
    only = [(7, 0, "user", "one two"), (7, 0, "user", "one two")]  # repeated rows are turns of their own
    assert found(trie.trie(trie.rebuilt(trie.turns(conversations(spark, only))))) == plain(rebuilt(only))
    assert trie.trie(trie.turns(conversations(spark, [(None, 1, "a", "b")]))).count() == 0


def test_role_and_text_are_told_apart(spark):
    rows = [(20, 0, "ab", "c"), (40, 0, "a", "bc"), (60, 0, "", "abc"), (80, 0, None, "abc")]
    assert found(trie.trie(trie.turns(conversations(spark, rows)))) == plain({c: [(role or "", text)] for c, _, role, text in rows})


def test_merge_compares_shared_turns_once():
    r = random.Random(5)
    shared = [bytes([x]) for x in range(100)]
    items = [(shared + [bytes([r.randrange(4)]) for _ in range(r.randrange(6))], i, []) for i in range(2000)]
    tree = trie.LoserTree([trie.run_of(items[k : k + 100]) for k in range(0, 2000, 100)])
    out = [(x[1], x[2], x[0]) for x in tree]
    assert [x[:2] for x in out] == sorted((k, i) for k, i, _ in items)
    for (a, _, _), (b, _, lcp) in zip(out, out[1:], strict=False):
        assert lcp == trie.shared_prefix(a, b)
    # The 100 shared turns are compared by the 19 first matches only; each of the five matches an item plays looks at no more than the turns behind them, and one more.
    assert tree.compared <= 19 * 101 + 5 * 2000 * 7 < 0.1 * 5 * 2000 * 100


def test_query_against_sql(spark):
    at, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"create view conversations as from '{at}/conversations.parquet'")
    cur = con.execute(trie.OP13_SQL)
    names = [d[0] for d in cur.description]
    assert names == NAMES and found(trie.op13_conversation_trie(spark, at)) == sorted(cur.fetchall(), key=str)
