import itertools
import random
import re

import pytest

from lodewell.llm import licenses

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    """n_words, n_base, first_word, last_word, base_labels by comparing at every word."""
    w, at = words_of(text), []
    for p, label in PHRASES.items():
        own = p.split()
        at += [(i, label) for i in range(len(w) - len(own) + 1) if w[i : i + len(own)] == own]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    None, "", " \n\t", "CC BY", "cc-by cc by,cc\nby", "occ by", "cc bye", "ccby", "éCC BY", "CC BYé", "CC\x00BY", "All RIGHTS   reserved.", "all rights all rights reserved reserved",
    "# Licensed under the GNU General Public License, version 3.", "General Public General Public License", "ÀCC cc by ÉÈ", " cc by cc by", "x " * 70_000 + "cc by",
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */\nall rights reserved", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\r\nmore", "spdx license identifier", "Released under the MIT License.",
]


def test_base_against_plain(spark, docs_of):
    r = random.Random(2)
    made = ["".join(r.choice(["cc ", "by ", "CC-BY ", "general ", "public ", "license", " ", "\n", "all rights ", "reserved", "é", "0"]) for _ in range(r.randrange(40))) for _ in range(500)]
    rows = [(i, t) for i, t in enumerate(TEXTS + made)] + [(3, "CC BY"), (3, "CC BY"), (None, "cc by")]
    got = licenses.scan(docs_of(rows).withColumnsRenamed({"lang": "labels", "source": "score"})).collect()
    assert sorted(((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((i, *base(t)) for i, t in rows), key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert all(r.labels.split(",") == sorted(set(r.labels.split(","))) for r in got)
    assert licenses.scan(docs_of([])).count() == 0


def said(text):
    n, b, first, last, base_labels, labels, terms, allowed, score = licenses.found_in(text, licenses.Scanner(licenses.phrases()), licenses.PERMISSIVE)
    return labels, terms, allowed


def test_labels():
    assert said("Released under the MIT License.") == ("MIT", [], True)
    assert said("This work is licensed under the GNU General Public License, version 3.") == ("GPL-3.0-only,gpl", [], False)
    assert said("Licensed under the Apache License, Version 2.0.") == ("Apache-2.0", [], True)
    assert said("Licensed under CC BY-NC 4.0.") == ("CC-BY-NC-4.0,cc-by", [], False)
    assert said("All rights reserved.") == ("reserved", [], None)
    assert said("plain text by a licensed driver") == ("", [], None)
    assert said("/* SPDX-License-Identifier: (mit or apache-2.0) */")[1] == ["mit OR apache-2.0"]
    assert said("# SPDX-License-Identifier: MIT OR GPL-2.0-only WITH Classpath-exception-2.0\nMPL-2.0") == ("GPL-2.0-only WITH Classpath-exception-2.0,MIT", ["MIT OR GPL-2.0-only WITH Classpath-exception-2.0"], True)
    assert said("SPDX-License-Identifier: MIT AND GPL-2.0-only")[2] is False


@pytest.mark.parametrize("text,shown", [
    ("MIT", "MIT"), ("MIT OR", "MIT"), ("OR MIT", None), ("(MIT", None), ("MIT)", "MIT"), ("()", None), ("A OR B AND C", "A OR B AND C"), ("(A OR B) AND C", "(A OR B) AND C"), ("((A) AND (B OR C))", "A AND (B OR C)"),
    ("A WITH x OR B", "A WITH x OR B"), ("A WITH B WITH C", "A WITH B"), ("(A OR B) WITH x", "A OR B"), ("A WITH (x)", "A"), ("GPL-2.0+ AND LicenseRef-own", "GPL-2.0+ AND LicenseRef-own"), ("A B", "A"), ("", None), ("A AND OR B", "A"), ("A AND (B OR", "A"),
])
def test_parser(text, shown):
    e = licenses.parsed(text)
    assert (None if e is None else str(e)) == shown


def test_evaluation_against_python():
    """Random expressions with all sets of allowed names, against Python's own operators."""
    r, names = random.Random(4), ["A", "B", "C", "D"]

    def expression(depth):
        if not depth or r.random() < 0.3:
            return r.choice(names)
        x = f"{expression(depth - 1)} {r.choice(['AND', 'OR', 'and', 'or'])} {expression(depth - 1)}"
        return f"({x})" if r.random() < 0.5 else x

    for _ in range(150):
        text = expression(4)
        e = licenses.parsed(text)
        again = licenses.parsed(str(e))
        assert set(e.operands()) == set(re.findall(r"\b[ABCD]\b", text)) and len(str(e)) <= len(text)
        for k in range(5):
            for allowed in itertools.combinations(names, k):
                want = eval(re.sub(r"\b[ABCD]\b", lambda m: str(m[0] in allowed), text).replace("AND", "and").replace("OR", "or"))  # noqa: S307, B023
                assert e.allowed(frozenset(allowed)) == want == again.allowed(frozenset(allowed))


def test_exceptions_and_suffixes():
    e = licenses.parsed("GPL-2.0-only WITH Classpath-exception-2.0")
    assert not e.allowed(frozenset({"MIT"})) and e.allowed(frozenset({"GPL-2.0-only"})) and e.allowed(frozenset({"GPL-2.0-only WITH Classpath-exception-2.0"}))
    assert licenses.parsed("GPL-2.0+").allowed(frozenset({"GPL-2.0"})) and not licenses.parsed("GPL-2.0").allowed(frozenset({"GPL-2.0+"}))


def test_query(spark):
    at = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    got = licenses.op11_license_scans(spark, at).collect()
    assert len(got) == len(text)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text[r.doc_id])
