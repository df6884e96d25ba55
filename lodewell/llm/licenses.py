"""Licence statements in texts: identifier tags and notice phrases, found by an Aho-Corasick automaton.

One automaton over words holds all phrases: the tag of licence identifiers and the notices by
which licences are known. A text's bytes are mapped once (A-Z to lower case, everything but
letters, digits and non-ASCII to a space, one byte for one), so words are where the bytes aren't
spaces and the automaton walks over them joined by one space; phrases stand between spaces, so
only whole words match, through line ends, comment marks and punctuation. Behind an identifier
tag comes an expression, which is read from the text itself up to the line's end: a
shunting-yard parser puts it in postfix order (WITH before AND before OR) and evaluates it, to
the identifiers in it and to whether a policy's licences satisfy it.

Matching is by document, so texts need no shuffle; a text is held by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lexical import spread
from ._common import Scratch, frugal

# Phrases and labels that every scan has.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices and the identifiers of the public licence list that they stand for, with how surely they do.
NOTICES = {
    "mit license": ("MIT", 0.9),
    "permission is hereby granted free of charge to any person obtaining a copy": ("MIT", 0.8),
    "apache license": ("Apache-2.0", 0.6),
    "apache license version 2 0": ("Apache-2.0", 1.0),
    "apache license 2 0": ("Apache-2.0", 1.0),
    "bsd license": ("BSD-3-Clause", 0.5),
    "redistribution and use in source and binary forms": ("BSD-3-Clause", 0.6),
    "3 clause bsd": ("BSD-3-Clause", 0.9),
    "2 clause bsd": ("BSD-2-Clause", 0.9),
    "gnu general public license": ("GPL-2.0-or-later", 0.5),
    "general public license version 2": ("GPL-2.0-only", 0.9),
    "general public license version 3": ("GPL-3.0-only", 0.9),
    "gnu lesser general public license": ("LGPL-2.1-or-later", 0.6),
    "gnu affero general public license": ("AGPL-3.0-or-later", 0.7),
    "mozilla public license": ("MPL-2.0", 0.7),
    "mozilla public license version 2 0": ("MPL-2.0", 1.0),
    "eclipse public license": ("EPL-2.0", 0.6),
    "isc license": ("ISC", 0.9),
    "cc by 4 0": ("CC-BY-4.0", 1.0),
    "cc by sa 4 0": ("CC-BY-SA-4.0", 1.0),
    "cc by nc 4 0": ("CC-BY-NC-4.0", 1.0),
    "cc by nd 4 0": ("CC-BY-ND-4.0", 1.0),
    "cc by nc sa 4 0": ("CC-BY-NC-SA-4.0", 1.0),
    "creative commons attribution": ("CC-BY-4.0", 0.5),
    "creative commons attribution 4 0": ("CC-BY-4.0", 0.9),
    "cc0 1 0": ("CC0-1.0", 1.0),
    "creative commons zero": ("CC0-1.0", 0.8),
    "public domain dedication": ("CC0-1.0", 0.6),
    "the unlicense": ("Unlicense", 0.7),
}
TAG = "spdx license identifier"
# What a policy of permissive terms admits.
PERMISSIVE = frozenset({"0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC0-1.0", "ISC", "MIT", "Unlicense", "Zlib"})
#: How much a base phrase alone and an identifier that can be read count for.
BASE_SURE, TAG_SURE = 0.3, 1.0

#: Bytes as the automaton sees them: words of lower-case letters, digits and non-ASCII, and spaces.
MAP = bytes(x + 32 if 0x41 <= x <= 0x5A else x if x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A else 32 for x in range(256))


# expressions

PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}
OPERATORS = {**{x: x for x in PRECEDENCE}, **{x.lower(): x for x in PRECEDENCE}}
TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.:\-]*\+?))")


@dataclass(frozen=True)
class Expression:
    """A licence expression in postfix order, with what it is made of."""

    postfix: tuple[str, ...]

    def operands(self) -> list[str]:
        """Its identifiers, an exception with its licence, in the order of the text."""
        return self._reduced(lambda x: [x], lambda op, a, b: [f"{a[0]} WITH {b[0]}"] if op == "WITH" else a + b)

    def allowed(self, policy: frozenset[str]) -> bool:
        """Whether licences of the policy satisfy it: either side of OR, both of AND; an exception's licence counts for the pair, and the pair may be named. Case doesn't matter."""
        policy = frozenset(x.lower() for x in policy)

        def leaf(x: str):
            return x.lower(), x.lower().removesuffix("+") in policy or x.lower() in policy

        def both(op: str, a, b):
            if op == "WITH":
                return f"{a[0]} with {b[0]}", a[1] or f"{a[0]} with {b[0]}" in policy
            return "", (a[1] or b[1]) if op == "OR" else (a[1] and b[1])

        return self._reduced(leaf, both)[1]

    def __str__(self) -> str:
        """With as few brackets as keep its meaning."""

        def both(op: str, a, b):
            sides = [f"({x})" if rank < PRECEDENCE[op] else x for x, rank in (a, b)]
            return f" {op} ".join(sides), PRECEDENCE[op]

        return self._reduced(lambda x: (x, 9), both)[0]

    def _reduced(self, leaf, both):
        stack = []
        for x in self.postfix:
            if x in PRECEDENCE:
                b, a = stack.pop(), stack.pop()
                stack.append(both(x, a, b))
            else:
                stack.append(leaf(x))
        return stack[0]


def parsed(text: str) -> Expression | None:
    """The longest well-formed expression that text begins with, or None. Operators may be in lower case; WITH joins two names.

    Shunting-yard: names go to the output, operators wait on a stack for those that bind less or
    a closing bracket. What the output and the stack make where a name or a closing bracket has
    been read and no bracket is open is an expression; the last such place counts.
    """
    out, waiting, best, at, depth = [], [], None, 0, 0
    last = "operator"  # what stands before: operator (or nothing, or an opening bracket), name, closed
    while m := TOKEN.match(text, at):
        bracket, word = m[1], m[2]
        op = OPERATORS.get(word)
        if bracket == "(":
            if last != "operator" or waiting[-1:] == ["WITH"]:
                break
            waiting.append("(")
            depth += 1
        elif bracket == ")":
            if last == "operator" or not depth:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth, last = depth - 1, "closed"
        elif op:
            if last == "operator" or op == "WITH" and (last == "closed" or waiting[-1:] == ["WITH"]):
                break
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[op]:
                out.append(waiting.pop())
            waiting.append(op)
            last = "operator"
        elif last == "operator":
            out.append(word)
            last = "name"
        else:
            break
        at = m.end()
        if last != "operator" and not depth:
            best = Expression((*out, *reversed(waiting)))
    return best


# scanning


@dataclass(frozen=True)
class Match:
    """A phrase at a word: kind is base, notice, or tag; a tag's expression is what the text has behind it."""

    word: int
    n_words: int
    kind: str
    label: str
    sure: float
    expression: Expression | None = None


class Scanner:
    """An automaton of phrases (words joined by one space, in lower case): {phrase: [(kind, label, sure), ...]}."""

    def __init__(self, phrases: dict[str, list[tuple[str, str, float]]]):
        self.automaton = ahocorasick.Automaton()
        for phrase, said in phrases.items():
            own = b" ".join(phrase.encode().translate(MAP).split()).decode("latin-1")
            if own:
                self.automaton.add_word(f" {own} ", (len(own) + 1, own.count(" ") + 1, said))
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[Match]]:
        """The number of words, and all matches by place. A null text is empty."""
        raw = (text or "").encode()
        spaced = raw.translate(MAP)
        words = spaced.split()
        if not words or not len(self.automaton):
            return len(words), []
        joined = b" " + b" ".join(words) + b" "
        hits = list(self.automaton.iter(joined.decode("latin-1")))
        if not hits:
            return len(words), []
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        firsts = np.searchsorted(gaps, [end - length for end, (length, _, _) in hits])
        ends = None
        found = []
        for first, (_, (_, many, said)) in zip(firsts.tolist(), hits, strict=True):
            for kind, label, sure in said:
                expression = None
                if kind == "tag":
                    if ends is None:
                        full = np.frombuffer(spaced + b" ", np.uint8) != 32
                        ends = np.flatnonzero(full[:-1] & ~full[1:]) + 1
                    at = int(ends[first + many - 1])
                    until = raw.find(b"\n", at)
                    expression = parsed(raw[at : until if until >= 0 else len(raw)].decode(errors="replace").lstrip(" \t:=\"'"))
                found.append(Match(first, many, kind, label, sure, expression))
        return len(words), sorted(found, key=lambda m: (m.word, -m.n_words, m.kind, m.label))


def phrases(base: dict[str, str] | None = None, notices: dict[str, tuple[str, float]] | None = None, tag: str = TAG) -> dict[str, list[tuple[str, str, float]]]:
    """What a Scanner takes, of base phrases with their labels, notices with labels and weights, and the identifier tag."""
    out: dict[str, list[tuple[str, str, float]]] = {}
    for p, label in (BASE if base is None else base).items():
        out.setdefault(p, []).append(("base", label, BASE_SURE))
    for p, (label, sure) in (NOTICES if notices is None else notices).items():
        out.setdefault(p, []).append(("notice", label, sure))
    out.setdefault(tag, []).append(("tag", "", TAG_SURE))
    return out


@lru_cache(maxsize=8)
def _scanner(items: tuple) -> Scanner:
    return Scanner({p: list(said) for p, said in items})


#: What is found in a text. terms: the well-formed expressions of its tags, in order.
FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, terms array<string>, allowed boolean, score double"
KINDS = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.float64()]


def found_in(text: str | None, scanner: Scanner, policy: frozenset[str]) -> tuple:
    """FOUND's values of a text.

    labels are those of base phrases, of notices (of those that overlap, the surest, the longest of
    equals) and the operands of expressions. score is how surely the text states its terms: 1 less
    the product of what each label leaves open. allowed says whether the policy admits all that is
    stated: every expression and every notice; it is null where nothing but base phrases is.
    """
    n, matches = scanner.scan(text)
    base = [m for m in matches if m.kind == "base"]
    sure = {m.label: m.sure for m in base}
    kept: list[Match] = []
    until = -1
    for m in matches:
        if m.kind == "notice":
            if m.word > until:
                kept.append(m)
            elif (m.sure, m.n_words) > (kept[-1].sure, kept[-1].n_words):
                kept[-1] = m
            until = max(until, m.word + m.n_words - 1)
    stated = [m.label in policy for m in kept]
    for m in kept:
        sure[m.label] = max(sure.get(m.label, 0.0), m.sure)
    expressions = [m.expression for m in matches if m.kind == "tag" and m.expression]
    for e in expressions:
        stated.append(e.allowed(policy))
        for x in e.operands():
            sure[x] = TAG_SURE
    left = 1.0
    for label in sorted(sure):
        left *= 1.0 - sure[label]
    places = [m.word for m in base]
    return n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted({m.label for m in base})), ",".join(sorted(sure)), [str(e) for e in expressions], all(stated) if stated else None, 1.0 - left


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases_: dict | None = None, policy: frozenset[str] = PERMISSIVE) -> DataFrame:
    """(id, FOUND): the licence statements in each text, a row for each of docs.

    Null and empty texts have no words, and the score 0. Very long texts are read whole, by one task
    each. Ids may be null and rows repeated; other columns are not looked at, whatever their names.
    An empty table gives an empty result.
    """
    items = tuple((p, tuple(said)) for p, said in (phrases() if phrases_ is None else phrases_).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(items)
        for b in batches:
            rows = [found_in(t.as_py(), scanner, policy) for t in b.column(1)]
            cols = zip(*rows, strict=True) if rows else [()] * len(KINDS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, KINDS, strict=True))], names=["id", *(x.split()[0] for x in FOUND.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"id {kind}, {FOUND}")


def op11_license_scans(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = Scratch(spark, "licenses").save(scan(docs), "found")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.array_join("terms", "; ").alias("terms"), "allowed")
