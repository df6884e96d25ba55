import random
import re

import corpus_pipeline
from lodewell.llm import packing

W = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    r = random.Random(9)
    en, de = "the and of that thing with from there other this".split(), "der die und das nicht von schön über zu mit".split()
    text = lambda lang, n: " ".join(r.choice(en if lang == "en" else de) + r.choice(["", "s", "en", str(r.randrange(99))]) for _ in range(n))
    passage = text("en", 60)
    rows = [(i, text("de" if i % 4 == 0 else "en", r.randint(40, 200)), "de" if i % 4 == 0 else "en", f"src{i % 5}") for i in range(120)]
    rows += [(200, rows[3][1], "en", "src1"), (201, rows[3][1].upper(), "en", "src1"), (202, rows[8][1], None, "src2")]  # copies
    rows += [(300, text("en", 50) + "\n" + passage + "\n" + text("en", 50), "en", "src0"), (301, passage + " " + text("en", 70), "en", "src0"), (302, passage, "en", "src3")]
    rows += [(400, None, "en", "src0"), (401, "12 34 !!", "en", "src0"), (402, "", None, None), (403, text("de", 80), None, None), (None, text("en", 80), "en", None), (5, rows[5][1], "en", "src0")]
    return rows, passage


def test_stages(spark, docs_of, tmp_path):
    rows, passage = corpus()
    docs = docs_of(rows).selectExpr("doc_id", "text", "lang", "source", "cast(char_length(text) as bigint) as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mix_sources", "best_fit_packing"]
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = at.collect()
    ids = {n: [r.doc_id for r in s] for n, s in seen.items()}
    given = [i for i, *_ in rows]
    assert sorted(map(str, ids["language_id"])) == sorted(str(i) for i in given if i not in (400, 401, 402))  # clean documents stay
    assert {r.doc_id: r.lang for r in seen["language_id"]}[403] == "de"
    copies = {200, 201, 202}
    assert sorted(map(str, ids["near_dedup"])) == sorted(str(i) for i in {*given} - {400, 401, 402} - copies)  # the repeated row is one
    by = {r.doc_id: r for r in seen["substring_dedup"]}
    assert 302 not in by and len(by) == len(ids["near_dedup"]) - 1
    assert passage not in by[300].text and passage not in by[301].text and by[300].text.count("\n") == 1
    before = {r.doc_id: r.text for r in seen["near_dedup"]}
    assert all(r.text == before[i] and r.n_chars == len(r.text) for i, r in by.items() if i not in (300, 301))
    count = lambda rs: sum(len(W.findall(r.text)) for r in rs)
    have, took = count(by.values()), count(seen["mix_sources"])
    leaves = {(r.source, r.lang) for r in by.values()}
    most = max(len(W.findall(r.text)) for r in by.values())
    assert have * 0.8 - 1 <= took <= have * 0.8 + most * len(leaves)  # the last document of each leaf is whole
    assert {(r.doc_id, r.text) for r in seen["mix_sources"]} <= {(r.doc_id, r.text) for r in by.values()} and len(set(ids["mix_sources"])) == len(ids["mix_sources"])
    words, tokens = packing.Words(None), {}
    for r in seen["mix_sources"]:
        tokens[r.doc_id] = len(words.ids(r.text)) // 4 + 1
    for r in seen["best_fit_packing"]:
        tokens[r.doc_id] -= r.length
    assert set(tokens.values()) == {0}
    ran = sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert ran == sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in seen["best_fit_packing"])


def test_empty(spark, docs_of, tmp_path):
    docs_of([]).selectExpr("doc_id", "text", "lang", "source", "cast(0 as bigint) as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
