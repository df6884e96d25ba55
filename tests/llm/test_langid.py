import random

import numpy as np

from lodewell.llm import langid


def test_held_out_accuracy(spark):
    got = langid.op9_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in got) <= 10 and all(0 <= r.score <= 1 for r in got)


def test_cases(spark, docs_of, tmp_path):
    en, de = "the thing and the other thing of that there", "der die und das nicht von zu über schön"
    rows = [(i, f"{en} {i}", "en") for i in range(30)] + [(100 + i, f"{de} {i}", "de") for i in range(30)] + [(300, None, "en"), (301, "", None), (302, "123 ... !!", "de"), (303, "UND DAS NICHT", None), (304, en + " " * 100 + "x" * 3_000_000, None), (None, de, None), (303, "UND DAS NICHT", None)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.op9_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (300, 301, 302, 303, None)] == ["und", "und", "und", "de", "de"]
    assert by[300].score == 0 and by[300].rejected and by[5].lang_pred == "en" and not by[5].rejected
    docs_of([]).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert langid.op9_language_id(spark, f"{tmp_path}/e").count() == 0
    docs_of([(1, "text", None)]).write.parquet(f"{tmp_path}/n/documents.parquet")
    assert langid.op9_language_id(spark, f"{tmp_path}/n").first().lang_pred == "und"


def test_rejection():
    texts = [f"the thing and the other thing of that there {i}" for i in range(50)]
    idf = np.ones(langid.PLACES, np.float32)
    c = langid.cluster(np.stack([langid.vector(t, idf)[0] for t in texts]))
    model = langid.Model(["en"] * len(c), c, idf, np.full(32, 0.4))
    assert [r for *_, r in model.predict(["zqxj vkwq pzzx jjqk", "the other thing there"])] == [True, False]


def test_parts_of_long_texts():
    t = "wörter und dinge " * 100_000
    whole, langid_part = langid.counts(t), langid._PART
    try:
        langid._PART = 1 << 30
        assert (langid.counts(t) == whole).all()
    finally:
        langid._PART = langid_part


def test_repeated_rows_nulls_and_clashes(spark, docs_of):
    from pyspark.sql import functions as F

    words = {"en": "the house and the people of this land were there with water", "de": "der mann und die frau sind nicht in dem haus gewesen", "fr": "les gens de la ville sont dans une maison avec leurs amis"}
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(words[k].split(), k=40)), k) for i, k in enumerate(list(words) * 20)]
    model = langid.fit(docs_of(rows))
    asked = [(1, words["de"]), (1, words["de"]), (None, words["fr"]), (2, None), (3, ""), (4, "12 345"), (5, (words["en"] + " ") * 5000)]
    docs = docs_of(asked).withColumns({c: F.lit("own") for c in ("score", "lang_pred", "rejected", "id")})
    got = sorted((str(x.id), x.lang_pred, x.rejected) for x in langid.identify(docs, model).collect())
    assert got == [("1", "de", False), ("1", "de", False), ("2", "und", True), ("3", "und", True), ("4", "und", True), ("5", "en", False), ("None", "fr", False)]
    kept = langid.with_language(docs, model).collect()
    assert len(kept) == len(asked) and {x.score for x in kept} == {"own"} and sum(not x["_lw_lang"].rejected for x in kept) == 4
    assert langid.identify(docs_of([]), model).count() == 0 and langid.with_language(docs_of([]), model).count() == 0


def plain_grams(text):
    """n-grams of 1 to 3 bytes of the lower-cased letters, by place."""
    raw = b" " + b" ".join(bytes(b if b > 127 or 97 <= b <= 122 or 65 <= b <= 90 else 32 for b in text.lower().encode()).split()) + b" "
    out = {}
    for n in (1, 2, 3):
        for i in range(len(raw) - n + 1):
            g = n
            for b in raw[i : i + n]:
                g = (g * 257 + b) % 2**32
            p = g * 2654435761 % 2**32 >> 19
            out[p] = out.get(p, 0) + 1
    return out


def unit(v):
    norm = sum(x * x for x in v.values()) ** 0.5
    return {k: x / norm for k, x in v.items()} if norm else v


def cos(a, b):
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def summed(vs):
    out = {}
    for v in vs:
        for k, x in v.items():
            out[k] = out.get(k, 0.0) + x
    return out


def test_query_against_a_plain_classifier(spark):
    """The whole query again with dictionaries: counts, document frequencies, clusters, cosines and rejection."""
    import math
    import zlib

    at = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text", "lang").collect())
    letters = lambda t: t is not None and any(c.isalpha() for c in t)
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 4 == 2 for d in docs}
    grams = {d.doc_id: plain_grams(d.text) for d in docs if letters(d.text)}
    train = [d for d in docs if not held[d.doc_id] and d.doc_id in grams and d.lang is not None]
    df = {}
    for d in train:
        for p in grams[d.doc_id]:
            df[p] = df.get(p, 0) + 1
    vec = {i: unit({p: math.log1p(c) * (math.log((1 + len(train)) / (1 + df.get(p, 0))) + 1) for p, c in g.items()}) for i, g in grams.items()}
    centroids, near_by_size = [], {}
    for lang in sorted({d.lang for d in train}):
        own = [vec[d.doc_id] for d in train if d.lang == lang]
        assert len(own) <= langid.SAMPLE / 1.2  # all of them are clustered
        centres = [unit(summed(own))]
        while len(centres) < min(langid.CENTROIDS, len(own)):
            far = [max(cos(v, c) for c in centres) for v in own]
            centres.append(own[far.index(min(far))])
        for _ in range(langid.TURNS):
            of = [max(range(len(centres)), key=lambda j, v=v: (cos(v, centres[j]), -j)) for v in own]
            centres = [unit(summed(v for v, o in zip(own, of, strict=True) if o == j)) for j in range(len(centres)) if j in of]
        centroids += [(lang, c) for c in centres]
        for d in train:
            if d.lang == lang:
                near_by_size.setdefault(sum(grams[d.doc_id].values()).bit_length(), []).append(max(cos(vec[d.doc_id], c) for c in centres))
    floor = [0.0] * 32
    for size in range(1, 32):
        some = near_by_size.get(size, ())
        floor[size] = langid.REJECT_SHARE * np.percentile(some, 1) if len(some) >= 20 else floor[size - 1]
    got = {r.doc_id: r for r in langid.op9_language_id(spark, at).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        if d.doc_id not in grams:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        best, lang = max((cos(vec[d.doc_id], c), lang) for lang, c in centroids)
        assert r.held_out == held[d.doc_id] and abs(r.score - min(1.0, best)) < 1e-4, d.doc_id
        assert r.lang_pred == lang and r.rejected == (best < floor[min(31, sum(grams[d.doc_id].values()).bit_length())])
