"""Language identification against a plain version, and its held-out accuracy."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkspan.llm.language import UNKNOWN, identify, train_profiles
from inkspan.llm.queries import QUERIES


def grams(text):
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    padded = f" {' '.join(letters.split())} "
    if not padded.strip():
        return Counter()
    out = Counter(c for c in padded if c != " ")
    out.update(padded[i : i + 2] for i in range(len(padded) - 1))
    out.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    return out


def code(gram):
    n = 0
    for c in gram:
        n = n << 21 | ord(c)
    return n


def ranked(counts, k):
    return [code(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:k]]


def plain(train, texts, k):
    counts = {}
    for text, lang in train:
        if lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: r for r, g in enumerate(ranked(c, k))} for lang, c in counts.items() if c}
    out = []
    for t in texts:
        own = ranked(grams(t), k)
        if not own or not profiles:
            out.append((UNKNOWN, 0.0))
            continue
        cost = lambda p: sum(min(abs(p[g] - i), k) if g in p else k for i, g in enumerate(own))
        d, lang = min((cost(p), lang) for lang, p in profiles.items())
        out.append((lang, 1 - d / (k * len(own))))
    return out


TRAIN = [
    ("the quick brown fox jumps over the lazy dog and the cat", "en"), ("this is the house that jack built", "en"),
    ("der schnelle braune fuchs springt über den faulen hund", "de"), ("das ist das haus vom nikolaus", "de"),
    ("le renard brun saute par-dessus le chien paresseux", "fr"), (None, "fr"), ("ignored", None), ("", "xx"), ("123", "yy"),
]


@pytest.mark.parametrize("k", [5, 30, 400])
def test_matches_the_plain_version(spark, k):
    texts = ["the dog and the fox", "über das haus", "le chien", "zzz", "", None, "42 !?", "Ünïcode", "a", "the " * 5000 + "haus", "日本語 テキスト"]
    profiles = train_profiles(spark.createDataFrame(TRAIN, "text string, lang string"), k)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [(r.lang_pred, r.score) for r in identify(docs, profiles, k).orderBy("doc_id").collect()]
    for g, e in zip(got, plain(TRAIN, texts, k)):
        assert g[0] == e[0] and g[1] == pytest.approx(e[1])


def test_extra_columns_and_empty_tables(spark):
    none = spark.createDataFrame([], "text string, lang string")
    docs = spark.createDataFrame([(1, "the dog", "x", 9), (1, "the dog", "x", 9)], "doc_id int, text string, lang_pred string, score int")
    out = identify(docs, train_profiles(none))
    assert [tuple(r) for r in out.collect()] == [(1, "the dog", UNKNOWN, 0.0)] * 2
    profiles = train_profiles(spark.createDataFrame(TRAIN, "text string, lang string"))
    assert identify(docs.limit(0), profiles).collect() == []


def test_held_out_accuracy(spark, small):
    out = QUERIES["op4_language_id"](spark, small)
    truth = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang", "text")
    judged = out.join(truth, "doc_id").where("held_out and lang is not null and length(text) > 20")
    r = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count(F.lit(1)).alias("n")).first()
    assert r["n"] > 20 and r["a"] > 0.9
    bad = out.where("(score < 0 or score > 1) or lang_pred is null").count()
    assert bad == 0
