"""Substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

from inkspan.llm.substrings import drop_repeats

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """(doc_id, text) -> sorted (doc_id, n_words, n_removed, sha256)."""
    key = lambda i: (i is None, i or 0)
    words = [WORDS.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            least[g] = min(least.get(g, key(i)), key(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < key(i):
                gone.update(range(p, p + window))
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=lambda r: (key(r[0]), r[3]))


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = drop_repeats(docs, **options).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted((tuple(r) for r in out), key=lambda r: ((r[0] is None, r[0] or 0), r[3]))


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_matches_brute_force(spark):
    rng = random.Random(1)
    shared = [prose(rng, n) for n in (50, 51, 49, 120)]
    rows = []
    for i in range(40):
        w = prose(rng, rng.randrange(0, 200))
        for s in rng.sample(shared, 2):
            at = rng.randrange(len(w) + 1)
            w[at:at] = s
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(100 + i, rows[3][1]) for i in range(5)]
    expected = brute(rows, 50)
    assert run(spark, rows) == expected
    assert sum(r[2] for r in expected) > 1000


def test_short_windows_and_levels(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(prose(rng, 60, 3))) for i in range(8)]
    for start in (1, 2, 3):
        assert run(spark, rows, window=4, start=start) == brute(rows, 4)


def test_nulls_empty_repeats_and_separators(spark):
    rng = random.Random(3)
    a, b = " ".join(prose(rng, 80)), " ".join(prose(rng, 70))
    # A no-break space and a unit separator are no separators; a null doc_id is after all others.
    odd = "x y\x1fz\x0bq"
    rows = [(None, a), (None, f"{b} tail"), (5, a), (5, f"head {a}"), (6, b), (7, None), (8, ""), (9, " \n "), (10, odd), (11, "kurz")]
    assert run(spark, rows) == brute(rows, 50)


def test_very_long_text(spark):
    rng = random.Random(4)
    long = prose(rng, 60_000, 20_000)
    rows = [(1, " ".join(long)), (2, " ".join(long[30_000:30_100])), (3, " ".join(["same"] * 5_000)), (4, " ".join(["same"] * 60))]
    assert run(spark, rows) == brute(rows, 50)


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_words string, _k int, _raw int")
    out = drop_repeats(docs)
    assert out.columns == ["doc_id", "text", "_k", "_raw", "n_words", "n_removed", "kept_sha256", "kept"]
    assert out.collect() == []
    docs = spark.createDataFrame([(1, "a b", "x", 7, 8)], docs.schema)
    assert [tuple(r)[:6] for r in drop_repeats(docs).collect()] == [(1, "a b", 7, 8, 2, 0)]
