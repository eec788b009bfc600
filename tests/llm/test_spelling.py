"""Spelling variants against all pairs of words in plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from inkspan.llm.spelling import Trie, count_words, passes, build_shards, variant_groups

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_counts(docs, drop=199):
    counts = Counter()
    for key, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if x.isascii() else x for x in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_groups(counts, ratio=5):
    forms, out = {}, {}
    for w, n in counts.items():
        near = [(-m, x) for x, m in counts.items() if one_edit(w, x)]
        best = min(near, default=None)
        forms[w] = best[1] if best and -best[0] >= ratio * n else None
        out[w] = [n, len(near), counts.get(forms[w])]
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, *out[w])
    return out


def collected(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    out = {r.word: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_automaton_against_all_edits():
    rng = random.Random(1)
    for letters, size in (("ab", 6), ("abc", 5), ("aé", 9), ("abcdé", 3)):
        for _ in range(40):
            words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, size))) for _ in range(rng.randint(0, 50))})
            trie = Trie(*Trie.pack(words, list(range(len(words)))))
            for w in [*words, "", "aaaa", "ababab"]:
                found = [trie.word_at(x) for x in trie.near(w)]
                assert sorted(found) == [x for x in words if one_edit(w, x)]
                assert [words[trie.rank[x]] for x in trie.near(w)] == found


def test_repeated_letters_and_very_long_words_stay_linear():
    trie = Trie(*Trie.pack(["a" * 99_999, "a" * 100_000, "a" * 50_000 + "b" + "a" * 49_999], [5, 6, 7]))
    assert sorted(trie.counts[trie.rank[x]] for x in trie.near("a" * 100_000)) == [5, 7]


def test_counts_with_deleted_letters(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abÉé÷") for _ in range(rng.randint(5, 8))) for _ in range(40)]
    docs = [(i % 50 if i % 9 else None, " ".join(rng.choice(vocabulary).upper() if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(60))) for i in range(120)]
    docs += [(1, None), (2, ""), (3, "12 _ 34"), (4, "Straße_straßen-ŒUVRES œuvres " * 9), (5, "w" * 200_000 + " ")] + [(6, "Repeat Repeats")] * 7
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "'x' AS n", "0 AS k")
    for drop in (199, 3, 0):
        assert {r.word: r.n for r in count_words(df, drop_one_in=drop).collect()} == plain_counts(docs, drop)


def test_groups_against_all_pairs_in_many_shards_and_passes(spark):
    rng = random.Random(4)
    words = {}
    for _ in range(60):
        base, n = "".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))), rng.randint(5, 4000)
        for _ in range(rng.randint(0, 12)):
            words.setdefault(base, n)
            at, n = rng.randrange(len(base)), max(5, n // rng.choice([1, 2, 5, 6]))
            base = rng.choice([base[:at] + base[at + 1 :], base[:at] + rng.choice("abcé") + base[at:], base[:at] + rng.choice("abcé") + base[at + 1 :]])
    words |= {"aaaaaa": 100, "aaaaab": 20, "aaaabb": 4, "baaaaa": 100, "zzzzzz": 7, "x" * 5000: 5, "x" * 5001: 25, "x" * 5002: 125, "x" * 5003: 625}
    words = {w: n for w, n in words.items() if n}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain_groups(words)
    assert any(v[1] not in (w, v[0]) for w, v in want.items())
    assert collected(variant_groups(df)) == want
    # Shards of 120 letters, passes of a few shards: the longest words are shards of their own.
    small = collected(variant_groups(df.selectExpr("*", "1 AS form", "2 AS root"), shard_chars=120, pass_bytes=4000))
    assert small == want
    shards = build_shards(df, sum(map(len, words)), 120).cache()
    assert sum(r.words for r in shards.collect()) == len(words) and len(passes(shards, 4000)) > 3
    assert all(r.words == 1 or len(r.labels) <= 121 for r in shards.collect())


def test_tables_without_words(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert variant_groups(none).collect() == []
    docs = spark.createDataFrame([(1, None), (2, "too few words here")], "doc_id long, text string")
    assert variant_groups(count_words(docs)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert variant_groups(count_words(docs)).collect() == [] == count_words(docs.limit(0)).collect()
    alone = variant_groups(spark.createDataFrame([("lonely", 9)], "word string, n long")).collect()
    assert [tuple(r) for r in alone] == [("lonely", None, "lonely", 9, 0, None)]
