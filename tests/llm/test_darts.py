"""Near-duplicate classes against exact Jaccard similarities of all pairs."""

from __future__ import annotations

import random

import numpy as np

from inkspan.llm.darts import Block, near_duplicates, shingles, signature, similarity, text_classes, throw
from inkspan.llm.components import components


def brute(rows, threshold=0.8, size=5):
    """(doc_id, text) -> doc_id -> class_id."""
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = []
    for i, t in rows:
        w = (t or "").encode().split()
        n = min(size, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            same = rows[x][1] is not None and rows[x][1] == rows[y][1]
            if None not in (rows[x][0], rows[y][0]) and (same or (a and len(a & b) >= threshold * len(a | b))):
                p, q = root(rows[x][0]), root(rows[y][0])
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.class_id for r in near_duplicates(docs, **options).collect()}


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_matches_all_pairs(spark):
    rng = random.Random(1)
    rows, i = [], 0
    for _ in range(12):
        base = prose(rng, rng.randrange(40, 300))
        rows.append((i, " ".join(base)))
        for _ in range(rng.randrange(5)):
            i += 1
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = "other"
            rows.append((i, " ".join(copy)))
        i += 1
    rng.shuffle(rows)
    expected = brute(rows)
    assert run(spark, rows) == expected
    assert 12 < len(set(expected.values())) < len(rows)


def test_chain_of_drifting_copies(spark):
    """Each text is near the next one only; a class holds them all."""
    rng = random.Random(2)
    text, rows = prose(rng, 200), []
    for i in range(30):
        rows.append((i, " ".join(text)))
        text = list(text)
        for k in range(2):
            text[(i * 13 + k * 90) % 200] = f"n{i}{k}"
    assert run(spark, rows) == brute(rows)


def test_large_group_of_copies(spark):
    rng = random.Random(3)
    text = prose(rng, 80)
    rows = [(i, " ".join(text[:-1] + [f"e{i}"])) for i in range(400)] + [(1000 + i, " ".join(text)) for i in range(400)]
    assert set(run(spark, rows).values()) == {0}


def test_nulls_short_texts_and_repeated_rows(spark):
    rows = [(1, "a b"), (2, "a b"), (3, "b a"), (4, None), (5, None), (6, ""), (7, ""), (8, " "), (9, "a  b"), (9, "a  b"), (None, "a b")]
    got = run(spark, rows)
    # Equal texts and equal words are near copies; wordless texts link to equal texts only; nulls to nothing.
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 1, None: None}


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, class_id string, _k string, _band int")
    assert near_duplicates(docs).collect() == []
    docs = spark.createDataFrame([(1, "a b c", "x", "y", 1), (2, "a b c", "x", "y", 1)], docs.schema)
    assert sorted(map(tuple, near_duplicates(docs).collect())) == [(1, 1), (2, 1)]


def test_weighted_agreement_follows_weighted_jaccard():
    """Coordinates agree as often as sum(min) / sum(max) of the weights."""
    rng = np.random.default_rng(4)
    elements = rng.integers(1, 2**62, 120, dtype=np.uint64)
    wa, wb = rng.uniform(0.2, 4, 120), rng.uniform(0.2, 4, 120)
    k = 2000
    agree = (signature(elements, wa, k) == signature(elements, wb, k)).mean()
    assert abs(agree - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.05


def test_darts_are_as_many_as_the_weight():
    elements = np.arange(1, 2001, dtype=np.uint64)
    weights = np.full(2000, 1.5)
    assert abs(len(throw(elements, weights, 3.0)[0]) / (2000 * 1.5 * 3) - 1) < 0.05


def test_shingles_count_repeats():
    found, counts = shingles(b"a b a b a b a b", 2)
    assert len(found) == 2 and sorted(counts) == [3, 4]


def test_components(spark):
    links = [(1, 2), (2, 3), (7, 6), (6, 5), (9, 9), (3, 1), (20, 10), (20, 15), (15, 12), (30, 31)] + [(i, i + 1) for i in range(100, 180)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = {2: 1, 3: 1, 7: 5, 6: 5, 20: 10, 15: 10, 12: 10, 31: 30} | {i: 100 for i in range(101, 181)}
    assert got == expected


def test_texts_that_share_an_id_are_all_compared(spark):
    """Every text of an id is signed, so each brings in its near copies."""
    rng = random.Random(5)
    texts = [prose(rng, 100) for _ in range(20)]
    rows = [(7, " ".join(t)) for t in texts] + [(100 + i, " ".join(t[:-1] + ["other"])) for i, t in enumerate(texts)]
    rows += [(200, "lone text of its own"), (200, " ".join(prose(rng, 50))), (None, " ".join(texts[0]))]
    got = run(spark, rows)
    assert got == brute(rows) | {None: None}
    assert set(got.values()) == {7, 200, None}


def test_classes_of_texts_that_share_an_id_stay_apart(spark):
    rng = random.Random(6)
    a, b, c = (prose(rng, 100) for _ in range(3))
    near = " ".join(a[:-1] + ["other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (None, near), (None, " ".join(c)), (None, " ".join(c)), (9, near), (1, None)]
    found = text_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = sorted((r._id is None, r._id or 0) for r in found)
    assert ids == [(False, 5), (False, 5), (False, 9), (True, 0)]
    assert len({r._root for r in found}) == 3


def test_blocks_compare_exactly():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 200)).astype(np.uint64)) for _ in range(40)]
    block = Block(sets)
    for s in sets:
        plain = [similarity(s, t) for t in sets]
        assert block.similarities(s).tolist() == plain
    assert Block([]).similarities(sets[1]).tolist() == []


def test_copies_around_the_threshold_in_one_band(spark):
    """Every text shares a band, few are alike: what is under the threshold stays apart, what is at it is linked."""
    rng = random.Random(6)
    base = prose(rng, 104)
    rows = []
    for i in range(60):
        copy = list(base)
        for k in rng.sample(range(len(copy) - 4), i % 5):
            copy[k] = f"n{rng.randrange(6)}"
        rows.append((i, " ".join(copy)))
    expected = brute(rows)
    assert len(set(expected.values())) > 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(docs, bands=40, rows=1).collect()} == expected


def test_a_very_long_text_and_an_empty_table(spark):
    rng = random.Random(7)
    long = [f"w{rng.randrange(50_000)}" for _ in range(60_000)]
    other = [*long[:59_000], *(f"n{i}" for i in range(1000))]
    rows = [(4, " ".join(long)), (9, " ".join(other)), (5, " ".join(long[:20_000]))]
    assert run(spark, rows) == {4: 4, 9: 4, 5: 5}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string, _k long, _d string, class_id long")).collect() == []


def test_few_links_run_few_stages(spark):
    """Small tables of links meet in no shuffles of their own; the driver keeps account of every stage."""
    rng = random.Random(4)
    rows = [(i, " ".join(prose(rng, 60))) for i in range(20)]
    rows += [(20 + i, t + " more") for i, t in rows[:10]]
    sc, group = spark.sparkContext, "few-stages"
    sc.setJobGroup(group, "near duplicates")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
    assert 0 < sum(len(j.stageIds) for j in jobs) < 100
