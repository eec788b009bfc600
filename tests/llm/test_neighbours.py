"""The permutation index against all distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from inkspan.llm.neighbours import ARRAYS, BLOCK, CANDIDATES, NEAR, SAMPLE, Block, choose_pivots, inverted_file, permutations, search
from inkspan.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def brute(rows, is_query, k=10):
    """(id, vector) -> {query: [(id, distance), ...]}; rows are usable and of unlike ids."""
    out = {}
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float64)
    for i, x in zip(ids, v):
        if is_query(i):
            d = np.sqrt(((v - x) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def run(spark, rows, every=1, schema="vec_id long, embedding array<float>", **options):
    got = {}
    df = spark.createDataFrame(rows, schema)
    for r in search(df, F.col("vec_id") % every == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r["rank"]
    return got


def vectors(n, d=8, seed=1):
    return np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32).tolist()


def test_few_vectors_are_found_exactly(spark):
    rows = list(enumerate(vectors(150)))
    assert run(spark, rows, every=10) == brute(rows, lambda i: i % 10 == 0)


def test_several_blocks(spark):
    rows = list(enumerate(vectors(600)))
    assert run(spark, rows, every=50, block=100, query_block=3) == brute(rows, lambda i: i % 50 == 0)


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(60)]
    assert run(spark, rows, every=20) == brute(rows, lambda i: i % 20 == 0)


def test_what_takes_no_part(spark):
    good = [(i, [float(i), 1.0]) for i in range(6)]
    bad = [(10, None), (11, []), (12, [0.0, 0.0]), (13, [NAN, 1.0]), (14, [INF, 1.0]), (15, [None, 1.0]), (16, [1.0]), (None, [1.0, 1.0])]
    assert run(spark, good + bad + good) == brute(good, lambda i: True)


def test_fewer_candidates_than_k_and_no_queries(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0])]
    assert run(spark, rows) == brute(rows, lambda i: True)
    assert run(spark, rows[:1]) == {}
    assert run(spark, [(1, [1.0, 0.0])], every=100) == {}
    assert run(spark, [], schema="vec_id long, embedding array<double>, _id int, block string") == {}


def test_extra_columns(spark):
    rows = [(i, [float(i), 1.0], "x", 3) for i in range(5)]
    got = run(spark, rows, schema="vec_id long, embedding array<double>, _v string, block int")
    assert got == brute([(i, v) for i, v, _, _ in rows], lambda i: True)


def test_footrule_by_inverted_file():
    v = np.array(vectors(40, 4))
    pivots = choose_pivots(v, 12)
    perms = permutations(v, pivots, 5)
    bounds, posted, positions = inverted_file(perms, len(pivots))
    where = lambda p: {int(x): i for i, x in enumerate(p)}
    for q in range(5):
        shared = np.zeros(40, int)
        for at, p in enumerate(perms[q]):
            for j in range(bounds[p], bounds[p + 1]):
                shared[posted[j]] += 5 - max(positions[j], at)
        for x in range(40):
            a, b = where(perms[q]), where(perms[x])
            footrule = sum(abs(a.get(p, 5) - b.get(p, 5)) for p in a.keys() | b.keys())
            assert footrule == 2 * sum(range(1, 6)) - 2 * shared[x]


def test_repeated_ids_take_the_least_vector(spark):
    rows = [(0, [1.0, 0.0]), (1, [5.0, 1.0]), (1, [2.0, 9.0]), (2, [2.0, 3.0])]
    assert run(spark, rows + [rows[1]], every=2) == brute([rows[0], rows[2], rows[3]], lambda i: i % 2 == 0)


def test_recall_over_five_full_blocks():
    """At production parameters, on full blocks of unit vectors without structure, which have no near ones."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(5 * BLOCK, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(len(v))
    pivots = choose_pivots(v[np.random.default_rng(1).permutation(len(v))[:SAMPLE]])
    blocks = []
    for lo in range(0, len(v), BLOCK):
        part = v[lo : lo + BLOCK]
        bounds, posted, positions = inverted_file(permutations(part, pivots, NEAR), len(pivots))
        arrays = (ids[lo : lo + BLOCK], np.arange(len(part)), np.zeros(len(part), bool), part, bounds, posted, positions)
        blocks.append(Block({a: np.ascontiguousarray(x, kind).tobytes() for (a, kind), x in zip(ARRAYS.items(), arrays)}, v.shape[1]))
    hit = 0
    for q in range(0, len(v), len(v) // 60):
        perm = permutations(v[q : q + 1], pivots, NEAR)[0]
        got = sorted(x for b in blocks for x in b.search(v[q], ids[q], perm, 10, CANDIDATES))[:10]
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len({i for _, i in got} & set(ids[np.argsort(d)[:10]].tolist()))
    assert hit / (10 * len(range(0, len(v), len(v) // 60))) >= 0.93


def test_recall_of_the_query(spark):
    """At production parameters, on a table of more vectors than candidates."""
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    usable = [(i, v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    expected = brute(usable, lambda i: i % 100 == 0)
    hit = total = 0
    got = {}
    for r in QUERIES["op1_permutation_index"](spark, folder).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    for q, near in expected.items():
        total += len(near)
        hit += sum(i in got.get(q, {}) for i, _ in near)
    assert hit / total >= 0.9
