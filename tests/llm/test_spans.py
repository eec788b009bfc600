"""Spans of personal data: base patterns plainly, the field against all segmentations and held-out made rows."""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import re

import numpy as np
import pytest

from inkspan.llm.queries import QUERIES
from inkspan.llm.spans import CARD, EMAIL, IP, KINDS, NEAR, PHONE, Field, base_spans, find_spans, fit, labelled, made_rows, train

PATTERNS = {
    EMAIL: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    IP: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    CARD: r"[0-9]([\x20-]?[0-9])+",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, x in enumerate(reversed(digits)):
        x = int(x) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                EMAIL: lambda: True,
                IP: lambda: all(int(x) <= 255 for x in m.group().split(".")),
                CARD: lambda: 14 <= len(digits) <= 19 and plain_luhn(digits),
                PHONE: lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    return fit(made_rows())


def noisy_texts():
    rng = random.Random(6)
    pieces = ["@", "@@", ".", "..", "a", "b.c", "é", " ", "  ", "-", "+", "+1", "(", ")", "\n", "12", "255", "256", "0001", "4845168114407329", "1.2.3.4", "10.0.0.1", "x@y.zz", "_d@e.f-g", "999", "555-0271", "+44 (20) 7946", " at ", " dot ", "[at]", "0" * 30]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(4000)]


def test_base_spans_against_the_patterns():
    for text in noisy_texts():
        assert base_spans(text)[0] == plain_base(text), text


def test_long_hostile_texts_are_read_in_linear_time(field):
    for text in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "+1" + "(" * 200_000, "1 2 " * 50_000, "1." * 100_000, " " * 300_000, "x at " * 60_000):
        field.spans(text)
    hidden = "w " * 200_000 + "mail a.b@c.org or +1 (555) 010-9999 10.1.2.3 " + "v " * 200_000
    assert [x[1] for x in field.spans(hidden)] == [EMAIL, PHONE, IP]


def test_base_spans_stay_and_added_spans_do_not_touch_them(field):
    for text in noisy_texts():
        found = field.spans(text)
        assert [x[:3] for x in found if x[3]] == plain_base(text)
        held = [(s, e) for s, _, e, base, _ in found if base]
        added = [(s, e) for s, _, e, base, _ in found if not base]
        assert all(e <= a or s >= b for s, e in added for a, b in held)
        assert all(a[1] <= b[0] for a, b in zip(added, added[1:]))


def test_decoding_finds_the_best_segmentation():
    rng = random.Random(8)
    pairs = {f"pair:{a}:{b}": rng.uniform(-2, 2) for a in KINDS for b in KINDS}
    field = Field(pairs)

    def worth(chosen):
        total = sum(s[3] for s in chosen)
        return total + sum(field.pairs[a[2]][b[2]] for a, b in zip(chosen, chosen[1:]) if b[0] - a[1] <= NEAR)

    for _ in range(300):
        cluster = []
        for _ in range(rng.randint(1, 9)):
            start = rng.randrange(30)
            cluster.append((start, start + rng.randint(NEAR + 1, 12), rng.randrange(4), round(rng.uniform(-3, 3), 3)))
        cluster.sort(key=lambda s: s[:3])
        best = max(
            (worth(c) for n in range(len(cluster) + 1) for c in itertools.combinations(cluster, n) if all(a[1] <= b[0] for a, b in zip(c, c[1:]))),
        )
        chosen = field.decode(cluster)
        assert all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:]))
        assert worth(chosen) == pytest.approx(best)


def test_training_climbs_the_likelihood_of_all_segmentations():
    rows = made_rows(60)
    small = {k: n for k, n in rows.items() if len(json.loads(k)) <= 10}

    def objective(field):
        """What fit() climbs: the likelihood less the penalty, which weighs against it from some step on."""
        total = 0.0
        for text, n in small.items():
            cluster = json.loads(text)
            scored = [(*s[:3], sum(field.weights.get(x, 0) for x in s[3])) for s in cluster]

            def worth(chosen):
                return sum(s[3] for s in chosen) + sum(field.pairs[a[2]][b[2]] for a, b in zip(chosen, chosen[1:]) if b[0] - a[1] <= NEAR)

            every = [worth(c) for k in range(len(scored) + 1) for c in itertools.combinations(scored, k) if all(a[1] <= b[0] for a, b in zip(c, c[1:]))]
            total += n**0.5 * (worth([s for s, c in zip(scored, cluster) if c[4]]) - np.logaddexp.reduce(every))
        return total / sum(n**0.5 for n in small.values()) - 0.003 / 2 * sum(x * x for x in field.weights.values())

    at = [objective(fit(small, rounds=r, penalty=0.003)) for r in (1, 10, 80)]
    assert at[0] < at[1] < at[2]


def test_held_out_made_rows(field):
    right = wrong = missed = 0
    for text in made_rows(1500, seed=99):
        cluster = json.loads(text)
        gold = {tuple(s[:3]) for s in cluster if s[4]}
        found = {s[:3] for s in field.decode([(*s[:3], sum(field.weights.get(x, 0.0) for x in s[3])) for s in cluster])}
        right, wrong, missed = right + len(gold & found), wrong + len(found - gold), missed + len(gold - found)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.95


@pytest.mark.parametrize(
    "text,want",
    [
        ("2024 4845168114407329", [("card", "4845168114407329")]),
        ("+1 (826) 555-4081 190.137.223.204", [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")]),
        ("write jane (at) example (dot) com now", [("email", "jane (at) example (dot) com")]),
        ("call (826) 555-4081 now", [("phone", "(826) 555-4081")]),
        ("see you at example.com", []),
        ("1234 5678 9012 3456 7890", []),
        ("from 2020-10-11 to 2021-11-12", []),
        ("number 2669109448945251 ok", []),
    ],
)
def test_what_one_pass_of_patterns_misses(field, text, want):
    assert [(KINDS[k], text[s:e]) for s, k, e, _, _ in field.spans(text)] == want


def test_nulls_repeats_clashing_columns_and_empty_tables(spark, field):
    rows = [(1, None, "a"), (2, "", "b"), (None, "é a@b.cc", "c"), (None, "é a@b.cc", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").selectExpr("*", "1 AS kind", "2 AS base")
    out = find_spans(docs, field)
    assert out.columns == ["doc_id", "text", "kind", "base", "spans"]
    got = sorted(([tuple(s)[:4] for s in r.spans] for r in out.collect()), key=len)
    assert got == [[], [], [(2, "email", 8, True)], [(2, "email", 8, True)]]
    assert find_spans(docs.limit(0), field).collect() == []
    assert train(docs.limit(0).select("doc_id", "text")).weights == field.weights


def test_query_over_whole_texts(spark, small):
    rows = {r.doc_id: r for r in QUERIES["op11_personal_data"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        base, r = plain_base(d.text or ""), rows[d.doc_id]
        listed = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""} and r.n_added == len(r.spans.split(",")) * bool(r.spans) - len(base)


def test_doubtful_labels_are_not_learnt():
    assert labelled("x 2024 4845168114407329 y") == []
    assert len(labelled("x 4845168114407329 y")) == 1 and len(labelled("x 4845168114407328 y")) == 1
