"""Toxicity scores: the estimator's parts and held-out accuracy."""

from __future__ import annotations

import numpy as np
import pytest

from inkspan.llm.queries import QUERIES
from inkspan.llm.toxicity import Model, features_of, fit_nnpu, risk_step, score, train


def auc(scores, labels):
    scores, labels = np.asarray(scores), np.asarray(labels)
    p, n = scores[labels == 1], scores[labels == 0]
    return float((p[:, None] > n[None, :]).mean() + 0.5 * (p[:, None] == n[None, :]).mean())


def test_learns_from_positives_and_unlabelled():
    """Feature 0 marks the toxic class; a share of the unlabelled has it too."""
    rng = np.random.default_rng(1)
    noise = lambda: rng.choice(np.arange(1, 20), 4, replace=False)
    positive = [np.append(noise(), 0) for _ in range(300)]
    unlabelled = [np.append(noise(), 0) if i % 10 == 0 else noise() for i in range(1000)]
    w, b = fit_nnpu(positive, unlabelled, 20, 0.1)
    of = lambda hits: 1 / (1 + np.exp(-(b + w[hits].sum())))
    assert min(of(p) for p in positive) > max(of(u) for i, u in enumerate(unlabelled) if i % 10)


@pytest.mark.parametrize("bias", [-2.0, 3.0, -9.0])
def test_the_risk_against_plain_sums(bias):
    """The estimator written out, and its slopes; with bias -9 the clean part is under 0 and cut off."""
    positive, unlabelled, prior, decay = [[0, 1], [0], [0, 2]], [[1], [0, 1], [], [2]], 0.3, 0.01
    w0 = np.array([1.5, -0.4, 8.0 if bias == -9.0 else 0.2, bias])
    f = lambda w, hits: w[-1] + sum(w[i] for i in hits)
    loss = lambda x: float(np.log1p(np.exp(-x)))
    mean = lambda xs: sum(xs) / len(xs)
    clean = lambda w: mean([loss(-f(w, u)) for u in unlabelled]) - prior * mean([loss(-f(w, p)) for p in positive])
    whole = lambda w: prior * mean([loss(f(w, p)) for p in positive]) + max(0.0, clean(w)) + decay * prior / 2 * float((w[:-1] ** 2).sum())
    arrays = [[np.array(h, np.int64) for h in rows] for rows in (positive, unlabelled)]
    risk, grad = risk_step(w0, *arrays, prior, decay)
    assert risk == pytest.approx(clean(w0)) and (risk < 0) == (clean(w0) < 0)
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        assert grad[k] == pytest.approx((whole(w0 + step) - whole(w0 - step)) / 2e-6, abs=1e-5)


def test_a_table_with_every_label_is_trained(spark):
    rows = [(i, f"good words here {i}" + (" vile filth" if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    out = score(docs, train(docs, labels)).collect()
    assert {r.doc_id for r in out if r.predicted == 1} == {i for i in range(0, 200, 4)}


@pytest.mark.parametrize("labelled", [0.1, 0.4, 1.0])
def test_the_prior_holds_whatever_share_is_labelled(spark, labelled):
    """Words overlap, so a wrong prior would push clean texts over the line, or toxic ones under it."""
    rng = np.random.default_rng(7)
    # Words are letters: digits would part them.
    name = lambda i: "".join(chr(97 + int(x)) for x in f"{i:03}")
    common, vile = [f"w{name(i)}x" for i in range(300)], [f"v{name(i)}x" for i in range(12)]
    rows, truth = [], {}
    for i in range(4000):
        truth[i] = int(rng.random() < 0.12)
        words = list(rng.choice(common, 25)) + list(rng.choice(vile, rng.integers(2, 5) if truth[i] else int(rng.random() < 0.1)))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = [(i, truth[i]) for i in range(3000) if rng.random() < labelled]
    model = train(docs.where("doc_id < 3000"), spark.createDataFrame(known, "doc_id long, toxic int"))
    out = {r.doc_id: r.predicted for r in score(docs, model).where("doc_id >= 3000").collect()}
    hit = np.mean([out[i] == truth[i] for i in out])
    wrong = np.mean([out[i] for i in out if not truth[i]])
    assert hit > np.mean([not truth[i] for i in out]) and wrong < 0.05
    # One label in ten leaves some 36 toxic examples, from which 0.942 was reached.
    assert hit > (0.95 if labelled > 0.1 else 0.93)


def test_positive_labels_alone(spark):
    rows = [(i, f"good words here {i}" + (" vile filth" if i % 20 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = score(docs, train(docs, spark.createDataFrame([(i, 1) for i in range(0, 200, 20)], "doc_id long, toxic int"))).collect()
    assert {r.doc_id for r in out if r.predicted == 1} == set(range(0, 400, 20))


def test_without_one_of_the_sets_the_prior_is_left():
    w, b = fit_nnpu([], [np.array([0])], 3, 0.2)
    assert not w.any() and 1 / (1 + np.exp(-b)) == pytest.approx(0.2)


def test_features():
    assert features_of("abc") == {"abc", "^abc", "abc$"}
    assert features_of("a") == {"a"}


def test_scores_of_nulls_long_texts_and_clashing_columns(spark):
    model = Model({"bad": 0}, np.array([6.0]), -3.0)
    rows = [(1, "bad", "x", "y"), (2, None, "x", "y"), (3, "", "x", "y"), (4, "good " * 100_000 + "BAD!", "x", "y"), (4, "bad9", "x", "y")]
    out = score(spark.createDataFrame(rows, "doc_id long, text string, score string, predicted string"), model)
    got = [(r.doc_id, round(r.score, 3), r.predicted) for r in out.collect()]
    assert got == [(1, 0.953, 1), (2, 0.047, 0), (3, 0.047, 0), (4, 0.953, 1), (4, 0.953, 1)]
    assert score(out.limit(0), model).collect() == []


def test_training_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for d, l in ((docs, labels), (docs.limit(0), labels), (docs, spark.createDataFrame([(1, 0), (None, 1), (9, None)], labels.schema))):
        model = train(d, l)
        assert model.vocabulary == {}
        assert all(0 < r.score < 0.5 for r in score(docs, model).collect())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    out = QUERIES["op5_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    rows = out.join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").toPandas()
    assert len(rows) > 100 and rows["score"].between(0, 1).all()
    assert auc(rows["score"], rows["toxic"]) > 0.95
    assert (rows["predicted"] == rows["toxic"]).mean() > 0.95 > (rows["toxic"] == 0).mean()
    assert rows["predicted"][rows["toxic"] == 0].mean() < 0.05
    assert out.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
