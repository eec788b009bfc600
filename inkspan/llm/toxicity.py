"""Toxicity scores from non-negative positive-unlabelled learning.

Known are some toxic documents (P); all training documents, these included, stand for the texts as they come (U),
of which a share ``prior`` is toxic. A linear classifier f on binary features is trained with numpy on
    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]),    l the logistic loss:
the unlabelled part stands for the clean class once the toxic share is taken out of it, and where that
estimate turns negative by over-fitting, it counts as 0 and has no gradient.

Features are a text's lower-cased words and the 4-letter pieces of these. The FEATURES that tell P from U
best are kept. The model is fitted on a bounded sample: at most POSITIVES toxic documents and UNLABELLED of
all, each the first by a hash of doc_id; counts, features and hits of the sample are made in Spark tasks,
and the driver gets the FEATURES counted terms and the sample's hits. Every document is then scored over
its whole text. Memory of a task: an Arrow batch, the model and WORDS cached words.

The prior is the toxic share of the labelled training documents (0.005 to 0.5; 0.05 if none is labelled, or all
that are are toxic). Labels are taken to be given regardless of toxicity, so that share holds for U, whether one
document in ten is labelled or all are. Null and empty texts get the score of a text without features; very long texts
are read whole. Without a toxic example all scores are the prior. A document with several labels is toxic if one says so. Ties between features go by name.
Repeated rows each count. An empty table gives an empty result. Columns of docs are kept, whatever their names;
score and predicted are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import cut, small_batches

POSITIVES, UNLABELLED, FEATURES, WORDS = 4000, 12000, 4096, 200_000
GRAM, LIFT, SURE = 4, 3.0, 5.0
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> set[str]:
    marked = f"^{word}$"
    return {word, *(marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1))}


class Hits:
    """Indices of the vocabulary's features in a text."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.cache = vocabulary, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        cache, vocabulary = self.cache, self.vocabulary
        for w in set(_WORD.findall((text or "").lower())):
            hit = cache.get(w)
            if hit is None:
                hit = tuple(vocabulary[x] for x in features_of(w) if x in vocabulary)
                if len(cache) >= WORDS:
                    cache.clear()
                cache[w] = hit
            if hit:
                found.update(hit)
        return np.fromiter(found, np.int32, len(found))


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def scorer(self):
        hits = Hits(self.vocabulary)
        return lambda text: float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[hits(text)].sum(), -30, 30))))


def risk_step(w: np.ndarray, ps: list[np.ndarray], us: list[np.ndarray], prior: float, decay: float) -> tuple[float, np.ndarray]:
    """The clean class's part of the risk, before it is cut off at 0, and the gradient of the whole risk in w (bias last)."""
    size = len(w) - 1

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    (pi, pr), (ui, ur) = flat(ps), flat(us)
    fp = w[-1] + np.bincount(pr, w[pi], len(ps))
    fu = w[-1] + np.bincount(ur, w[ui], len(us))
    sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
    clean_risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    grad = np.zeros(size + 1)

    def add(index: np.ndarray, row: np.ndarray, by: np.ndarray) -> None:
        grad[:-1] += np.bincount(index, by[row], size)
        grad[-1] += by.sum()

    add(pi, pr, prior * (sp - 1) / len(ps))
    if clean_risk > 0:
        add(pi, pr, -prior * sp / len(ps))
        add(ui, ur, su / len(us))
    grad[:-1] += decay * w[:-1] * prior
    return float(clean_risk), grad


def fit_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float,
    epochs: int = 60, rate: float = 0.05, decay: float = 1e-3, seed: int = 5,
) -> tuple[np.ndarray, float]:
    """Weights and bias, by Adam over mini-batches of both sets."""
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    if not positive or not unlabelled:
        return w[:-1], float(w[-1])
    batches = max(1, min(4, len(positive) // 256))
    step = 0
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for b in range(batches):
            ps = [positive[i] for i in p_order[b::batches]]
            us = [unlabelled[i] for i in u_order[b::batches]]
            if not ps or not us:
                continue
            _, grad = risk_step(w, ps, us, prior, decay)
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def choose_features(counts: DataFrame, positives: int, unlabelled: int, k: int = FEATURES) -> list[str]:
    """The k features most surely commoner in P; counts: feature, p, u. At most k rows reach the driver.

    A feature must be LIFT times as frequent in P as in U, and SURE standard deviations above chance.
    """
    lift = (F.col("p") / positives) / ((F.col("u") + 0.5) / (unlabelled + 1))
    expected = F.col("u") / unlabelled * positives
    surely = (F.col("p") - expected) / F.sqrt(expected + 1)
    best = counts.where((lift > LIFT) & (surely > SURE)).orderBy(surely.desc(), "feature").limit(k)
    return [r["feature"] for r in best.collect()]


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """docs: doc_id, text - the training rows; labels: doc_id, toxic."""
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = cut(docs.where("doc_id is not null").select("doc_id").distinct().join(known, "doc_id", "left"))
    share = ids.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("x")).first()["x"]
    prior = min(max(0.05 if share is None or share == 1 else share, 0.005), 0.5)
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = (
        ids.where("toxic = 1").orderBy(order, "doc_id").limit(positives).select("doc_id", F.lit(True).alias("toxic"))
    ).unionByName(
        ids.orderBy(order, "doc_id").limit(unlabelled).select("doc_id", F.lit(False).alias("toxic"))
    )
    # At most positives + unlabelled ids, so the side that is broadcast is bounded.
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text"))
    n_p, n_u = (sample.where(F.col("toxic") == x).count() for x in (True, False))
    if not n_p or not n_u:
        return Model({}, np.zeros(0), float(np.log(prior / (1 - prior))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pd.DataFrame:
            names = list(seen[0].keys() | seen[1].keys())
            frame = pd.DataFrame({"feature": pd.Series(names, dtype=object), "u": [seen[0][x] for x in names], "p": [seen[1][x] for x in names]})
            seen[0].clear(), seen[1].clear()
            return frame

        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"]):
                found: set[str] = set()
                for w in set(_WORD.findall((text or "").lower())):
                    found |= features_of(w)
                seen[bool(toxic)].update(found)
                if len(seen[0]) + len(seen[1]) > 1_000_000:
                    yield out()
        yield out()

    counts = sample.mapInPandas(count, "feature string, u long, p long").groupBy("feature").agg(F.sum("u").alias("u"), F.sum("p").alias("p"))
    vocabulary = {x: i for i, x in enumerate(choose_features(counts, n_p, n_u))}

    def hit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Hits(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "hits": [find(t) for t in batch["text"]]})

    rows = sample.mapInPandas(hit, "toxic boolean, hits array<int>").toPandas()
    sets = [[np.asarray(h, np.int64) for h in rows["hits"][rows["toxic"] == x]] for x in (True, False)]
    weights, bias = fit_nnpu(*sets, len(vocabulary), prior)
    return Model(vocabulary, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns with score (0 to 1) and predicted (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = shared.value.scorer()
        for batch in texts:
            yield batch.map(of, na_action=None)

    out = docs.drop("score", "predicted").withColumn("score", F.pandas_udf(judge, "double")("text"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
