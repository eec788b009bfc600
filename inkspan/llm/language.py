"""Language identification by rank-order profiles.

A profile is a language's PROFILE most frequent character n-grams (1 to 3 letters, words padded by a
space) in rank order, counted over all training texts. A document's own most frequent n-grams are
compared with each profile: an n-gram costs the distance between its two ranks, or PROFILE if the profile
lacks it. The language with the least sum wins, ties to the smaller name. The score is
1 - distance / (the distance to a profile that shares nothing).

Training counts are summed in each task before they are shuffled; profiles are broadcast: PROFILE rows
for each language, whatever the input. Memory: an Arrow batch, and FLUSH n-grams a task.

Null texts and texts without letters are ``und`` with score 0. Texts are read whole; letters of any script
count. Without a training text every document is ``und``. Repeated rows each count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import small_batches

PROFILE = 400
FLUSH = 1_000_000
UNKNOWN = "und"
_BITS = 21
_letters: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point -> itself for letters, space for all else."""
    if not _letters:
        points = np.arange(0x110000, dtype=np.int64)
        keep = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _letters.append(np.where(keep, points, 32))
    return _letters[0]


def letters_of(text: str) -> np.ndarray:
    """Folded code points, each run of other characters one space, with a space at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _fold()[raw]
    c = np.concatenate([[32], c, [32]])
    gap = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return c[keep]


def ngrams(text: str | None) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams: three code points of 21 bits; n-grams of a mere space are left out."""
    if not text:
        return np.empty(0, np.int64)
    c = letters_of(text)
    if len(c) < 3:
        return np.empty(0, np.int64)
    one = c[c != 32]
    two = (c[:-1] << _BITS) | c[1:]
    three = (((c[:-2] << _BITS) | c[1:-1]) << _BITS) | c[2:]
    return np.concatenate([one, two, three[c[1:-1] != 32]])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent codes, most frequent first, ties to the smaller code."""
    if len(codes) > 4 * k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        kept = counts >= least
        codes, counts = codes[kept], counts[kept]
    return codes[np.lexsort((codes, -counts))[:k]]


def out_of_place(document: np.ndarray, profile_codes: np.ndarray, profile_ranks: np.ndarray, k: int = PROFILE) -> int:
    """Sum of rank differences; profile_codes are sorted."""
    at = np.searchsorted(profile_codes, document)
    at[at == len(profile_codes)] = 0
    hit = profile_codes[at] == document
    return int(np.where(hit, np.minimum(np.abs(profile_ranks[at] - np.arange(len(document))), k), k).sum())


def train_profiles(docs: DataFrame, k: int = PROFILE) -> DataFrame:
    """(text, lang) -> lang, code, rank (from 0): each language's k most frequent n-grams."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def fold() -> None:
            for lang, parts in held.items():
                codes, n = counted(np.concatenate(parts))
                if lang in sums:
                    codes = np.concatenate([sums[lang][0], codes])
                    n = np.concatenate([sums[lang][1], n])
                    codes, inverse = np.unique(codes, return_inverse=True)
                    n = np.bincount(inverse, n).astype(np.int64)
                sums[lang] = codes, n
            held.clear()

        def out() -> Iterator[pd.DataFrame]:
            for lang, (codes, n) in sums.items():
                yield pd.DataFrame({"lang": pd.Series([lang] * len(codes), dtype=object), "code": codes, "n": n})
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                codes = ngrams(text)
                if len(codes):
                    held.setdefault(lang, []).append(codes)
                    size += len(codes)
                if size >= FLUSH:
                    fold()
                    size = 0
                    if sum(len(c) for c, _ in sums.values()) > FLUSH:
                        yield from out()
        fold()
        yield from out()

    small_batches(docs.sparkSession)
    counts = (
        docs.where("lang is not null and text is not null")
        .select("lang", "text")
        .mapInPandas(count, "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    # Compared as it is, so that Spark keeps the first k of each partition before it sorts a language.
    first = counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return first.select("lang", "code", (F.col("_r") - 1).alias("rank"))


def identify(docs: DataFrame, profiles: DataFrame, k: int = PROFILE) -> DataFrame:
    """docs' columns, with lang_pred and score added (replacing columns so named)."""
    rows = profiles.toPandas()  # k rows a language
    known = []
    for lang, part in sorted(rows.groupby("lang"), key=lambda x: x[0]):
        part = part.sort_values("code")
        known.append((lang, part["code"].to_numpy(), part["rank"].to_numpy()))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            langs, scores = [], []
            for text in batch:
                codes = ngrams(text)
                lang, score = UNKNOWN, 0.0
                if len(codes) and shared.value:
                    own = ranked(*counted(codes), k)
                    distance, lang = min((out_of_place(own, c, r, k), name) for name, c, r in shared.value)
                    score = 1.0 - distance / (k * len(own))
                langs.append(lang)
                scores.append(score)
            yield pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": scores})

    judge = F.pandas_udf(predict, "lang_pred string, score double")
    return (
        docs.drop("lang_pred", "score")
        .withColumn("_judged", judge("text"))
        .withColumns({"lang_pred": F.col("_judged.lang_pred"), "score": F.col("_judged.score")})
        .drop("_judged")
    )
