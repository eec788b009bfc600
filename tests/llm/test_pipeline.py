"""The corpus pipeline against brute force, stage by stage."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_darts import brute as near_classes
from tests.llm.test_substrings import WORDS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def documents():
    rng = random.Random(1)
    en = "the house is old and the cat sleeps on a chair near the open window while rain falls over small hills".split()
    de = "das haus ist alt und die katze schläft auf einem stuhl neben dem offenen fenster während regen fällt".split()
    passage = [rng.choice(en) + str(rng.randrange(99)) for _ in range(60)]
    rows = []
    for i in range(60):
        words = [rng.choice(en if i % 2 else de) for _ in range(rng.randrange(20, 150))]
        if i % 9 == 0:
            words[10:10] = passage
        rows.append((i, " ".join(words), "en" if i % 2 else "de", ["web", "book", None][i % 3]))
    rows += [(100 + i, rows[i][1], rows[i][2], "web") for i in range(0, 20, 2)]
    rows += [(200 + i, rows[i][1] + " end", rows[i][2], "web") for i in range(1, 20, 4) if len(rows[i][1].split()) > 60]
    rows += [(300, None, "en", "web"), (301, "", "en", "web"), (302, "123 !", None, "web"), (303, "haus", None, None), (None, "das haus ist alt", "de", "web")]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


def test_language_rejects_texts_without_letters(spark, docs):
    out = corpus_pipeline.language(spark, docs, "")
    kept = {r.doc_id for r in out.collect()}
    assert kept == {r[0] for r in documents()} - {300, 301, 302}
    assert out.columns == COLUMNS
    right = [r.lang == ("en" if r.doc_id % 2 else "de") for r in out.collect() if r.doc_id is not None and r.doc_id < 60]
    assert sum(right) >= 58


def test_one_document_of_each_class_stays(spark, docs):
    out = corpus_pipeline.near_copies(spark, docs, "")
    classes = near_classes([(r[0], r[1]) for r in documents()])
    expected = [r for r in documents() if r[0] is None or classes[r[0]] == r[0]]
    assert rows_of(out) == sorted(expected, key=str)
    assert len(expected) < len(documents())


def test_ids_that_repeat_keep_their_own_texts(spark):
    rng = random.Random(8)
    one, two, three = (" ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(3))
    row = lambda i, text, source="web": (i, text, "en", source, len(text))
    rows = [row(1, one), row(2, one + " end"), row(2, two), row(2, two), row(2, two, "book"), row(None, three), row(None, three), row(None, one), row(None, two + " end")]
    out = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert rows_of(out) == sorted([row(1, one), row(2, two, "book"), row(None, three)], key=str)


def test_repeated_passages_are_cut(spark, docs):
    least = {}
    key = lambda i: (i is None, i or 0)
    cut = [(r, WORDS.findall(r[1] or "")) for r in documents()]
    for r, w in cut:
        for p in range(len(w) - 49):
            g = tuple(w[p : p + 50])
            least[g] = min(least.get(g, key(r[0])), key(r[0]))
    expected = []
    for r, w in cut:
        gone = {j for p in range(len(w) - 49) if least[tuple(w[p : p + 50])] < key(r[0]) for j in range(p, p + 50)}
        if not gone:
            expected.append(r)
        elif len(gone) < len(w):
            text = " ".join(x for j, x in enumerate(w) if j not in gone)
            expected.append((r[0], text, *r[2:4], len(text)))
    assert rows_of(corpus_pipeline.substrings(spark, docs, "")) == sorted(expected, key=str)


def test_mixing_repeats_whole_documents(spark, docs):
    out = Counter(rows_of(corpus_pipeline.mixing(spark, docs, "")))
    assert set(out) <= set(documents()) and max(out.values()) == 2
    words = sum(len((r[1] or "").split()) * n for r, n in out.items())
    assert words == pytest.approx(1.5 * sum(len((r[1] or "").split()) for r in documents()), rel=0.1)


def test_run_is_its_stages_one_after_the_other(spark, docs, tmp_path):
    folder = f"file://{tmp_path}"
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    step = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        step = stage(spark, step, folder)
        assert step.columns == COLUMNS
        step.write.parquet(f"{folder}/{i}")
        step = spark.read.parquet(f"{folder}/{i}")
    out = corpus_pipeline.run(spark, folder).collect()
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.TOKENIZER))
    expected = []
    for r in step.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        expected.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in out), key=str) == sorted(expected, key=str)


def test_stages_take_empty_tables_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", lang_pred string, _k int, size string")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == [], name
    one = spark.createDataFrame([(1, "the house", "en", "web", 9, "x", 1, "y")], empty.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert {r.doc_id for r in stage(spark, one, "").collect()} <= {1}, name
