"""SentencePiece coding against the sentencepiece library on whole texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from inkspan.llm.pieces import Codec, codec, encode_documents, encode_texts, segments_of
from inkspan.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "\n", "\n\n", " \n ", "a", " a", "a ", "  a  b ", "▁", "▁a▁", "a▁ b", "\t", "a\tb", "x\r\ny", "\n a", "a\n b\n\nc ",
    "日本語 テキスト", "naïve café", "🙂 🙃🙂", "\u0000", "a b", "​", "é é", "<s>", "</s> <unk> <0x0A>", "ＡＢＣ", "𝔘nicode", "—…“”", "ﬁ",
    "▁▁", "a" * 300, " ".join(["word"] * 2000), "x " * 50 + "\n" * 7, "العربية", "ไทย", "", "\U0010ffff", "�", "0123456789" * 9,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def expected(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    back = library.decode(ids)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, text):
    raw, back, agrees = next(encode_texts([text], MODEL))
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(raw, "<u4").tolist() == ids
    assert back.decode() == library.decode(ids)
    assert agrees


def test_random_texts(library):
    rng = random.Random(1)
    alphabet = "abc éß \n▁日🙂\t.,1 "
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        raw, back, _ = next(encode_texts([text], MODEL))
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(raw, "<u4").tolist() == ids and back.decode() == library.decode(ids), repr(text)


def test_agenda_alone_equals_the_library():
    """Before the library is asked: heap and matrix give the same ids as it does."""
    agenda = codec(MODEL).agenda
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choice("aeinrstlo") for _ in range(rng.randrange(1, 20))) for _ in range(500)]
    library = agenda.library_segments(words)
    assert [agenda.by_heap(w) for w in words] == library
    assert agenda.by_matrix(words) == library


def test_segments_keep_the_text():
    for text in ODD:
        parts = segments_of(text)
        assert "".join(parts) == ("▁" + text.replace(" ", "▁") if text else "")


def test_small_cache_gives_the_same(library):
    small = Codec(MODEL, cache=10)
    small.learn({"▁a", "▁b"})
    small.learn({f"▁w{i}" for i in range(12)})
    assert len(small.ids) == 12


def test_documents_with_nulls_repeats_and_a_long_text(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (7, None), (1008, "same"), (1008, "same"), (1009, "long word " * 30_000)]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, n_tokens string, ids int")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_documents(docs, MODEL).collect())
    assert got == sorted((str(i), *expected(library, t)) for i, t in rows)
    full = encode_documents(docs.where("doc_id = 1008"), MODEL, with_ids=True).collect()
    assert [r.ids for r in full] == [library.encode("same", add_bos=True, add_eos=True)] * 2 and full[0].decoded == "same"
    assert encode_documents(docs.limit(0), MODEL).collect() == []


def test_query(spark, small, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    out = QUERIES["op10_sentencepiece"](spark, small).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out} == {i: expected(library, t) for i, t in texts.items()}
    assert all(r.library_agrees for r in out)


def test_segments_are_compared_in_few_calls():
    """The library takes segments behind a space together, and all others together."""
    agenda = codec(MODEL).agenda
    segments = [f"▁word{i}" for i in range(50)] + [f"line{i}é" for i in range(50)] + ["▁", "\n", "▁▁two"]
    library, calls = agenda.library, []

    class Counted:
        def encode(self, texts, **options):
            calls.append(texts)
            return library.encode(texts, **options)

    agenda.library = Counted()
    try:
        told = agenda.library_segments(segments)
    finally:
        agenda.library = library
    assert told == agenda.encode_segments(segments) and len(calls) <= 2
