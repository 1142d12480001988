import hashlib
import random

import pytest

from helpers import rows_of
from plume.llm import pieces as K

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    path = P.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return path, sentencepiece.SentencePieceProcessor(model_file=path), K.Vocabulary(f.read())


def odd_texts(n):
    r = random.Random(5)
    alphabet = "   abcdefgthe▁\n\t,.()[]{}01239éüñçßőж中文🙂\u0000‍́</s>[INST]<0x41>AB'\"_-"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(n)] + [
        "", " ", "  ", "   a", "a  ", "\n\n", " " * 501, "▁▁ ▁", "a" * 5000, "ab " * 3000, "</s> <s> <unk> <0x0A>",
        "if (x){\n    return y;\n}\n\n\n", "�", "﻿x", "é" * 300, "🙂" * 200, "\u0000"]


def test_identifiers_and_texts_equal_the_library(model):
    _, sp, vocabulary = model
    encoder = K.Encoder(vocabulary)
    texts = odd_texts(4000)
    ids = sp.encode(texts)
    assert [t for t, i in zip(texts, ids) if encoder(t) != i] == []
    assert [t for t, i in zip(texts, ids) if vocabulary.decode(i) != sp.decode(i)] == []


def test_a_text_of_one_chunk_needs_no_cuts(model):
    _, sp, vocabulary = model
    for text in odd_texts(300):
        if text:
            assert list(vocabulary.encode(K.MARK + text.replace(" ", K.MARK))) == sp.encode(text)


def test_any_identifiers_decode_as_the_library_does(model):
    _, sp, vocabulary = model
    r = random.Random(6)
    bytes_ = list(vocabulary.value)
    for _ in range(4000):
        ids = [r.choice([r.randrange(sp.get_piece_size()), r.choice(bytes_), r.choice([0, 1, 2, 28705])])
               for _ in range(r.randint(0, 8))]
        assert vocabulary.decode(ids) == sp.decode(ids), ids


def test_memory_is_bounded_and_harmless(model, monkeypatch):
    _, sp, vocabulary = model
    monkeypatch.setattr(K, "MEMORY", 5)
    encoder = K.Encoder(vocabulary)
    for text in ["alpha beta gamma delta epsilon zeta eta theta", "theta eta alpha iota kappa lambda"] * 2:
        assert encoder(text) == sp.encode(text)
    assert len(encoder) <= 5 and len(encoder.old) <= 5


def test_digest_with_odd_rows(spark, model):
    path, sp, _ = model
    rows = [(1, None), (2, ""), (3, "Hello, wörld"), (3, "Hello, wörld"), (None, "x " * 5000), (2**60 + 1, "z" * 70000),
            *((10 + i, t) for i, t in enumerate(odd_texts(50)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "'a' AS ids", "true AS agrees")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(d, len(i := sp.encode(t or "")), sha(",".join(map(str, i))), sha(sp.decode(i)), True) for d, t in rows]
    assert rows_of(K.digest(df, path)) == sorted(expected, key=str)
    assert K.digest(df.limit(0), path).count() == 0


def test_encode_gives_the_identifiers(spark, model):
    path, sp, _ = model
    df = spark.createDataFrame([(1, "some words"), (2, None)], "item long, text string")
    assert rows_of(K.encode(df, path, key="item")) == [(1, sp.encode("some words"), "some words", True), (2, [], "", True)]


def test_other_models_are_refused(model):
    from sentencepiece import sentencepiece_model_pb2 as schema

    path, *_ = model
    with open(path, "rb") as f:
        proto = schema.ModelProto.FromString(f.read())
    proto.trainer_spec.model_type = schema.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError, match="merge-type"):
        K.Vocabulary(proto.SerializeToString())
