import random

import pytest

from helpers import rows_of
from plume.llm import tokens as K

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    path = P.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_counts_equal_the_library(model):
    path, sp = model
    with open(path, "rb") as f:
        memory = K.Memory(K.Pieces(f.read()))
    r = random.Random(0)
    alphabet = "  abcdefgthe▁\n\t,.()[]{}01239éüñçßőж中文🙂\u0000‍́</s>[INST]<0x41>AB'\"_-"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "  ", "   a", "a  ", "\n\n", " " * 500, "a" * 5000, "if (x){\n    return y;\n}\n\n\n", "</s> <s> <unk> <0x0A>"]
    assert [t for t in texts if memory.count(t) != len(sp.encode(t))] == []


def test_memory_is_bounded_and_harmless(model, monkeypatch):
    path, sp = model
    monkeypatch.setattr(K, "MEMORY", 5)
    with open(path, "rb") as f:
        memory = K.Memory(K.Pieces(f.read()))
    for text in ["alpha beta gamma delta epsilon zeta eta theta", "theta eta alpha iota kappa lambda"] * 2:
        assert memory.count(text) == len(sp.encode(text))
    assert len(memory) <= 5 and len(memory.old) <= 5


def test_digest_with_odd_rows(spark, model):
    path, sp = model
    rows = [(1, None), (2, ""), (3, "Hello, wörld"), (3, "Hello, wörld"), (None, "x " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens")
    expected = [(d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t in rows]
    assert rows_of(K.digest(df, path)) == sorted(expected, key=str)
    assert K.digest(df.limit(0), path).count() == 0
