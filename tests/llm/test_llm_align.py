import random
from collections import Counter
from hashlib import sha256

import pytest

from helpers import rows_of
from plume.llm import align as A

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def paths():
    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def cut(paths):
    """Per text both lists of (identifier, bytes), by other means than the operator's."""
    a = tokenizers.Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    alphabet = tokenizers.pre_tokenizers.ByteLevel.alphabet()
    # the alphabet's characters in order of the bytes they stand for
    plain = sorted(ord(c) for c in alphabet if ord(c) < 256)
    byte = {chr(x): x for x in plain}
    byte |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in byte.values())}

    def one(text):
        if not text:
            return [], []
        x = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            y.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        data = (" " + text).encode()
        same = b"".join(t for _, t in x) == data == b"".join(t for _, t in y)
        return (x, y) if same else ([], [])

    return one


def ends(tokens):
    out, at = [], 0
    for _, t in tokens:
        at += len(t)
        out.append(at)
    return out


def brute(rows, cut):
    """From the contract: every pair of tokens is looked at."""
    found, counts = [], Counter()
    for d, text in rows:
        x, y = cut(text)
        ex, ey = ends(x), ends(y)
        links = [(x[i][0], y[j][0]) for i in range(len(x)) for j in range(len(y)) if ex[i] == ey[j]]
        counts.update(links)
        groups, i, j = [], 0, 0
        for e in sorted(set(ex) & set(ey)):
            k, m = ex.index(e) + 1, ey.index(e) + 1
            groups.append(",".join(str(t[0]) for t in x[i:k]) + "|" + ",".join(str(t[0]) for t in y[j:m]))
            i, j = k, m
        over = sum(ex[i] - len(x[i][1]) < ey[j] and ey[j] - len(y[j][1]) < ex[i] for i in range(len(x)) for j in range(len(y)))
        found.append((d, len(x), len(y), links, groups, over))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(((d, a, b, len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                    sha256(";".join(g).encode()).hexdigest() if a else "", over) for d, a, b, links, g, over in found), key=str)


def some_rows(n):
    r = random.Random(2)
    words = ["the", "internationalisation", "of", "straße", "中文字", "🙂", "x\u0000y", "</s>", "<|endoftext|>", "<0x41>", "don't",
             "12345", "\n\n", "  ", "\t", "naïve", "…", "é"]
    return [(i, r.choice([None, "", *([r.choice([" ", ""]).join(r.choice(words) for _ in range(r.randint(1, 25)))] * 8)])) for i in range(n)]


def test_digest_against_brute_force(spark, paths, cut):
    rows = some_rows(120)
    rows += rows[:15] + [(None, "again"), (None, "mark ▁ inside"), (2**60 + 1, "big id"), (7, "x" * 3000), (8, "ab " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS links", "2 AS N_A", "'q' AS pair")
    assert rows_of(A.digest(df, *paths)) == brute(rows, cut)
    assert A.digest(df.limit(0), *paths).count() == 0


def test_chunks_end_where_both_tokenizers_end_a_token(paths):
    r = random.Random(9)
    assert A._cuttable(*paths)
    pairs = A.Pairs(A.byte_level_tokens(paths[0]), A.piece_tokens(paths[1]))
    aligner = A.Aligner(pairs, *paths, True)
    alphabet = "aB9éÀ×÷_.,;:!?)('\"-  \n\n\t\r\u00a0\u2003\u3000中🙂\u0301\u0000<"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 30))) for _ in range(6000)]
    texts += [" ", "  ", "\n", "a ", "a \n", "a\n", "a\n\nb", "it's", "x's.y", "I'll go.\nThen", "a .b", "a. b", "don't!'s"]
    whole = A.Aligner(pairs, *paths, False)
    a, b = aligner.a, aligner.b
    want = list(zip([e.ids for e in a.encode_batch([" " + t for t in texts], add_special_tokens=False)], b.encode(texts)))
    for text, (x, y) in zip(texts, want):
        chunks = aligner.cut(" " + text)
        assert "".join(chunks) == " " + text
        xs, ys, _ = aligner.ids(chunks)
        assert [i for c in xs for i in c] == x and [i for c in ys for i in c] == y, text
    total = lambda found: [(sum(c[0] for c in f), sum(c[1] for c in f), sum(c[2] for c in f), ";".join(c[3] for c in f),
                            b"".join(c[4] for c in f)) for f in found]
    first = total(aligner(texts))
    assert first == total(whole(texts)) == total(aligner(texts))  # cut or not, new or remembered


def test_gallop_against_sets():
    r = random.Random(4)
    for _ in range(500):
        long = sorted(r.sample(range(300), r.randint(0, 120)))
        short = sorted(r.sample(range(320), r.randint(0, min(20, len(long) + 1))))
        assert A.gallop(short, long) == [sum(x < v for x in long) for v in short]


def test_align_gives_groups_and_overlaps(spark, paths, cut):
    rows = some_rows(60)
    out = {r.doc_id: r for r in A.align(spark.createDataFrame(rows, "doc_id long, text string"), *paths).collect()}
    for d, text in rows:
        x, y = cut(text)
        r, ex, ey = out[d], ends(x), ends(y)
        assert r.a_ids == [t[0] for t in x] and r.b_ids == [t[0] for t in y]
        both = sorted(set(ex) & set(ey))
        assert r.a_cut == [ex.index(e) + 1 for e in both] and r.b_cut == [ey.index(e) + 1 for e in both]
        for i, (first, last) in enumerate(zip(r.a_first, r.a_last)):
            hit = [j for j in range(len(y)) if ex[i] - len(x[i][1]) < ey[j] and ey[j] - len(y[j][1]) < ex[i]]
            assert [first, last] == [hit[0], hit[-1]]


def test_every_link_is_a_numbered_pair(paths, cut):
    pairs = A.Pairs(A.byte_level_tokens(paths[0]), A.piece_tokens(paths[1]))
    assert len(pairs.codes) <= pairs.a_size.sum() + 2 * pairs.b_size.sum() + len(pairs.a)
    known = set(pairs.codes.tolist())
    for _, text in some_rows(200):
        x, y = cut(text)
        ex, ey = ends(x), ends(y)
        for e in set(ex) & set(ey):
            assert x[ex.index(e)][0] * len(pairs.b) + y[ey.index(e)][0] in known
