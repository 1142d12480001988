import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from helpers import rows_of
from plume.llm import syncmers as S


def brute(spark, rows):
    texts = sorted({t or "" for _, t in rows})
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").withColumn("h", F.xxhash64("t")).collect()} if texts else {}
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        edited = t[:len(t) - len(t) // 4] + after[:len(t) // 4]
        own, changed, next_ = S.fingerprints([t])[0], S.fingerprints([edited])[0], S.fingerprints([after])[0]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed, S.likeness(own, changed), S.likeness(own, next_)))
    return sorted(out, key=str)


def test_digest_against_brute_force(spark):
    r = random.Random(1)
    text = lambda m: "".join(r.choice("abcé 🙂中d") for _ in range(m))
    for n in (1, 12, 40):
        rows = [(r.choice([i, i, None, 3]), r.choice([None, "", text(r.randint(1, 400)), text(5)])) for i in range(n)]
        rows += rows[:2]
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("mine"))
        assert rows_of(S.digest(df)) == brute(spark, rows)
    assert S.digest(df.limit(0)).count() == 0


def test_no_document_is_lost_beside_a_null_id(spark):
    rows = [(2**60 + i, f"text of document {i} " * 5) for i in range(3000)] + [(None, "no id"), (2**60 + 7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(S.digest(df)) == brute(spark, rows)


def test_syncmers_are_closed_and_free_of_context():
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh ") for _ in range(500))
    whole, part = S.syncmers([text, text[100:300]])
    inside = {(int(p) - 100, int(h)) for p, h in zip(*whole) if 100 <= p and p + S.K <= 300}
    assert inside == {(int(p), int(h)) for p, h in zip(*part)}
    assert 0.2 < len(whole[0]) / (len(text) - S.K + 1) < 0.5  # about 2 in K - S + 1


def test_edited_texts_are_nearer_than_strangers():
    r = random.Random(7)
    texts = ["".join(r.choice("abcdefghijklmnop ") for _ in range(3000)) for _ in range(20)]
    prints = S.fingerprints(texts)
    for a, b, x, y in zip(texts, texts[1:], prints, prints[1:]):
        edited = S.fingerprints([a[:2250] + b[:750]])[0]
        assert S.likeness(x, edited) > 0.35 and S.likeness(x, y) < 0.1
    assert S.likeness(prints[0], prints[0]) == 1.0 and S.likeness("", "") == 1.0 and S.likeness("", prints[0]) == 0.0


def test_fingerprints_keep_every_anchor():
    r = random.Random(9)
    word = lambda m: "".join(r.choice("abcdefghijklmnop ") for _ in range(m))
    line = word(40)
    texts = [word(20000), (line + "\n") * 300, "a" * 3000, word(12), "short", ""]
    for text, own, coded in zip(texts, S.syncmers(texts), S.fingerprints(texts)):
        at, value = S.decoded(coded)
        if len(own[0]):
            assert np.array_equal(at, own[0]) and np.array_equal(value, own[1])
        else:
            assert len(at) == bool(text)


def test_a_passage_shared_by_long_texts_shows():
    r = random.Random(11)
    word = lambda m: "".join(r.choice("abcdefghijklmnop ") for _ in range(m))
    for size in (5000, 100000):
        passage = word(300)
        a, b = word(size) + passage + word(size), word(size // 2) + passage + word(size)
        anchors = len(S.syncmers([passage])[0][0])
        x, y = S.fingerprints([a, b])
        union = len(S.decoded(x)[0]) + len(S.decoded(y)[0]) - anchors
        # other k-mers may agree by chance, and then stand out of order
        assert anchors > 70 and abs(S.likeness(x, y) * union - anchors) < 0.1 * anchors


def test_every_occurrence_counts():
    line = "the quick brown fox jumps over the lazy dog\n"
    few, many = S.fingerprints([line * 10, line * 40])
    assert 0.2 < S.likeness(few, many) < 0.3


def test_likeness_against_longest_run():
    r = random.Random(13)
    for _ in range(50):
        places = r.sample(range(40), r.randint(0, 12))
        best = [0] * len(places)
        for i, p in enumerate(places):
            best[i] = 1 + max((best[j] for j in range(i) if places[j] < p), default=0)
        assert S._longest_run(np.array(places, np.int64)) == max(best, default=0)


def test_texts_are_shuffled_packed(spark):
    from plume.llm import syncmers

    texts = ["", "a", "ä\U0001f600\x00 " * 50, "word " * 20_000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = syncmers.with_next(docs).filter("NOT head").collect()
    assert sorted((r.doc_id, syncmers.unpacked(bytes(r.text))) for r in rows) == [(i, t or "") for i, t in enumerate(texts)]
    assert sum(len(r.text) for r in rows) < 2_000
