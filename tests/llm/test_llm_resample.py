import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from helpers import ALNUM, lower, rows_of
from plume.llm import resample as R


def words(text):
    return ALNUM.findall(lower(text))


def features(text):
    w = words(text)
    return [zlib.crc32(x.encode()) for x in [*w, *map(" ".join, zip(w, w[1:]))]]


def brute(rows, target, buckets=R.BUCKETS, least=20, share=(25, 100)):
    s, t = (Counter(f % buckets for x in texts for f in features(x)) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for d, x in rows:
        own = [gain[f % buckets] for f in features(x)]
        weight = sum(own) // len(own) if own else 0
        h = int(sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(fit[:share[0] * len(fit) // share[1]], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in out), key=str)


def some_rows(n, seed=3):
    r = random.Random(seed)
    vocabulary = ["alpha", "BETA", "gämma", "x", "中文", "über", "o" * 47, "p" * 48, "q" * 49, "z" * 200, "don't", "7"]
    line = lambda: "".join(r.choice(vocabulary) + r.choice([" ", " ", ", ", " - "]) for _ in range(r.randint(0, 9)))
    shared = [line() for _ in range(5)] + ["", " ", "..."]
    text = lambda: r.choice(["\n", "\n\n", "\r\n"]).join(r.choice([line(), r.choice(shared)]) for _ in range(r.randint(1, 8)))
    return [(i, r.choice([None, "", text(), text(), text(), text()])) for i in range(n)]


def test_digest_against_brute_force(spark):
    rows = some_rows(150)
    rows += rows[:20] + [(None, "word " * 30)] * 12 + [(None, None), (2**60 + 1, "long " * 9000 + "y" * 70000)]
    target = ["alpha beta\ngamma don't 7", None, "", "中文 über\nx"]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' AS weight", "1 AS line", "0 AS N_WORDS")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert rows_of(R.digest(df, goal)) == brute(rows, target)
    assert rows_of(R.digest(df, goal.limit(0))) == brute(rows, [])
    few = rows[:6]
    assert rows_of(R.digest(spark.createDataFrame(few, "doc_id long, text string"), goal, share=(1, 2), least=1)) == \
        brute(few, target, least=1, share=(1, 2))
    assert R.digest(df.limit(0), goal).count() == 0


def test_bucket_counts_multiply_lines_and_add_their_joints(spark):
    texts = ["a b\nc d\n\n \ne", "a b\nc d", "a b\nc d", None, "", "\n", "B a\r\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    expected = Counter(f % 50 for t in texts for f in features(t))
    assert {r.bucket: r.n for r in R.bucket_counts(df, 50).collect()} == dict(expected)


def test_resample_returns_whole_documents_near_the_target(spark):
    r = random.Random(8)
    near = ["ship", "harbour", "sail", "tide"]
    far = ["stock", "market", "bond", "yield"]
    rows = [(i, " ".join(r.choice(near if i % 4 == 0 else far) for _ in range(60)), "keep") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank string")
    goal = spark.createDataFrame([(" ".join(near * 40),)], "text string")
    drawn = R.resample(df, goal, share=(1, 5)).collect()
    assert len(drawn) == 80 and sorted(x["rank_"] for x in drawn) == list(range(1, 81))
    assert sum(x.doc_id % 4 == 0 for x in drawn) >= 60
    assert all(x.text == rows[x.doc_id][1] and x["rank"] == "keep" for x in drawn)


def test_noise_is_gumbel(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    values = [x.n for x in ids.select(R.noise(ids.doc_id, 7).alias("n")).collect()]
    assert sum(values) / len(values) == pytest.approx(577, abs=30)


def test_ranks_are_dense_with_one_hot_id(spark):
    rows = [(5, "same words in every row of this hot group " * 4)] * 3000 + [(i, f"word{i} " * 25) for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = R.digest(df, spark.createDataFrame([("same words",)], "text string")).collect()
    ranks = sorted(r["rank"] for r in out if r["rank"])
    assert len(out) == 3300 and ranks == list(range(1, 3300 * 25 // 100 + 1))
