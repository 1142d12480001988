import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import SPACE, rows_of
from plume.llm import repeats as R


def brute(rows, n):
    counts, words = Counter(), [SPACE.findall(t or "") for _, t in rows]
    for w in words:
        counts.update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - n + 1) if counts[tuple(w[i:i + n])] > 1 for j in range(i, i + n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(7))
def test_removed_words_against_brute_force(spark, seed):
    r = random.Random(seed)
    size, n = r.choice([2, 3, 20, 300]), [1, 2, 3, 5, 8, 35, 35][seed]
    text = lambda m: " ".join("w%d" % r.randrange(size) for _ in range(m))
    passages = [text(r.randint(1, 80)) for _ in range(4)]
    rows = []
    for i in range(30):
        t = r.choice([None, "", " ", text(r.randint(0, 100)), text(20) + "\n" + r.choice(passages) + " \x0b " + text(12),
                      r.choice(passages), text(3) + " " + r.choice(passages) + " " + r.choice(passages)])
        rows.append((r.choice([i, i, None, 1]), t))
        if r.random() < 0.2:
            rows.append(rows[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept, names = R._kept(df, n)
    assert rows_of(kept.select("doc_id", names["n_words"], names["n_removed"], F.sha2(names["kept"], 256))) == brute(rows, n)


def test_texts_without_repeats_stay_and_columns_pass(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, "Keep\tme  " + passage, "a"), (2, passage + " tail", "b"), (3, "as  it\nis", "c"), (4, None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string").withColumn("bits", F.lit(1)).withColumn("Kept", F.lit(2))
    out = R.remove_repeats(df)
    assert out.columns == df.columns
    assert rows_of(out, "doc_id", "text", "slot") == [(1, "Keep me", "a"), (2, "tail", "b"), (3, "as  it\nis", "c"), (4, None, "d")]
    assert R.digest(df.limit(0)).count() == 0


def test_words_of_70000_bytes_that_differ_by_a_swap(spark):
    word = "ab" * 35_000
    other = word[:3] + "x" + word[4:65_539] + "y" + word[65_540:]
    swapped = other[:3] + "y" + other[4:65_539] + "x" + other[65_540:]
    rest = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*rest[:20], long, *rest[20:]])) for i, long in enumerate((other, swapped))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept, names = R._kept(df, 35)
    assert rows_of(kept.select("doc_id", names["n_words"], names["n_removed"], F.sha2(names["kept"], 256))) == brute(rows, 35)
    assert {r.n_removed for r in R.digest(df).collect()} == {0}
