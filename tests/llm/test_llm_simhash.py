import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helpers import SPACE, lower, rows_of
from plume.llm import simhash as S
from plume.llm.links import components


def print_of(text, shingle=3):
    w = SPACE.findall(lower(text))
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < shingle else [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, bits):
    """Smallest index linked to each index."""
    least = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= bits and least[i] != least[j]:
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    return least


def test_fingerprint_is_the_majority_of_xxh64_bits(spark):
    texts = [None, "", " \t", "One", "one two", "A b c", "a  b\nc d e f", "ÄÖ x\x0by z " * 40, "a b c " * 999]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: int(r.fingerprint, 16) for r in S.digest(df).collect()}
    assert got == {i: print_of(t) for i, t in enumerate(texts)}
    hashed = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert hashed == int(np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).view(np.int64))


@pytest.mark.parametrize("bits,limit", [(3, 20_000), (3, 25), (2, 10), (1, 20_000), (0, 20_000)])
def test_links_connect_what_all_pairs_would(spark, bits, limit):
    r = random.Random(bits + limit)
    prints = [r.getrandbits(64) for _ in range(60)]
    for b in prints[:12]:  # chains and a dense group
        for _ in range(6):
            for x in r.sample(range(64), r.choice([1, 2, 3, 3, 4])):
                b ^= 1 << x
            prints.append(b)
    prints += [prints[20] ^ (1 << a) ^ (1 << c) for a in range(0, 40) for c in (50, 51)]
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    found = components(S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits, limit)).collect()
    by_root = {}
    for x in found:
        by_root.setdefault(x.root, set()).add(x.node)
    expected = {}
    for i, g in enumerate(groups(prints, bits)):
        expected.setdefault(g, set()).add(signed[i])
    assert sorted(map(sorted, by_root.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)
    assert all(root == min(nodes) for root, nodes in by_root.items())


def test_components_and_survivors_with_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text, "x"), (3, text.upper(), "y"), (3, text.upper(), "y"), (None, text, "z"), (9, None, "n"), (8, "", "e"),
            (None, "alone it stands", "q"), (7, "alone and different words here", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("Component_ID", F.lit(1))
    got = [(r.doc_id, r.component_id) for r in S.digest(df).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 8), (8, 8), (None, None), (7, 7)], key=str)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert rows_of(kept, "doc_id", "fp") == sorted([(3, "y"), (8, "e"), (None, "q"), (7, "r")], key=str)
    assert S.digest(df.limit(0)).count() == 0 and S.keep_one(df.limit(0)).count() == 0
