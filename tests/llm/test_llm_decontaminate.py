import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import ALNUM, lower, rows_of
from plume.llm import decontaminate as D


def windows(items, n):
    found = defaultdict(set)
    for i, text in items:
        w = ALNUM.findall(lower(text))
        for j in range(max(1, len(w) - n + 1) if w else 0):
            found[tuple(w[j:j + n])].add(i)
    return found


def brute(docs, items, n):
    out = []
    for d, text in docs:
        w, hit, ids = ALNUM.findall(lower(text)), set(), set()
        for win, own in windows(items, n).items():
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j:j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    ids |= own
        sha = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), sha, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(60))
def test_index_finds_every_window(seed, monkeypatch):
    r = random.Random(seed)
    words = [("é%d" if i % 2 else "W%d") % i for i in range(r.choice([2, 3, 6, 30]))]
    text = lambda m: " ".join(r.choice(words) for _ in range(m))
    n = r.choice([1, 2, 3, 4])
    items = [(i, text(r.choice([0, 1, 2, 3, 5, 8]))) for i in range(r.randint(0, 6))]
    texts = [r.choice(["", text(r.randint(0, 40)), "zz " + text(9) + ", zz-" + text(3), "..."]) for _ in range(r.randint(1, 6))]
    monkeypatch.setattr(D, "PIECE_WORDS", r.choice([7, 1 << 20]))
    counts, hits, ids = D._shard([t.encode() for t in texts], D.Block([(i, t.encode()) for i, t in items], n))
    for k, t in enumerate(texts):
        (_, n_words, n_hit, n_items, _, _), = brute([(0, t)], items, n)
        assert (int(counts[k]), len(hits[k]), len(ids[k])) == (n_words, n_hit, n_items)


@pytest.fixture()
def tables(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, "Start. " + item.upper() + "; end"), (2, None), (3, ""), (4, "short item"), (4, "short item"),
            (None, "x one two three four five six seven eight nine TEN"), (6, "one two three " * 2000), (7, "?!")]
    items = [(10, item), (11, "Short, item!"), (12, None), (13, "..."), (14, item), (None, "x")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_digest_with_odd_rows(spark, tables):
    docs, items, d, b = tables
    items = [(i, t) for i, t in items if i is not None]
    assert rows_of(D.digest(d, b.filter("item_id IS NOT NULL"))) == brute(docs, items, 10)
    assert D.digest(d.limit(0), b).count() == 0
    assert [r.n_hit for r in D.digest(d, b.limit(0)).collect()] == [0] * len(docs)


def test_blocks_of_the_benchmark_give_the_same(spark, tables):
    docs, _, d, b = tables
    for limit in (1, 3, 400_000):
        found, names = D.contaminated(d, b, 10, limit)
        now = rows_of(found, *names.values())
        assert limit == 1 or now == before
        before = now


def test_clean_cuts_spans_and_keeps_other_columns(spark):
    item = "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10"
    d = spark.createDataFrame([(1, "Keep this. " + item + "! And that", 5), (2, item, 6), (3, None, 7), (4, "clean", 8)],
                              "doc_id long, text string, Spans long").withColumn("items", F.lit("mine")).withColumn("utf8", F.lit(1))
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = D.clean(d, b)
    assert out.columns == d.columns
    assert rows_of(out) == rows_of(spark.createDataFrame(
        [(1, "Keep this. ! And that", 5, "mine", 1), (3, None, 7, "mine", 1), (4, "clean", 8, "mine", 1)], out.schema))


def test_words_of_70000_bytes_that_differ_by_a_swap(spark):
    word = "ab" * 35_000
    one = word[:3] + "x" + word[4:65_539] + "y" + word[65_540:]
    two = word[:3] + "y" + word[4:65_539] + "x" + word[65_540:]
    text = lambda long: " ".join([*(f"w{i}" for i in range(5)), long, *(f"v{i}" for i in range(4))])
    docs = spark.createDataFrame([(1, text(one)), (2, text(two))], "doc_id long, text string")
    items = spark.createDataFrame([(9, text(one))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in D.digest(docs, items).collect()} == {1: 10, 2: 0}


def test_items_may_have_names(spark):
    words = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, words + " and more"), (2, "none")], "doc_id long, text string")
    items = spark.createDataFrame([("b/2", words), ("a/1", words), (None, words)], "item_id string, text string")
    for block_windows in (1, 400_000):
        found, names = D.contaminated(docs, items, block_windows=block_windows)
        got = {r.doc_id: r[names["items"]] for r in found.collect()}
        assert got == {1: ["a/1", "b/2", None], 2: []}
    sha = hashlib.sha256(b"a/1,b/2").hexdigest()
    assert {r.doc_id: (r.n_items, r.items_sha256) for r in D.digest(docs, items).collect()}[1] == (3, sha)


def test_cleaning_is_one_pass_in_one_worker_without_a_copy_of_the_text(spark):
    from plume.llm import decontaminate

    docs = spark.createDataFrame([(1, "a b c d e f g h i j k tail"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    out = decontaminate.clean(docs, items)
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, " tail"), (2, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "as binary" not in plan
