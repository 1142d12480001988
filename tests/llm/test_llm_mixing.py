import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import SPACE, rows_of
from plume.llm import mixing as M


def targets(sizes):
    """Shares by weight; whatever is above its cap is shared again."""
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    full = set()
    while True:
        rest = [s for s in sources if s not in full]
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = {s for s in rest if share[s] > 3 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in full else share[s] for s in sources}
        full |= above


@pytest.mark.parametrize("seed,bucket", [(0, 3), (1, 100), (2, 2), (3, 20_000)])
def test_mix_meets_its_targets(spark, seed, bucket, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", bucket)
    r = random.Random(seed)
    names = ["a", "b", None, "é", "Z", "zz"][:r.randint(1, 6)]
    rows = [(r.choice([i, None]), r.choice(names), r.choice(["", "x", "a b " * r.randint(1, 50), None]))
            for i in range([5, 60, 60, 1][seed])]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(SPACE.findall(t or ""))
    goal = targets(sizes)
    mixed = M.mix(df).collect()
    taken = Counter()
    for x in mixed:
        assert x.target == pytest.approx(goal[x.source]) and x.source_size == sizes[x.source]
        assert all(0 <= s <= x.size * x.rows for s in x.served or [])
        taken[x.source] += sum(x.served or [])
    for s in sizes:  # whole words
        assert goal[s] - 1 <= taken[s] <= goal[s]
    each = M.digest(df)
    assert each.filter("taken < 0 OR taken > 3 * size").isEmpty()
    assert each.agg(F.sum("taken")).first()[0] == sum(taken.values())
    assert rows_of(M.digest(df)) == rows_of(M.digest(df.repartition(7)))  # reruns agree
    assert M.digest(df).count() == len(rows)
    clash = df.withColumn("size", F.lit("s")).withColumn("Taken", F.lit("t")).withColumn("key", F.lit("k"))
    docs = M.mixed_documents(clash)
    assert docs.columns == [*clash.columns, "size_", "source_size", "target", "taken_", "place"]
    assert docs.agg(F.sum("taken_")).first()[0] == (sum(taken.values()) or None)


def test_queue_is_cut_at_the_budget(spark):
    """The words taken are the first ones of the queue of single words, in order
    of finish time, until the budget is used up."""
    r = random.Random(5)
    rows = [(i, "abc"[i % 3], "w " * r.randint(1, 30)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = M.mix(df).collect()
    words = []
    for s in "abc":
        own = sorted((x for x in mixed if x.source == s), key=lambda x: x.key)
        at = 0
        for round_ in range(3):
            for x in own:
                for _ in range(x.size):
                    at += 1
                    words.append((at / x.target, x.doc_id))
    budget = sum(x.size for x in mixed)
    queue = Counter(d for _, d in sorted(words)[:budget])
    assert all(abs(queue[x.doc_id] - sum(x.served or [])) <= 1 for x in mixed)


@pytest.mark.parametrize("bucket", [7, 100, 20_000])
def test_repeated_rows_are_served_in_turn(spark, bucket, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", bucket)
    rows = [(1, "a", "one two three four five")] * 1000 + [(2, "b", "x " * 5000)] + [(None, "c", "y z")] * 7
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    goal = targets({"a": 5000, "b": 5000, "c": 14})
    for out, size, taken in ((M.digest(df), "size", "taken"), (M.mixed_documents(df), "size", "taken")):
        words = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(taken).alias("n")).collect()}
        for d, s in ((1, "a"), (2, "b"), (None, "c")):
            assert goal[s] - 1 <= words[d] <= goal[s]
        assert out.filter(f"{taken} > 3 * {size}").isEmpty()
    assert M.digest(df).count() == len(rows)


def test_empty_and_plan(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert M.digest(df).count() == 0 and M.mixed_documents(df).count() == 0
    full = spark.createDataFrame([(1, "a", "x y")], df.schema)
    plan = M.digest(full)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
