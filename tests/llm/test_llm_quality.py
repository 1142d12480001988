import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from helpers import rows_of
from plume.llm import quality as Q


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    return docs, labels, Q.digest(docs, labels)


def test_held_out_accuracy(spark, judged):
    """Mined on one half of the labels, measured on the other."""
    docs, labels, _ = judged
    model = Q.fit(docs, labels.filter("doc_id % 2 = 0"))
    found, names = Q.scored(docs, model)
    rows = found.join(labels.filter("doc_id % 2 = 1"), "doc_id").select(names["score"], "quality", "toxic").collect()
    share = lambda keep: np.mean([s < 0.5 for s, q, t in rows if keep(q, t)])
    assert share(lambda q, t: q == 0) > 0.95
    assert share(lambda q, t: q == 1 and t == 1) > 0.72
    assert share(lambda q, t: q == 1 and t == 0) < 0.01


def test_held_out_recall_in_every_language_with_enough_labels(spark):
    """Mined on one half of the labels, measured on the other, by language."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found, names = Q.scored(docs, Q.fit(docs, labels.filter("doc_id % 2 = 0")))
    rows = found.join(labels.filter("doc_id % 2 = 1 AND quality = 1"), "doc_id").select(names["score"], "toxic", "lang").collect()
    for lang in {r.lang for r in rows}:
        toxic = [r[0] < 0.5 for r in rows if r.toxic == 1 and r.lang == lang]
        assert len(toxic) < 25 or np.mean(toxic) >= 0.9, (lang, len(toxic))
        assert np.mean([r[0] < 0.5 for r in rows if r.toxic == 0 and r.lang == lang]) < 0.005
    assert np.mean([r[0] < 0.5 for r in rows if r.toxic == 1]) >= 0.9


def test_votes_of_mined_terms(spark):
    terms = Q.C.Words([b"zorblax quuxly"], Q.C.ALNUM_TABLE).hash
    model = Q.Model(terms)
    texts = [b"a fine day", b"one zorblax here", b"zorblax and zorblax", b"quuxly zorblax", b"one quuxly"]
    votes = Q.Shapes(texts).votes(model.terms)[:, Q.SHAPE_LABELLERS:]
    said = {tuple((v == Q.BAD).tolist()) for v in votes[1:2]}
    assert (votes[:, 0] == Q.BAD).tolist() == [False, False, True, True, False]  # two or more
    assert (votes[:, 1:] == Q.BAD).any(1).tolist() == [False, True, True, True, True]
    assert said in ({(False, True, False)}, {(False, False, True)})


def test_every_row_is_scored_and_reruns_agree(judged):
    docs, labels, found = judged
    first = rows_of(found)
    assert len(first) == docs.count()
    again = rows_of(Q.digest(docs.repartition(5), labels))
    assert [r[0] for r in first] == [r[0] for r in again] and [r[3] for r in first] == [r[3] for r in again]
    assert all(0 <= r[1] <= 1 and 0 <= r[2] <= 1 for r in first)


def test_em_recovers_accuracies():
    """Votes drawn from known rates; the posterior finds the class."""
    r = np.random.default_rng(1)
    m, n = len(Q.LABELLERS), 20_000
    kind = r.choice(3, n, p=[0.75, 0.15, 0.1])
    votes = np.full((n, m), Q.NONE)
    for j in range(m):
        own = 1 if j < Q.SHAPE_LABELLERS else 2
        bad = r.random(n) < np.where(kind == own, 0.6, 0.01)
        votes[:, j] = np.where(bad, Q.BAD, Q.GOOD if own == 1 else Q.NONE)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good = Q.estimate(patterns, counts)[at.ravel()]
    # what the true rates and shares would say
    logs = np.zeros((n, 3)) + np.log([0.75, 0.15, 0.1])
    for j in range(m):
        for c in range(3):
            rate = 0.6 if c == (1 if j < Q.SHAPE_LABELLERS else 2) else 0.01
            logs[:, c] += np.log(np.where(votes[:, j] == Q.BAD, rate, 1 - rate))
    best = np.mean((logs.argmax(1) == 0) == (kind == 0))
    assert np.mean((good > 0.5) == (kind == 0)) > best - 0.005


def test_odd_rows_and_no_labels(spark):
    rows = [(1, None), (2, ""), (3, "A quiet sentence about rivers and hills that goes on."), (3, "A quiet sentence about rivers and hills that goes on."),
            (None, "SHOUT!! SHOUT!! SHOUT!! SHOUT!! SHOUT!! NOW!!"), (5, "word " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Score", F.lit("mine"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {(r.doc_id, r.rejected) for r in Q.digest(docs, none).collect()}
    assert {(1, True), (2, True)} <= found
    kept = Q.keep_good(docs, none)
    assert kept.columns == docs.columns
    assert Q.digest(docs.limit(0), none).count() == 0
    assert Q.digest(docs, spark.createDataFrame([(None, None, None), (1, 0, 1)], none.schema)).count() == len(rows)


def test_rare_toxic_words_are_mined_among_many_common_ones(spark):
    r = np.random.default_rng(3)
    common = np.array([f"w{i:05d}" for i in range(9000)])
    rows, marks = [], []
    for i in range(90):
        words = r.permutation(common).tolist()
        if i < 6:
            words.insert(100, "zorblax")
        rows.append((i, " ".join(words)))
        marks.append((i, int(i >= 30), int(i < 30)))
    terms = Q.mine_terms(spark.createDataFrame(rows, "doc_id long, text string"),
                         spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), 20_000)
    word = Q.C.Words([b"zorblax"], Q.C.ALNUM_TABLE).hash
    begin = Q.C.Words([b"zorbl"], Q.C.ALNUM_TABLE).hash ^ np.uint64(1)
    assert sorted(terms.tolist()) == sorted([int(word[0]), int(begin[0])])


@pytest.mark.parametrize("n", [1, 16_000, 10**9, 16_777_216_001, 5 * 10**10, 10**15])
def test_samples_have_their_size_at_any_number_of_rows(spark, n):
    limit = int(str(Q._share(n, 16_000)("id")._jc.toString()).rsplit(" ", 1)[1].rstrip("L)"))
    assert limit / 2**62 * n == pytest.approx(min(n, 16_000), rel=1e-3)


def test_one_document_repeated_beyond_the_sample(spark):
    rows = [(7, "A quiet sentence about rivers and hills that goes on and on.")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for train_rows in (1, 16_000):
        model = Q.fit(docs, none, train_rows=train_rows)
        assert model.bias != 0
