"""Quality classifier from weak labels.

1. Labellers vote on every document: good, bad, or nothing.  They look at
   shape (shouting, symbols, doubled marks, lone marks, repetition, long runs,
   variety) and at words: words and word beginnings are mined that labelled
   toxic documents have and labelled good ones don't; one labeller looks for
   two or more of them, two others for any of one half of them.  Their votes
   overlap.
2. Expectation-maximisation over the counts of vote patterns (of all documents)
   estimates each labeller's rates in each class (good, bad by shape, bad by
   words) and the classes' shares, and with them the probability that a document is good.
3. These probabilities train a linear scorer over hashed features (words and
   shape), which decides.

Scale: the votes are one narrow pass; at most 3^10 pattern counts reach the
driver.  Mining and training use samples of bounded size, chosen by a hash:
about ``mine_rows`` labelled documents and ``train_rows`` documents.  Scoring
is one narrow pass with the weights (a fixed number) as a broadcast.

Defined cases: a null or blank text gets no vote and is rejected (there is
nothing to keep); repeated rows are judged alike; without labels the mined
words are none; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plume.llm import common as C

SHARD_BYTES = 1 << 20
#: Hashed features of the scorer.
WIDTH = 1 << 18
BAD, GOOD, NONE = 0, 1, 2
LABELLERS = ["shouting", "symbols", "marks", "lone", "repetition", "runs", "variety", "several", "terms_a", "terms_b"]
SHAPE_LABELLERS = 7
#: Bytes of a word's beginning that is mined beside the word.
BEGINNING = 5


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars.encode(), np.uint8)] = True
    return table


_UPPER, _SYMBOL = _table(C.UPPER), _table("|!#$%&*~^{}<>=_\\@+")
_LETTER = _table(C.UPPER + C.LOWER) | (np.arange(256) >= 0xC0)  # a letter beyond ASCII counts by its first byte


class Shapes:
    """Shares that describe the texts, and their lower-cased words."""

    def __init__(self, texts: list[bytes]) -> None:
        w = C.Words(texts, C.SPACE_TABLE)
        raw = np.frombuffer(w.data, np.uint8)
        at = w.offset
        self.n = w.counts()
        letters = np.maximum(self._count(_LETTER[raw], at), 1)
        self.upper = self._count(_UPPER[raw], at) / letters
        symbol = _SYMBOL[raw]
        words = np.maximum(self.n, 1)
        self.symbol = self._count(symbol, at) / np.maximum(np.diff(at), 1)
        self.double = self._count(np.append(symbol[1:] & symbol[:-1], False), at) / words
        lone = symbol[w.start] & (w.end - w.start == 1)
        self.lone = self._count(lone, w.first) / words
        text = np.repeat(np.arange(len(self.n)), self.n)
        same = np.append(w.hash[1:] == w.hash[:-1], False) & np.append(text[1:] == text[:-1], False)
        self.repeat = self._count(same, w.first) / words
        # words that are followed by four equal ones
        run = same.copy()
        for k in range(1, 4):
            run &= np.append(same[k:], np.zeros(min(k, len(same)), bool))
        self.run = self._count(run, w.first) / words
        order = np.lexsort((w.hash, text))
        new = np.append(True, (w.hash[order][1:] != w.hash[order][:-1]) | (text[order][1:] != text[order][:-1]))[:len(order)]
        self.variety = self._count(new, w.first) / words
        self.words = C.Words([t.lower() for t in texts], C.ALNUM_TABLE)
        x = self.words
        self.beginning = x.hashes(np.minimum(x.end, x.start + BEGINNING)) ^ np.uint64(1)
        self.beginning[x.end - x.start <= BEGINNING] = 0

    @staticmethod
    def _count(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marks)])
        return sums[at[1:]] - sums[at[:-1]]

    def votes(self, terms: "Terms") -> np.ndarray:
        """A column per labeller of BAD, GOOD or NONE."""
        def above(x: np.ndarray, good: float, bad: float) -> np.ndarray:
            return np.where(x > bad, BAD, np.where(x < good, GOOD, NONE))

        few = self.n < 20
        variety = np.where(few, NONE, np.where(self.variety < 0.25, BAD, np.where(self.variety > 0.4, GOOD, NONE)))
        marks = terms.marks(self.words.hash) | terms.marks(self.beginning)
        # two or more of the terms anywhere; any of either half of them
        said = [np.where(self._count(marks >> k & 1, self.words.first) > (k == 0), BAD, NONE) for k in range(3)]
        votes = np.stack([above(self.upper, 0.15, 0.3), above(self.symbol, 0.02, 0.04), above(self.double, 0.02, 0.1),
                          above(self.lone, 0.02, 0.1), above(self.repeat, 0.1, 0.3), above(self.run, 0.02, 0.1), variety, *said], 1)
        votes[self.n == 0] = NONE
        return votes

    def features(self, votes: np.ndarray) -> list[np.ndarray]:
        """Per text its hashed features: words, votes, steps of the shares."""
        out = []
        steps = [(v * 20).astype(np.int64) for v in (self.upper, self.symbol * 4, self.double, self.lone, self.repeat, 1 - self.variety)]
        index = (self.words.hash % np.uint64(WIDTH - 256)).astype(np.int64) + 256
        for i in range(len(self.n)):
            shape = [64 + 32 * k + min(int(s[i]), 31) for k, s in enumerate(steps)]
            said = [3 * k + int(v) for k, v in enumerate(votes[i])]
            out.append(np.unique(np.concatenate([index[self.words.first[i]:self.words.first[i + 1]], shape, said])))
        return out


class Terms:
    """Hashes of words and beginnings, each in some of three lists."""

    def __init__(self, lists: list[np.ndarray]) -> None:
        self.hash = np.unique(np.concatenate(lists).astype(np.uint64))
        self.lists = sum(np.isin(self.hash, x).astype(np.int64) << k for k, x in enumerate(lists))

    def marks(self, hashes: np.ndarray) -> np.ndarray:
        """Bit k if the hash is in list k."""
        if not len(self.hash):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, self.lists[at], 0)


def _share(rows: int, most: int):
    """A filter that keeps about ``most`` of ``rows`` rows by a hash: below a
    limit of 62 bits, so the share holds for any number of rows."""
    limit = min(1 << 62, (most << 62) // max(1, rows))
    return lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 62)) < F.lit(limit)


def mine_terms(docs: DataFrame, labels: DataFrame, mine_rows: int, support: int = 4) -> np.ndarray:
    """Hashes of words and word beginnings of labelled toxic documents that
    labelled good ones don't have, most frequent first.  Support counts
    different following words, so copies of one text don't count twice."""
    few = labels.filter(_share(labels.count(), mine_rows)("doc_id")).groupBy("doc_id") \
                .agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    few = few.select("doc_id", (F.col("toxic") == 1).alias("toxic")).filter("toxic") \
             .unionByName(few.filter("toxic = 0 AND quality = 1").select("doc_id", F.lit(False).alias("toxic")))
    sample = C.checkpoint(docs.select("doc_id", "text").filter("text IS NOT NULL")
                          .join(F.broadcast(few), "doc_id")  # about mine_rows rows of 9 bytes
                          .select("toxic", C.utf8().alias("utf8")))
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return np.zeros(0, np.uint64)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "utf8", SHARD_BYTES):
            unit, text, after = _units(batch)
            toxic = np.array(batch.column("toxic").to_pylist(), bool)
            of = toxic[text]
            # the words that follow a unit in toxic texts; the texts of each kind that have it
            pairs = _distinct(unit[of], after[of])
            both = _distinct(unit, text.astype(np.uint64))
            units, first = np.unique(both[0], return_index=True)
            bad = np.concatenate([[0], np.cumsum(toxic[both[1].astype(np.int64)])])
            ends = np.append(first[1:], len(both[0]))
            t = bad[ends] - bad[first]
            zeros = np.zeros(len(pairs[0]), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([pairs[0], units]).view(np.int64)),
                 pa.array(np.concatenate([pairs[1], np.zeros(len(units), np.uint64)]).view(np.int64), mask=np.arange(len(zeros) + len(units)) >= len(zeros)),
                 pa.array(np.concatenate([zeros, t])), pa.array(np.concatenate([zeros, ends - first - t]))], ["unit", "next", "t", "g"])

    rates = sample.mapInArrow(counts, "unit long, next long, t long, g long").groupBy("unit").agg(
        F.count_distinct("next").alias("n"), F.sum("t").alias("t"), F.sum("g").alias("g"))
    terms = rates.filter((F.col("n") >= support) & (F.col("g") * size[True] * 50 <= F.col("t") * size[False]))
    found = terms.orderBy(F.desc("t"), "unit").select("unit").collect()  # units of about mine_rows texts that toxic ones alone have
    return np.array([r.unit for r in found], np.int64).view(np.uint64)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(a)]
    return a[new], b[new]


def _units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every word and beginning of the texts, its text, and the next word."""
    shapes = Shapes(batch.column("utf8").to_pylist())
    word, begin = shapes.words.hash, shapes.beginning
    text = np.repeat(np.arange(batch.num_rows), shapes.words.counts())
    after = np.append(word[1:], np.uint64(0))[:len(word)]
    long = begin != 0
    return np.concatenate([word, begin[long]]), np.concatenate([text, text[long]]), np.concatenate([after, after[long]])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """EM for three classes, good and two ways to be bad (by shape, by words):
    the probability of good for each vote pattern.

    Every labeller starts as mostly right about its own way to be bad, and
    keeps a prior of that kind worth a hundredth of the documents, so the
    classes can't change names."""
    m = patterns.shape[1]
    weight = counts.astype(float)
    shape = np.arange(m) < SHAPE_LABELLERS
    start = np.empty((m, 3, 3))  # labeller, class, vote
    start[:, :] = np.where(shape[:, None, None], [0.02, 0.83, 0.15], [0.005, 0.005, 0.99])
    start[shape, 1] = [0.4, 0.4, 0.2]
    start[~shape, 2] = [0.5, 0.005, 0.495]
    first = np.array([0.7, 0.15, 0.15])
    rates, share = start, first
    onehot = (patterns[:, :, None] == np.arange(3)).astype(float)
    posterior = np.zeros((len(patterns), 3))
    for _ in range(rounds):
        logs = np.einsum("nmv,mcv->nc", onehot, np.log(rates)) + np.log(share)
        new = np.exp(logs - logs.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
        prior = max(1.0, weight.sum() / 100)
        held = weight[:, None] * posterior
        share = (held.sum(0) + prior * first) / (weight.sum() + prior)
        rates = np.einsum("nmv,nc->mcv", onehot, held) + prior * start
        rates /= rates.sum(2, keepdims=True)
    return posterior[:, 0]


def _train(rows: list[tuple[float, np.ndarray]], rounds: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on presence of features, soft labels, Adam steps over
    all rows; features of fewer than three rows stay at 0."""
    y = np.array([r[0] for r in rows])
    index = np.concatenate([r[1] for r in rows])
    size = np.array([len(r[1]) for r in rows])
    df = np.bincount(index, minlength=WIDTH)
    row = np.repeat(np.arange(len(rows)), size)
    use = df[index] >= 3
    index, row = index[use], row[use]
    weights, bias = np.zeros(WIDTH), 0.0
    m, v, mb, vb = np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=weights[index], minlength=len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.bincount(index, weights=error[row], minlength=WIDTH) / len(rows) + penalty * weights
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        gb = error.mean()
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        step = 0.05 * min(1.0, 4 * (1 - t / (rounds + 1)))
        weights -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        bias -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-5)
    return weights, bias


class Model:
    """Terms, posterior by vote pattern, and the scorer's weights."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = Terms([terms, terms[0::2], terms[1::2]])
        self.posterior: dict[int, float] = {}
        self.weights, self.bias = np.zeros(WIDTH, np.float32), 0.0

    def code(self, votes: np.ndarray) -> np.ndarray:
        return votes @ (3 ** np.arange(votes.shape[1]))

    def score(self, shapes: Shapes, votes: np.ndarray) -> np.ndarray:
        z = np.array([self.weights[f].sum() + self.bias for f in shapes.features(votes)])
        return np.where(shapes.n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def fit(docs: DataFrame, labels: DataFrame, mine_rows: int = 20_000, train_rows: int = 16_000) -> Model:
    """Fit the weak-label model on all documents and the scorer on a sample."""
    C.ship(docs.sparkSession)
    spark = docs.sparkSession
    model = Model(mine_terms(docs, labels, mine_rows))
    shared = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in C.slices(batches, "utf8", SHARD_BYTES):
            shapes = Shapes(batch.column("utf8").to_pylist())
            code = own.code(shapes.votes(own.terms)[shapes.n > 0])
            values, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    counted = docs.select(C.utf8().alias("utf8")).mapInArrow(count, "code long, n long") \
                  .groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()  # at most 3^10 rows
    if not counted:
        return model
    codes = np.array([r.code for r in counted])
    counts = np.array([r.n for r in counted])
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    model.posterior = dict(zip(codes.tolist(), estimate(patterns, counts).tolist()))
    shared = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in C.slices(batches, "utf8", SHARD_BYTES):
            shapes = Shapes(batch.column("utf8").to_pylist())
            votes = shapes.votes(own.terms)
            y = [own.posterior.get(c, 0.5) for c in own.code(votes).tolist()]
            keep = pa.array(shapes.n > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), pa.array(y, pa.float64()), pa.array([f.tolist() for f in shapes.features(votes)], pa.list_(pa.int32()))],
                ["order", "y", "features"]).filter(keep)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            lists = batch.column("features")
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            rows += [(y, flat[a:b].astype(np.int64)) for y, a, b in zip(batch.column("y").to_pylist(), offsets[:-1], offsets[1:])]
        if not rows:
            return
        weights, bias = _train(rows)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(weights[at], bias))], ["at", "weight"])

    order = F.xxhash64("doc_id", "text")

    def trained(which: Column) -> list:
        sample = docs.filter(which).select(order.alias("order"), C.utf8().alias("utf8"))
        return (sample.mapInArrow(features, "order long, y double, features array<int>")
                .dropDuplicates(["order"])  # rows equal in id and text train once, so the bound holds
                .repartition(1).sortWithinPartitions("order")  # about train_rows rows
                .mapInArrow(train, "at long, weight double").collect())  # at most WIDTH rows

    rows = trained(_share(int(counts.sum()), train_rows)("doc_id", "text"))
    if not rows:  # so few different rows that the hash leaves none: those with the smallest hash
        least = docs.filter(F.trim(F.coalesce("text", F.lit(""))) != "").agg(F.min(order).alias("least")).first().least
        rows = trained(order == least)
    for r in rows:
        if r["at"] < 0:
            model.bias = r.weight
        else:
            model.weights[r["at"]] = r.weight
    return model


def scored(docs: DataFrame, model: Model) -> tuple[DataFrame, dict[str, str]]:
    """The documents with ``posterior`` (weak label) and ``score`` (scorer's
    probability of good), under free names as in the dictionary."""
    C.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("posterior double, score double")
    def judge(data: pd.Series) -> pd.DataFrame:  # the texts alone go to Python, two numbers come back
        own, texts, weak, scores = shared.value, data.tolist(), [], []
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        at = 0
        while at < len(texts):  # about SHARD_BYTES of text at a time, one text at least
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SHARD_BYTES, side="right")))
            shapes = Shapes(texts[at:to])
            votes = shapes.votes(own.terms)
            weak += [own.posterior.get(c, 0.5) for c in own.code(votes).tolist()]
            scores += own.score(shapes, votes).tolist()
            at = to
        return pd.DataFrame({"posterior": weak, "score": scores}, dtype="float64")

    judged = C.fresh(docs, "judged")
    names = {c: C.fresh(docs, c) for c in ("posterior", "score")}
    out = docs.withColumn(judged, judge(C.utf8()))
    return out.select(*docs.columns, *(F.col(judged)[c].alias(n) for c, n in names.items())), names


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the scorer does not reject."""
    found, names = scored(docs, fit(docs, labels))
    return found.filter(F.col(names["score"]) >= threshold).select(*docs.columns)


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, posterior, score, rejected) for every row."""
    docs = docs.select("doc_id", "text")
    found, names = scored(docs, fit(docs, labels))
    return found.select("doc_id", F.col(names["posterior"]).alias("posterior"), F.col(names["score"]).alias("score"),
                        (F.col(names["score"]) < threshold).alias("rejected"))
