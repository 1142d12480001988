"""Importance resampling towards a target distribution.

A text's features are its words and its pairs of consecutive words, hashed into
buckets (CRC-32).  A bucket's gain is the logarithm of how much more often the
target uses it than the documents do; a document's weight is the mean gain of
its features; weight plus Gumbel noise (from a hash of its id) is its score,
and the highest scores are drawn, which samples without replacement.

The bucket counts of a corpus come from its distinct lines: newlines cut the
texts, equal lines meet once in a grouping, a line's features are counted once
and multiplied by its occurrences, and the pairs that reach from one line to
the next are added from the documents.

Scale: the grouping shuffles each distinct line of a task once (a hot line is
folded in every task first).  Per task one vector of counts goes on; the driver
sees ``buckets`` sums per corpus, and broadcasts as many gains.  Scoring is one
narrow pass.  Scores are integers between about -80,000 and 110,000 (logarithms
of counts below 2^63, noise of 32 bits), so their histogram is bounded; it gives
the lowest score drawn, and only rows from there on are dealt out by range and
sorted.  Ties are broken down to the reading order, so no range holds a hot key.
A rank is the place in its range plus the rows of the ranges before, read from a
checkpoint: a lost executor changes no rank.

Defined cases: null texts have no words; documents of fewer than ``least``
words are scored but never drawn; a null doc_id hashes as an empty one and comes
last among ties; rows of one doc_id go by features, weight and reading order;
an empty table gives no rows, an empty target gains for rare buckets only.
Other columns may have any names; result columns take a free one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plume.llm import common as C

BUCKETS = 10_000
SLICE_BYTES = 1 << 20
#: Longer words are hashed one by one behind so many bytes.
STEPS = 48
_NEWLINE, _SPACE = 10, 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def _advance(state: np.ndarray, data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 states after the ``size`` bytes from ``start`` of each row, all
    rows byte by byte together."""
    raw = np.frombuffer(data, np.uint8)
    order = np.argsort(-size, kind="stable")
    state, at, length = state[order], start[order], size[order]
    steps = min(STEPS, int(length[0])) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(steps), side="left")  # rows longer than each step
    for k, n in enumerate(live.tolist()):
        s = state[:n]
        state[:n] = _TABLE[(s ^ raw[at[:n] + k]) & 0xFF] ^ (s >> 8)
    for i in range(int(np.searchsorted(-length, -STEPS, side="left"))):
        rest = data[at[i] + STEPS:at[i] + length[i]]
        state[i] = zlib.crc32(rest, int(state[i] ^ _ONES)) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


class Features:
    """Buckets of the words and of the pairs of consecutive words of texts.
    Pair i is that of words i and i + 1; ``inside``: both are of one text;
    ``across``: and a newline stands between them."""

    def __init__(self, texts: list[bytes], buckets: int) -> None:
        self.words = w = C.Words([t.lower() for t in texts], C.ALNUM_TABLE, hashes=False)
        self.buckets = buckets
        counts = w.counts()
        owner = np.repeat(np.arange(len(texts)), counts)
        self.owner = owner
        self.inside = owner[1:] == owner[:-1]
        self._state = _advance(np.full(len(owner), _ONES), w.data, w.start, w.end - w.start)

    def across(self) -> np.ndarray:
        w = self.words
        breaks = np.concatenate([[0], np.cumsum(np.frombuffer(w.data, np.uint8) == _NEWLINE)])
        return self.inside & (breaks[w.start[1:]] > breaks[w.end[:-1]])

    def single(self) -> np.ndarray:
        return ((self._state ^ _ONES) % np.uint32(self.buckets)).astype(np.int64)

    def pairs(self, which: np.ndarray) -> np.ndarray:
        """Buckets of the pairs ``which``: the first word's state goes on over
        a space and the second word."""
        w = self.words
        state = self._state[which]
        state = _TABLE[(state ^ np.uint32(_SPACE)) & 0xFF] ^ (state >> 8)
        state = _advance(state, w.data, w.start[which + 1], (w.end - w.start)[which + 1])
        return ((state ^ _ONES) % np.uint32(self.buckets)).astype(np.int64)


def _totals(batches: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Sums (bucket, times) of a task as one batch."""
    sums = np.zeros(buckets, np.int64)
    for bucket, times in batches:
        np.add.at(sums, bucket, times)
    used = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["bucket", "n"])


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often the features of all texts fall into each bucket."""
    C.ship(docs.sparkSession)
    texts = docs.select(F.col("text").alias("text")).filter(F.col("text").isNotNull())
    lines = (texts.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line") != "")
             .groupBy("line").agg(F.count(F.lit(1)).alias("times")))

    def of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in C.slices(batches, "line", SLICE_BYTES):
                f = Features(batch.column("line").to_pylist(), buckets)
                times = batch.column("times").to_numpy()
                yield f.single(), times[f.owner]
                pair = np.flatnonzero(f.inside)
                yield f.pairs(pair), times[f.owner[pair]]
        return _totals(each(), buckets)

    def of_breaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in C.slices(batches, "text", SLICE_BYTES):
                f = Features(batch.column("text").to_pylist(), buckets)
                pair = np.flatnonzero(f.across())
                yield f.pairs(pair), np.ones(len(pair), np.int64)
        return _totals(each(), buckets)

    own = lines.select(F.col("line").cast("binary").alias("line"), "times").mapInArrow(of_lines, "bucket long, n long")
    between = texts.select(C.utf8().alias("text")).mapInArrow(of_breaks, "bucket long, n long")
    return own.unionByName(between).groupBy("bucket").agg(F.sum("n").alias("n"))


def _vector(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():  # a row per bucket at most
        out[r.bucket] = r.n
    return out


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of the
    counts s, t and their sums S, T in the documents and in the target."""
    s, t = _vector(bucket_counts(docs, buckets), buckets), _vector(bucket_counts(target, buckets), buckets)
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t)))
                     for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> tuple[DataFrame, dict[str, str]]:
    """The documents with their n_words, n_features and weight (the floored
    mean gain; 0 without features), under the names in the dictionary."""
    spark = docs.sparkSession
    C.ship(spark)
    shared = spark.sparkContext.broadcast(gain)
    names, out = {}, docs
    for key in ("utf8", "n_words", "n_features", "weight"):
        names[key] = C.fresh(out, key)
        out = out.withColumn(names[key], C.utf8() if key == "utf8" else F.lit(None).cast("long"))
    text, kept = names.pop("utf8"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in C.slices(batches, text, SLICE_BYTES):
            f = Features(batch.column(text).to_pylist(), len(own))
            pair = np.flatnonzero(f.inside)
            value = own[f.single()]
            value[pair] += own[f.pairs(pair)]
            sums = np.concatenate([[0], np.cumsum(value)])
            first = f.words.first
            sums, n_words = sums[first[1:]] - sums[first[:-1]], f.words.counts()
            n = n_words + np.maximum(n_words - 1, 0)
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*columns, *(pa.array(x.astype(np.int64)) for x in (n_words, n, sums // np.maximum(n, 1)))],
                [*kept, *names.values()])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names.values())])
    return out.select(*kept, text).mapInArrow(run, schema), names


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from a hash of the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with ``name``: 1, 2, 3, ... in the given order (which should
    leave no large group of ties)."""
    placed = C.checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    at, part, before = (C.fresh(placed, c) for c in ("at", "part", "before"))
    placed = placed.withColumn(at, F.monotonically_increasing_id())
    number = F.shiftright(at, 33)
    sizes = placed.groupBy(number.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per range
    offsets, done = [], 0
    for r in sorted(sizes, key=lambda r: r.part):
        offsets.append((r.part, done))
        done += r.n
    starts = rows.sparkSession.createDataFrame(offsets, f"{part} long, {before} long")
    inside = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.withColumn(part, number).join(F.broadcast(starts), part)
            .withColumn(name, F.col(before) + inside + 1).drop(at, part, before))


def _cut(scored: DataFrame, score: str, fits: Column, share: float | tuple[int, int]) -> tuple[int, int]:
    """The number to draw of the rows that fit, and the lowest score drawn."""
    counts = scored.filter(fits).groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n")).collect()
    up, down = share
    wanted = up * sum(r.n for r in counts) // down
    seen = 0
    for r in sorted(counts, key=lambda r: -r.score):
        seen += r.n
        if seen >= wanted:
            return wanted, r.score
    return 0, 0


def _scored(docs: DataFrame, gain: np.ndarray, seed: int) -> tuple[DataFrame, dict[str, str]]:
    out, names = weighted(docs, gain)
    names["score"] = C.fresh(out, "score")
    return out.withColumn(names["score"], F.col(names["weight"]) + noise(F.col("doc_id"), seed)), names


def _drawn(scored: DataFrame, names: dict[str, str], share: tuple[int, int], least: int) -> tuple[DataFrame, DataFrame]:
    """The rows drawn with their rank, and the others."""
    fits = F.col(names["n_words"]) >= least
    score = F.col(names["score"])
    wanted, lowest = _cut(scored, names["score"], fits, share)
    names["rank"] = C.fresh(scored, "rank")
    tie = C.fresh(scored, "tie")
    order = [score.desc(), F.col("doc_id").asc_nulls_last(), F.col(names["n_features"]), F.col(names["weight"]), F.col(tie)]
    high = scored.withColumn(tie, F.monotonically_increasing_id()).filter(fits & (score >= lowest) & F.lit(wanted > 0))
    ranked = numbered(high, order, names["rank"]).drop(tie)
    rest = scored.filter(~(fits & (score >= lowest) & F.lit(wanted > 0)))
    return ranked.withColumn(names["rank"], F.when(F.col(names["rank"]) <= wanted, F.col(names["rank"]))), rest


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (25, 100), least: int = 20,
             seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """The drawn documents, all columns, with n_words, n_features, weight,
    score and rank (under free names): ``share`` (a fraction) of the documents
    with at least ``least`` words."""
    scored, names = _scored(docs, gains(docs, target, buckets), seed)
    return _drawn(scored, names, share, least)[0].filter(F.col(names["rank"]).isNotNull())


def digest(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (25, 100), least: int = 20,
           seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document."""
    scored, names = _scored(docs.select("doc_id", "text"), gains(docs, target, buckets), seed)
    scored = C.checkpoint(scored.drop("text"))  # a narrow row per document; read three times below
    ranked, rest = _drawn(scored, names, share, least)
    out = ranked.unionByName(rest.withColumn(names["rank"], F.lit(None).cast("long")))
    return out.select("doc_id", *(F.col(names[c]).alias(c) for c in ("n_features", "weight", "score", "rank")))
