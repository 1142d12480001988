"""Substring dedup by level-wise doubling of repeated word windows.

A word goes if it lies in a window of ``n`` words whose word sequence starts
anywhere else as well, in another document or the same one.  Lengths go up
level by level, and only what is repeated at one length is extended:

1. *A quarter of the window* (9 words for 35).  Every window of n words holds
   one anchor: its 9-word part with the smallest hash (the leftmost of
   equals).  The choice depends on the words alone, so equal windows have
   equal anchors at equal offsets, and only anchors (about 1 in 14 words) need
   counting.  Anchors seen once are done.
2. *Twice that* (18 words): a repeated anchor is extended by its length to the
   left and to the right.  Each window of n words holds one of the two parts;
   windows whose part is seen once are done.
3. *The window itself* (twice again, cut to n).  Neighbouring windows with the
   same anchor form a segment; segments equal as a whole are repeated, window
   by window, without looking closer.  Only for anchors that also stand in a
   segment seen once are single windows counted, with one copy of each equal
   segment standing for all.

Longer repeats are unions of repeated windows, so the removal is complete
here and no candidates are left to extend.

Scale: the shuffles carry 64-bit hashes of anchors, pre-aggregated before the
exchange, so a passage that a third of the documents share costs a row per
task.  Texts are shuffled only where a broadcast bit map of fixed size (4 MB,
whatever the input) says that the text may hold a repeat; a full bit map costs
a shuffle more, never a result.

Defined cases: null and blank texts have no words and lose none; repeated rows
are documents of their own, so all their windows are repeated; documents
shorter than n words lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plume.llm import common as C

SHARD_BYTES = 4 << 20
#: Bits of the map of affected texts, and rows of 64 bits.
MAP_ROWS = 1 << 18


class Anchors:
    """Anchors of the windows of n words in the texts of ``w``."""

    def __init__(self, w: C.Words, n: int) -> None:
        self.n, self.base = n, -(-n // 4)
        self.part = min(2 * self.base, n)
        total = len(w.hash)
        self._sums(w.hash)
        room = total - n + 1
        if room <= 0:
            empty = np.zeros(0, np.int64)
            self.at = self.lo = self.hi = self.text = empty
            self.hash = self.segment = self.left = self.right = empty.astype(np.uint64)
            return
        end = np.repeat(w.first[1:], w.counts())
        short = self.window(np.arange(total - self.base + 1), self.base)
        bits = np.uint64(total.bit_length())
        best = (short >> bits << bits) | np.arange(len(short), dtype=np.uint64)
        best = _sliding_min(best, n - self.base + 1)
        start = np.flatnonzero(np.arange(room) + n <= end[:room])
        at = (best[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        cut = np.flatnonzero((np.diff(start) != 1) | (np.diff(at) != 0)) + 1
        first, last = np.append(0, cut), np.append(cut, len(start)) - 1
        if not len(start):
            first = last = np.zeros(0, np.int64)
        self.at, self.lo, self.hi = at[first], start[first], start[last]
        self.text = np.searchsorted(w.first, self.at, side="right") - 1
        self.hash = short[self.at]
        span = self.hi + n - self.lo
        self.segment = C.mix(self._raw(self.lo, span) + (self.at - self.lo).astype(np.uint64) * C._MIXER + span.astype(np.uint64))

    def _sums(self, hashes: np.ndarray) -> None:
        power = _table(_POWER, len(hashes), C._BASE)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power, dtype=np.uint64)])

    def _raw(self, at: np.ndarray, size) -> np.ndarray:
        inverse = _table(_INVERSE, len(self.sums), _BASE_INVERSE)
        return (self.sums[at + size] - self.sums[at]) * inverse[at]

    def window(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each place."""
        return C.mix(self._raw(at, size))

    def halves(self, which: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level 2 hashes of the anchors at ``which``: left and right part (0
        where the text has no such part; no window of the anchor needs it)."""
        at, back = self.at[which], self.part - self.base
        begin, end = first[self.text[which]], first[self.text[which] + 1]
        left = np.where(at - back >= begin, self.window(np.maximum(at - back, 0), self.part), np.uint64(0))
        fits = at + self.part <= end
        right = np.where(fits, self.window(np.where(fits, at, 0), self.part), np.uint64(0))
        return left, right


_POWER, _INVERSE = [np.ones(1, np.uint64)], [np.ones(1, np.uint64)]
_BASE_INVERSE = np.uint64(pow(int(C._BASE), -1, 2**64))


def _table(table: list[np.ndarray], n: int, base: np.uint64) -> np.ndarray:
    if len(table[0]) < n:
        table[0] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 16), base, np.uint64))])
    return table[0][:n]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        take = min(have, width - have)
        x = np.minimum(x[:len(x) - take], x[take:])
        have += take
    return x


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _lists(values: np.ndarray, owner: np.ndarray, texts: int) -> pa.Array:
    """One list per text of the values that belong to it (owner ascending)."""
    offsets = np.searchsorted(owner, np.arange(texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _signed(values))


def _member(values: np.ndarray, known: list[int] | None) -> np.ndarray:
    if not known:
        return np.zeros(len(values), bool)
    return np.isin(values.view(np.int64), np.array(known, np.int64))


def _anchor_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "utf8", SHARD_BYTES):
            a = Anchors(C.Words(batch.column("utf8").to_pylist(), C.SPACE_TABLE), n)
            texts = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), _lists(a.hash, a.text, texts), _lists(a.segment, a.text, texts)],
                ["key", "anchors", "segments"])

    return run


def _window_rows(n: int):
    """For the candidate texts: windows of open and giving segments whose
    level 2 parts are to be counted; one row per window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a text in this task say the same
        for batch in C.slices(batches, "utf8", SHARD_BYTES):
            keys = batch.column("key").to_pylist()
            new = []
            for i, k in enumerate(keys):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            if not new:
                continue
            batch = batch.take(pa.array(new, pa.int64()))
            keys = np.array([keys[i] for i in new], np.int64)
            w = C.Words(batch.column("utf8").to_pylist(), C.SPACE_TABLE)
            a = Anchors(w, n)
            edge = np.searchsorted(a.text, np.arange(len(new) + 1))
            open_, give = np.zeros(len(a.at), bool), np.zeros(len(a.at), bool)
            for mark, name in ((open_, "open"), (give, "give")):
                for i, known in enumerate(batch.column(name).to_pylist()):
                    own = slice(edge[i], edge[i + 1])
                    mark[own] = _member(a.segment[own], known)
            which = np.flatnonzero(open_ | give)
            if not len(which):
                continue
            left, right = a.halves(which, w.first)
            size = a.hi[which] - a.lo[which] + 1
            of = np.repeat(np.arange(len(which)), size)
            start = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a.lo[which], size)
            # a window of the anchor holds its left part, its right part, or both
            holds_left = start <= a.at[which][of] - (a.part - a.base)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[a.text[which]][of]), _signed(a.hash[which][of]),
                 _signed(np.where(holds_left, left[of], right[of])), pa.array(holds_left),
                 _signed(a.window(start, n)), pa.array(open_[which][of])],
                ["key", "anchor", "part", "left", "hash", "open"])

    return run


def candidates(docs: DataFrame, n: int = 35) -> tuple[DataFrame, DataFrame]:
    """What is repeated, by text key: (key, full: segments repeated as a whole)
    and (key, windows: hashes of further repeated windows)."""
    C.ship(docs.sparkSession)
    texts = docs.select(_key().alias("key"), C.utf8().alias("utf8"))
    # level 1: anchors
    rows = C.checkpoint(texts.mapInArrow(_anchor_rows(n), "key long, anchors array<long>, segments array<long>")
                        .filter(F.size("anchors") > 0))
    rows = rows.select("key", F.explode(F.arrays_zip("anchors", "segments")).alias("a")) \
               .select("key", F.col("a.anchors").alias("anchor"), F.col("a.segments").alias("segment"))
    # written first, so both sides of the join are plain shuffles and a hot anchor's rows can be split
    repeated = C.checkpoint(rows.groupBy("anchor").count().filter("count > 1").select("anchor"))
    rows = C.checkpoint(rows.join(repeated, "anchor"))
    # segments as a whole; anchors with a segment seen once stay open
    segments = C.checkpoint(rows.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min("key").alias("first")))
    closer = segments.filter("n = 1").select("anchor").distinct()
    state = F.when(F.col("n") == 1, F.lit("open")).when(F.col("anchor2").isNotNull(), F.lit("give")).otherwise(F.lit("full"))
    segments = segments.join(closer.withColumnRenamed("anchor", "anchor2"), F.col("anchor") == F.col("anchor2"), "left") \
                       .select("anchor", "segment", "n", "first", state.alias("state"))
    marks = rows.join(segments, ["anchor", "segment"]).select("key", "segment", "state", (F.col("key") == F.col("first")).alias("gives"))
    own = C.checkpoint(marks.groupBy("key").agg(
        F.collect_set(F.when(F.col("state") != "open", F.col("segment"))).alias("full"),
        F.collect_set(F.when(F.col("state") == "open", F.col("segment"))).alias("open"),
        F.collect_set(F.when((F.col("state") == "give") & F.col("gives"), F.col("segment"))).alias("give")))
    # levels 2 and 3: windows of what is open
    wanted = own.filter((F.size("open") > 0) | (F.size("give") > 0)).select("key", "open", "give")
    held = _marked(texts, "key", _bits(wanted), "marked").filter("marked").drop("marked").join(wanted, "key")
    windows = C.checkpoint(held.mapInArrow(
        _window_rows(n), "key long, anchor long, part long, left boolean, hash long, open boolean"))
    # a giver stands for two or more, so anything it shares is repeated
    weight = F.max(F.when(F.col("open"), F.lit(0)).otherwise(F.lit(2)))
    once = F.count("*")
    parts = windows.groupBy("anchor", "left", "part").agg(F.greatest(weight, once).alias("n")).filter("n > 1") \
                   .select("anchor", "left", "part")
    windows = windows.join(parts, ["anchor", "left", "part"]).select("key", "anchor", "hash", "open")
    counts = windows.groupBy("anchor", "hash").agg(F.greatest(weight, once).alias("n")).filter("n > 1").select("anchor", "hash")
    more = windows.filter("open").join(counts, ["anchor", "hash"]).groupBy("key").agg(F.collect_set("hash").alias("windows"))
    return own.select("key", "full"), more


def _key() -> Column:
    return F.xxhash64(C.utf8())


def _bits(keys: DataFrame) -> DataFrame:
    """A bit map of the keys: at most MAP_ROWS rows (slot, bits)."""
    slot = F.shiftrightunsigned("key", 46).alias("slot")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("key").bitwiseAND(F.lit(63)).cast("int"))
    return C.checkpoint(keys.groupBy(slot).agg(F.bit_or(bit).alias("bits")))


def _marked(docs: DataFrame, key: str, bits: DataFrame, marked: str) -> DataFrame:
    """``docs`` with ``marked``: whether the key's bit is set (true for every
    key of the map, for few others)."""
    slot, held = C.fresh(docs, "slot"), C.fresh(docs, "bits")
    small = F.broadcast(bits.select(F.col("slot").alias(slot), F.col("bits").alias(held)))  # at most 2**18 rows of 16 bytes
    bit = F.call_function("shiftright", F.col(held), F.col(key).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return (docs.join(small, F.shiftrightunsigned(key, 46) == F.col(slot), "left")
            .withColumn(marked, F.coalesce(bit == 1, F.lit(False))).drop(slot, held))


def _removed(w: C.Words, n: int, full: list, windows: list) -> list[np.ndarray]:
    """Per text: mask of the words that go."""
    a = Anchors(w, n)
    cover = np.zeros(len(w.hash) + 1, np.int64)
    edge = np.searchsorted(a.text, np.arange(len(full) + 1))
    for i in range(len(full)):
        if not full[i] and not windows[i]:
            continue
        own = slice(edge[i], edge[i + 1])
        whole = _member(a.segment[own], full[i])
        lo, hi = a.lo[own], a.hi[own]
        np.add.at(cover, lo[whole], 1)
        np.add.at(cover, hi[whole] + n, -1)
        if windows[i]:
            lo, size = lo[~whole], hi[~whole] - lo[~whole] + 1
            start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
            start = start[_member(a.window(start, n), windows[i])]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + n, -1)
    gone = np.cumsum(cover[:-1]) > 0
    return [gone[w.first[i]:w.first[i + 1]] for i in range(len(full))]


def repeated(docs: DataFrame, n: int = 35) -> tuple[DataFrame, dict[str, str]]:
    """The documents with ``full`` and ``windows`` (hashes of what repeats in
    them, null where nothing does), under free names as in the dictionary."""
    full, more = candidates(docs, n)
    known = C.checkpoint(full.join(more, "key", "left"))
    names = {k: C.fresh(docs, f"repeat_{k}") for k in ("key", "full", "windows", "utf8", "marked")}
    keyed = docs.withColumn(names["key"], _key())
    marked = names.pop("marked")
    flagged = _marked(keyed, names["key"], _bits(known.select("key")), marked)
    rest = flagged.filter(~F.col(marked)).drop(marked) \
                  .withColumn(names["full"], F.lit(None).cast("array<long>")) \
                  .withColumn(names["windows"], F.lit(None).cast("array<long>"))
    known = known.select(F.col("key").alias(names["key"]), F.col("full").alias(names["full"]), F.col("windows").alias(names["windows"]))
    hit = flagged.filter(marked).drop(marked).join(known, names["key"], "left")
    return rest.unionByName(hit.select(*rest.columns)), names


def _cut(n: int, names: dict[str, str], columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, names["utf8"], SHARD_BYTES):
            texts = batch.column(names["utf8"]).to_pylist()
            full, windows = (batch.column(names[k]).to_pylist() for k in ("full", "windows"))
            w = C.Words(texts, C.SPACE_TABLE)
            counts = w.counts()
            removed, kept = [], []
            masks = _removed(w, n, full, windows) if any(full) or any(windows) else None
            for i, text in enumerate(texts):
                words = text.split()
                gone = masks[i] if masks else None
                if gone is not None and gone.any():
                    words = [x for x, g in zip(words, gone.tolist()) if not g]
                    removed.append(int(gone.sum()))
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary())], [*columns, names["n_words"], names["n_removed"], names["kept"]])

    return run


def _kept(docs: DataFrame, n: int) -> tuple[DataFrame, dict[str, str]]:
    """The documents with n_words, n_removed and kept (UTF-8 of the kept words
    joined by one space)."""
    found, names = repeated(docs, n)
    names |= {k: C.fresh(found, k) for k in ("n_words", "n_removed", "kept")}
    source = found.withColumn(names["utf8"], C.utf8())
    schema = docs.limit(0).withColumn(names["n_words"], F.lit(0).cast("long")) \
                 .withColumn(names["n_removed"], F.lit(0).cast("long")).withColumn(names["kept"], F.lit(b"")).schema
    return source.mapInArrow(_cut(n, names, docs.columns), schema), names


def remove_repeats(docs: DataFrame, n: int = 35) -> DataFrame:
    """The documents without their repeated words; a text that loses words
    becomes its kept words joined by one space, others stay as they are."""
    kept, names = _kept(docs, n)
    text = F.when(F.col(names["n_removed"]) > 0, F.col(names["kept"]).cast("string")).otherwise(F.col("text"))
    return kept.withColumn("text", text).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    kept, names = _kept(docs.select("doc_id", "text"), 35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
