"""Benchmark decontamination with an FM-index per training shard.

A shard is a few megabytes of neighbouring documents in one task.  Its words
become integers (the words of the benchmark block at hand; any other word is
the terminator 0), its suffixes are sorted, and the Burrows-Wheeler transform
is stored as a wavelet tree in level order with rank counts.  Every window of
the benchmark (``n`` words, or a whole shorter item) is searched backward
through the ranks, all windows at once; occurrences are located by walking to
the next sampled suffix position.  Covered words merge into removal spans.

Scale: no shuffle and no per-document state outside the task.  The benchmark
is read in blocks of at most ``block_windows`` windows; each block is one
broadcast of bounded size and one pass over the documents.  Further blocks
carry the spans found so far through a checkpoint, so the benchmark may be of
any size.

Defined cases: a null text has no words; an item without words has no window;
repeated rows are judged alike, each for itself; an empty benchmark hits
nothing; an item id may be of any type that sorts (numbers, text), and a
null one is kept as a hit without an id.  Other input
columns pass through; result columns take a free name (see ``contaminated``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plume.llm import common as C

#: Every so many words a suffix position is kept.
SAMPLE = 32
#: Bytes of text per shard; longer documents are indexed in overlapping pieces.
SHARD_BYTES = 2 << 20
PIECE_WORDS = 1 << 20
#: Windows of the benchmark searched in one pass.
BLOCK_WINDOWS = 400_000


class FMIndex:
    """FM-index over integers; 0 is a terminator that no pattern holds, and
    zeros sort by position (so a suffix is compared up to its next zero)."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        seq = np.append(seq, 0)
        self.n, self.symbols = len(seq), symbols
        sa = _suffixes(seq)
        before = seq[sa - 1]
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        # sampled rows: every SAMPLE-th position and the ones after a terminator
        kept = (sa % SAMPLE == 0) | (before == 0)
        self.kept_rank = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])
        self.kept, self.kept_at = kept, sa[kept]
        self.levels = []  # per bit, highest first: zeros before each place, number of zeros
        bits = max(1, int(symbols - 1).bit_length())
        column = before
        for level in range(bits - 1, -1, -1):
            bit = (column >> level) & 1 == 1
            zeros = np.concatenate([np.zeros(1, np.int32), np.cumsum(~bit, dtype=np.int32)])
            self.levels.append((level, zeros, int(zeros[-1])))
            column = np.concatenate([column[~bit], column[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place ``at`` of the transform."""
        first = np.zeros(len(at), np.int64)
        for level, zeros, total in self.levels:
            one = (symbol >> level) & 1 == 1
            za, zf = zeros[at], zeros[first]
            at = np.where(one, total + at - za, za)
            first = np.where(one, total + first - zf, zf)
        return at - first

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for level, zeros, total in self.levels:
            za = zeros[at]
            one = zeros[at + 1] == za
            out |= one.astype(np.int64) << level
            at = np.where(one, total + at - za, za)
        return out

    def search(self, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows whose suffixes begin with each pattern."""
        lo, hi = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        live = np.arange(len(size))
        a, b = np.zeros(len(size), np.int64), np.full(len(size), self.n, np.int64)
        step = 0
        while len(live):
            symbol = words[live, size[live] - 1 - step].astype(np.int64)
            a = self.smaller[symbol] + self.rank(symbol, a)
            b = self.smaller[symbol] + self.rank(symbol, b)
            step += 1
            done = (size[live] == step) & (a < b)
            lo[live[done]], hi[live[done]] = a[done], b[done]
            on = (size[live] > step) & (a < b)
            live, a, b = live[on], a[on], b[on]
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled row, count the steps."""
        out = np.zeros(len(row), np.int64)
        live, steps = np.arange(len(row)), 0
        row = row.copy()
        while len(live):
            here = self.kept[row]
            out[live[here]] = self.kept_at[self.kept_rank[row[here]]] + steps
            live, row = live[~here], row[~here]
            if len(live):
                symbol = self.symbol(row)
                row = self.smaller[symbol] + self.rank(symbol, row)
                steps += 1
        return out


def _suffixes(seq: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; only rows still tied are sorted again."""
    n = len(seq)
    zero = np.flatnonzero(seq == 0)
    rank = seq.astype(np.int64) + len(zero)
    rank[zero] = np.arange(len(zero))
    width = np.int64(max(n, int(rank.max()) + 1) + 1)
    rest = np.flatnonzero(seq)
    last = n - 1
    near = np.minimum(rest + 1, last)
    key = rank[rest] * width + rank[near]
    h = 2
    if width < 1 << 21:  # three words fit into one sort key
        key = key * width + rank[np.minimum(rest + 2, last)]
        key = np.where(seq[near] == 0, (rank[rest] * width + rank[near]) * width, key)
        h = 3
    order = np.argsort(key, kind="stable")
    place, key = rest[order], key[order]
    sa = np.concatenate([zero, place])
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) + len(zero) if len(key) else key
    rank[place] = group
    rank[zero] = np.arange(len(zero))
    size_one = np.concatenate([new[1:], [True]]) & new if len(key) else new
    tied = np.flatnonzero(~size_one) + len(zero)  # places in sa
    while len(tied):
        rows = sa[tied]
        key = rank[rows] * width + rank[np.minimum(rows + h, last)]
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        sa[tied] = rows
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        rank[rows] = tied[start]
        tied = tied[~(np.concatenate([new[1:], [True]]) & new)]
        h *= 2
    return sa


class Block:
    """Distinct windows of some benchmark items, as word ids of the block."""

    def __init__(self, items: list[tuple[object, bytes]], n: int) -> None:
        w = C.Words([t.lower() for _, t in items], C.ALNUM_TABLE)
        self.words, ids = np.unique(w.hash, return_inverse=True)
        ids = ids.astype(np.int32) + 1
        found: dict[bytes, int] = {}
        rows: list[np.ndarray] = []
        pairs: set[tuple[int, int]] = set()
        self.items = [k for k, _ in items]
        for i in range(len(items)):
            own = ids[w.first[i]:w.first[i + 1]]
            for j in range(max(1, len(own) - n + 1) if len(own) else 0):
                window = own[j:j + n]
                at = found.setdefault(window.tobytes(), len(rows))
                if at == len(rows):
                    rows.append(window)
                pairs.add((at, i))
        self.size = np.array([len(r) for r in rows], np.int64)
        self.windows = np.zeros((len(rows), n), np.int32)
        for i, r in enumerate(rows):
            self.windows[i, :len(r)] = r
        pair = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.item_first = np.searchsorted(pair[:, 0], np.arange(len(rows) + 1))
        self.item_of = pair[:, 1]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)


def occurrences(seq: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every window in the sequence."""
    if not len(block.size) or not len(seq):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    over = block.windows.shape[1] - 1
    at_all, window_all = [], []
    for begin in range(0, len(seq), PIECE_WORDS):
        piece = seq[begin:begin + PIECE_WORDS + over]
        index = FMIndex(piece, len(block.words) + 1)
        lo, hi = index.search(block.windows, block.size)
        count = hi - lo
        window = np.repeat(np.arange(len(count)), count)
        row = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        at = index.locate(row)
        own = at < PIECE_WORDS  # later ones belong to the next piece
        at_all.append(at[own] + begin)
        window_all.append(window[own])
    return np.concatenate(at_all), np.concatenate(window_all)


def _shard(texts: list[bytes], block: Block) -> tuple[np.ndarray, list[np.ndarray], list[list[int]]]:
    """Per text: words, hit word numbers, and numbers of the block's items."""
    w = C.Words([t.lower() for t in texts], C.ALNUM_TABLE)
    ids = block.ids(w.hash)
    # a terminator after each text
    counts = w.counts()
    seq = np.zeros(len(ids) + len(texts), np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    seq[np.arange(len(ids)) + owner] = ids
    begin = w.first[:-1] + np.arange(len(texts))
    at, window = occurrences(seq, block)
    cover = np.zeros(len(seq) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + block.size[window] if len(at) else at, -1)
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    edge = np.searchsorted(hit, np.append(begin, len(seq)))
    doc = np.searchsorted(begin, at, side="right") - 1
    # of several empty texts at one place none has an occurrence, so the last is right
    seen = np.unique(np.stack([doc, window], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    items: list[set[int]] = [set() for _ in texts]
    for d, x in seen.tolist():
        items[d].update(block.item_of[block.item_first[x]:block.item_first[x + 1]].tolist())
    hits = [hit[edge[i]:edge[i + 1]] - begin[i] for i in range(len(texts))]
    return counts, hits, [sorted(s) for s in items]


def _runs(words: np.ndarray) -> np.ndarray:
    """Sorted word numbers as (first, past the last) spans."""
    if not len(words):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(words) > 1) + 1
    return np.stack([words[np.append(0, cut)], words[np.append(cut - 1, len(words) - 1)] + 1], 1)


def _blocks(benchmark: DataFrame, n: int, block_windows: int) -> Iterator[Block]:
    items: list[tuple[object, bytes]] = []
    held = 0
    for row in benchmark.select("item_id", C.utf8().alias("text")).toLocalIterator():
        text = bytes(row.text)
        # an item longer than a block is cut with an overlap of n - 1 words
        w = C.Words([text.lower()], C.ALNUM_TABLE, hashes=False)
        total = len(w.start)
        for at in range(0, max(1, total - n + 1), block_windows):
            if not total:
                break
            last = min(total, at + block_windows + n - 1)
            part = w.data[w.start[at]:w.end[last - 1]]
            if items and held + last - at > block_windows:
                yield Block(items, n)
                items, held = [], 0
            items.append((row.item_id, part))
            held += last - at
    if items:
        yield Block(items, n)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10,
                 block_windows: int = BLOCK_WINDOWS) -> tuple[DataFrame, dict[str, str]]:
    """The documents with the result columns ``n_words`` (long), ``spans``
    (array of alternating first and past-the-last hit words, merged) and
    ``items`` (array of the item ids that hit, sorted, without repeats), under
    the names in the returned dictionary (a clash takes a free name)."""
    before, block, names = _searched(docs, benchmark, n, block_windows)
    return _pass(before, block, names, before.schema), names


def _searched(docs: DataFrame, benchmark: DataFrame, n: int, block_windows: int):
    """The documents with the result columns of all blocks of the benchmark but
    the last, the last block (broadcast), and the columns' names."""
    spark = docs.sparkSession
    C.ship(spark)
    names = {}
    out = docs
    item = benchmark.schema["item_id"].dataType
    for key, kind in (("n_words", T.LongType()), ("spans", T.ArrayType(T.LongType())), ("items", T.ArrayType(item))):
        names[key] = C.fresh(out, key)
        out = out.withColumn(names[key], F.lit(None).cast(kind))
    last = None
    for block in _blocks(benchmark, n, block_windows):
        if last is not None:
            out = C.checkpoint(_pass(out, spark.sparkContext.broadcast(last), names, out.schema))
        last = block
    return out, spark.sparkContext.broadcast(Block([], n) if last is None else last), names


def _pass(docs: DataFrame, block, names: dict[str, str], schema: T.StructType,
          finish: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda batch: batch) -> DataFrame:
    """One pass with a block; ``finish`` makes the rows returned (of ``schema``)
    of the ones with the result columns, in the same Python worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = block.value
        for batch in C.slices(batches, "text", SHARD_BYTES):
            texts = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
            counts, hits, items = _shard(texts, own)
            before = batch.column(names["spans"]).to_pylist()
            known = batch.column(names["items"]).to_pylist()
            spans, ids = [], []
            for i, hit in enumerate(hits):
                if before[i]:
                    old = np.array(before[i]).reshape(-1, 2)
                    hit = np.union1d(hit, np.concatenate([np.arange(a, b) for a, b in old]))
                spans.append(_runs(hit).ravel().tolist())
                found = {own.items[k] for k in items[i]} | set(known[i] or ())
                ids.append(sorted(found - {None}) + [None] * (None in found))
            columns = {f.name: batch.column(f.name) for f in batch.schema}
            columns[names["n_words"]] = pa.array(counts, pa.int64())
            columns[names["spans"]] = pa.array(spans, pa.list_(pa.int64()))
            columns[names["items"]] = pa.array(ids, batch.schema.field(names["items"]).type)
            yield finish(pa.RecordBatch.from_arrays(list(columns.values()), list(columns)))

    return docs.mapInArrow(run, schema)


def remove_spans(text: str | None, spans: list[int] | None) -> str | None:
    """The text without the spans: from a span's first word to its last."""
    if not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    w = C.Words([data.lower()], C.ALNUM_TABLE, hashes=False)
    out, at = [], 0
    for a, b in zip(spans[0::2], spans[1::2]):
        out.append(data[at:w.start[a] - 1])  # positions count the leading separator
        at = w.end[b - 1] - 1
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "replace")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents with every occurrence of a benchmark window cut out of
    the text; a document that loses all its words goes.  Texts without a hit
    and null texts stay as they are."""
    before, block, names = _searched(docs, benchmark, n, BLOCK_WINDOWS)
    schema, columns = docs.schema, docs.columns
    words, spans = names["n_words"], names["spans"]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column(spans).to_pylist()
        total = batch.column(words).to_pylist()
        keep = [not s or sum(s[1::2]) - sum(s[0::2]) < n for s, n in zip(rows, total)]
        text = batch.column("text")
        if any(rows):
            text = pa.array([remove_spans(t, s) for t, s in zip(text.to_pylist(), rows)], text.type)
        own = [text if c == "text" else batch.column(c) for c in columns]
        return pa.RecordBatch.from_arrays(own, columns).filter(pa.array(keep, pa.bool_()))

    return _pass(before, block, names, schema, cut)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts, hit items and the removal spans."""
    found, names = contaminated(docs.select("doc_id", "text"), benchmark)
    spans, items = F.col(names["spans"]), F.col(names["items"])
    size = F.size(spans) / 2
    n_hit = F.when(size > 0, F.aggregate(
        F.sequence(F.lit(1), size.cast("int")), F.lit(0).cast("long"),
        lambda a, i: a + F.element_at(spans, i * 2) - F.element_at(spans, i * 2 - 1))).otherwise(F.lit(0).cast("long"))
    return found.select(
        "doc_id", F.col(names["n_words"]).alias("n_words"), n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (size > 0).alias("contaminated"))
