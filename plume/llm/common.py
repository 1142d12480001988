"""Helpers shared by the training-data operators: shipping this package to the
executors, cutting lineage, slicing Arrow batches, and a vectorised word
splitter that works on whole UTF-8 texts.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plume.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Java and Python forms of the two word classes of this subpackage.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(prefix="plume-zip-"), "plume.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def utf8(text: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first free variant of it: extra input columns may clash
    (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Regroup Arrow batches into ones of about ``limit`` bytes of ``column``
    (a single longer row stays alone), so a task's memory is bounded whatever
    the batch size."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield _merged(held)
                held, size, start = [], 0, i
            size += n
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield _merged(held)


def _merged(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


# ---------------------------------------------------------------- words

def _class_table(pattern_bytes: bytes) -> np.ndarray:
    """True for the bytes of words: every byte but the given ones."""
    table = np.ones(256, bool)
    table[np.frombuffer(pattern_bytes, np.uint8)] = False
    return table


SPACE_TABLE = _class_table(bytes([0x20, 9, 10, 11, 12, 13]))
ALNUM_TABLE = _class_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

_rng = np.random.Generator(np.random.PCG64(20240229))
#: Random 64-bit value of each byte, and the odd base of the positional sum.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(0xFFFF, _BASE, np.uint64))])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a list of UTF-8 texts: for all of them together the byte
    positions ``start``/``end`` in ``data``, a 64-bit ``hash``, and
    ``first``: the index of each text's first word, with the total at its
    end.  ``offset[i]`` is where text i begins in ``data``."""

    def __init__(self, texts: list[bytes], table: np.ndarray, hashes: bool = True) -> None:
        self.data = b" ".join([b"", *texts, b""])
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])
        raw = np.frombuffer(self.data, np.uint8)
        inside = table[raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[-1]:
            edges = np.append(edges, len(raw))
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.offset)
        if hashes:
            self.hash = self.hashes(self.end)

    def hashes(self, end: np.ndarray, step: int = 1 << 21) -> np.ndarray:
        """Hashes of the words up to ``end`` (at most each word's own end)."""
        raw = np.frombuffer(self.data, np.uint8)
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):  # in blocks: 8 bytes per byte of text are held only for one
            to = max(at + 1, int(np.searchsorted(self.start, self.start[at] + step)))
            out[at:to] = self._hashes(raw, self.start[at:to], end[at:to])
            at = to
        return out

    @staticmethod
    def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        lo, hi = int(start[0]), int(end[-1])
        block = raw[lo:hi]
        size = end - start
        place = (np.arange(lo, hi) - np.repeat(start, np.diff(np.append(start, hi)))) & 0xFFFF
        value = _BYTE[block] * _POWERS[place]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        whole = sums[end - lo] - sums[start - lo]
        for i in np.flatnonzero(size > 0x10000):  # powers repeat after 64 KiB: fold part by part
            parts = np.append(np.arange(start[i], end[i], 0x10000), end[i]) - lo
            whole[i] = 0
            for part in sums[parts[1:]] - sums[parts[:-1]]:
                whole[i:i + 1] = mix(whole[i:i + 1] * _BASE + part)
        return mix(whole + size.astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


_MIXER = np.uint64(0xD6E8FEB86659FD93)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values, by doubling (empty if too few)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out, have = hashes, 1
    while have < n:
        take = min(have, n - have)
        tail = out if take == have else rolling(hashes, take)
        size = len(hashes) - have - take + 1
        out = out[:size] * np.uint64(pow(int(_BASE), take, 2**64)) + tail[have:have + size] * _MIXER
        have += take
    return out
