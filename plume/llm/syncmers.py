"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if, of its inner s-mers, one with
the smallest hash stands at its first or last place.  Whether it is one
depends on the k-mer alone, so unchanged passages keep their anchors whatever
happens around them.  A fingerprint keeps all anchors of a text, every
occurrence with its position.  The n-th occurrence of an anchor in one text is
matched with its n-th in the other; the likeness of two fingerprints is the
share of the anchors of both together that stand in both and in the same order.

Scale: the fingerprint of a text needs only the text.  The edited text needs
the start of the next document by doc_id, which is brought next to it by one
range shuffle of the texts: the first key of each range (a row per range, from
the ids alone) is also sent to the range before, so no range waits for another.

Defined cases: null counts as empty; a text without a syncmer is its own only
anchor, an empty text has none (likeness 1 to another empty one, else 0).
Rows are in order of doc_id (null first), then of the text's hash and of the
compressed text; a single row is its own next document.  doc_id must be long.
"""

from __future__ import annotations

from base64 import b64decode, b64encode
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plume.llm import common as C

K, S = 10, 5
SLICE_BYTES = 1 << 20
_ANCHOR = np.dtype([("hash", ">u4"), ("gap", "u1")])
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        take = min(have, width - have)
        x = np.minimum(x[:len(x) - take], x[take:])
        have += take
    return x


def syncmers(texts: list[str], k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the positions and 32-bit hashes of its closed syncmers."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    if len(points) < k:
        empty = np.zeros(0, np.int64)
        return [(empty, empty)] * len(texts)
    # high bits of a sum of odd multiples depend on all points below; they are compared first
    inner = C.rolling((points.astype(np.uint64) + np.uint64(1)) * _ODD, s)
    width = k - s + 1
    least = _window_min(inner, width)
    edge = inner[:len(least)] == least
    edge |= inner[width - 1:] == least
    at = np.flatnonzero(edge)
    text = np.searchsorted(ends, at, side="right")
    inside = at + k <= ends[text]
    at, text = at[inside], text[inside]
    # the k-mer's hash from the s-mers that cover it
    value = np.zeros(len(at), np.uint64)
    for shift in [*range(0, k - s, s), k - s]:
        value = C.mix(value ^ inner[at + shift])
    value = (value >> np.uint64(32)).astype(np.int64)
    at = at - (ends - sizes)[text]
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    return [(at[cut[i]:cut[i + 1]], value[cut[i]:cut[i + 1]]) for i in range(len(texts))]


def _anchors(text: str, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's anchors: its syncmers, or the text itself if it has none."""
    if len(at) or not text:
        return at, value
    own = int.from_bytes(sha256(text.encode("utf-8", "surrogatepass")).digest()[:4], "big")
    return np.zeros(1, np.int64), np.array([own], np.int64)


def _coded(at: np.ndarray, value: np.ndarray) -> str:
    out = np.empty(len(at), _ANCHOR)
    out["hash"] = value
    out["gap"] = np.diff(at, prepend=0)  # at most K - S: so many k-mers in a row have a syncmer
    return b64encode(out.tobytes()).decode()


def decoded(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """The positions and hashes of a fingerprint's anchors, in text order."""
    out = np.frombuffer(b64decode(fingerprint), _ANCHOR)
    return np.cumsum(out["gap"], dtype=np.int64), out["hash"].astype(np.int64)


def fingerprints(texts: list[str]) -> list[str]:
    """Per text all its anchors in text order, five bytes each in base64: four of
    the hash, one of the distance from the anchor before (or the text's start)."""
    return [_coded(*_anchors(t, *own)) for t, own in zip(texts, syncmers(texts))]


def _edited(texts: list[str], nexts: list[str], own: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """The edited texts and their anchors; syncmers of what is kept are taken
    over, only k-mers that reach into the new tail are looked at."""
    kept = [len(t) - len(t) // 4 for t in texts]
    edited = [t[:n] + x[:len(t) // 4] for t, n, x in zip(texts, kept, nexts)]
    begin = [max(0, n - K + 1) for n in kept]
    tails = syncmers([e[b:] for e, b in zip(edited, begin)])
    anchors = []
    for e, n, b, (at, value), (more, new) in zip(edited, kept, begin, own, tails):
        old = at + K <= n
        anchors.append(_anchors(e, np.concatenate([at[old], more + b]), np.concatenate([value[old], new])))
    return edited, anchors


def _numbered(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors in order of (hash, place): keys of hash and occurrence, places."""
    both = np.sort((value.astype(np.uint64) << _HALF) | np.arange(len(value), dtype=np.uint64))
    hashes = both >> _HALF
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[:len(both)])
    occurrence = np.arange(len(both)) - np.repeat(first, np.diff(np.append(first, len(both))))
    return (hashes << _HALF) | occurrence.astype(np.uint64), (both & _LOW).astype(np.int64)


def _likeness(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    (a, place_a), (b, place_b) = one, two
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    found = np.searchsorted(b, a)
    hit = b[np.minimum(found, len(b) - 1)] == a
    # the places in b of the shared anchors, in the order of a
    shared = place_b[found[hit]][np.argsort(place_a[hit])]
    return _longest_run(shared) / (len(a) + len(b) - len(shared))


def _longest_run(places: np.ndarray) -> int:
    """The length of the longest increasing run (with gaps) of distinct places."""
    falls = np.flatnonzero(places[1:] < places[:-1])
    if not len(falls):
        return len(places)
    tails = places[:falls[0] + 1].tolist()
    for p in places[falls[0] + 1:].tolist():
        if p > tails[-1]:
            tails.append(p)
        else:
            tails[bisect_left(tails, p)] = p
    return len(tails)


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    return _likeness(_numbered(decoded(a)[1]), _numbered(decoded(b)[1]))


def packed(data: bytes) -> bytes:
    """A text's bytes compressed, behind their number."""
    return len(data).to_bytes(8, "big") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def unpacked(data: bytes) -> str:
    size = int.from_bytes(data[:8], "big")
    return pa.Codec("zstd").decompress(data[8:], size, asbytes=True).decode("utf-8", "replace") if size else ""


def _ranges(docs: DataFrame) -> list[tuple]:
    """The first key of each range of documents: one row per range."""
    parts = 4 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = (docs.select("known", "doc_id", "hash").repartitionByRange(parts, "known", "doc_id", "hash")
             .groupBy(F.spark_partition_id().alias("part"))
             .agg(F.min(F.struct("known", "doc_id", "hash")).alias("first")))
    return sorted((r.first.known, r.first.doc_id or 0, r.first.hash) for r in first.select("first").collect())


def with_next(docs: DataFrame) -> DataFrame:
    """(part, head, doc_id, text): documents dealt into ranges of doc_id, and
    at the end of each range (head true) the first one of the next range; the
    text is packed (see ``unpacked``)."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64(text).alias("hash"), text.alias("text"))
    starts = docs.sparkSession.sparkContext.broadcast(_ranges(keyed))  # a row per range

    @F.pandas_udf("parts array<int>, packed binary")
    def parts(known: pd.Series, doc_id: pd.Series, hash_: pd.Series, data: pd.Series) -> pd.DataFrame:
        own = starts.value
        out = []
        for k, d, h in zip(known.tolist(), doc_id.tolist(), hash_.tolist()):
            at = bisect_right(own, (k, d, h)) - 1
            # the first of a range also ends the one before (of the first range: the last)
            out.append([at, (at - 1) % len(own)] if own[at] == (k, d, h) else [at])
        return pd.DataFrame({"parts": out, "packed": [packed(t) for t in data.tolist()]})

    # a column of long with nulls would reach pandas as doubles, which round large ids
    own_id = F.coalesce("doc_id", F.lit(0).cast("long"))
    dealt = keyed.select("known", "doc_id", "hash", parts("known", own_id, "hash", F.col("text").cast("binary")).alias("dealt"))
    dealt = dealt.select("known", "doc_id", "hash", F.col("dealt.packed").alias("text"), F.posexplode("dealt.parts").alias("copy", "part"))
    order = ["part", "copy", "known", "doc_id", "hash", "text"]
    return (dealt.repartition("part").sortWithinPartitions(*order)
            .select("part", (F.col("copy") == 1).alias("head"), "doc_id", "text"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text (the last
    quarter replaced by the start of the next document), and the likenesses."""
    C.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the slice before: (part, head, doc_id, text)
        for batch in C.slices(batches, "text", SLICE_BYTES // 2):  # packed
            part, head, doc_id, text = (batch.column(c).to_pylist() for c in ("part", "head", "doc_id", "text"))
            rows = list(zip(part, head, doc_id, map(unpacked, text)))
            if held is not None:
                rows.insert(0, held)
            held = rows[-1]
            texts = [r[3] for r in rows]
            own = syncmers(texts)
            anchors = [_anchors(t, *x) for t, x in zip(texts, own)]
            keys = [_numbered(value) for _, value in anchors]
            # a row is followed by its next document, or is the head that ends its range
            pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            edited, changed = _edited([texts[i] for i in pairs], [texts[i + 1] for i in pairs], [own[i] for i in pairs])
            out = [(rows[i][2], len(texts[i]), sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), _coded(*anchors[i]), _coded(*c),
                    _likeness(keys[i], _numbered(c[1])), _likeness(keys[i], keys[i + 1]))
                   for i, e, c in zip(pairs, edited, changed)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)
