"""SimHash near-duplicates by a segment-popcount embedding.

Each whole text becomes a 64-bit fingerprint (majority of the hash bits of its
word shingles).  Equal fingerprints fold into one row first, so a group of
copies of any size is one point.  A fingerprint is embedded as the bit counts
of its 32 two-bit segments.  The Manhattan distance of two such vectors never
exceeds the number of differing bits, so fingerprints within 3 bits are within
Manhattan distance 3, and then one half of the segments (16 of them) is within
distance 1.  The grid range-join works on the halves: a point lies in the
cell of its own counts and probes the cells one count up; two points within
distance 1 on a half meet in a cell.  Meeting points are verified exactly by
their differing bits.

Scale: 2 cells and about 24 probes per distinct fingerprint are shuffled, 20
bytes each; no text is.  A cell is worked through by one task in sorted order:
small cells by vector comparisons, larger ones by a search that drops points
from the cell as they are reached, so a cell gives at most one link per point,
never all pairs.  Cells with more than ``cell_limit`` rows (own points and
probes) are dealt out in pairs of blocks to many tasks.

Defined cases: a null or blank text has fingerprint zero, which links like any
other; repeated rows keep one row each; a null doc_id gets the component of
its text, and counts for the smallest id only if no other is there (then
null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plume.llm import common as C
from plume.llm.links import components

SEED = 42
PAIRS_OF_BITS = 0x55555555
#: Cells of at most this many rows are compared by shifts of the sorted rows.
SMALL = 8


def fingerprint(data: bytes | None, shingle: int) -> int:
    """Majority bits over the XXH64 hashes of the shingles, as signed long."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    set_bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> Column:
    """The fingerprint column (signed long) of a text column."""
    C.ship(docs.sparkSession)

    @F.pandas_udf("long")
    def udf(data: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, shingle) for x in data], dtype="int64")

    return udf(C.utf8(text))


def _cells(points: DataFrame, bits: int) -> DataFrame:
    """(cell, fp, own): each point's own cells and its probes one count up."""
    low = F.lit(PAIRS_OF_BITS).cast("long")
    counts = [half.bitwiseAND(low) + F.shiftrightunsigned(half, 1).bitwiseAND(low)
              for half in (F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))]
    halves = F.array(*counts)
    # the cell number: 32 bits of counts, then the half
    half = points.select("fp", F.posexplode(halves).alias("half", "counts"))
    own = F.struct((F.col("counts") * 2 + F.col("half")).alias("cell"), F.lit(True).alias("own"))
    if bits < 2:  # one half is then equal
        return half.select("fp", own.alias("c")).select("c.cell", "fp", "c.own")
    # a segment counts 0, 1 or 2; adding one to a count below 2 never carries
    up = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(15)), lambda i: _segment(F.col("counts"), i) < 2),
        lambda i: F.struct(((F.col("counts") + _unit(i)) * 2 + F.col("half")).alias("cell"), F.lit(False).alias("own")))
    return (half.select("fp", F.explode(F.concat(F.array(own), up)).alias("c"))
            .select("c.cell", "fp", "c.own"))


def _unit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (i * 2).cast("int"))


def _segment(counts: Column, i: Column) -> Column:
    return F.call_function("shiftright", counts, (i * 2).cast("int")).bitwiseAND(F.lit(3).cast("long"))


def _dealt(cells: DataFrame, cell_limit: int) -> DataFrame:
    """Adds ``block``: 0, or for rows of a crowded cell the pairs of blocks
    they belong to, so that any two rows of the cell meet in one of them."""
    # own points and probes alike; a cell without an own point compares nothing
    crowded = (cells.groupBy("cell").agg(F.count("*").alias("count"), F.max("own").alias("real"))
               .filter(F.col("real") & (F.col("count") > cell_limit))
               .select("cell", F.ceil(F.col("count") / cell_limit).cast("int").alias("blocks")))
    crowded = C.checkpoint(crowded)
    if crowded.isEmpty():
        return cells.withColumn("block", F.lit(0).cast("long"))
    # at most (2 N / cell_limit) rows; the planner broadcasts them if they are small
    joined = cells.join(crowded, "cell", "left")
    n = F.col("blocks").cast("long")
    mine = F.pmod(F.xxhash64("fp"), n)
    other = F.explode(F.when(n.isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), n - 1),
                    lambda j: F.least(mine, j) * n + F.greatest(mine, j))))
    return joined.select("cell", "fp", "own", other.alias("block"))


def _within(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def _reach(points: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join each group of the cell's points, one per point reached;
    points leave the cell as they are reached, which keeps dense cells cheap."""
    links, rest = [], points
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            here = front.pop()
            near = _within(rest, here, bits)
            if near.any():
                for x in rest[near]:
                    links.append((here, x))
                    front.append(x)
                rest = rest[~near]
    return links


def _cell_links(bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # rows of the last cell, which may go on
        for frame in frames:
            key = np.stack([frame["cell"].to_numpy(), frame["block"].to_numpy()])
            fp, own = frame["fp"].to_numpy().view(np.uint64), frame["own"].to_numpy()
            if held is not None:
                key = np.concatenate([held[0], key], axis=1)
                fp, own = np.concatenate([held[1], fp]), np.concatenate([held[2], own])
            start = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))) if key.shape[1] else np.zeros(0, np.int64)
            if not len(start):
                continue
            last = start[-1]
            held = key[:, last:], fp[last:], own[last:]
            yield _compare(start[:-1], last, fp, own, bits)
        if held is not None and len(held[1]):
            yield _compare(np.zeros(1, np.int64), len(held[1]), held[1], held[2], bits)

    return run


def _compare(start: np.ndarray, stop: int, fp: np.ndarray, own: np.ndarray, bits: int) -> pd.DataFrame:
    size = np.diff(np.append(start, stop))
    a, b = [], []
    # cells without an own point hold no pair that is not met elsewhere
    real = np.add.reduceat(own[:stop], start) > 0 if len(start) else np.zeros(0, bool)
    few = np.repeat(real & (size > 1) & (size <= SMALL), size)
    group = np.repeat(np.arange(len(size)), size)
    for shift in range(1, SMALL):
        if stop <= shift:
            break
        same = few[shift:] & (group[shift:] == group[:-shift])
        at = np.flatnonzero(same)
        at = at[(fp[at] != fp[at + shift]) & _within(fp[at], fp[at + shift], bits)]
        a.append(fp[at])
        b.append(fp[at + shift])
    for i in np.flatnonzero(real & (size > SMALL)):
        links = _reach(np.unique(fp[start[i]:start[i] + size[i]]), bits)
        if links:
            pairs = np.array(links, np.uint64)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    join = lambda x: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)
    return pd.DataFrame({"a": join(a), "b": join(b)})


def links(points: DataFrame, bits: int = 3, cell_limit: int = 20_000) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column ``fp``) exactly
    as all pairs within ``bits`` differing bits would."""
    if not 0 <= bits <= 3:
        raise ValueError("the grid covers 0 to 3 differing bits")
    C.ship(points.sparkSession)
    dealt = _dealt(_cells(points, bits), cell_limit)
    return (dealt.repartition(F.col("cell"), F.col("block")).sortWithinPartitions("cell", "block")
            .mapInPandas(_cell_links(bits), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id, kept_fp) for every row of ``docs``; kept_fp
    is the fingerprint of the component's row with the smallest doc_id."""
    prints = C.checkpoint(docs.select("doc_id", fingerprints(docs, shingle).alias("fp")))
    points = C.checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(points.select("fp"), bits))
    point = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
                  .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("first")
    named = (point.join(point.groupBy("root").agg(first), "root")
             .select("fp", F.col("first.least").alias("component_id"), F.col("first.fp").alias("kept_fp")))
    return prints.join(named, "fp", "left")


def digest(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """The documents, one per component: the row with the smallest doc_id (a
    null id only if there is no other), then the smallest fingerprint.  Of rows
    that repeat both, the first by the JSON of all their columns stays.

    The text moves once, and only if the dropped keys are too many for the
    planner to broadcast."""
    found = near_duplicates(docs, shingle, bits)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("kept_fp"))
    keys = found.groupBy("doc_id", "fp").agg(F.max(stays).alias("stays"), F.count("*").alias("rows"))
    gone = C.checkpoint(keys.filter(~F.col("stays") | (F.col("rows") > 1))
                        .select(F.col("doc_id").alias("gone_id"), F.col("fp").alias("gone_fp"), "stays"))
    key = C.fresh(docs, "fp")
    printed = docs.withColumn(key, fingerprints(docs, shingle))
    match = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col(key) == F.col("gone_fp"))
    kept = printed.join(gone, match, "left_anti").select(*docs.columns)
    repeated = gone.filter("stays")
    if repeated.isEmpty():
        return kept
    row = F.struct(*[F.col(c) for c in docs.columns])
    once = (printed.join(repeated, match, "left_semi").groupBy("doc_id", key)
            .agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*"))
    return kept.unionByName(once)
