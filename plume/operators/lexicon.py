"""Substring tests against large lexicons.

The lookahead pattern of ``functions.labels`` tries every position against all
terms; it suits some hundred terms and needs no Python.  For thousands of terms
a text is read once by an automaton instead (``functions.automaton``), in Arrow
batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.automaton import Automaton, parts
from ..session import ship_package

#: Bytes of an automaton's table; larger lexicons are run part by part.
TABLE_LIMIT = 256 << 20
#: Characters of text per step of a task.
SLICE_CHARS = 1 << 20


def lexicon_terms(terms: DataFrame, column: str = "term", most: int = 5_000_000) -> list[str]:
    """The distinct lower-cased terms, sorted; empty and null ones are left
    out.  They go through the driver, so more than ``most`` are an error."""
    rows = (terms.select(F.lower(F.col(column)).alias("term")).filter("term <> ''").distinct()
            .limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"a lexicon of more than {most} terms")
    return sorted(r.term for r in rows)


def lexicon_hits(df: DataFrame, terms: list[str], text: str = "textOriginal", key: str = "row_id",
                 limit: int = TABLE_LIMIT) -> DataFrame:
    """(key, hits): per row the distinct terms that its lower-cased text
    contains, in order.  ``terms`` are distinct, lower case and sorted
    (``lexicon_terms``).  A null text and an empty lexicon have no hits.

    One narrow pass; the automaton's table is a broadcast of at most ``limit``
    bytes.  A larger lexicon is cut into runs of terms that keep the limit; each
    run is looked up by a stage of its own in the same pass, and the hits of all
    are put one behind the other (runs are in order, so the hits are, too)."""
    spark = df.sparkSession
    ship_package(spark)
    low = df.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"),
                    F.array().cast("array<string>").alias("hits"))
    for run_terms in parts(terms, limit):
        low = _with_hits(low, spark.sparkContext.broadcast(Automaton(run_terms)), key)
    return low.select(key, "hits")


def _with_hits(low: DataFrame, shared, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Automaton = shared.value
        names = np.array(own.terms, object)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            at = 0
            while at < len(texts):  # about SLICE_CHARS characters, one text at least
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_CHARS, side="right")))
                found = own.hits(texts[at:to])
                rows = batch.slice(at, to - at)
                before = rows.column(2)
                sizes = np.diff(before.offsets.to_numpy()) + np.array([len(f) for f in found])
                if len(before.flatten()):
                    values = pa.array([x for b, f in zip(before.to_pylist(), found) for x in [*b, *names[f]]], pa.string())
                else:
                    values = pa.array(names[np.concatenate(found)], pa.string())
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.ListArray.from_arrays(offsets, values)], rows.schema.names)
                at = to

    return low.mapInArrow(run, low.schema)
