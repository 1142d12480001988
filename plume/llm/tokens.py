"""Token counts by byte-pair merging with a heap and a linked list.

The model file (sentencepiece, BPE with byte fallback) is only read for its
pieces and scores; the merging is done here, and no identifiers are made.  A
text's symbols are its characters, linked in both directions; a heap holds the
adjacent pairs that are pieces, best score first and leftmost of equals; each
pop merges one pair and pushes the two pairs the merge creates.  The count is
the number of initial symbols (a character that is no piece counts its UTF-8
bytes) minus the number of merges.

A text is merged in chunks that no piece can cross, found from the pieces
themselves: before a space mark that does not follow another, and between
characters of which no piece holds both sorts side by side.  A chunk's count
is remembered in the worker (two generations of a bounded table), so frequent
words are merged once per generation.

Scale: one narrow pass, no shuffle; the pieces (a fixed vocabulary) are the
only broadcast.

Defined cases: null counts as empty, and an empty text has no tokens; there is
no length limit and no special string.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plume.llm import common as C

#: The model's mark for a space; here both are written as a space.
MARK, SPACE = "▁", " "
#: Chunks remembered per generation and worker (about 150 bytes each).
MEMORY = 500_000


class Pieces:
    """The merges that the pieces allow, and the rule for cutting chunks."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        if len(normal) >= 1 << 20 or not any(sp.is_byte(i) for i in range(size)):
            raise ValueError("the model has no byte pieces, or too many pieces")
        ranked = sorted(normal, key=lambda i: -sp.get_score(i))
        number = {sp.id_to_piece(i).replace(MARK, SPACE): n for n, i in enumerate(ranked)}
        self.single = {p: n for p, n in number.items() if len(p) == 1}
        if any(c not in self.single for p in number for c in p):
            raise ValueError("a piece holds a character that is no piece")
        #: numbers of two adjacent symbols, packed, to the number of the piece they make
        self.merge = {number[p[:k]] << 20 | number[p[k:]]: n for p, n in number.items()
                      for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.pattern = _cuts([p for p in number if len(p) > 1])


def _cuts(pieces: list[str]) -> str:
    """A pattern of chunks that no piece crosses: a chunk ends before a space
    mark that follows another character; ``apart`` characters stand beside
    their own sort only; before an ``opening`` character no other one stands."""
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        return "(?s)..*"
    beside = {(a, b) for p in pieces for a, b in zip(p, p[1:]) if SPACE not in (a, b)}
    marks_seen = {c for p in pieces for c in p if not c.isalpha() and c != SPACE}

    def fix(marks: set[str], wrong) -> set[str]:
        while bad := {c for pair in beside for c in wrong(*pair, marks)} & marks:
            marks = marks - bad
        return marks

    apart = fix(marks_seen, lambda a, b, m: (a, b) if (a in m) != (b in m) else ())
    opening = fix(marks_seen - apart, lambda a, b, m: (b,) if b in m and a not in m else ())
    x, o = (re.escape("".join(sorted(m))) for m in (apart, opening))
    parts = [rf"{SPACE}*[^{SPACE}{x}{o}]+", rf"{SPACE}+"]
    if apart:
        parts.insert(1, rf"{SPACE}*[{x}]+")
    if opening:
        parts.insert(1, rf"{SPACE}*[{o}]+[^{SPACE}{x}{o}]*")
    return "|".join(parts)


def count_merged(chunk: str, single: dict[str, int], merge: dict[int, int]) -> int:
    """Symbols of the chunk minus merges."""
    symbols = [single.get(c, -1) for c in chunk]
    n = count = len(symbols)
    if -1 in symbols:
        count += sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c, s in zip(chunk, symbols) if s < 0)
    found = merge.get
    # heap entries: the made piece's number (smaller is better), then the place
    heap = []
    for i in range(n - 1):
        if symbols[i] >= 0 and symbols[i + 1] >= 0:
            made = found(symbols[i] << 20 | symbols[i + 1])
            if made is not None:
                heap.append(made << 32 | i)
    if not heap:
        return count
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        entry = pop(heap)
        i, made = entry & 0xFFFFFFFF, entry >> 32
        j = after[i]
        left = symbols[i]
        if left < 0 or j >= n or symbols[j] < 0 or found(left << 20 | symbols[j]) != made:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = made, -1
        count -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if symbols[k] >= 0:
                new = found(made << 20 | symbols[k])
                if new is not None:
                    push(heap, new << 32 | i)
        h = before[i]
        if h >= 0 and symbols[h] >= 0:
            new = found(symbols[h] << 20 | made)
            if new is not None:
                push(heap, new << 32 | h)
    return count


class Memory(dict):
    """Counts of chunks; two generations bound the size, frequent chunks stay."""

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.pieces, self.old = pieces, {}
        self.find = re.compile(pieces.pattern).findall

    def __missing__(self, chunk: str) -> int:
        n = self.old.get(chunk)
        if n is None:
            n = count_merged(chunk, self.pieces.single, self.pieces.merge)
        if len(chunk) < 100:
            if len(self) >= MEMORY:
                self.old = dict(self)
                self.clear()
            self[chunk] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.find(SPACE + text.replace(MARK, SPACE))))


_memories: dict[int, Memory] = {}


def token_counts(spark: SparkSession, text: Column, model_path: str) -> Column:
    """The number of tokens (long) of a text column."""
    C.ship(spark)
    with open(model_path, "rb") as f:
        pieces = Pieces(f.read())
    shared = spark.sparkContext.broadcast(pieces)
    key = hash(model_path)

    @F.pandas_udf("long")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory = _memories.get(key)
        if memory is None:
            memory = _memories[key] = Memory(shared.value)
        for texts in batches:
            yield pd.Series([memory.count(t) for t in texts], dtype="int64")

    return udf(text)


def digest(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                          token_counts(docs.sparkSession, text, model_path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
