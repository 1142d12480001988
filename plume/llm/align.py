"""Alignment of two tokenizers' cuts of the same text.

Both tokenizers' tokens are byte strings that make up the same text, so each
has a rising list of token ends.  The shorter list drives a galloping search
through the longer one: from the last place found, steps of 1, 2, 4, ... until
an end is not smaller, then a binary search in the last step.  The search gives
each end's rank in the other list, and whether it stands there too.  Common
ends cut both token lists into groups; differences of neighbouring ranks give
the range of tokens that a token overlaps.

A group's last tokens end together and are linked.  How often a pair of
identifiers is linked in the whole corpus tells how well a link is supported.
Of two strings that end at one place the shorter is a suffix of the longer, so
the pairs that can ever be linked follow from the vocabularies alone (the sum of
the token lengths at most, whatever the corpus): they are numbered, counts are
one vector per task, and the sums (bounded in that way) are broadcast.

Texts are cut into chunks at whose ends both tokenizers end a token.  The new
chunks of a batch are encoded and searched in a row, and a worker remembers what
short ones gave; a text is put together from its chunks.

Scale: one narrow pass over the texts writes a row per document with its link
numbers to the shared folder; counts and the final columns are two narrow
passes over these rows.  Nothing is shuffled but the vectors of counts.

Defined cases: null and empty texts, and texts that one tokenizer changes (a
``▁`` in the text), have no tokens; strings of special tokens are plain text;
repeated rows are rows of their own, and each counts.  Columns of other names
are left alone.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plume.llm import common as C
from plume.session import scratch_path

MARK = "▁"
SLICE_BYTES = 1 << 19


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable ones for themselves, the others in order from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of each identifier of a byte-level tokenizers file; empty for
    added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    value = _byte_of_char()
    vocabulary = spec["model"]["vocab"]
    out = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]))
    for token, i in vocabulary.items():
        out[i] = bytes(value[c] for c in token)
    for t in spec["added_tokens"]:
        out[t["id"]] = b""
    return out


def piece_tokens(path: str) -> list[bytes]:
    """The bytes of each identifier of a sentencepiece model; empty for control
    and unknown pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            out.append(b"")
        else:
            out.append(piece.replace(MARK, " ").encode())
    return out


class Pairs:
    """The tokens of both vocabularies and the numbered pairs of identifiers
    that can end together: one's bytes are a suffix of the other's."""

    def __init__(self, a: list[bytes], b: list[bytes]) -> None:
        self.a, self.b = a, b
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        codes = {i * len(b) + j for i, j in _suffix_pairs(a, b)}
        codes.update(i * len(b) + j for j, i in _suffix_pairs(b, a))
        #: identifier of a times the size of b, plus that of b; sorted
        self.codes = np.array(sorted(codes), np.int64)
        self.names = [str(i) for i in range(max(len(a), len(b)))]

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, a * len(self.b) + b)

    def b_of(self) -> np.ndarray:
        return self.codes % len(self.b)


def _suffix_pairs(long: list[bytes], short: list[bytes]) -> Iterator[tuple[int, int]]:
    ids: dict[bytes, list[int]] = {}
    for j, token in enumerate(short):
        if token:
            ids.setdefault(token, []).append(j)
    for i, token in enumerate(long):
        for k in range(len(token)):
            for j in ids.get(token[k:], ()):
                yield i, j


def gallop(short: list[int], long: list[int]) -> list[int]:
    """For each number of the rising list ``short`` its rank in the rising list
    ``long``: how many are smaller."""
    ranks, at, n = [], 0, len(long)
    if not n or short and short[-1] > long[-1]:
        long = [*long, float("inf")]  # every search ends inside
    for value in short:
        if long[at] < value:
            at += 1
            if long[at] < value:
                step = 1
                while at + step < n and long[at + step] < value:
                    at += step
                    step += step
                at = bisect_left(long, value, at + 1, min(at + step, n))
        ranks.append(at)
    return ranks


class Alignment:
    """Two token lists of one text: ``a_cut`` and ``b_cut`` are the numbers of
    tokens up to each common end; ``overlaps`` counts pairs of tokens that share
    a byte."""

    def __init__(self, a_end: np.ndarray, b_end: np.ndarray) -> None:
        turned = len(b_end) < len(a_end)
        short, long = (b_end, a_end) if turned else (a_end, b_end)
        self.turned, self.ranks = turned, np.array(gallop(short.tolist(), long.tolist()), np.int64)
        self.common = long[self.ranks] == short if len(short) else np.zeros(0, bool)  # both end with the text
        hit = np.flatnonzero(self.common)
        cuts = hit + 1, self.ranks[hit] + 1
        self.a_cut, self.b_cut = cuts[::-1] if turned else cuts

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last token of the longer list that each token of the
        shorter one overlaps (the last of a text ends both lists): the first
        begins behind the end before if that is common, else around it."""
        first = np.concatenate([[0], self.ranks[:-1] + self.common[:-1]]) if len(self.ranks) else self.ranks
        return first, self.ranks

    def overlaps(self) -> np.ndarray:
        """How many tokens of the longer list each token of the shorter one overlaps."""
        first, last = self.ranges()
        return last - first + 1


#: Letters and digits that every version of Unicode knows, and marks that no
#: piece may join to them.
_WORD, _MARKS = "A-Za-z0-9À-ÖØ-öø-ɏ", ".,;:!?)"
#: Chunks, at whose ends both tokenizers end a token: before a space or newline
#: behind a visible character, behind a lone newline, between word and mark.
_CHUNK = re.compile(
    rf" ?[{_WORD}]+(?=[ \n{_MARKS}])|[{_MARKS}]+(?=[ \n])|\n(?=[\w!-~])|"
    rf"(?s:.+?)(?:(?<=[\w!-~])(?=[ \n])|(?<=[\w!-~]\n)(?=[\w!-~])|(?<=[{_WORD}])(?=[{_MARKS}])|\Z)")
#: Chunks remembered in a worker (about 400 bytes each), and the longest.
MEMORY, REMEMBERED = 300_000, 64


def _cuttable(a_path: str, b_path: str) -> bool:
    """Whether both tokenizers end a token at the end of each chunk: a splits
    words, marks and white space as byte-level tokenizers do by default; no
    piece of b bears a mark behind a word, a newline, or ``▁`` but in front."""
    import sentencepiece

    with open(a_path, encoding="utf-8") as f:
        spec = json.load(f)
    words = spec.get("pre_tokenizer") or {}
    sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
    crossing = re.compile(rf"\n|[^{MARK}]{MARK}|[{_WORD}][{_MARKS}]")
    return (words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
            and not spec.get("normalizer")
            and not any(crossing.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size())))


#: A chunk: its tokens of a and of b, its pairs of overlapping tokens, the text
#: of its groups and the numbers of its links (int32); None if a tokenizer
#: changes it.  Plain tuples of compact values: the garbage collector leaves
#: them alone.
Aligned = tuple[int, int, int, str, bytes] | None


class Aligner:
    """Both tokenizers in a worker, one thread each, and the chunks aligned."""

    def __init__(self, pairs: Pairs, a_path: str, b_path: str, cuttable: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.pairs = pairs
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.cut = _CHUNK.findall if cuttable else lambda text: [text]
        #: what the library puts before a newline and its text
        self.before = len(self.b.encode("\n"))
        lone = self.b.piece_to_id(MARK)
        #: what b makes of a space alone (an empty text for the library)
        self.lone = [self.b.piece_to_id(f"<0x{x:02X}>") for x in MARK.encode()] if self.b.is_unknown(lone) else [lone]
        self.known: dict[str, Aligned] = {}

    def ids(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Identifiers of the chunks, and whether both token lists spell them."""
        a = [e.ids for e in self.a.encode_batch(chunks, add_special_tokens=False)]
        # the library puts a space before a text: it takes a chunk's own, or stands before a newline that goes again
        opened = self.b.encode([c[1:] if c[0] == " " else "\n" + c for c in chunks], num_threads=1)
        b = [self.lone if c == " " else y if c[0] == " " else y[self.before:] for c, y in zip(chunks, opened)]
        spell_a, spell_b = self.pairs.a.__getitem__, self.pairs.b.__getitem__
        same = [b"".join(map(spell_a, x)) == c.encode("utf-8", "surrogatepass") == b"".join(map(spell_b, y))
                for c, x, y in zip(chunks, a, b)]
        return a, b, same

    def align(self, chunks: list[str]) -> None:
        """Align chunks that are not known, all in a row: chunks end together,
        so one search runs through the ends of them all."""
        a, b, same = self.ids(chunks)
        for c, s in zip(chunks, same):
            if not s:
                self.known[c] = None
        rows = [(c, x, y) for c, x, y, s in zip(chunks, a, b, same) if s]
        n_a, n_b = (np.array([len(r[k]) for r in rows], np.int64) for k in (1, 2))
        a_ids, b_ids = (np.fromiter(chain.from_iterable(r[k] for r in rows), np.int64) for k in (1, 2))
        a_end, b_end = np.cumsum(self.pairs.a_size[a_ids]), np.cumsum(self.pairs.b_size[b_ids])
        found = Alignment(a_end, b_end)
        links = self.pairs.numbers(a_ids[found.a_cut - 1], b_ids[found.b_cut - 1]).astype(np.int32)
        a_to, b_to = np.cumsum(n_a), np.cumsum(n_b)
        group_to = np.searchsorted(found.a_cut, a_to, "right")
        groups = _group_texts(a_ids, b_ids, found, self.pairs.names)
        over = np.concatenate([[0], np.cumsum(found.overlaps())])[np.concatenate([[0], b_to if found.turned else a_to])]
        g = 0
        for (c, x, y), to, n in zip(rows, group_to.tolist(), np.diff(over).tolist()):
            self.known[c] = len(x), len(y), n, ";".join(groups[g:to]), links[g:to].tobytes()
            g = to

    def __call__(self, texts: list[str]) -> list[list[Aligned]]:
        """The aligned chunks of a space and each text; none of a text that a
        tokenizer changes, nor of an empty one."""
        cut = [self.cut(" " + t) if t else [] for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        new = list({c for chunks in cut for c in chunks if c not in self.known})
        if new:
            self.align(new)
        out = []
        for chunks in cut:
            found = list(map(self.known.__getitem__, chunks))
            out.append([] if None in found else found)
        for c in new:
            if len(c) > REMEMBERED:
                del self.known[c]
        return out


def _group_texts(a_ids: np.ndarray, b_ids: np.ndarray, found: Alignment, names: list[str]) -> list[str]:
    """``a1,a2|b1``: the identifiers of each group in order."""
    a, b = ([names[i] for i in ids.tolist()] for ids in (a_ids, b_ids))
    out, i, j = [], 0, 0
    for k, m in zip(found.a_cut.tolist(), found.b_cut.tolist()):
        out.append(f"{a[i] if k == i + 1 else ','.join(a[i:k])}|{b[j] if m == j + 1 else ','.join(b[j:m])}")
        i, j = k, m
    return out


_workers: dict[tuple[str, str], Aligner] = {}


def _aligner(shared: tuple) -> Aligner:
    """A worker's aligner of two files, made once."""
    key = shared[1:3]
    if key not in _workers:
        _workers[key] = Aligner(*shared)
    return _workers[key]


def _shared(spark: SparkSession, a_path: str, b_path: str):
    C.ship(spark)
    pairs = Pairs(byte_level_tokens(a_path), piece_tokens(b_path))
    return spark.sparkContext.broadcast((pairs, a_path, b_path, _cuttable(a_path, b_path)))


def _texts(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.coalesce("text", F.lit("")).alias("text"))


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id") -> DataFrame:
    """Per row ``key`` (long), a_ids, b_ids, and a_cut, b_cut: the numbers of
    tokens of each up to the end of every group; and per token of a the first
    and last token of b that it overlaps (a_first, a_last).  Whole texts are
    encoded and searched."""
    shared = _shared(docs.sparkSession, a_path, b_path)
    names = [key, "a_ids", "b_ids", "a_cut", "b_cut", "a_first", "a_last"]
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        sizes = aligner.pairs.a_size, aligner.pairs.b_size
        for batch in C.slices(batches, "text", SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            rows = []
            for text, *ids, same in zip(texts, *aligner.ids([" " + t for t in texts])):
                x, y = (np.array(i if text and same else [], np.int64) for i in ids)
                found = Alignment(np.cumsum(sizes[0][x]), np.cumsum(sizes[1][y]))
                first, last = found.ranges()
                if found.turned:  # ranges of a's tokens from those of b's
                    own = np.arange(len(x))
                    first, last = np.searchsorted(last, own, "left"), np.searchsorted(first, own, "right") - 1
                rows.append((x, y, found.a_cut, found.b_cut, first, last))
            columns = [pa.array([v.astype(np.int32) for v in c], ints) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return _texts(docs, key).mapInArrow(run, f"{key} long, " + ", ".join(f"{n} array<int>" for n in names[1:]))


def _linked(docs: DataFrame, shared) -> DataFrame:
    """doc_id, the counts and digest of the groups, and the link numbers."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_overlaps", "links"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        for batch in C.slices(batches, "text", SLICE_BYTES):
            rows, links = [], []
            for d, chunks in zip(batch.column(0).to_pylist(), aligner(batch.column("text").to_pylist())):
                n_a, n_b, overlaps, groups, own = zip(*chunks) if chunks else ((), (), (), (), ())
                own = b"".join(own)
                text = sha256(";".join(groups).encode()).hexdigest() if chunks else ""
                rows.append((d, sum(n_a), sum(n_b), len(own) // 4, text, sum(overlaps)))
                links.append(own)
            ends = np.cumsum([0, *(len(x) // 4 for x in links)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(links), np.int32)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), types)), lists], names)

    return _texts(docs, "doc_id").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_overlaps long, links array<int>")


def link_counts(linked: DataFrame, shared) -> np.ndarray:
    """Per numbered pair how many links of the corpus hold it."""
    size = len(shared.value[0].codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["pair", "n"])

    sums = np.zeros(size, np.int64)
    # as many rows as pairs can be linked at most: bounded by the vocabularies
    for r in linked.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        sums[r.pair] = r.n
    return sums


def digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: tokens, groups, links, how many of them are the
    corpus's best of their b identifier, the sum of their pairs' counts, the
    digest of the groups, and the overlapping token pairs."""
    spark = docs.sparkSession
    shared = _shared(spark, a_path, b_path)
    path = scratch_path(spark, "aligned")
    _linked(docs, shared).write.parquet(path)
    linked = spark.read.parquet(path)
    counts = link_counts(linked, shared)
    pairs = shared.value[0]
    b_of = pairs.b_of()
    highest = np.zeros(len(pairs.b), np.int64)
    np.maximum.at(highest, b_of, counts)
    known = spark.sparkContext.broadcast((counts, counts == highest[b_of]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = known.value
        for batch in batches:
            links = batch.column("links")
            size = np.diff(links.offsets.to_numpy())
            flat = links.flatten().to_numpy()
            cut = np.concatenate([[0], np.cumsum(size)])
            sums = [np.concatenate([[0], np.cumsum(x[flat].astype(np.int64))]) for x in (best, count)]
            n_best, count_sum = (pa.array(s[cut[1:]] - s[cut[:-1]]) for s in sums)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names[:4]), pa.array(size.astype(np.int64)), n_best, count_sum,
                 batch.column("groups_sha256"), batch.column("n_overlaps")], names)

    return linked.mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long")
