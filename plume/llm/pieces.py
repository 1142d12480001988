"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The model file is read for its pieces, scores and normaliser settings; the
work is done here.  A text's symbols are its characters (a space is the mark
``▁``, and one stands before the text).  An agenda holds the adjacent pairs
that make a piece, best score first and leftmost of equal scores; the top pair
is merged, and the one or two pairs the merge makes join the agenda.  What is
left are the pieces; a character that is no piece becomes the byte pieces of
its UTF-8 form.  Decoding joins the pieces, turns runs of byte pieces into
characters and marks into spaces, and takes the first mark away.

Both directions are checked against the sentencepiece library, batch by Arrow
batch: ``agrees`` says per row whether the identifiers and the decoded text are
the library's.  The library never supplies a result.

A text is cut where no piece can cross, which the pieces themselves tell, and a
chunk's identifiers are remembered in the worker (two generations of a bounded
table).

Scale: one narrow pass over the texts, no shuffle; the vocabulary (fixed size)
is the only broadcast; a task holds about ``SLICE_BYTES`` of text, or one text.

Defined cases: null counts as empty; an empty text has no identifiers and
decodes to an empty text; strings of control pieces inside a text are plain
text; ``▁`` in a text is read as a space, as the library does; repeated rows
give repeated results; columns of other names are left alone.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain, groupby, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plume.llm import common as C

MARK = "▁"
SLICE_BYTES = 1 << 20
#: Chunks remembered per generation and worker (about 250 bytes each), and the
#: longest chunk remembered.
MEMORY, REMEMBERED = 600_000, 64
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Chunks of at most so many symbols keep their agenda as a list, longer ones as a heap.
SHORT = 40
NEVER = 1 << 40
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


class Vocabulary:
    """What encoding and decoding need of a model; raises ValueError for
    models of another kind."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto.FromString(model)
        norm = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != schema.TrainerSpec.BPE:
            raise ValueError("not a merge-type (BPE) vocabulary")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces \
                or proto.trainer_spec.treat_whitespace_as_suffix or proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("the model rewrites its input")
        if not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or BYTE not in kinds:
            raise ValueError("the model has unused or user-defined pieces, or no byte pieces")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.number = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte = {int(_BYTE_PIECE.fullmatch(p.piece)[1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        #: pieces of equal score have equal places in the agenda
        place = {s: n for n, s in enumerate(sorted({p.score for p in proto.pieces}, reverse=True))}
        self.size = len(proto.pieces)
        #: two adjacent identifiers, packed, to the place of what they make, and to its identifier
        self.place, self.made = {}, {}
        for piece, made in self.number.items():
            for k in range(1, len(piece)):
                left, right = self.number.get(piece[:k]), self.number.get(piece[k:])
                if left is not None and right is not None:
                    self.place[left * self.size + right] = place[proto.pieces[made].score]
                    self.made[left * self.size + right] = made
        if any(c not in self.number for p in self.number for c in p):
            raise ValueError("a piece holds a character that is no piece")
        self.pattern = _cuts([p for p in self.number if len(p) > 1])
        #: what a piece adds to a decoded text; byte pieces stand apart
        self.said = [p.piece.replace(MARK, " ") if p.type == NORMAL else "" for p in proto.pieces]
        self.value = {i: b for b, i in self.byte.items()}
        self.unknown = {i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN}
        #: identifiers from here on are ordinary pieces
        self.plain = 1 + max(i for i, p in enumerate(proto.pieces) if p.type != NORMAL)
        self.names = [str(i) for i in range(self.size)]
        self.unknown_said = proto.trainer_spec.unk_surface

    def encode(self, chunk: str) -> tuple[int, ...]:
        """Identifiers of a marked chunk, by the agenda."""
        number = self.number
        symbols = [number.get(c, -1) for c in chunk]
        if -1 in symbols:  # a character that is no piece joins nothing
            out: list[int] = []
            for known, part in groupby(chunk, number.__contains__):
                if known:
                    out.extend(self._merged([number[c] for c in part]))
                else:
                    out.extend(self.byte[b] for b in "".join(part).encode("utf-8", "surrogatepass"))
            return tuple(out)
        return tuple(self._merged(symbols))

    def _merged(self, symbols: list[int]) -> list[int]:
        if len(symbols) > SHORT:
            return self._merged_long(symbols)
        # a short agenda is a list beside the symbols: the place of each pair
        place, made, size = self.place.get, self.made, self.size
        pairs = [a * size + b for a, b in pairwise(symbols)]
        agenda = [place(p, NEVER) for p in pairs]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)  # the leftmost of equals
            new = made[pairs[i]]
            symbols[i:i + 2] = [new]
            del agenda[i], pairs[i]
            if i < len(agenda):
                pairs[i] = p = new * size + symbols[i + 1]
                agenda[i] = place(p, NEVER)
            if i:
                pairs[i - 1] = p = symbols[i - 1] * size + new
                agenda[i - 1] = place(p, NEVER)
        return symbols

    def _merged_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap of (place, position) and linked symbols."""
        place, made, size = self.place.get, self.made, self.size
        n = len(symbols)
        agenda = [at << 40 | i for i, (a, b) in enumerate(pairwise(symbols)) if (at := place(a * size + b)) is not None]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        while agenda:
            entry = pop(agenda)
            i = entry & 0xFFFFFFFFFF
            j = after[i]
            if gone[i] or j >= n or place(pair := symbols[i] * size + symbols[j]) != entry >> 40:
                continue  # a side was merged away or has grown since; the pair of now has an entry of its own
            symbols[i], gone[j] = made[pair], True
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (at := place(symbols[i] * size + symbols[k])) is not None:
                    push(agenda, at << 40 | i)
            h = before[i]
            if h >= 0 and (at := place(symbols[h] * size + symbols[i])) is not None:
                push(agenda, at << 40 | h)
        return [s for s, g in zip(symbols, gone) if not g]

    def decode(self, ids: list[int]) -> str:
        """The text of identifiers; bytes that are no UTF-8 become U+FFFD."""
        value, said = self.value, self.said
        if not ids or min(ids) >= self.plain:
            text = "".join(map(said.__getitem__, ids))
        else:
            parts, held = [], bytearray()
            for i in ids:
                if i in value:
                    held.append(value[i])
                    continue
                if held:
                    parts.append(_characters(bytes(held)))
                    held.clear()
                parts.append(self.unknown_said if i in self.unknown else said[i])
            parts.append(_characters(bytes(held)))
            text = "".join(parts)
        first = next((i for i in ids if said[i] or i in value or i in self.unknown), None)
        return text[1:] if self.prefix and first is not None and said[first].startswith(" ") else text


def _cuts(pieces: list[str]) -> str:
    """A pattern of chunks that no piece crosses: cut before a mark behind
    another character, and before an opening character behind one that is none
    (in no piece does another character but a mark stand before an opening one)."""
    if any(MARK in p.lstrip(MARK) for p in pieces):
        return "(?s).+"
    beside = {(a, b) for p in pieces for a, b in zip(p, p[1:]) if a != MARK}
    opening = {c for p in pieces for c in p if not c.isalpha() and c != MARK}
    while wrong := {b for a, b in beside if b in opening and a not in opening}:
        opening -= wrong
    if not opening:
        return f"{MARK}*[^{MARK}]+|{MARK}+"
    o = re.escape("".join(sorted(opening)))
    return f"{MARK}*[{o}]*[^{MARK}{o}]+|{MARK}*[{o}]+|{MARK}+"


def _characters(data: bytes) -> str:
    """Valid characters as they are, U+FFFD for each other byte."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as bad:
        return data[:bad.start].decode("utf-8") + "�" + _characters(data[bad.start + 1:])


class Encoder(dict):
    """Chunks to identifiers, remembered; two generations bound the size."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}
        self.chunks = re.compile(vocabulary.pattern).findall

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.vocabulary.encode(chunk)
        if len(chunk) <= REMEMBERED:
            if len(self) >= MEMORY:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def __call__(self, text: str) -> list[int]:
        if not text:
            return []
        marked = self.vocabulary.prefix + text.replace(" ", MARK)
        return list(chain.from_iterable(map(self.__getitem__, self.chunks(marked))))


_workers: dict[str, tuple] = {}


def _worker(path: str, vocabulary: Vocabulary, model: bytes) -> tuple:
    """A worker's encoder and library processor of a model, made once."""
    if path not in _workers:
        import sentencepiece

        _workers[path] = Encoder(vocabulary), sentencepiece.SentencePieceProcessor(model_proto=model)
        gc.freeze()  # the tables stay: the collector need not walk them again
    return _workers[path]


def _each_batch(docs: DataFrame, model_path: str, columns: list[str], schema: str,
                make: Callable[[pa.RecordBatch, Vocabulary, list[list[int]], list[str], list[bool]], list[pa.Array]]) -> DataFrame:
    """Encode, decode and check the texts; ``make`` turns a batch into columns."""
    C.ship(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((Vocabulary(model), model))
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, proto = shared.value
        encoder, library = _worker(model_path, vocabulary, proto)
        for batch in C.slices(batches, "text", SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            ids = [encoder(t) for t in texts]
            decoded = [vocabulary.decode(i) for i in ids]
            agrees = [a == b and c == d for a, b, c, d in zip(
                ids, library.encode(texts, num_threads=1), decoded, library.decode(ids, num_threads=1))]
            yield pa.RecordBatch.from_arrays(make(batch, vocabulary, ids, decoded, agrees), names)

    text = F.coalesce("text", F.lit("")).alias("text")
    return docs.select(*columns, text).mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """``key`` (long), ids (array of int), decoded, agrees: a row per row."""
    def make(batch, vocabulary, ids, decoded, agrees):
        return [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())]

    return _each_batch(docs, model_path, [key], f"{key} long, ids array<int>, decoded string, agrees boolean", make)


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, digests of the identifiers and of the decoded text, agrees."""
    def sha(text: str) -> str:
        return sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def make(batch, vocabulary, ids, decoded, agrees):
        return [batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array([sha(",".join(map(vocabulary.names.__getitem__, i))) for i in ids]),
                pa.array(map(sha, decoded)), pa.array(agrees, pa.bool_())]

    return _each_batch(docs, model_path, ["doc_id"],
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean", make)
