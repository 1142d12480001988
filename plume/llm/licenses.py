"""License scans with a positional index of rare licence words.

Templates are phrases and openings of licence texts, with a label and key
phrases within.  One pass counts in how many documents each template word
stands (all documents, so the weights are those of the corpus).  The index then
holds some rare words of each template with their places in it.  A document
looks up every indexed word it has; each occurrence names the origin at which
the template would then lie, and the postings are intersected: an origin that at
least ``agree`` of the indexed words name is a candidate.  A candidate counts if
a key phrase stands there, word by word.

- A phrase, and a short template, is indexed by the rarest words of its only
  key phrase, which all have to agree, so no place of the key phrase is missed.
- A long opening is indexed by the rarest word of each of ``RARE`` stretches;
  ``AGREE`` of them in step and one of several key phrases are enough, so an edited licence is found
  by what is left of it.

The score of a match is the weighted share (inverse document frequency) of the
template's words that stand at their places; a document has that of its best
match, 0 without one.

Scale: two narrow passes over the texts, no shuffle but the word counts (a row
per template word and task); the index is a constant plus those counts.

Defined cases: doc_id must be long; null counts as empty; no match gives null places, empty labels
and score 0; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plume.llm import common as C

SHARD_BYTES = 4 << 20


#: Indexed words: of a short template's key phrase, of a long template; and how
#: many of the latter have to agree.
RARE_IN_KEY, RARE, AGREE = 3, 12, 4


@dataclass(frozen=True)
class Template:
    """Words of a licence text, its label, and the key phrases within.  With
    several key phrases it is a long one."""

    label: str
    words: str
    keys: tuple[str, ...]
    base: bool = False

    def split(self) -> list[str]:
        return self.words.split()

    def places(self) -> list[tuple[int, int]]:
        """(first word, words) of each key phrase."""
        words, found = self.split(), []
        for key in map(str.split, self.keys):
            found.append((next(i for i in range(len(words)) if words[i:i + len(key)] == key), len(key)))
        return found


def _phrase(label: str, words: str) -> Template:
    return Template(label, words, (words,), base=True)


# the three phrases are fixed; the openings of common licences are a choice
TEMPLATES = [
    _phrase("cc-by", "cc by"),
    _phrase("gpl", "general public license"),
    _phrase("reserved", "all rights reserved"),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license",
             ("except in compliance with the license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2",
             ("gnu general public license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3",
             ("gnu general public license version 3",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("permission is hereby granted free of charge",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("mit", """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the software""",
             ("permission is hereby granted", "to deal in the software without restriction",
              "sublicense and or sell copies of the software", "the above copyright notice and this permission notice")),
    Template("bsd", """
        redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice
        this list of conditions and the following disclaimer in the documentation and or other materials provided with
        the distribution""",
             ("redistribution and use in source", "provided that the following conditions are met",
              "redistributions of source code must retain", "redistributions in binary form must reproduce")),
    Template("apache-2.0", """
        licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
        license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by
        applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language
        governing permissions and limitations under the license""",
             ("licensed under the apache license", "you may not use this file except in compliance",
              "unless required by applicable law or agreed to in writing", "without warranties or conditions of any kind",
              "the specific language governing permissions and limitations")),
    Template("gpl", """
        is free software you can redistribute it and or modify it under the terms of the gnu general public license as
        published by the free software foundation either version of the license or at your option any later version
        this program is distributed in the hope that it will be useful but without any warranty without even the implied
        warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details""",
             ("you can redistribute it and or modify it", "as published by the free software foundation",
              "in the hope that it will be useful but without any warranty")),
    Template("isc", """
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies""",
             ("permission to use copy modify", "for any purpose with or without fee", "this permission notice appear in all copies")),
    Template("mpl-2.0", """
        this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at""",
             ("this source code form is subject to the terms", "if a copy of the mpl was not distributed with this file")),
]


def _hash(words: list[str]) -> np.ndarray:
    return C.Words([x.encode() for x in words], C.ALNUM_TABLE).hash


class Index:
    """Positional index of the rarest words of each template."""

    def __init__(self, templates: list[Template], idf: dict[str, float]) -> None:
        self.templates = templates
        vocabulary = sorted({x for t in templates for x in t.split()})
        hashes = _hash(vocabulary)
        order = np.argsort(hashes)
        self.hashes, self.vocabulary = hashes[order], [vocabulary[i] for i in order]
        number = {x: i for i, x in enumerate(self.vocabulary)}
        self.idf = np.array([idf[x] for x in self.vocabulary])
        self.words = [np.array([number[x] for x in t.split()]) for t in templates]
        #: per template the places of its indexed words, and how many have to agree
        self.indexed: list[list[int]] = []
        self.agree: list[int] = []
        postings = defaultdict(list)  # word: places (template, offset)
        for n, t in enumerate(templates):
            own, keys = t.split(), t.places()
            long = len(keys) > 1
            rank = lambda i: (-idf[own[i]], i)
            if long:  # of each stretch, so that any part of the text has its share
                rarest = [min(part.tolist(), key=rank) for part in np.array_split(np.arange(len(own)), RARE) if len(part)]
            else:
                rarest = sorted(sorted(range(keys[0][0], sum(keys[0])), key=rank)[:RARE_IN_KEY])
            self.indexed.append(rarest)
            self.agree.append(min(AGREE, len(rarest)) if long else len(rarest))
            for i in rarest:
                postings[number[own[i]]].append((n, i))
        self.postings = dict(postings)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of template words, -1 for any other word."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def matches(self, ids: np.ndarray, first: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Per template the verified places: word numbers of a key phrase's
        start (of the first one that stands there), and scores.  ``first``:
        where each text's words begin."""
        where = np.flatnonzero(ids >= 0)
        word = ids[where]
        text = np.searchsorted(first, np.arange(len(ids)), side="right") - 1
        begin, end = first[text], first[text + 1]
        named = defaultdict(list)
        for x, postings in self.postings.items():
            at = where[word == x]
            for n, offset in postings:
                named[n].append((at, at - offset))
        found = []
        for n, lists in sorted(named.items()):
            at, origin = (np.concatenate(x) for x in zip(*lists))
            # the postings' intersection: origins of a text that enough of them name
            order = np.lexsort((origin, begin[at]))
            at, origin = at[order], origin[order]
            low, high = begin[at], end[at]
            new = np.flatnonzero(np.append(True, (origin[1:] != origin[:-1]) | (low[1:] != low[:-1]))[:len(at)])
            agree = new[np.diff(np.append(new, len(at))) >= self.agree[n]]
            origin, low, high = origin[agree], low[agree], high[agree]
            words = self.words[n]
            start = np.full(len(origin), -1)  # of the first key phrase that stands at its place
            for key, size in self.templates[n].places():
                stands = (start < 0) & (origin + key >= low) & (origin + key + size <= high)
                for i in range(key, key + size):  # word by word
                    stands[stands] = ids[origin[stands] + i] == words[i]
                start[stands] = origin[stands] + key
            sure = start >= 0
            origin, low, high, start = origin[sure], low[sure], high[sure], start[sure]
            share = np.zeros(len(origin))
            for i, x in enumerate(words):
                place = origin + i
                inside = (place >= low) & (place < high)
                share += self.idf[x] * (inside & (ids[np.clip(place, 0, len(ids) - 1)] == x)) if len(ids) else 0
            found.append((n, start, share / self.idf[words].sum()))
        return found


def word_weights(docs: DataFrame, templates: list[Template]) -> dict[str, float]:
    """Inverse document frequency of every template word, over all documents."""
    C.ship(docs.sparkSession)
    vocabulary = sorted({x for t in templates for x in t.split()})
    even = Index(templates, dict.fromkeys(vocabulary, 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(len(vocabulary), np.int64), 0
        for batch in C.slices(batches, "utf8", SHARD_BYTES):
            w = C.Words([x.lower() for x in batch.column("utf8").to_pylist()], C.ALNUM_TABLE)
            ids = even.ids(w.hash)
            at = np.flatnonzero(ids >= 0)
            text = np.searchsorted(w.first, at, side="right") - 1
            pairs = np.unique(text * len(vocabulary) + ids[at])
            counts += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([*even.vocabulary, None]), pa.array([*counts.tolist(), rows], pa.int64())], ["word", "n"])

    totals = docs.select(C.utf8().alias("utf8")).mapInArrow(run, "word string, n long") \
                 .groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row per template word
    df = {r.word: r.n for r in totals}
    rows = df.pop(None, 0)
    return {x: math.log((rows + 2) / (df.get(x, 0) + 1)) for x in vocabulary}


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score) for every row."""
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, word_weights(docs, templates)))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in C.slices(batches, "utf8", SHARD_BYTES):
            w = C.Words([x.lower() for x in batch.column("utf8").to_pylist()], C.ALNUM_TABLE)
            n = batch.num_rows
            count, score = np.zeros(n, np.int64), np.zeros(n)
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base, labels = defaultdict(set), defaultdict(set)
            for t, at, share in own.matches(own.ids(w.hash), w.first):
                text = np.searchsorted(w.first, at, side="right") - 1
                np.maximum.at(score, text, share)
                label = own.templates[t].label
                for i in np.unique(text).tolist():
                    labels[i].add(label)
                    if own.templates[t].base:
                        base[i].add(label)
                if own.templates[t].base:
                    np.add.at(count, text, 1)
                    np.minimum.at(low, text, at - w.first[text])
                    np.maximum.at(high, text, at - w.first[text])
            none = count == 0
            columns = [batch.column("doc_id"), w.counts(), count, pa.array(low, mask=none), pa.array(high, mask=none),
                       [",".join(sorted(base[i])) for i in range(n)], [",".join(sorted(labels[i])) for i in range(n)],
                       np.round(np.minimum(score, 1.0), 9)]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
              "base_labels string, labels string, score double")
    return docs.select("doc_id", C.utf8().alias("utf8")).mapInArrow(run, schema)
