import random

import numpy as np
from helpers import ALNUM, lower, rows_of
from plume.llm import licenses as L


def standing(w, t, index):
    """Origins of a template in the words ``w``: enough indexed words agree and
    a key phrase stands; with where its first standing key phrase begins."""
    n, own = index.templates.index(t), t.split()
    out = []
    for origin in range(-len(own), len(w)):
        at = lambda i: w[origin + i] if 0 <= origin + i < len(w) else None
        agree = sum(at(i) == own[i] for i in index.indexed[n])
        keys = [k for k, size in t.places() if all(at(i) == own[i] for i in range(k, k + size))]
        if keys and agree >= index.agree[n]:
            out.append(origin + keys[0])
    return out


def brute(rows, index):
    out = []
    for d, text in rows:
        w, places, labels, base = ALNUM.findall(lower(text)), [], set(), set()
        for t in L.TEMPLATES:
            if len(t.keys) > 1:
                found = standing(w, t, index)
            else:  # a short template: wherever its key phrase stands
                key = t.keys[0].split()
                found = [i for i in range(len(w) - len(key) + 1) if w[i:i + len(key)] == key]
            if found:
                labels.add(t.label)
            if found and t.base:
                base.add(t.label)
                places += found
        out.append((d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels))))
    return sorted(out, key=str)


def test_every_key_phrase_is_found(spark):
    r = random.Random(3)
    bits = ["CC BY", "cc-by cc by cc", "All rights reserved", "all rights", "General Public License", "GNU general public license, version 3",
            "the MIT license", "x", "é", "apache license version 2.0", "mozilla public license", "cc by nc", "lesser general public license"]
    for t in L.TEMPLATES:  # pieces of the long openings
        own = t.split()
        bits += [" ".join(own[i:i + 25]) for i in range(0, len(own), 20)] if len(t.keys) > 1 else []
    rows = [(i if r.random() < 0.9 else None, r.choice([None, "", " ".join(r.choice(bits) for _ in range(r.randint(0, 9)))])) for i in range(300)]
    rows += rows[:3] + [(1000, "filler words " * 20_000 + "CC by")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS utf8", "2 AS score")
    found = L.scan(df)
    index = L.Index(L.TEMPLATES, L.word_weights(df, L.TEMPLATES))
    assert rows_of(found.select(*found.columns[:7])) == sorted(
        brute(rows[:-1], index) + [(1000, 40_002, 1, 40_000, 40_000, "cc-by", "cc-by")], key=str)
    for x in found.collect():
        assert 0 <= x.score <= 1 and (x.score > 0) == (x.labels != "")
    assert L.scan(df.limit(0)).count() == 0


def test_whole_templates_score_higher(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "see apache license version 2 0 somewhere")]
    score = {x.doc_id: x.score for x in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert score[1] == 1.0 and 0.3 < score[2] < 1.0


def test_edited_licences_keep_their_label(spark):
    def opening(label):
        return max((t.words for t in L.TEMPLATES if t.label == label), key=len)

    mit, bsd, apache = (" ".join(opening(x).split()) for x in ("mit", "bsd", "apache-2.0"))
    edits = [("mit", mit.replace("free of charge", "at no charge")), ("mit", mit.replace("permission is hereby granted free of charge to any", "any")),
             ("mit", mit.replace("merge publish", "merge and publish")), ("bsd", bsd.replace("source and binary", "source or binary")),
             ("bsd", bsd[:bsd.index("redistributions in binary")]), ("apache-2.0", apache.replace("version 2 0 the license", "2 0")),
             ("apache-2.0", apache[apache.index("unless required"):])]
    rows = [(i, "some words before " + text + " and after") for i, (_, text) in enumerate(edits)]
    rows += [(100, mit), (101, "to any person a copy of the software without limitation the rights to use " * 20),
             (102, " ".join(reversed(mit.split()))), (103, "permission is hereby granted for the picnic on the software lawn")]
    found = {x.doc_id: x for x in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(edits):
        assert label in found[i].labels.split(","), edits[i]
    # of an edited opening the best match is below that of a whole one
    long = [t for t in L.TEMPLATES if t.words.split() == mit.split()]
    alone = {x.doc_id: x.score for x in L.scan(spark.createDataFrame(rows, "doc_id long, text string"), long).collect()}
    assert alone[100] == 1.0 and 0 < alone[0] < 1 and 0 < alone[1] < 1 and 0 < alone[2] < 1
    assert all(found[i].labels == "" and found[i].score == 0 for i in (101, 102, 103))


def test_words_of_the_text_before_do_not_hide_a_key_phrase():
    words = L.C.Words([b"released x", b"the mit license"], L.C.ALNUM_TABLE)
    template = [t for t in L.TEMPLATES if t.words == "released under the mit license"]
    for first in (False, True):  # the order of the index must not matter
        index = L.Index(template, dict.fromkeys(template[0].split(), 1.0))
        index.postings = dict(sorted(index.postings.items(), key=lambda x: (index.vocabulary[x[0]] == "released") != first))
        ids = index.ids(words.hash)
        (_, at, score), = index.matches(ids, words.first)
        assert at.tolist() == [2] and np.allclose(score, 0.6)
