"""Large lexicons: the automaton equals one substring test per term."""

import random

from plume.functions.automaton import Automaton, LANE, parts, table_bytes
from plume.operators import lexicon as X


def _words(r, n, alphabet, longest):
    return sorted({"".join(r.choice(alphabet) for _ in range(r.randint(1, longest))) for _ in range(n)})


def test_hits_against_substring_tests():
    r = random.Random(1)
    for alphabet, longest in (("ab", 6), ("abcé中🙂 ", 4), ("ab", 40)):
        terms = _words(r, 60, alphabet, longest)
        texts = ["".join(r.choice(alphabet + "xé") for _ in range(r.choice([0, 1, 30, LANE, LANE + 1, 3 * LANE + 5]))) for _ in range(40)]
        found = Automaton(terms).hits(texts)
        assert [[terms[i] for i in f] for f in found] == [[t for t in terms if t in text] for text in texts]


def test_terms_across_lanes_are_found_once():
    term = "x" * 100 + "y"
    for at in range(LANE - 102, LANE + 3):
        text = "a" * at + term + "a" * 300
        assert [f.tolist() for f in Automaton([term, "xy"]).hits([text, text + text])] == [[0, 1], [0, 1]]


def test_table_bound_and_parts():
    r = random.Random(2)
    terms = _words(r, 3000, "abcdefghijklmnop", 12)
    assert Automaton(terms).size <= table_bytes(terms)
    cut = list(parts(terms, 100_000))
    assert [t for p in cut for t in p] == terms and len(cut) > 3
    assert all(Automaton(p).size <= 100_000 for p in cut)


def test_lexicon_hits_over_rows(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, "", "".join(r.choice("abcABC é\n") for _ in range(r.randint(1, 600)))])) for i in range(200)]
    rows += rows[:10] + [(None, "abc " * 200_000)]
    df = spark.createDataFrame(rows, "row_id long, textOriginal string").selectExpr("*", "1 AS hits", "2 AS text").repartition(3)
    raw = [*_words(r, 400, "abc é", 5), "ABC", "", None]
    terms = X.lexicon_terms(spark.createDataFrame([(t,) for t in raw], "term string"))
    assert terms == sorted({t.lower() for t in raw if t})
    expected = sorted(((i, [t for t in terms if t in (text or "").lower()]) for i, text in rows), key=str)
    for limit in (X.TABLE_LIMIT, 4_000):
        out = X.lexicon_hits(df, terms, limit=limit)
        assert out.columns == ["row_id", "hits"]
        assert sorted(map(tuple, out.collect()), key=str) == expected
    assert X.lexicon_hits(df, []).filter("size(hits) > 0").isEmpty()
    assert X.lexicon_hits(df.limit(0), terms).isEmpty()
