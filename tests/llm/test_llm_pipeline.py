import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as CP
from conftest import SF0001, SF001
from helpers import SPACE, lower
from plume.llm import queries
from plume.sources.tables import TABLES, table_path
from test_llm_decontaminate import brute as hits
from test_llm_pii import PLAIN, find
from test_llm_simhash import groups, print_of


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF0001, t)}')")
    res = con.execute(queries.ORACLES[key])
    columns = [d[0] for d in res.description]
    df = queries.QUERIES[key](spark, SF0001)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(res.fetchall(), key=str)


def test_registered():
    keys = E.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in keys if k.startswith("op")}
    assert "pipeline" in keys and len(CP.STAGES) == 5


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").select("item_id", "text").collect()]
    frames = [docs]
    for i, (_, stage) in enumerate(CP.STAGES):
        stage(spark, frames[-1], SF0001).write.parquet(str(tmp_path / str(i)))
        frames.append(spark.read.parquet(str(tmp_path / str(i))))
    for before, after in zip(frames[:4], frames[1:5]):
        assert after.columns == before.columns == docs.columns
    texts = [{r.doc_id: r.text for r in f.collect()} for f in frames]
    # 3: the smallest doc_id of each group of near fingerprints
    ids = sorted(texts[1])
    least = groups([print_of(texts[1][d]) for d in ids], 3)
    assert set(texts[2]) == {ids[i] for i in set(least)}
    # 1: no benchmark window is left, texts without one are as they were
    for row in hits([(d, t) for d, t in texts[2].items()], items, 10):
        if row[2] == 0:
            assert texts[3][row[0]] == texts[2][row[0]]
    assert all(r[2] == 0 for r in hits(list(texts[3].items()), items, 10))
    # 8: no span is left
    assert not any(list(find(k, t or "")) for t in texts[4].values() for k in PLAIN)
    # 6: the words taken are those of the budget
    last = frames[5]
    size = sum(len(SPACE.findall(t or "")) for t in texts[4].values())
    taken = last.agg(F.sum("taken")).first()[0]
    assert size - len({r.source for r in docs.collect()}) * 3 <= taken <= size
    assert set(texts[5]) <= set(texts[4])
    assert last.filter(F.col("n_chars") != F.length("text")).count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    kept = CP.STAGES[0][1](spark, docs, SF001)
    clean = docs.join(labels.filter("quality = 1 AND toxic = 0"), "doc_id")
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.01 * clean.count()
    assert lower("AbÉ") == "abÉ"


def test_empty_table_and_odd_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, Score int, key int, taken string, slot int"
    rows = [(None, None, None, None, None, "a", 1, 2, "t", 3), (1, "", "en", "s", 0, "a", 1, 2, "t", 3),
            (2, "A calm line of words that says little but says it well.", "en", "s", 9, "a", 1, 2, "t", 3),
            (2, "A calm line of words that says little but says it well.", "en", "s", 9, "a", 1, 2, "t", 3)]
    for name, data in (("none", []), ("odd", rows)):
        docs = spark.createDataFrame(data, schema)
        for i, (_, stage) in enumerate(CP.STAGES):
            path = str(tmp_path / f"{name}{i}")
            stage(spark, docs, SF0001).write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns[:10] == [c.split()[0] for c in schema.split(", ")]
        assert docs.count() <= len(data)
