"""The indexed search equals the plain one and reads fewer files."""

import random

from pyspark.sql import functions as F

from plume.operators.explorer import explorer_search
from plume.operators.search_index import SearchIndex


def test_indexed_search_equals_the_plain_one(spark, scratch):
    r = random.Random(1)
    words = ["Angel", "gel", "élan", "a.b*c", "中文字", "🙂x", "tab\tx", "new\nline", "ÀÉ", '"q"']
    rows = [(i, r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randint(0, 6)))]), r.choice(["north", "SOUTH", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, text string, place string").withColumn("a.dot", F.lit("dotted")).drop("a.dot")
    index = SearchIndex(spark, scratch)
    index.build(df, rows_per_file=20)
    for term in ["GEL", "angel e", "a.b*", "中文字", "🙂x", "w\nl", "à", "é", "", "south", "nowhere at all", '"Q"', "b tab"]:
        key = lambda d: sorted(tuple(x) for x in d.select("row_id").collect())
        assert key(index.search(term)) == key(explorer_search(df, term)), term
        assert key(index.search(term, ["place"])) == key(explorer_search(df, term, ["place"])), term


def test_files_without_the_term_are_not_read(spark, scratch):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.concat(F.lit("comment number "), F.lpad("id", 6, "0")).alias("text"))
    index = SearchIndex(spark, scratch)
    index.build(df.repartition(1).sortWithinPartitions("row_id"), rows_per_file=50)
    assert len(index.rows().inputFiles()) == 20
    found = index.candidates("number 000777")
    assert len(found.inputFiles()) <= 4
    assert [x.row_id for x in index.search("NUMBER 000777").collect()] == [777]
    assert index.candidates("xyz").isEmpty() and len(index.candidates("nu").inputFiles()) == 20
