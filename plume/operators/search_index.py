"""Free-text search with an index of character triples.

A plain search reads and lower-cases every text.  Here the table is written
once in files of equal size, and beside it, for every triple of neighbouring
characters (lower case, all string columns), the files that hold it.  A search
intersects the postings of the term's triples and reads the files that hold all
of them; the exact test of the plain search follows, so the result is the same.
Terms of fewer than three characters read every file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import ROWS_PER_FILE, write_parquet_exact
from .explorer import explorer_search


class SearchIndex:
    """A searchable copy of a table below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, df: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> None:
        """Write the rows and the postings (triple, file), the latter in order
        of the triple, so a search reads few of them."""
        write_parquet_exact(df, f"{self.path}/rows", rows_per_file)
        rows = self.rows()
        texts = [F.lower(F.col(f"`{f.name}`")) for f in rows.schema.fields if f.dataType.simpleString() == "string"]
        # every triple, overlapping ones too, in one pass over the text
        triples = F.regexp_extract_all(F.concat_ws("\n", *texts), F.lit("(?s)(?=(...))"), F.lit(1))
        (rows.select(F.col("_metadata.file_name").alias("file"), F.explode(F.array_distinct(triples)).alias("triple"))
         .distinct().repartitionByRange("triple").sortWithinPartitions("triple")
         .write.mode("overwrite").parquet(f"{self.path}/postings"))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def candidates(self, term: str) -> DataFrame:
        """The rows of the files that hold every triple of the term."""
        needle = term.lower()
        triples = sorted({needle[i:i + 3] for i in range(len(needle) - 2)})
        if not triples:
            return self.rows()
        postings = self.spark.read.parquet(f"{self.path}/postings").filter(F.col("triple").isin(triples))
        held = postings.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(triples))
        files = [r.file for r in held.select("file").collect()]  # of the table's files, which the driver lists anyway
        if not files:
            return self.rows().limit(0)
        return self.spark.read.parquet(*(f"{self.path}/rows/{f}" for f in sorted(files)))

    def search(self, term: str, columns: list[str] | None = None) -> DataFrame:
        """The rows in which some string column (of ``columns``) holds the term,
        whatever its case."""
        return explorer_search(self.candidates(term), term, columns)
