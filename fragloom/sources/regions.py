"""A position index: which files hold which places of a chromosome, so that a region is read from the files that it lies in.

Rows in order of place over range partitions (`writers.sorted_by_place`) make files of a short span each; the index has a row
for each file and chromosome.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "path string, chromosome string, first long, last long, rows long"


def index_of(rows: DataFrame, path: Column | str, chromosome: str, start: Column | str, stop: Column | str) -> DataFrame:
    """INDEX of rows with the path of the file that each was read from: the least start and the greatest stop (exclusive) in it."""
    path, start, stop = (F.col(x) if isinstance(x, str) else x for x in (path, start, stop))
    named = rows.select(path.alias("path"), F.col(chromosome).cast("string").alias("chromosome"), start.cast("long").alias("first"), stop.cast("long").alias("last"))
    return named.groupBy("path", "chromosome").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("rows"))


def files_of(index: DataFrame, chromosome: str, start: int, stop: int) -> list[str]:
    """The files that may hold rows of [start, stop): names of files alone reach the driver."""
    hit = index.where((F.col("chromosome") == str(chromosome)) & (F.col("first") < stop) & (F.col("last") > start))
    return sorted(r.path for r in hit.select("path").distinct().collect())


def read_region(spark: SparkSession, index: DataFrame, read: Callable[[SparkSession, list[str]], DataFrame], chromosome: str, at: str, begin: Column | str, end: Column | str, start: int, stop: int) -> DataFrame:
    """Rows that overlap [start, stop) of a chromosome (column `at`), by `read` from the files that the index names; where it names none, no
    rows of any file. An index without files is an error."""
    files = files_of(index, chromosome, start, stop)
    begin, end = (F.col(x) if isinstance(x, str) else x for x in (begin, end))
    if not files:
        some = index.agg(F.min("path")).first()[0]
        if some is None:
            raise ValueError("the index has no files")
        return read(spark, [some]).limit(0)
    return read(spark, files).where((F.col(at).cast("string") == str(chromosome)) & (begin < stop) & (end > start))


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that a CIGAR takes."""
    runs = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))


def read_parquet(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.parquet(*files)
