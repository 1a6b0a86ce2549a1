"""Micro-batch ingest of read files: an extension, in place of a loop over batches of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.kmers import normalised

SCHEMA = "name string, seq string, qual string"


def fastq_stream(spark: SparkSession, folder: str, files: int = 16) -> DataFrame:
    """(name, seq, qual) of FASTQ files as they arrive in a folder, each read whole; `files` at most in a batch."""
    texts = spark.readStream.schema("value string").option("maxFilesPerTrigger", files).text(folder, wholetext=True)
    lines = texts.select(F.split(F.rtrim("value"), "\n").alias("l"))
    record = F.explode(F.sequence(F.lit(0), F.floor(F.size("l") / 4).cast("int") - 1))
    rows = lines.where(F.size("l") >= 4).select("l", record.alias("i"))
    at = lambda k: F.element_at("l", F.col("i") * 4 + k + 1)
    return rows.select(F.regexp_extract(at(0), r"^@(\S*)", 1).alias("name"), normalised(at(1)).alias("seq"), at(3).alias("qual"))


def each_batch(reads: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs `work(batch, number)` on each batch; a restarted query goes on where it was."""
    out = reads.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def up_to(reads: DataFrame, bases: int, done: int = 0) -> DataFrame:
    """The batch, or none of it once `done` bases have been seen: the limit stops after the batch that reaches it."""
    return reads if done < bases else reads.limit(0)
