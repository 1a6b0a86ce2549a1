"""The engine's relations over the driver's tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def frags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragment haplotypes: a line item is a fragment of the read that its order stands for."""
    by = Window.partitionBy("l_orderkey").orderBy(
        "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linestatus"
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("read_id"),
        (F.row_number().over(by) - 1).cast("long").alias("frag_id"),
        (F.col("l_suppkey") % 5).alias("subject_id"),
        (F.col("l_partkey") % 2000 * 50000).alias("subject_offset"),
        (F.col("l_quantity") * 20).cast("long").alias("frag_size"),
        F.col("l_quantity").cast("long").alias("mapq"),
        F.round(100 - 200 * F.col("l_discount"), 6).alias("identity"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0).cast("long").alias("hp"),
        F.col("l_linestatus").alias("status"),
    )


FRAGS = """frags as (select l_orderkey read_id,
 cast(row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax, l_discount, l_returnflag, l_linestatus) - 1 as bigint) frag_id,
 l_suppkey % 5 subject_id, l_partkey % 2000 * 50000 subject_offset, cast(floor(l_quantity * 20) as bigint) frag_size, cast(floor(l_quantity) as bigint) mapq,
 round(100 - 200 * l_discount, 6) "identity", cast(case l_returnflag when 'A' then 1 when 'R' then 2 else 0 end as bigint) hp, l_linestatus status from lineitem)"""


def genome(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """(sid, seq): the letters of each text as bases; reads are made of the benchmark's texts in the same way."""
    key = "doc_id" if name == "documents" else "item_id"
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return table(spark, sf_dir, name).select(F.col(key).alias("sid"), F.translate(letters, _LETTERS, _BASES).alias("seq"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genome(spark, sf_dir, "benchmark").withColumnRenamed("sid", "qid")


def _encoded(key: str, to: str, name: str) -> str:
    return f"select {key} {to}, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_LETTERS}', '{_BASES}') seq from {name}"


GENOME, READS = f"genome as ({_encoded('doc_id', 'sid', 'documents')})", f"reads as ({_encoded('item_id', 'qid', 'benchmark')})"


def snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phased heterozygous SNPs: a part, whose brand is the phase set and whose size gives the phase."""
    even = F.col("p_size") % 2 == 0
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 5).alias("sid"),
        (F.col("p_partkey") % 2000 * 50000 + F.col("p_size")).alias("soff"),
        F.col("p_brand").alias("phase_set"),
        F.when(even, 0).otherwise(1).cast("long").alias("gt0"),
        F.when(even, 1).otherwise(0).cast("long").alias("gt1"),
    )


SNPS = """snps as (select p_partkey % 5 sid, p_partkey % 2000 * 50000 + p_size soff, p_brand phase_set, cast(case when p_size % 2 = 0 then 0 else 1 end as bigint) gt0,
 cast(case when p_size % 2 = 0 then 1 else 0 end as bigint) gt1 from part)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chr, start, stop): an event is an interval of its user's chromosome, from its second on."""
    start = F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("chr"), start.alias("start"), (start + 1 + F.floor(F.col("value") * 60)).alias("stop"))


INTERVALS = "intervals as (select user_id chr, cast(floor(epoch(ts)) as bigint) \"start\", cast(floor(epoch(ts)) as bigint) + 1 + cast(floor(value * 60) as bigint) stop from events)"
