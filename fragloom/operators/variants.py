"""Phased heterozygous SNPs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def phased_het(vcf: DataFrame) -> DataFrame:
    """(chrom, pos0, ref, alt, phase_set, gt0, gt1) of VCF records (chrom, pos, ref, alt, filter, format, sample) that are SNPs of
    two single-base alleles, phased 0|1 or 1|0, in a phase set. pos0 counts from 0."""
    keys, values = F.split("format", ":"), F.split("sample", ":")
    value = lambda k: F.try_element_at(values, F.array_position(keys, k).cast("int"))
    known = lambda k: F.when(F.array_position(keys, k) > 0, value(k))
    rows = vcf.withColumns({"_gt": known("GT"), "_ps": known("PS")})
    snp = F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$")
    rows = rows.where(snp & F.col("_gt").isin("0|1", "1|0") & F.col("_ps").isNotNull() & ~F.col("_ps").isin("", "."))
    return rows.select(
        "chrom", (F.col("pos") - 1).alias("pos0"), "ref", "alt", F.col("_ps").alias("phase_set"), F.substring("_gt", 1, 1).cast("long").alias("gt0"), F.substring("_gt", 3, 1).cast("long").alias("gt1")
    )


def phase_set_ids(snps: DataFrame) -> DataFrame:
    """Phase-set names of each chromosome as dense numbers, in order of their first place (sets on one chromosome are few)."""
    first = snps.groupBy("sid", "phase_set").agg(F.min("soff").alias("at"))
    return first.select("sid", "phase_set", (F.row_number().over(Window.partitionBy("sid").orderBy("at", "phase_set")) - 1).alias("ps"))


def most_variants(snps: DataFrame) -> DataFrame:
    """SNPs of the phase set with the most SNPs on each chromosome; of equal ones the smallest."""
    n = snps.groupBy("sid", "phase_set").agg(F.count("*").alias("n"))
    best = n.groupBy("sid").agg(F.min_by("phase_set", F.struct(-F.col("n"), "phase_set")).alias("phase_set"))
    return snps.join(best, ["sid", "phase_set"], "left_semi")


def with_rank(snps: DataFrame) -> DataFrame:
    return snps.withColumn("rank", F.row_number().over(Window.partitionBy("sid").orderBy("soff")))
