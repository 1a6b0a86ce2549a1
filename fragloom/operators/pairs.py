"""Pairs of fragments for other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALLELES = ("both-ref", "ref", "alt")


def ashic(frags: DataFrame, mapq: int = 0) -> DataFrame:
    """(read_id, offset1, allele1, offset2, allele2): the first fragment of each read with each other one, both of that mapq."""
    w = Window.partitionBy("read_id").orderBy("frag_id")
    rows = frags.withColumns({"_first": F.first(F.struct("frag_id", "subject_offset", "hp", "mapq")).over(w)})
    name = lambda hp: F.element_at(F.array(*map(F.lit, ALLELES)), (hp + 1).cast("int"))
    rows = rows.where((F.col("frag_id") != F.col("_first.frag_id")) & (F.col("mapq") >= mapq) & (F.col("_first.mapq") >= mapq))
    return rows.select("read_id", F.col("_first.subject_offset").alias("offset1"), name(F.col("_first.hp")).alias("allele1"), F.col("subject_offset").alias("offset2"), name(F.col("hp")).alias("allele2"))


def hic(frags: DataFrame) -> DataFrame:
    """Variant fragments (read_id, subject_id, subject_offset, frag_id, n_blocks, name, blocks, quals) as paired lines.

    blocks: the text of the variant blocks. A read's only fragment on a chromosome is a line of its own (mate and insert -1);
    else each pair is one line in order of offsets: blocks and qualities one after another, sites summed, and the name of the
    fragment that comes first on the read with the last three characters of the other's.
    """
    key = ["read_id", "subject_id"]
    n = F.count("*").over(Window.partitionBy(*key))
    rows = frags.withColumn("_n", n)
    line = lambda *c: F.concat_ws(" ", *c).alias("line")
    alone = rows.where("_n = 1").select(*key, line(F.col("n_blocks"), "name", F.lit("1"), F.lit("-1"), F.lit("-1"), "blocks", "quals"))
    cols = ("subject_offset", "n_blocks", "name", "blocks", "quals")
    a = rows.where("_n > 1").select(*key, "frag_id", *cols)
    b = a.select(*key, *(F.col(c).alias(f"{c}2") for c in ("frag_id", *cols)))
    pairs = a.join(b, key).where("frag_id < frag_id2")
    first = F.col("subject_offset") < F.col("subject_offset2")
    pick = lambda c, yes=True: F.when(first, F.col(c if yes else f"{c}2")).otherwise(F.col(f"{c}2" if yes else c))
    mate = F.split(pick("blocks", False), " ").getItem(0)
    name = F.concat(F.col("name"), F.lit("-"), F.expr("right(name2, 3)"))
    paired = pairs.select(
        *key,
        line(F.col("n_blocks") + F.col("n_blocks2"), name, F.lit("1"), mate, F.abs(F.col("subject_offset") - F.col("subject_offset2")), pick("blocks"), pick("blocks", False), F.concat(pick("quals"), pick("quals", False))),
    )
    return alone.unionByName(paired)


def overlapping_variants(frags: DataFrame) -> DataFrame:
    """Pairs whose variants are out of order (first_var, last_var): the earlier fragment's last is not before the later's first. Must be empty."""
    key = ["read_id", "subject_id"]
    a = frags.select(*key, "frag_id", "subject_offset", "first_var", "last_var")
    b = a.select(*key, *(F.col(c).alias(f"{c}2") for c in ("frag_id", "subject_offset", "first_var", "last_var")))
    pairs = a.join(b, key).where("frag_id < frag_id2")
    return pairs.where(F.when(F.col("subject_offset") < F.col("subject_offset2"), F.col("last_var") >= F.col("first_var2")).otherwise(F.col("last_var2") >= F.col("first_var")))
