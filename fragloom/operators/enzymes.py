"""Restriction enzymes: sites, digestion, inference and chain coordinates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kmers import both_strands

# Names and cut sites of the enzymes.
CATALOGUE = {"DpnII": "^GATC", "HindIII": "A^AGCTT", "NcoI": "C^CATGG", "NlaIII": "CATG^"}
LONGEST = 6


@dataclass(frozen=True)
class Enzyme:
    motif: str
    cut: int


def parse(site: str) -> Enzyme:
    """An enzyme from its site with ^ where it cuts: ACGT only, at most six bases, equal to its reverse complement."""
    if site.count("^") != 1:
        raise ValueError(f"{site}: one ^ must mark the cut")
    motif = site.replace("^", "").upper()
    if not re.fullmatch(f"[ACGT]{{1,{LONGEST}}}", motif):
        raise ValueError(f"{site}: 1 to {LONGEST} of ACGT")
    if motif[::-1].translate(str.maketrans("ACGT", "TGCA")) != motif:
        raise ValueError(f"{site}: not its own reverse complement")
    return Enzyme(motif, site.index("^"))


def site_offsets(seq: str, enzyme: Enzyme) -> np.ndarray:
    """Offsets of the motif, without one at 0 and one that ends on the last base (neither is scanned)."""
    found = np.array([m.start() for m in re.finditer(f"(?={enzyme.motif})", seq)], np.int64)
    return found[(found >= 1) & (found + len(enzyme.motif) < len(seq))]


def loci(seqs: DataFrame, enzyme: Enzyme, *keys: str, ends: bool = True) -> DataFrame:
    """(keys, locus): 0, the sites, length and length + 1 of each sequence (ends=False: the sites alone).

    A scan in Arrow batches: SQL's substring walks a string from its start each time.
    """
    kinds = ", ".join(f"{k} {seqs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = []
            for seq in batch.column("seq").to_pylist():
                own = site_offsets(seq or "", enzyme)
                found.append(np.concatenate([[0], own, [len(seq or ""), len(seq or "") + 1]]).astype(np.int64) if ends else own)
            index = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in keys), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], [*keys, "locus"])

    return seqs.select(*keys, "seq").mapInArrow(run, f"{kinds}, locus long")


def read_loci(reads: DataFrame, enzyme: Enzyme, key: str = "qid") -> DataFrame:
    """Loci of both strands of reads."""
    return loci(both_strands(reads), enzyme, key, "strand")


def digest(seqs: DataFrame, enzyme: Enzyme, key: str) -> DataFrame:
    """(key, start, stop): the pieces between neighbouring loci up to the end."""
    w = Window.partitionBy(key).orderBy("locus")
    cuts = loci(seqs, enzyme, key).select(key, F.col("locus").alias("start"), F.lead("locus").over(w).alias("stop"), F.max("locus").over(Window.partitionBy(key)).alias("_n"))
    return cuts.where("stop < _n").drop("_n")


def nearby(queries: DataFrame, sites: DataFrame, key: str, at: str, within: int = 30) -> DataFrame:
    """Sites at most `within` from `at`, by a join on bins of a locus."""
    width = 4 * within
    left = queries.withColumn("_bin", F.explode(F.sequence(F.floor((F.col(at) - within) / width), F.floor((F.col(at) + within) / width))))
    right = sites.withColumn("_bin", F.floor(F.col("locus") / width))
    return left.join(right, [key, "_bin"]).where(F.abs(F.col("locus") - F.col(at)) <= within).drop("_bin")


def site_pairs(hits: DataFrame, read_sites: DataFrame, ref_sites: DataFrame, hit: str, read: str, ref: str, start: bool = True, within: int = 30, shift: int = 50, slope: float = 0.2) -> DataFrame:
    """(hit, q, s): pairs of a read's and a reference's site where a hit (qoff, qend, soff, send) may start, or end.

    Sites lie `within` of the hit's own start (end) and before (after) its other end; the parts from the two sites to there
    differ by `shift` and `slope` at most. Sites: (read or ref, locus). Each side is a band join; the pairs are an equal join on the hit,
    with as many rows as sites of both sides that are near one end.
    """
    q, s, far_q, far_s = ("qoff", "soff", "qend", "send") if start else ("qend", "send", "qoff", "soff")
    inner = lambda far: F.col("locus") < F.col(far) if start else F.col("locus") > F.col(far)
    own = nearby(hits, read_sites, read, q, within).where(inner(far_q)).select(hit, F.col("locus").alias("q"), F.abs(F.col(far_q) - F.col("locus")).alias("_q"))
    other = nearby(hits, ref_sites, ref, s, within).where(inner(far_s)).select(hit, F.col("locus").alias("s"), F.abs(F.col(far_s) - F.col("locus")).alias("_s"))
    alike = (F.abs(F.col("_q") - F.col("_s")) <= shift) & (F.abs(1 - F.col("_q") / F.col("_s")) <= slope)
    return own.join(other, hit).where(alike).select(hit, "q", "s")


def bounded_index(at: Column, sorted_loci: Column) -> Column:
    """The largest i with loci[i] <= at, and size - 3 at most (the last two loci are the end's)."""
    below = F.size(F.filter(sorted_loci, lambda x: x <= at)) - 1
    return F.greatest(F.lit(0), F.least(below, F.size(sorted_loci) - 3))


def top_hits(hits: DataFrame, read: str = "qid", most: int = 3) -> DataFrame:
    """The hits of each read with the greatest scores; ties go to the smaller reference place."""
    w = Window.partitionBy(read).orderBy(F.desc("score"), "sid", "sbeg", "qbeg", "strand")
    return hits.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def winner(counted: DataFrame) -> DataFrame:
    """One row (enzyme): the enzyme of (enzyme, n) whose count is over twice the second's, else null."""
    w = Window.orderBy(F.desc("n"), "enzyme")  # a row for each enzyme of the catalogue
    ranked = counted.select("enzyme", "n", F.row_number().over(w).alias("k"))
    best, second = F.max(F.when(F.col("k") == 1, F.col("n"))), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("n"))), F.lit(0))
    return ranked.agg(F.when(best > 2 * second, F.max(F.when(F.col("k") == 1, F.col("enzyme")))).alias("enzyme"), best.alias("best"), second.alias("second"))


def chain_flags(hits: DataFrame, size: int) -> DataFrame:
    """Alignments (qdir, qoff, qend, qsize, soff, send, enzyme_qoff, enzyme_qend, enzyme_soff, enzyme_send) with their chain coordinates and flags.

    A side is perfect if read and reference end on the site there, pseudo-perfect if one of them does. On the reverse strand
    sides change places, and ends at a site move by the enzyme's size.
    """
    lq, ls = F.col("qoff") == F.col("enzyme_qoff"), F.col("soff") == F.col("enzyme_soff")
    rq, rs = F.col("qend") == F.col("enzyme_qend"), F.col("send") == F.col("enzyme_send")
    forward = F.col("qdir") == 0
    l_both, r_both, l_any, r_any = lq & ls, rq & rs, lq | ls, rq | rs
    shift = lambda at_site: F.when(at_site, F.lit(size)).otherwise(F.lit(0))
    return hits.withColumns(
        {
            "lp": F.when(forward, l_both).otherwise(r_both), "rp": F.when(forward, r_both).otherwise(l_both),
            "lpp": F.when(forward, l_any).otherwise(r_any), "rpp": F.when(forward, r_any).otherwise(l_any),
            "is_perfect": l_both & r_both, "is_pseudo_perfect": l_any & r_any,
            "chain_qoff": F.when(forward, F.col("qoff")).otherwise(F.col("qsize") - F.col("qend") - shift(rq)),
            "chain_qend": F.when(forward, F.col("qend")).otherwise(F.col("qsize") - F.col("qoff") - shift(lq)),
        }
    )
