"""The mapper as a plan: seeds by joins, chains and alignments by Arrow functions over the reads in order, qualities and names by expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kmers
from ..operators import mapping as M
from ..operators.enzymes import CATALOGUE, Enzyme, parse, top_hits
from ..operators.pieces import pieces as parts_of
from ..operators.scans import streamed
from ..sources.scratch import written
from ..sources.writers import cigar

#: Bases of a piece of the reference; a chromosome is a row for each piece, and never one value.
PIECE = 20_000

CANDIDATE = "qid long, sid long, strand int, qbeg int, qend int, sbeg long, send long, seeds int"
FRAGMENT = (
    "read_id long, frag_id int, qdir int, qsize int, fwd_qoff int, fwd_qend int, subject_id long, ssize long, soff long, send long, enzyme_qoff int, enzyme_qend int, enzyme_soff long, enzyme_send long,"
    " matches int, length int, pi double, mapq int, kind string, sa string, q_row string, s_row string, cigar string, frag_cigar string, frag_seq string"
)


def pieces(genome: DataFrame, size: int = PIECE) -> DataFrame:
    """(sid, piece, start, seq, ssize) of (sid, seq)."""
    return parts_of(genome, size).select("sid", "piece", "start", F.col("part").alias("seq"), F.col("length").alias("ssize"))


def candidates(seeds: DataFrame, reads: DataFrame, k: int, options: M.Options = M.Options()) -> DataFrame:
    """Chains of seeds (qid, strand, sid, qoff, soff), on the read's strand. Reads stream by in order, each led by a row with its length."""
    whole = lambda c, t="long": F.col(c).cast(t).alias(c)
    found = seeds.select(whole("qid"), F.lit(1).alias("kind"), whole("sid"), whole("strand", "int"), whole("qoff"), whole("soff"))
    none = F.lit(0).cast("long")
    lengths = reads.select(whole("qid"), F.lit(0).alias("kind"), none.alias("sid"), F.lit(0).alias("strand"), F.length("seq").cast("long").alias("qoff"), none.alias("soff"))

    def chained(table: pa.Table) -> list[tuple]:
        kind, sid, strand, q, s = (table.column(c).to_numpy() for c in ("kind", "sid", "strand", "qoff", "soff"))
        if kind[0] == 1 or kind[-1] == 0:  # no read, or no seeds
            return []
        lead = int(np.searchsorted(kind, 1))
        cuts = [lead, *(np.flatnonzero((sid[1:] != sid[:-1]) | (strand[1:] != strand[:-1])) + 1).tolist(), len(sid)]
        qid, size, out = table.column("qid")[0].as_py(), int(q[0]), []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lead <= lo < hi:
                out += [(qid, int(sid[lo]), int(strand[lo]), *hit) for hit in M.chain_seeds(q[lo:hi], s[lo:hi], k, size, options)]
        return out

    return streamed(found.unionByName(lengths), "qid", ["kind", "sid", "strand"], chained, CANDIDATE)


def ranked_chromosomes(chains: DataFrame) -> DataFrame:
    """(qid, sid, score, place): chromosomes of each read by their best chain."""
    from pyspark.sql import Window

    best = chains.groupBy("qid", "sid").agg(F.max("seeds").alias("score"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "sid")))


def alignments(chains: DataFrame, reads: DataFrame, genome: DataFrame, enzyme: Enzyme | None, options: M.Options = M.Options(), choose: bool = True) -> DataFrame:
    """FRAGMENT rows of each read, from its chains and the pieces of the reference around them; without a choice a row for each chain
    that extends to an alignment. Chains are written once; reads stream by in order, each with its chains and pieces."""
    chains, parts = written(chains, "chains"), pieces(genome)
    reach = F.col("qsize") + options.pad + options.tail
    wide = chains.join(reads.select("qid", F.length("seq").alias("qsize")), "qid")
    asked = wide.select("qid", "sid", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("sbeg") - reach) / PIECE)).cast("int"), F.floor((F.col("send") + reach) / PIECE).cast("int"))).alias("piece")).distinct()
    near = asked.join(parts, ["sid", "piece"]).select("qid", "sid", "start", "seq", "ssize")
    empty = lambda df, names: df.select("qid", *(F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in names))
    names = [("kind", "int"), ("sid", "long"), ("strand", "int"), ("qbeg", "int"), ("qend", "int"), ("sbeg", "long"), ("send", "long"), ("seeds", "int"), ("start", "long"), ("seq", "string"), ("ssize", "long")]
    rows = (
        empty(chains.withColumn("kind", F.lit(1)), names)
        .unionByName(empty(near.withColumn("kind", F.lit(2)), names))
        .unionByName(empty(reads.join(chains.select("qid").distinct(), "qid", "left_semi").select("qid", F.lit(0).alias("kind"), "seq"), names))
    )

    def aligned(table: pa.Table) -> list[tuple]:
        lo, hi = np.searchsorted(table.column("kind").to_numpy(), (1, 2)).tolist()
        read = table.column("seq")[0].as_py() if lo else None
        if read is None:
            return []
        own = table.slice(lo, hi - lo).select(["sid", "strand", "qbeg", "qend", "sbeg", "send", "seeds"]).to_pydict()
        hits = [(sid, strand, tuple(hit)) for sid, strand, *hit in zip(*own.values(), strict=True)]
        near = table.slice(hi).select(["sid", "start", "seq", "ssize"]).to_pydict()
        sizes = dict(zip(near["sid"], near["ssize"], strict=True))
        ref = M.Reference(list(zip(near["sid"], near["start"], near["seq"], strict=True)), sizes)
        strands = (read, M.reverse(read))
        if choose:
            chain, found, kind = M.map_read(read, hits, ref, enzyme, options)
        else:
            chain, found, kind = [x for sid, d, hit in hits if (x := M.extend(hit, strands[d], ref, d, sid, options))], [], "hit"
        qid, out = table.column("qid")[0].as_py(), []
        for i, x in enumerate(sorted(chain, key=lambda x: x.span)):
            y = found[x.other] if 0 <= x.other < len(found) else None
            sa = f"{'+-'[y.qdir]}:{y.span[0]}:{y.span[1]}:{y.sid}:{y.soff}:{y.send}:{y.pi:.4f}" if y else None
            same = int((np.frombuffer(x.a.encode(), np.uint8) == np.frombuffer(x.b.encode(), np.uint8)).sum())
            out.append(
                (qid, i, x.qdir, x.qsize, *x.span, x.sid, sizes.get(x.sid, 0), x.soff, x.send, *x.eq, *x.es, same, len(x.a), round(x.pi, 6), x.mapq, kind, sa, x.a, x.b,
                 cigar(x.a, x.b, x.qoff, x.qsize - x.qend), cigar(x.a, x.b), strands[x.qdir][x.qoff : x.qend])
            )
        return out

    return streamed(rows, "qid", ["kind", "sid", "strand", "qbeg", "sbeg", "start"], aligned, FRAGMENT)


def map_reads(reads: DataFrame, genome: DataFrame, enzyme: Enzyme | None = None, k: int = 15, stride: int = 4, fraction: float = 1e-4, least: int = 100, options: M.Options = M.Options()) -> DataFrame:
    """Fragments of (qid, seq) reads on a (sid, seq) genome."""
    return alignments(chains_of(reads, genome, k, stride, fraction, least, options), reads, genome, enzyme, options)


def chains_of(reads: DataFrame, genome: DataFrame, k: int = 15, stride: int = 4, fraction: float = 1e-4, least: int = 100, options: M.Options = M.Options()) -> DataFrame:
    """CANDIDATE chains of reads; counts of the genome's k-mers are written once, for the cutoff and for what it keeps."""
    ref = kmers.extract_hashed(genome, "sid", k, stride)
    counted = written(kmers.counts(ref, "hash"), "counts")
    postings = kmers.frequent_removed(ref, counted, kmers.cutoff(counted, fraction, least), "hash")
    return candidates(kmers.seeds(kmers.of_reads(reads, k), postings, "hash"), reads, k, options)


def best_hits(reads: DataFrame, genome: DataFrame, most: int = 3) -> DataFrame:
    """FRAGMENT rows of the `most` chains of each read with the most seeds, each extended on its own, without sites."""
    chains = chains_of(reads, genome).withColumn("score", F.col("seeds"))
    return alignments(top_hits(chains, "qid", most).drop("score"), reads, genome, None, choose=False)


def infer_enzyme(reads: DataFrame, genome: DataFrame, catalogue: dict[str, str] = CATALOGUE, within: int = 30, least: int = 200, most: int = 3) -> DataFrame:
    """(enzyme, n): alignments of the best hits of each read, of `least` bases, whose both ends lie near a site of the enzyme on read and
    reference. `winner` picks one."""
    found = best_hits(reads, genome, most).withColumn("qsize", F.col("qsize").cast("long"))
    strand = F.col("qdir") == 1
    hits = found.join(reads.select(F.col("qid").alias("read_id"), "seq"), "read_id").select(
        F.monotonically_increasing_id().alias("hit"), F.when(strand, kmers.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("qseq"), "subject_id", "ssize", "soff", "send",
        F.when(strand, F.col("qsize") - F.col("fwd_qend")).otherwise(F.col("fwd_qoff")).alias("qbeg"), F.when(strand, F.col("qsize") - F.col("fwd_qoff")).otherwise(F.col("fwd_qend")).alias("qend"),
    )
    wide = within + 8
    around = lambda seq, at: F.substring(seq, F.greatest(F.lit(1), at - wide + 1).cast("int"), (F.least(at, F.lit(wide)) + wide).cast("int"))
    # pieces that overlap by a window on either side hold the bases around any place whole
    parts = parts_of(genome, PIECE, wide, wide).select(F.col("sid").alias("subject_id"), "piece", "start", "part")
    for end in ("soff", "send"):
        hits = hits.withColumn("piece", F.floor(F.least(F.col(end), F.col("ssize") - 1) / PIECE).cast("int")).join(parts, ["subject_id", "piece"])
        hits = hits.withColumn(f"at_{end}", around(F.col("part"), F.col(end) - F.col("start"))).drop("piece", "start", "part")
    there = lambda at, size, text, motif: (at >= least) & (at <= size - least) & (F.instr(text, motif) > 0)
    kinds = []
    for name, site in sorted(catalogue.items()):
        motif = parse(site).motif
        near = lambda text, at, m=motif: F.substring(text, (F.least(at, F.lit(wide)) - within + 1).cast("int"), F.lit(2 * within + len(m)))
        on_read = [there(F.col(c), F.length("qseq"), near(around(F.col("qseq"), F.col(c)), F.col(c)), motif) for c in ("qbeg", "qend")]
        on_ref = [there(F.col(c), F.col("ssize"), near(F.col(f"at_{c}"), F.col(c)), motif) for c in ("soff", "send")]
        good = on_read[0] & on_read[1] & on_ref[0] & on_ref[1] & (F.col("qend") - F.col("qbeg") >= least) & (F.col("send") - F.col("soff") >= least)
        kinds.append(F.struct(F.lit(name).alias("enzyme"), good.cast("long").alias("n")))
    counted = hits.select(F.explode(F.array(*kinds)).alias("e")).groupBy("e.enzyme").agg(F.sum("e.n").alias("n"))
    names = reads.sparkSession.createDataFrame([(n,) for n in sorted(catalogue)], "enzyme string")
    return names.join(F.broadcast(counted), "enzyme", "left").select("enzyme", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # a row for each enzyme


EQUAL = "read_id long, ids array<long>, covered long, chains int, mean_pi double"


def equal_cover(rows: DataFrame, options: M.Options = M.Options()) -> DataFrame:
    """EQUAL of each read of (read_id, id, beg, end, pi): of the chains that cover most of the read, the most identical one (of several,
    that with the smallest ids), and how many were looked at.

    One alignment may follow another if it overlaps it by `overlap` at most and reaches 5 bases beyond its start and end.
    Reads are dealt to calls of many.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("read_id", "end", "beg", "id")])
        read, own, beg, end, pi = (table.column(c).to_numpy() for c in ("read_id", "id", "beg", "end", "pi"))
        cuts = np.append(np.flatnonzero(np.append(True, read[1:] != read[:-1])), len(read)).tolist()
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = beg[lo:hi], end[lo:hi]
            may = (a[None, :] - b[:, None] >= -options.overlap) & (b[None, :] - b[:, None] > 5) & (a[None, :] - a[:, None] > 5)
            found = M.equal_chains(list(zip(a.tolist(), b.tolist(), strict=True)), [np.flatnonzero(x).tolist() for x in may])
            ranked = min((-sum(pi[lo + i] for i in c) / len(c), [int(own[lo + i]) for i in c], c) for c in found)
            spans = [(int(a[i]), int(b[i])) for i in ranked[2]]
            covered = sum(y - x for x, y in spans) - sum(max(0, x[1] - y[0]) for x, y in zip(spans, spans[1:], strict=False))
            out.append((int(read[lo]), ranked[1], covered, len(found), -ranked[0]))
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.float64())
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.table({n.split()[0]: pa.array(c, t) for n, c, t in zip(EQUAL.split(", "), columns, kinds, strict=True)})

    buckets = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.groupBy(F.pmod(F.xxhash64("read_id"), F.lit(buckets)).alias("_bucket")).applyInArrow(lambda t: run(t), EQUAL)


def mapping_quality(rows: DataFrame, group: list[str], pi: str, kind: str) -> DataFrame:
    """rows with mapq: from how far the best competitor of the same group is behind, as expressions."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group)
    top = F.sort_array(F.collect_list(F.col(pi)).over(w), asc=False)
    second = F.when(F.col(pi) == F.get(top, F.lit(0)), F.get(top, F.lit(1))).otherwise(F.get(top, F.lit(0)))
    sure = F.lit(None).cast("double")
    for name, p in M.CERTAINTY.items():
        sure = F.when(F.col(kind) == name, F.lit(p)).otherwise(sure)
    apart = F.coalesce(F.abs(1 - second / F.col(pi)), F.lit(1.0))
    q = F.ceil(F.round(-10 * F.log10(1 - sure * apart), 6))
    return rows.withColumn("mapq", F.least(F.lit(60), F.greatest(F.lit(0), q)).cast("long"))


def with_names(fragments: DataFrame, reads: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Fragments with the columns that the writers ask for; reads: (qid, read_name, seq, qual), chromosomes: (sid, sname)."""
    out = fragments.join(reads.select(F.col("qid").alias("read_id"), "read_name", "seq", "qual"), "read_id").join(chromosomes.select(F.col("sid").alias("subject_id"), "sname"), "subject_id")
    turned = F.col("qdir") == 1
    qual = F.when(turned, F.reverse("qual")).otherwise(F.col("qual"))
    at = F.when(turned, F.col("qsize") - F.col("fwd_qend")).otherwise(F.col("fwd_qoff"))
    return out.withColumns({"seq": F.when(turned, kmers.reverse_complement(F.col("seq"))).otherwise(F.col("seq")), "qual": qual, "frag_qual": F.substring(qual, at + 1, F.col("fwd_qend") - F.col("fwd_qoff"))})
