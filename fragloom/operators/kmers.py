"""k-mers and inverted indexes over sequences, as relations.

Two forms give the same rows: `extract` stays in SQL expressions and carries the k-mer's text, for short sequences (each
`substring` walks from the start); `extract_hashed` packs two bits a base in numpy, some tens of times faster, for sequences
of any length. Plans use the latter, and long keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pieces import pieces

LARGEST = 31

#: Bases of the pieces that intervals are cut from.
PIECE = 1 << 16


def normalised(seq: Column) -> Column:
    """Upper case, and every other character than ACGT as A."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "A")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def extract(seqs: DataFrame, k: int, stride: int = 1) -> DataFrame:
    """(other columns, kmer, soff) of each k-mer of seq, every `stride` bases from 0 on."""
    at = F.explode(F.sequence(F.lit(0), F.length("seq") - k, F.lit(stride)))
    rows = seqs.where(F.length("seq") >= k).withColumn("soff", at)
    return rows.withColumn("kmer", F.substring("seq", F.col("soff") + 1, F.lit(k))).drop("seq")


def kmer_hash(kmer: Column) -> Column:
    """The k-mer as a number of base 4 (A 0, C 1, G 2, T 3); 31 bases fit a long."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


_CODE = np.zeros(256, np.int64)
for _i, _b in enumerate("ACGT"):
    _CODE[[ord(_b), ord(_b.lower())]] = _i


def hashes(seq: bytes, k: int, stride: int = 1) -> np.ndarray:
    """Hashes of the k-mers of a sequence, every stride bases."""
    codes = _CODE[np.frombuffer(seq, np.uint8)]
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(len(range(0, n, stride)), np.int64)
    for i in range(k):
        out = out << 2 | codes[i : i + n : stride]
    return out


#: k-mers of an Arrow batch that goes back to Spark.
ROWS = 1 << 20


def extract_hashed(seqs: DataFrame, key: str, k: int, stride: int = 1) -> DataFrame:
    """(key, hash, soff) by numpy over Arrow batches; many short sequences share a batch, a long one comes out in several."""
    if not 0 < k <= LARGEST:
        raise ValueError(f"k must be 1 to {LARGEST}")
    kind = seqs.schema[key].dataType.simpleString()

    def made(keys: pa.Array, held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        which, h, at = zip(*held, strict=True)
        of = np.repeat(which, [len(x) for x in h])
        return pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(np.concatenate(h)), pa.array(np.concatenate(at))], [key, "hash", "soff"])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            held, rows = [], 0
            for i, seq in enumerate(batch.column("seq")):
                text = (seq.as_py() or "").encode("ascii", "replace")
                for at in range(0, max(0, len(text) - k + 1), ROWS * stride):  # so that the codes of a part alone are held
                    part = hashes(text[at : at + (ROWS - 1) * stride + k], k, stride)
                    held.append((i, part, at + np.arange(len(part), dtype=np.int64) * stride))
                    rows += len(part)
                    if rows >= ROWS:
                        yield made(batch.column(key), held)
                        held, rows = [], 0
            if held:
                yield made(batch.column(key), held)

    return seqs.select(key, "seq").mapInArrow(run, f"{key} {kind}, hash long, soff long")


def of_reads(reads: DataFrame, k: int) -> DataFrame:
    """(qid, strand, hash, qoff): every k-mer of both strands of (qid, seq)."""
    rows = both_strands(reads.select("qid", "seq")).select(F.struct("qid", "strand").alias("of"), "seq")
    return extract_hashed(rows, "of", k).select("of.qid", "of.strand", "hash", F.col("soff").alias("qoff"))


def text_of(hash_: Column, k: int) -> Column:
    """The k-mer of a hash."""
    return F.translate(F.lpad(F.conv(hash_.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def extract_intervals(seqs: DataFrame, regions: DataFrame, k: int, stride: int = 1) -> DataFrame:
    """(sid, hash, soff) of the k-mers inside intervals (chr, start, stop), every `stride` bases from each interval's start on.

    Intervals are rows, so Spark deals them to tasks; each meets the pieces of the sequence that it lies in, by equal keys, and only its
    own bases there go to Python.
    """
    first, last = (F.floor(F.col(c) / PIECE) for c in ("start", "_last"))
    rows = regions.select(F.col("chr").alias("sid"), "start", "stop", (F.col("stop") - 1).alias("_last")).where(F.col("stop") - F.col("start") >= k)
    rows = rows.withColumn("piece", F.explode(F.sequence(first, last).cast("array<int>")))
    parts = pieces(seqs, PIECE, after=k - 1).select("sid", "piece", F.col("start").alias("_from"), "part")
    ahead = F.greatest(F.lit(0), F.ceil((F.col("_from") - F.col("start")) / stride)) * stride
    rows = rows.join(parts, ["sid", "piece"]).withColumn("_at", (F.col("start") + ahead).cast("long"))
    size = F.least(F.col("stop"), F.col("_from") + PIECE + k - 1) - F.col("_at")
    cut = F.substring("part", (F.col("_at") - F.col("_from") + 1).cast("int"), size.cast("int"))
    rows = rows.where(size >= k).select(F.struct("sid", F.col("_at").alias("start")).alias("at"), cut.alias("seq"))
    return extract_hashed(rows, "at", k, stride).select("at.sid", "hash", (F.col("at.start") + F.col("soff")).alias("soff"))


def both_strands(seqs: DataFrame) -> DataFrame:
    """seqs with strand 0 and, reverse-complemented, strand 1."""
    return seqs.withColumn("strand", F.lit(0)).unionByName(seqs.withColumns({"seq": reverse_complement(F.col("seq")), "strand": F.lit(1)}))


def counts(kmers: DataFrame, key: str = "kmer") -> DataFrame:
    return kmers.groupBy(key).agg(F.count("*").alias("n"))


def complemented(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the reverse complements."""
    out, h = np.zeros_like(h), h.copy()
    for _ in range(k):
        out = out << 2 | 3 - (h & 3)
        h >>= 2
    return out


def counts_of_both_strands(seqs: DataFrame, k: int) -> DataFrame:
    """(hash, n) of the k-mers of both strands of (seq), a row for a k-mer and its reverse complement, under the smaller hash.

    Sequences are counted batch by batch in numpy, so that a row is shuffled for each different k-mer of a batch, not for each
    place. A k-mer that is its own reverse complement counts twice at each place, as in counts of both strands.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        held, bases = [], 0

        def made() -> pa.RecordBatch:
            own, n = np.unique(np.concatenate(held), return_counts=True)
            other = complemented(own, k)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(own, other)), pa.array(n * np.where(own == other, 2, 1))], ["hash", "n"])

        for batch in batches:
            for seq in batch.column("seq"):
                text = (seq.as_py() or "").encode("ascii", "replace")
                for at in range(0, max(0, len(text) - k + 1), ROWS):
                    held.append(hashes(text[at : at + ROWS + k - 1], k))
                    bases += len(held[-1])
                    if bases >= 4 * ROWS:
                        yield made()
                        held, bases = [], 0
        if held:
            yield made()

    return seqs.select("seq").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def own_complement(hash_: Column, k: int) -> Column:
    """Whether a k-mer is its own reverse complement: base i and base k - 1 - i add up to 3."""
    same = F.lit(k % 2 == 0)
    for i in range(k // 2):
        base = lambda j: F.shiftrightunsigned(hash_, 2 * j).bitwiseAND(F.lit(3))
        same = same & (base(i) + base(k - 1 - i) == 3)
    return same


def cutoff(counted: DataFrame, fraction: float, least: int) -> DataFrame:
    """One row (cutoff): the count at place floor(distinct * fraction) in descending order, and `least` at least.

    The place is found in the histogram of counts, which is small, and not by ranking every k-mer.
    """
    histogram = counted.groupBy("n").agg(F.count("*").alias("kmers"))
    upto = F.sum("kmers").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    place = F.floor(F.sum("kmers").over(Window.partitionBy()) * F.lit(fraction))
    at = histogram.select("n", upto.alias("upto"), place.alias("place")).where("upto > place")
    return at.agg(F.greatest(F.coalesce(F.max("n"), F.lit(0)), F.lit(least)).cast("long").alias("cutoff"))


def frequent_removed(kmers: DataFrame, counted: DataFrame, limit: DataFrame, key: str = "kmer") -> DataFrame:
    """k-mers whose count is at most the cutoff (one row), by a left-semi join with the kept keys."""
    kept = counted.join(F.broadcast(limit), F.col("n") <= F.col("cutoff")).select(key)  # limit is one row
    return kmers.join(kept, key, "left_semi")


def index_stats(counted: DataFrame, limit: DataFrame) -> DataFrame:
    """Total, distinct and removed k-mers, and removed distinct ones."""
    over = F.col("n") > F.col("cutoff")
    return counted.join(F.broadcast(limit)).agg(  # limit is one row
        F.sum("n").alias("total"), F.count("*").alias("distinct_kmers"), F.sum(F.when(over, F.col("n")).otherwise(0)).alias("removed"), F.sum(over.cast("long")).alias("removed_distinct")
    )


def index(repeat: DataFrame, other: DataFrame, key: str = "kmer", repeats=(0.1, 1), others=(1e-4, 100)) -> DataFrame:
    """Postings of repeat regions and of the rest, each without its frequent k-mers; `placed` deals and sorts them for lookups."""
    from ..sources.scratch import written

    parts = []
    for kmers, (fraction, least) in ((repeat, repeats), (other, others)):
        counted = written(counts(kmers, key), "counts")
        parts.append(frequent_removed(kmers, counted, cutoff(counted, fraction, least), key))
    return parts[0].unionByName(parts[1])


def placed(postings: DataFrame, key: str = "kmer") -> DataFrame:
    """Postings in order of key over range partitions: files of them can be looked up by the statistics of their keys."""
    return postings.repartitionByRange(key).sortWithinPartitions(key)


def seeds(query: DataFrame, postings: DataFrame, key: str = "kmer", most: int = 20) -> DataFrame:
    """Matches of query k-mers (qid, strand, qoff) and postings (sid, soff); reference places with more than `most` matches
    of a read, strands together, are left out. Postings are first cut down to the query's k-mers."""
    wanted = postings.join(query.select(key).distinct(), key, "left_semi")
    hits = query.join(wanted, key)
    n = F.count("*").over(Window.partitionBy("qid", "sid", "soff"))
    return hits.withColumn("_n", n).where(F.col("_n") <= most).drop("_n", key)


def adaptive_k(bases: int) -> int:
    """The smallest k for which bases / 4 ** k is under 5."""
    k = 1
    while bases / 4**k >= 5:
        k += 1
    return k


#: Shares of distinct k-mers below each threshold, and its name.
THRESHOLDS = (("t_threshold", 0.995), ("t_extend", 0.99), ("t_low", 0.9), ("t_high", 0.998))


def score_thresholds(counted: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row: for each threshold the count at place floor(distinct * (1 - share)) in descending order of count; weight: the k-mers
    that a row stands for (by default one)."""
    histogram = counted.groupBy("n").agg((F.count("*") if weight is None else F.sum(weight)).alias("kmers"))
    upto = F.sum("kmers").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("kmers").over(Window.partitionBy())
    h = histogram.select("n", upto.alias("upto"), total.alias("total"))
    return h.agg(*(F.max(F.when(F.col("upto") > F.floor(F.col("total") * F.lit(1.0 - share)), F.col("n"))).alias(name) for name, share in THRESHOLDS))


def clamped(n: Column, low: Column, high: Column) -> Column:
    """Scores of k-mers: counts from `high` on are `high`, below `low` half of `low`."""
    return F.when(n >= high, high).when(n < low, F.floor(low / 2)).otherwise(n).cast("long")


def coverage(postings: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """(sid, covered, longest_gap): bases of each sequence that kept k-mers cover, and the longest run without."""
    from ..sources.scratch import written
    from .intervals import complement, merge

    placed = written(postings.select(F.col("sid").alias("chr"), F.col("soff").cast("long").alias("start"), (F.col("soff") + k).cast("long").alias("stop")), "placed")
    spans = written(merge(placed), "merged")
    gaps = complement(spans, lengths.select(F.col("sid").alias("chr"), F.col("length").cast("long").alias("length")))
    cover = spans.groupBy("chr").agg(F.sum(F.col("stop") - F.col("start")).alias("covered"))
    gap = gaps.groupBy("chr").agg(F.max(F.col("stop") - F.col("start")).alias("longest_gap"))
    out = lengths.select(F.col("sid").alias("chr")).join(cover, "chr", "left").join(gap, "chr", "left")
    return out.select(F.col("chr").alias("sid"), F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("longest_gap", F.lit(0)).alias("longest_gap"))
