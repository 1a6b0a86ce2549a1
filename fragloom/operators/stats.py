"""Statistics over fragments, reads and contacts (pairs of fragments of a read)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DISTANCES = (5_000_000, 50_000_000, 2_147_483_647)


def contacts(frags: DataFrame, *keys: str, columns: tuple[str, ...] = ("subject_offset", "hp")) -> DataFrame:
    """Pairs of fragments of the same keys, once each; columns of the second end in 2. One exchange serves both sides."""
    a = frags.select(*keys, "frag_id", *columns)
    b = frags.select(*keys, F.col("frag_id").alias("frag_id2"), *(F.col(c).alias(f"{c}2") for c in columns))
    return a.join(b, list(keys)).where("frag_id < frag_id2")


def _count(cond) -> F.Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def contact_stats(frags: DataFrame) -> DataFrame:
    """For each distance: same-chromosome contacts within it, phased ones, and those of H1, H2 and both; all distances in one pass."""
    pairs = contacts(frags, "read_id", "subject_id")
    pairs = pairs.withColumn("_d", F.abs(F.col("subject_offset") - F.col("subject_offset2")))
    by = pairs.groupBy(F.when(F.col("_d") <= DISTANCES[0], 0).when(F.col("_d") <= DISTANCES[1], 1).otherwise(2).alias("_class")).agg(
        F.count("*").alias("contacts"),
        _count((F.col("hp") > 0) & (F.col("hp2") > 0)).alias("phased"),
        _count((F.col("hp") == 1) & (F.col("hp2") == 1)).alias("h1"),
        _count((F.col("hp") == 2) & (F.col("hp2") == 2)).alias("h2"),
        _count((F.col("hp") > 0) & (F.col("hp2") > 0) & (F.col("hp") != F.col("hp2"))).alias("trans"),
    )  # three rows
    far = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(d).cast("long").alias("max_distance")) for i, d in enumerate(DISTANCES))))
    rows = by.withColumn("_far", far).where("_class <= _far.i")
    return rows.groupBy(F.col("_far.max_distance").alias("max_distance")).agg(*(F.sum(c).alias(c) for c in ("contacts", "phased", "h1", "h2", "trans")))


def frag_stats(frags: DataFrame) -> DataFrame:
    """Reads, reads with a tagged fragment, fragments, tagged ones, H1, H2 and percentages."""
    hp = F.col("hp")
    by = frags.groupBy("read_id").agg(F.count("*").alias("n"), _count(hp > 0).alias("p"), _count(hp == 1).alias("one"), _count(hp == 2).alias("two"))
    pct = lambda a, b: F.round(F.lit(100.0) * a / b, 6)
    sums = by.agg(F.count("*").alias("reads"), _count(F.col("p") > 0).alias("phased_reads"), F.sum("n").alias("frags"), F.sum("p").alias("phased"), F.sum("one").alias("h1"), F.sum("two").alias("h2"))
    return sums.withColumns({"phased_reads_pct": pct(F.col("phased_reads"), F.col("reads")), **{f"{c}_pct": pct(F.col(c), F.col("frags")) for c in ("phased", "h1", "h2")}})


def _rates(rows: DataFrame) -> DataFrame:
    div = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return rows.withColumns({"accuracy": div("accurate", "tagged"), "recall": div("accurate", "total")})


def eval_frags(truth: DataFrame, other: DataFrame) -> DataFrame:
    """Fragments tagged in truth, also tagged in other, and tagged alike."""
    both = truth.where("hp > 0").select("read_id", "frag_id", "hp").join(other.select("read_id", "frag_id", F.col("hp").alias("hp2")), ["read_id", "frag_id"])
    return _rates(both.agg(F.count("*").alias("total"), _count(F.col("hp2") > 0).alias("tagged"), _count(F.col("hp") == F.col("hp2")).alias("accurate")))


def eval_contacts(truth: DataFrame, other: DataFrame) -> DataFrame:
    """The same of contacts of a read, of any chromosomes: both fragments must be tagged, and alike."""
    both = truth.where("hp > 0").select("read_id", "frag_id", "hp").join(other.select("read_id", "frag_id", F.col("hp").alias("o")), ["read_id", "frag_id"])
    pairs = contacts(both, "read_id", columns=("hp", "o"))
    tagged = (F.col("o") > 0) & (F.col("o2") > 0)
    return _rates(pairs.agg(F.count("*").alias("total"), _count(tagged).alias("tagged"), _count(tagged & (F.col("hp") == F.col("o")) & (F.col("hp2") == F.col("o2"))).alias("accurate")))


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """One row (median, mean): the value at place n div 2 from 0, in ascending order; found in the histogram of values."""
    h = rows.groupBy(value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy())
    placed = h.select(value, "_n", upto.alias("_upto"), total.alias("_total"))
    return placed.agg(F.min(F.when(F.col("_upto") > F.floor(F.col("_total") / 2), F.col(value))).alias("median"), F.round(F.sum(F.col(value) * F.col("_n")) / F.sum("_n"), 6).alias("mean"))


def read_frag_stats(frags: DataFrame, size: str = "frag_size") -> DataFrame:
    """Fragments, reads, contacts, and mean and upper median of fragment sizes and of fragments a read. The last read counts as well."""
    reads = frags.groupBy("read_id").agg(F.count("*").alias("n"))
    sums = reads.agg(F.sum("n").alias("frags"), F.count("*").alias("reads"), F.sum(F.floor(F.col("n") * (F.col("n") - 1) / 2)).alias("contacts"))
    a = upper_median(frags, size).select(F.col("median").alias("size_median"), F.col("mean").alias("size_mean"))
    b = upper_median(reads, "n").select(F.col("median").alias("reads_median"), F.col("mean").alias("reads_mean"))
    return sums.join(a).join(b)  # one row each


def summary(frags: DataFrame) -> DataFrame:
    """Fragments, whole means of size and mapping quality, mean identity."""
    n = F.count("*")
    return frags.agg(n.alias("frags"), F.floor(F.sum("frag_size") / n).alias("avg_size"), F.floor(F.sum("mapq") / n).alias("avg_mapq"), F.round(F.avg("identity"), 6).alias("avg_identity"))


def over_files(lists: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Fragment and contact statistics of several lists together; each list counts once."""
    rows = lists[0]
    for other in lists[1:]:
        rows = rows.unionByName(other)
    return frag_stats(rows), contact_stats(rows)


def chain_summary(chain: DataFrame, key: str = "qid") -> DataFrame:
    """Mean identity and covered bases of each read's chain of fragments (fwd_qoff, fwd_qend, pi); overlaps count once."""
    w = Window.partitionBy(key).orderBy("fwd_qoff", "fwd_qend")
    seen = F.max("fwd_qend").over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = F.greatest(F.lit(0), F.col("fwd_qend") - F.greatest(F.col("fwd_qoff"), F.coalesce(seen, F.lit(0))))
    return chain.withColumn("_own", own).groupBy(key).agg(F.round(F.avg("pi"), 6).alias("avg_pi"), F.sum("_own").alias("covered"))


def mapped_totals(fragments: DataFrame) -> DataFrame:
    """One row: reads with a fragment, fragments, and their bases."""
    return fragments.agg(F.count_distinct("read_id").alias("reads"), F.count("*").alias("frags"), F.coalesce(F.sum("frag_size"), F.lit(0)).cast("long").alias("bases"))
