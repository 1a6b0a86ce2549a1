"""Filters and selections of fragments and records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quality(frags: DataFrame, size: int = 100, mapq: int = 5, identity: float = 90.0) -> DataFrame:
    return frags.where((F.col("frag_size") >= size) & (F.col("mapq") >= mapq) & (F.col("identity") >= identity))


def take_budget(rows: DataFrame, order: list[str], size: str, budget: int, buckets: int = 64, most: int = 1_000_000) -> DataFrame:
    """Rows in order until their sizes reach the budget; the row that reaches it is the last. order[0]: a number.

    Sums of ranges of the first order column (a row for each of `buckets` ranges reaches the driver) tell in which range the
    budget is reached; that range is cut again until it has `most` rows or a single value. Ranges before it are taken whole,
    and only its rows are summed one by one.
    """
    at, low, high, before = F.col(order[0]), None, None, 0
    while True:
        inside = rows if low is None else rows.where(at > low)
        inside = inside if high is None else inside.where(at.isNull() | (at <= high))
        cuts = sorted(set(inside.approxQuantile(order[0], [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))))
        part = F.lit(0)
        for c in cuts:
            part = part + F.when(at > F.lit(c), 1).otherwise(0)
        sums = inside.groupBy(part.alias("part")).agg(F.sum(size).alias("own"), F.count("*").alias("n"), F.min(at).alias("least"), F.max(at).alias("greatest")).orderBy("part").collect()
        upto, hit = before, None
        for i, r in enumerate(sums):
            if upto + (r["own"] or 0) >= budget:
                hit = i
                break
            upto += r["own"] or 0
        if hit is None:  # all rows together stay below the budget
            return rows if high is None else rows.where(at.isNull() | (at <= high))
        before, r = upto, sums[hit]
        last = sums[hit - 1]["greatest"] if hit else None
        low = low if last is None else last
        whole = r["least"] == r["greatest"] or r["greatest"] is None
        if whole or r["n"] <= most or len(sums) == 1:
            break
        high = r["greatest"]
    edge = at.isNull() if r["greatest"] is None else at <= r["greatest"] if low is not None else at.isNull() | (at <= r["greatest"])
    crossing = rows.where(edge if low is None else edge & (at > low))
    run = F.sum(size).over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    taken = crossing.withColumn("_run", F.lit(before) + run).where(F.col("_run") - F.col(size) < budget).drop("_run")
    return taken if low is None else rows.where(at.isNull() | (at <= low)).unionByName(taken)


def coverage_capped(frags: DataFrame, lengths: DataFrame, cover: int, cap: int = 200, fresh: int = 20) -> DataFrame:
    """Fragments (subject_id, ord, start, stop) of each chromosome in order of ord: one is taken if `fresh` of its places have under
    `cover` taken ones, until the taken bases reach length * cover; lengths: (subject_id, length). Chromosomes without a length have none.

    The rule looks at all earlier choices on the chromosome, so its rows go through one task in order. Spark sorts them (and
    spills); they stream by in batches, and the task holds the chromosome's coverage alone, a byte a base.
    """
    names = frags.columns
    schema = frags.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, depth, total, limit = None, np.zeros(0, np.uint8), 0, 0
        for batch in batches:
            taken = np.zeros(batch.num_rows, bool)
            columns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("subject_id", "start", "stop", "_length"))
            for i, (subject, start, stop, length) in enumerate(zip(*columns, strict=True)):
                if subject != at:
                    at, depth, total, limit = subject, np.zeros(int(length), np.uint8), 0, int(length) * cover
                if total >= limit:
                    continue
                if stop > len(depth):
                    depth = np.append(depth, np.zeros(int(stop) - len(depth), np.uint8))
                own = depth[start:stop]
                if np.count_nonzero(own < cover) >= fresh:
                    taken[i] = True
                    own[own < cap] += 1
                    total += stop - start
            yield batch.select(names).filter(pa.array(taken))

    rows = frags.join(lengths.select("subject_id", F.col("length").alias("_length")), "subject_id").select(*names, "_length")
    return rows.repartition("subject_id").sortWithinPartitions("subject_id", "ord").mapInArrow(run, schema)


def hash_sample(rows: DataFrame, key: str, share: float, grain: int = 1000) -> DataFrame:
    """A repeatable sample: rows whose key, scrambled, falls in the first `share` of `grain` classes."""
    return rows.where((F.col(key) * 7919 + 104729) % grain < int(share * grain))


def sample(rows: DataFrame, share: float, seed: int | None = None) -> DataFrame:
    return rows.sample(share, seed)


def chromosome_sizes(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.col("sid").alias("name"), F.length("seq").cast("long").alias("length"))


def on_chromosomes(rows: DataFrame, chromosome: str, names: list) -> DataFrame:
    return rows.where(F.col(chromosome).isin(names))
