"""Parts of long sequences. SQL's substring walks a string from its start, and an explode copies it for each row, so that cutting up a
chromosome by expressions takes quadratic time; here each sequence is gone through once, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bases of an Arrow batch that goes back to Spark.
BASES = 1 << 22


def pieces(seqs: DataFrame, size: int, before: int = 0, after: int = 0, key: str = "sid") -> DataFrame:
    """(key, piece, start, part, length) of (key, seq): piece n is [n * size, n * size + size) with up to `before` bases more on its
    left and `after` on its right; part begins at start; length is the sequence's. Null and empty sequences have no pieces."""
    names = [key, "piece", "start", "part", "length"]

    def record(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        which, *columns = zip(*rows, strict=True)
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([keys.take(pa.array(which)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bases = [], 0
            for i, seq in enumerate(batch.column("seq")):
                text = seq.as_py() or ""
                for n, at in enumerate(range(0, len(text), size)):
                    lo = max(0, at - before)
                    rows.append((i, n, lo, text[lo : at + size + after], len(text)))
                    bases += len(rows[-1][3])
                    if bases >= BASES:
                        yield record(batch.column(key), rows)
                        rows, bases = [], 0
            if rows:
                yield record(batch.column(key), rows)

    kind = seqs.schema[key].dataType.simpleString()
    return seqs.select(key, "seq").mapInArrow(run, f"`{key}` {kind}, piece int, start long, part string, length long")


def bases(rows: DataFrame, seqs: DataFrame, start: str, stop: str, name: str, size: int = 1 << 16) -> DataFrame:
    """Rows (sid, ...; equal ones once) with the bases [start, stop) of their sequence: rows meet the pieces that they lie in, by equal keys, and a
    row's pieces are joined, so only what it asks for and a piece's rest is shuffled. start is 0 or more; what lies beyond a sequence's
    end is left out, and rows that meet no piece have null."""
    own = rows.columns
    ends = F.sequence(F.floor(F.col(start) / size), F.floor((F.col(stop) - 1) / size)).cast("array<int>")
    asked = rows.withColumn("_piece", F.explode_outer(F.when(F.col(stop) > F.col(start), ends)))
    parts = pieces(seqs, size).select(F.col("sid").alias("_sid"), F.col("piece").alias("_in"), F.col("start").alias("_from"), "part")
    met = asked.join(parts, (F.col("sid") == F.col("_sid")) & (F.col("_piece") == F.col("_in")), "left")
    lo = F.greatest(F.col(start), F.col("_from"))
    cut = F.substring("part", (lo - F.col("_from") + 1).cast("int"), (F.col(stop) - lo).cast("int"))
    part = F.when(F.col("_from").isNotNull(), F.struct("_from", cut.alias("cut")))
    found = met.select(*own, part.alias("_cut")).groupBy(*own).agg(F.sort_array(F.collect_set("_cut")).alias("_cuts"))
    text = F.array_join(F.transform("_cuts", lambda x: x["cut"]), "")
    return found.select(*own, F.when(F.size("_cuts") > 0, text).alias(name))
