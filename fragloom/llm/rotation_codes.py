"""Near-duplicate vectors by binary codes under random rotations.

A unit vector is rotated at random and each coordinate keeps its sign only: D bits, x, with the correction factor <x, v> stored
beside them. The inner product of another vector q with x, divided by that factor, is an unbiased estimate of <q, v>, and the
factor also tells how far it may be off. q's coordinates are rounded at random to four bits, so the estimate takes four
counts of common bits. Pairs whose estimate plus its bound misses the threshold are dropped, the others are computed anew
in double precision, and only those link.

Pairs meet where they share a band of code bits. Bands get longer with the logarithm of the number of vectors, so that strangers
that meet stay in proportion to it, and their number is such that a pair at the threshold meets in one with the probability
RECALL. A pair counts in the first band that it shares. Large bands are met block by block. A call returns sums and a
spanning forest of links, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, merge
from .shared import bounded_batches, written
from .textvec import release

THRESHOLD = 0.9
#: Share of the pairs at the threshold that meet in a band; standard deviations by which an estimate may be off.
RECALL, WIDTHS = 0.998, 5.0
#: Bits of a rounded coordinate, seed of rotations and of rounding.
ROUNDED, SEED = 4, 20_240_521
#: Rows of a call, rows of a band that are met in one block, pairs that are estimated at once.
CALL, BLOCK, PAIRS = 4_096, 2_048, 1 << 17

_MADE = "node long, size long, vector binary, codes binary, planes binary, factor float, low float, step float, total float"


@lru_cache(maxsize=64)
def rotation(dims: int, number: int) -> np.ndarray:
    """A random rotation of `dims` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dims, number]).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def padded(dims: int) -> int:
    """Vectors are filled up with zeros to whole words of bits."""
    return -(-dims // 64) * 64


def bands(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a band, bands) for so many vectors: signs of vectors at an angle differ with the probability angle / pi."""
    bits = min(30, max(8, math.ceil(math.log2(max(2, vectors))) - 4))
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meets))


def units(flat: np.ndarray, dims: int) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares of very long and short vectors stay finite."""
    v = flat.astype(np.float64).reshape(-1, dims)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


class Codes:
    """Codes, correction factors and rounded coordinates of unit vectors, under the first of `rotations` rotations; codes of all."""

    def __init__(self, v: np.ndarray, rotations: int):
        self.width = width = padded(v.shape[1])
        full = np.zeros((len(v), width), np.float32)
        full[:, : v.shape[1]] = v
        turned = full @ rotation(width, 0)
        self.codes = np.stack([words_of((turned if r == 0 else full @ rotation(width, r)) > 0) for r in range(rotations)], 1)
        self.factor = np.abs(turned).sum(1) / np.float32(math.sqrt(width))
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / (2**ROUNDED - 1), np.float32(1e-12))
        rounding = np.random.default_rng([SEED, width]).random(width, np.float32)
        level = np.clip(np.floor((turned - self.low[:, None]) / self.step[:, None] + rounding), 0, 2**ROUNDED - 1).astype(np.uint8)
        self.planes = np.stack([words_of(level >> p & 1) for p in range(ROUNDED)], 1)
        self.total = level.sum(1, dtype=np.float32)


def estimate(code: np.ndarray, factor: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Unbiased estimates of inner products, of code and factor of one vector each and rounded coordinates of another."""
    width = code.shape[1] * 64
    common = sum((np.bitwise_count(code & planes[:, p]).sum(1, dtype=np.int32) << p for p in range(ROUNDED)), np.zeros(len(code), np.int32))
    ones = np.bitwise_count(code).sum(1, dtype=np.int32)
    return (step * (2 * common - total) + low * (2 * ones - width)) / (math.sqrt(width) * factor)


def slack(factor: np.ndarray, step: np.ndarray, width: int, threshold: float, widths: float = WIDTHS) -> np.ndarray:
    """How far below the threshold the estimate of a pair that reaches it may lie: what the code leaves out of its vector is a random
    direction, of which the other vector has sqrt(1 - threshold ** 2) at most; each rounded coordinate is off by half a step at most
    in the mean of squares."""
    missed = np.sqrt(np.maximum(0, 1 - factor**2) / (width - 1) * (1 - threshold**2))
    return widths * np.sqrt(missed**2 + (step / 2) ** 2) / factor


def _made(classes: DataFrame, rotations: int) -> DataFrame:
    """node, size and what `Codes` holds, of distinct vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            flat, at = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
            for dims in np.unique(np.diff(at)).tolist():
                rows = np.flatnonzero(np.diff(at) == dims)
                for part in np.split(rows, range(4096, len(rows), 4096)):
                    own = np.stack([flat[at[i] : at[i + 1]] for i in part.tolist()])
                    c = Codes(units(own, dims), rotations)
                    blob = lambda a: pa.array([x.tobytes() for x in a], pa.binary())
                    keep = batch.select(["node", "size"]).take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([*keep.columns, blob(own), blob(c.codes), blob(c.planes), *(pa.array(x, pa.float32()) for x in (c.factor, c.low, c.step, c.total))], [x.split()[0] for x in _MADE.split(", ")])
        release()

    return classes.mapInArrow(run, _MADE)


def keys_of(codes: np.ndarray, bits: int, many: int) -> np.ndarray:
    """Bands of codes (rows, rotations, words): as many whole ones of each rotation as fit."""
    rows, rotations, _ = codes.shape
    each = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8).reshape(rows, rotations, -1), axis=2, bitorder="little")
    fit = each.shape[2] // bits
    value = (each[:, :, : fit * bits].reshape(rows, rotations * fit, bits).astype(np.int64) << np.arange(bits)).sum(2)
    return value[:, :many]


def banded(made: DataFrame, bits: int, many: int) -> DataFrame:
    """made with a row for each band: band, key; dims tells vectors of different lengths apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("planes")).to_numpy(zero_copy_only=False)
            out: list = [None] * batch.num_rows
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                codes = np.frombuffer(b"".join(batch.column("codes").take(pa.array(rows)).to_pylist()), np.uint64).reshape(len(rows), -1, size // 8 // ROUNDED)
                for i, k in zip(rows.tolist(), keys_of(codes, bits, many).tolist(), strict=True):
                    out[i] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    keyed = made.mapInArrow(run, f"{_MADE}, keys array<long>")
    return keyed.select("*", F.octet_length("vector").alias("dims"), F.posexplode("keys").alias("band", "key")).drop("keys")


def pairs_of(sizes: np.ndarray, own: np.ndarray | None, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b), b < a, of items that stand in runs of these sizes; with own, those within a block of it and those across
    are all met, in runs that hold the rows of one block or of two."""
    starts = np.cumsum(sizes) - sizes
    before = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)  # partners of each
    ends = np.cumsum(before)
    at = 0
    while at < len(before):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        n = before[at:to]
        a = np.repeat(np.arange(at, to), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.arange(at, to) - n, n)
        if own is not None:
            keep = own[a] != own[b]
            a, b = a[keep], b[keep]
        if len(a):
            yield a, b
        at = to


class Call:
    """Rows of some bands in one call, in runs of one band and key (and pair of blocks)."""

    def __init__(self, table: pa.Table, bits: int, threshold: float, kind: str):
        """table: columns of `banded` and lo, hi, own."""
        self.threshold, self.bits, self.kind = threshold, bits, kind
        order = pc.sort_indices(table, [(c, "ascending") for c in ("dims", "band", "key", "lo", "hi", "node")])
        table = table.take(order).combine_chunks()
        self.table = table
        self.node, self.size, self.dims = (table.column(c).to_numpy() for c in ("node", "size", "dims"))

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs, in pieces; of each part (vectors of one length) the codes are arrays."""
        dims = self.dims
        cuts = np.flatnonzero(np.append(True, dims[1:] != dims[:-1])).tolist() + [len(dims)] if len(dims) else [0]
        for from_, to in zip(cuts[:-1], cuts[1:], strict=True):
            t = self.table.slice(from_, to - from_)
            blob = lambda c, kind, t=t: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(t.num_rows, -1)
            self.flat = blob("vector", self.kind)
            self.unit = None
            planes = blob("planes", np.uint64)
            words = planes.shape[1] // ROUNDED
            self.planes = planes.reshape(-1, ROUNDED, words)
            self.codes = blob("codes", np.uint64).reshape(t.num_rows, -1, words)
            self.factor, self.low, self.step, self.total = (t.column(c).to_numpy() for c in ("factor", "low", "step", "total"))
            band, key, lo, hi, own = (t.column(c).to_numpy() for c in ("band", "key", "lo", "hi", "own"))
            self.band = band
            new = np.append(True, (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
            sizes = np.diff(np.append(np.flatnonzero(new), t.num_rows))
            across = np.repeat((lo != hi)[new], sizes)
            block = np.where(across, own, np.arange(len(own)))  # within one block all pairs, across two those of different ones
            for a, b in pairs_of(sizes, block):
                good = self.near(a, b)
                if good.any():
                    yield a[good] + from_, b[good] + from_

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs link, and meet here first."""
        found = estimate(self.codes[a, 0], self.factor[a], self.planes[b], self.low[b], self.step[b], self.total[b])
        good = found >= self.threshold - slack(self.factor[a], self.step[b], self.codes.shape[2] * 64, self.threshold)
        at = np.flatnonzero(good)
        if not len(at):
            return good
        if self.unit is None:
            self.unit, self.keys = units(self.flat.ravel(), self.flat.shape[1]), keys_of(self.codes, self.bits, int(self.band.max()) + 1).astype(np.int32)
        for at in np.split(at, range(1 << 14, len(at), 1 << 14)):
            x, y = a[at], b[at]
            first = (self.keys[x] == self.keys[y]).argmax(1) == self.band[x]
            good[at] = first
            at, x, y = at[first], x[first], y[first]
            good[at] = np.einsum("ij,ij->i", self.unit[x], self.unit[y]) >= self.threshold
        return good


def links(classes: DataFrame, bits: int, many: int, kind: str, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(node, other, n) of distinct vectors: sums of the sizes of the vectors that a call links with node (other null), and a
    spanning forest of the call's links (n null)."""
    width = 64  # of the shortest vectors; longer ones have more bands in a rotation than they need
    made = written(_made(classes, -(-many // (width // bits))), "codes")
    rows = banded(made, bits, many)
    key = ["dims", "band", "key"]
    large = written(rows.groupBy(*key).count().where(F.col("count") > block), "large")
    big = large.select(*(F.col(c).alias(f"l_{c}") for c in key), F.col("count").alias("n"))
    rows = rows.join(big, [F.col(c) == F.col(f"l_{c}") for c in key], "left").drop(*(f"l_{c}" for c in key))
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("own", "with")).withColumn("hi", F.greatest("own", "with")).drop("with", "blocks", "n")
    calls = max(1, math.ceil(made.count() * many / CALL))
    rows = rows.withColumn("call", F.pmod(F.xxhash64(*key, "lo", "hi"), F.lit(calls)))

    def run(table: pa.Table) -> pa.Table:
        release()  # of the call before
        call = Call(table, bits, threshold, kind)
        nodes, place = np.unique(call.node, return_inverse=True)
        label, sums = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
        for a, b in call.parts():
            np.add.at(sums, place[a], call.size[b])
            np.add.at(sums, place[b], call.size[a])
            label = merge(label, place[a], place[b])
        some, tree = np.flatnonzero(sums), np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table(
            {
                "node": pa.array(np.concatenate([nodes[some], nodes[tree]]), pa.int64()),
                "other": pa.array(np.concatenate([nodes[some], nodes[label[tree]]]), pa.int64(), mask=np.arange(len(some) + len(tree)) < len(some)),
                "n": pa.array(np.concatenate([sums[some], sums[tree]]), pa.int64(), mask=np.arange(len(some) + len(tree)) >= len(some)),
            }
        )

    return rows.groupBy("call").applyInArrow(run, "node long, other long, n long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links (other vectors at a cosine of at least `threshold`), component_id (smallest vec_id reachable by links), kept.

    Vectors that are null, empty or zero, or hold null, NaN or infinite components, link with nothing, nor do vectors of different
    lengths. Equal vectors are one class, whose copies all link; they are never expanded into pairs. Rows of one vec_id are
    vectors of their own; null ids link likewise, their component is that of the smallest id reachable, null if none is
    (kept is then false). Only those pairs link whose cosine in double precision reaches the threshold; a pair right at it is
    found with the probability `recall`, nearer ones almost surely. No rows give no rows; other columns are left behind.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = "f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "f8"
    vector = F.col("embedding").cast("array<float>" if kind == "f4" else "array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = (F.size("embedding") > 0) & ~F.exists("embedding", odd) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(valid, vector).alias("vector"))
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    bits, many = bands(n, threshold, recall)
    found = written(links(classes.select("node", "size", "vector"), bits, many, kind, threshold, block), "links")
    sums = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = classes.join(sums, "node", "left").join(roots, "node", "left").select("vector", "id", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    known = written(known, "known")
    least = known.groupBy("root").agg(F.min("id").alias("component_id"))
    known = known.join(least, "root").select("vector", "n_links", "component_id")
    same = rows.where("vector is not null").join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return same.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def oracle() -> str:
    """All pairs in DuckDB's SQL, in double precision."""
    return f"""
        with recursive rows as (select row_number() over () as r, vec_id, embedding::double[] as v from embeddings),
        good as (
            select r, vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from rows
            where len(v) > 0 and list_sum(list_transform(v, lambda x: case when x is null or isnan(x) or isinf(x) then 1 else 0 end)) = 0 and list_sum(list_transform(v, lambda x: abs(x))) > 0
        ),
        links as (select a.r as a, b.r as b from good a join good b on a.r <> b.r and len(a.u) = len(b.u) and list_inner_product(a.u, b.u) >= {THRESHOLD}),
        reach as (select r as a, r as b from rows union select reach.a, links.b from reach join links on links.a = reach.b),
        least as (select a, min(vec_id) as component_id from reach join rows on rows.r = reach.b group by a),
        counts as (select a, count(*) as n from links group by a)
        select vec_id, coalesce(n, 0)::bigint as n_links, component_id, coalesce(vec_id = component_id, false) as kept
        from rows join least on least.a = rows.r left join counts on counts.a = rows.r
    """
