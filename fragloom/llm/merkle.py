"""Merkle manifests of tables by superblock reduction: a root that stands for all rows, and a proof for each of them.

Nodes of a tree are numbered. Nodes of one bucket (number divided by fanout ** LEVELS) go to one call of `applyInPandas`, which
collapses LEVELS levels to one node; buckets' nodes are reduced in the same way until each tree has one left. A proof is
the way up inside a row's bucket, followed by that of its bucket's node, and so on. Calls hold fanout ** LEVELS nodes at most,
and rows are numbered by range partitions, whose counts alone are summed up; so no tree, however large, meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BATCH_BYTES, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run; levels that a call collapses (1,024 nodes).
FANOUT, LEVELS = 2, 10
#: A document is tampered with where this divides the checksum of its id.
TAMPERED = 7

_BLOCK = "tree string, bucket long, total long, digest binary, ids array<long>, nodes binary, tampered binary"


def joined_digest(digests: Sequence[bytes]) -> bytes:
    """SHA-256 of the digests' hexadecimal texts, one after another."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def levels_of(nodes: list[bytes], fanout: int, most: int | None) -> list[list[bytes]]:
    """The nodes, and those of each level above: `most` levels, or (None) until a single node remains."""
    out = [nodes]
    while len(out) <= most if most is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([joined_digest(last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return out


def path(levels: list[list[bytes]], place: int, fanout: int) -> bytes:
    """The way up from a node: for each level the counts of siblings to the left and right, and their digests."""
    out = []
    for nodes in levels[:-1]:
        first = place - place % fanout
        run = nodes[first : first + fanout]
        out += [bytes((place - first, len(run) - 1 - (place - first))), *run[: place - first], *run[place - first + 1 :]]
        place //= fanout
    return b"".join(out)


def siblings(way: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    """The siblings to the left and to the right, level by level."""
    out, at = [], 0
    while at < len(way):
        left, right = way[at], way[at + 1]
        all_ = [way[i : i + 32] for i in range(at + 2, at + 2 + 32 * (left + right), 32)]
        out.append((all_[:left], all_[left:]))
        at += 2 + 32 * (left + right)
    return out


def folded(node: bytes, way: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """The root that a node and its siblings give."""
    for left, right in way:
        node = joined_digest([*left, node, *right])
    return node


def leaf(fields: Sequence[str] = FIELDS, **instead: Column) -> Column:
    """Digest of a row, as hexadecimal text: of each field `-` if null, else its UTF-8 bytes' count, a colon and the value."""
    texts = [instead.get(f, F.col(f)).cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def numbered_nodes(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows of trees with number (from 0 in each tree, in order of the columns `by`, nulls first) and total.

    Rows are sorted in range partitions and numbered there; a tree's number begins after those of its rows in partitions
    before. Equal rows are told apart by where they were read, so that no range has to hold all of them.
    """
    rows = rows.withColumn("read_at", F.monotonically_increasing_id())
    order = ["tree", *by, "read_at"]
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("read_at").withColumn("place", F.monotonically_increasing_id()), "nodes")
    part = F.shiftright("place", 33).alias("part")
    counts = placed.groupBy("tree", part).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("tree").alias("of"), F.col("part").alias("in"), (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("total"))
    found = placed.join(starts, F.col("tree").eqNullSafe(F.col("of")) & (F.shiftright("place", 33) == F.col("in")))
    return found.withColumn("number", F.col("place") + F.col("shift")).drop("place", "shift", "of", "in")


def _collapse(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """A row for each bucket of nodes (tree, number, total, digest, id, tampered): what its nodes are and the node that they become."""
    size = fanout**levels

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number")
        total, digests = int(rows["total"].iloc[0]), list(rows["digest"])
        top = levels_of(digests, fanout, levels if total > size else None)[-1][0]
        ids = [int(x) if x else None for x in rows["id"]]  # as text: whole numbers and nulls together become floats in pandas
        tampered = b"".join(x if x is not None else d for x, d in zip(rows["tampered"], digests, strict=True))
        tree = rows["tree"].iloc[0]
        return pd.DataFrame({"tree": [tree if isinstance(tree, str) else None], "bucket": [int(rows["number"].iloc[0]) // size], "total": [total], "digest": [top], "ids": [ids], "nodes": [b"".join(digests)], "tampered": [tampered]})

    return nodes.withColumns({"bucket": F.expr(f"number div {size}"), "id": F.col("id").cast("string")}).groupBy("tree", "bucket").applyInPandas(run, _BLOCK)


@dataclass
class Manifest:
    """blocks: of each super-level, from the leaves up, the table of buckets; tops: (tree, digest) of each tree."""

    blocks: list[DataFrame]
    tops: DataFrame
    fanout: int
    levels: int


def reduce(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """The trees over numbered nodes (tree, number, total, digest, id, tampered); no nodes give no trees."""
    blocks = []
    while True:
        blocks.append(written(_collapse(nodes, fanout, levels), f"level{len(blocks)}"))
        total = F.ceil(F.col("total") / fanout**levels).cast("long")
        nodes = blocks[-1].select("tree", F.col("bucket").alias("number"), total.alias("total"), "digest", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("tampered"))
        if (nodes.agg(F.max("total")).first()[0] or 0) <= 1:
            return Manifest(blocks, nodes.select("tree", "digest"), fanout, levels)


def _opened(block: dict, way: bytes, fanout: int, levels: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(place, node, way to the root) of each node of a bucket whose own node has this way."""
    nodes = [block["nodes"][i : i + 32] for i in range(0, len(block["nodes"]), 32)]
    tree = levels_of(nodes, fanout, levels if block["total"] > fanout**levels else None)
    for place, node in enumerate(nodes):
        yield place, node, path(tree, place, fanout) + way


def ways(manifest: Manifest, above: DataFrame) -> DataFrame:
    """Buckets of leaves with the ways of their nodes up to the root: columns of the bucket, way, top (digest of the tree).

    above: (tree, way) of each tree's top in a tree of trees.
    """
    fanout, levels, size = manifest.fanout, manifest.levels, manifest.fanout**manifest.levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                rows = [(block["tree"], block["bucket"] * size + place, way, block["top"]) for place, _, way in _opened(block, block["way"], fanout, levels)]
                tree, number, way, top = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(number, pa.int64()), pa.array(way, pa.binary()), pa.array(top, pa.binary())], ["of", "number", "way", "top"])

    tops = above.join(manifest.tops.select(F.col("tree").alias("t"), F.col("digest").alias("top")), F.col("tree").eqNullSafe(F.col("t"))).select(F.col("tree").alias("of"), F.lit(0).cast("long").alias("number"), "way", "top")
    for i, block in enumerate(reversed(manifest.blocks)):
        joined = block.join(tops, F.col("tree").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("number"))).drop("of", "number")
        if i == len(manifest.blocks) - 1:
            return joined
        tops = joined.mapInArrow(run, "of string, number long, way binary, top binary")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "lang", order: str = "doc_id", changed: str = "n_chars", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row: its place in the manifest, and whether
    its leaf and its siblings still give the root after tampering (where 7 divides the CRC-32 of doc_id, `changed` grows by 1).

    Each value of `tree` (null is one, the first) has a tree of its rows by `order`: null ids first, and rows of one id by their
    leaves, so that equal rows stand side by side, each with a proof of its own. Null fields count as `-`, empty texts as `0:`.
    Very long texts are digested where they are read; only digests are shuffled. A null id is not tampered with; nor is a null
    `changed` altered, so both verify. An empty table gives no rows. Other columns, whatever their names, are left behind.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    broken = F.crc32(F.col(order).cast("string")) % TAMPERED == 0
    other = leaf(fields, **{changed: F.try_add(F.col(changed).cast("long"), F.lit(1))})
    leaves = docs.select(F.col(tree).cast("string").alias("tree"), F.col(order).cast("long").alias("id"), F.unhex(leaf(fields)).alias("digest"), F.when(broken, F.unhex(other)).alias("tampered"))
    lower = reduce(numbered_nodes(written(leaves, "leaves"), ["id", "digest"]), fanout, levels)

    trees = lower.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    named = numbered_nodes(trees, ["name"])
    upper = reduce(named.select("tree", "number", "total", "digest", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("tampered")), fanout, levels)
    root = upper.tops.select("digest").first()
    root = bytes(root.digest) if root else b""
    end = ways(upper, spark.createDataFrame([("", b"")], "tree string, way binary"))
    size = fanout**levels

    def of_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                rows = [(block["bucket"] * size + place, way) for place, _, way in _opened(block, block["way"], fanout, levels)]
                number, way = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(way, pa.binary())], ["at", "way"])

    above = named.join(end.mapInArrow(of_trees, "at long, way binary"), F.col("number") == F.col("at")).select(F.col("name").alias("tree"), "way")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                rows = []
                for place, node, way in _opened(block, block["way"], fanout, levels):
                    up = siblings(way)
                    proof = joined_digest([d for left, right in up for d in (*left, *right)])
                    again = folded(block["tampered"][32 * place : 32 * place + 32], up)
                    rows.append((block["ids"][place], node.hex(), block["top"].hex(), root.hex(), proof.hex(), again.hex(), again == root))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _PROOF.split(", ")])

    return ways(lower, above).mapInArrow(prove, _PROOF)


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def oracle() -> str:
    """The same for two nodes a run, in DuckDB's SQL: levels by recursion, the checksum bit by bit."""
    part = lambda v: f"coalesce(octet_length(encode({v}))::varchar || ':' || {v}, '-')"
    row = lambda n: "sha256(" + " || ".join(part(f"{f}::varchar" if f != "n_chars" else f"({n})::varchar") for f in FIELDS) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::bigint)"
    up = """{0} as (
            select 0 as level, tree, i, h, count(*) over (partition by tree) as n from {1}
            union all
            select any_value(level) + 1, tree, i // 2, sha256(string_agg(h, '' order by i)), any_value((n + 1) // 2) from {0} where n > 1 group by tree, i // 2
        )"""
    way = """select d.{0}, l.level, s.h, s.i < l.i as before
            from {1} d join {2} l on l.tree = d.tree and l.i = d.i >> l.level and l.n > 1
            left join {2} s on s.tree = l.tree and s.level = l.level and s.i = xor(l.i, 1)"""
    return f"""
        with recursive leaves as (
            select doc_id, coalesce('=' || lang, '') as tree, {row("n_chars")} as leaf, case when {crc} % {TAMPERED} = 0 then {row("n_chars + 1")} end as tampered from documents
        ), placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i from leaves),
        rows as (select *, row_number() over () as r from placed),
        first as (select tree, i, leaf as h from rows),
        {up.format("nodes", "first")},
        subroots as (select tree as name, h, row_number() over (order by tree) - 1 as i, '' as tree from nodes where n = 1),
        {up.format("tops", "subroots")},
        steps as (
            {way.format("r", "rows", "nodes")}
            union all
            select d.r, 1000 + w.level, w.h, w.before from rows d join ({way.format("name", "subroots", "tops")}) w on w.name = d.tree
        ), ordered as (select *, row_number() over (partition by r order by level) as step from steps),
        proofs as (select r, sha256(coalesce(string_agg(h, '' order by level), '')) as proof from steps group by r),
        fold as (
            select r, 0::bigint as step, coalesce(tampered, leaf) as h from rows
            union all
            select f.r, o.step, sha256(case when o.h is null then f.h when o.before then o.h || f.h else f.h || o.h end) from fold f join ordered o on o.r = f.r and o.step = f.step + 1
        ), ended as (select r, arg_max(h, step) as h from fold group by r)
        select d.doc_id, d.leaf, s.h as subroot, t.h as root, coalesce(p.proof, sha256('')) as proof_sha256, e.h as folded_root, e.h = t.h as verified
        from rows d join subroots s on s.name = d.tree join tops t on t.n = 1 join ended e on e.r = d.r left join proofs p on p.r = d.r
    """
