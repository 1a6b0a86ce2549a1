"""SimHash near-dedup by vantage-point trees: exact pairs of fingerprints within a Hamming radius.

A tree over a bounded sample of fingerprints deals all distinct fingerprints to shards. At a node with vantage v and
bound m, fingerprints with d(x, v) <= m go left and the others right; by the triangle inequality partners across the
bound differ by at most `radius` in d, so the left ones with d > m - radius go right as well, and every pair meets in a
shard. Each shard goes on splitting its own fingerprints in the same way down to small leaves, where all distances are
computed. A shard returns a spanning forest of its pairs, so that a group of n copies costs n links and not n * n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, merge
from .shared import blocks, blocks_apart, docs_of, free_name, numbered, written
from .textvec import U, Words, mix, release, shingles, slices, utf8

RADIUS, WIDTH, SEED = 2, 3, 42
#: Fingerprints from which the driver makes the tree of shards, and the distinct fingerprints that a shard shall have.
SAMPLE, SHARD_ROWS = 16_384, 6_000
LEAF = 192


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """64 bits, each the majority of that bit over the XXH64 hashes of the word shingles (fewer words: all; none: zero)."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 32_768):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + 32_768], ends[at : at + 32_768], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            data, at = utf8(batch.column("text"))
            fps = np.array([fingerprint(data[a:b].tobytes(), width) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs_of(docs).mapInArrow(run, "doc_id long, fp long")


def apart(fps: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (one word each, or rows of words) from v."""
    d = np.bitwise_count(fps ^ v)
    return d if fps.ndim == 1 else d.sum(1, dtype=np.int64)


def split(fps: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int, np.ndarray] | None:
    """Vantage, bound and distances that deal fps most evenly for the fewest rows on both sides; None if none helps."""
    best, bits = None, 64 if fps.ndim == 1 else 64 * fps.shape[1]
    for v in fps[rng.choice(len(fps), 4)]:
        d = apart(fps, v)
        upto = np.cumsum(np.bincount(d, minlength=bits + 1))
        for m in range(1, bits):
            right = len(fps) - upto[max(0, m - radius)]
            cost = float(upto[m]) ** 1.6 + float(right) ** 1.6
            if upto[m] < len(fps) and (best is None or cost < best[0]):
                best = (cost, v, m, d)
    return best[1:] if best and best[0] < 0.97 * float(len(fps)) ** 1.6 else None


def grow(sample: np.ndarray, leaf: int, radius: int) -> list[tuple]:
    """The tree of shards, as nodes (vantage, bound, left, right) or (shard,), the root first. Bounded by the sample."""
    rng, nodes, shards, todo = np.random.default_rng(7), [()], 0, [(0, sample)]
    while todo:
        i, own = todo.pop()
        cut = split(own, radius, rng) if len(own) > leaf else None
        if cut is None:
            nodes[i] = (shards,)
            shards += 1
            continue
        v, m, d = cut
        nodes[i] = (v, m, len(nodes), len(nodes) + 1)
        todo += [(len(nodes), own[d <= m]), (len(nodes) + 1, own[d > m - radius])]
        nodes += [(), ()]
    return nodes


def deal(nodes: list[tuple], fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, fingerprints): every pair within the radius meets in a shard."""
    todo = [(0, fps)]
    while todo:
        i, own = todo.pop()
        if not len(own):
            continue
        if len(nodes[i]) == 1:
            yield nodes[i][0], own
            continue
        v, m, left, right = nodes[i]
        d = np.bitwise_count(own ^ v)
        todo += [(left, own[d <= m]), (right, own[d > m - radius])]


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (places in fps) of all pairs within the radius, by a vantage-point tree in memory."""
    rng, label, todo, held, size = np.random.default_rng(11), np.arange(len(fps)), [np.arange(len(fps))], [], 0
    while todo:
        own = todo.pop()
        x = fps[own]
        cut = split(x, radius, rng) if len(own) > LEAF else None
        if cut is not None:
            _, m, d = cut
            todo += [own[d <= m], own[d > m - radius]]
            continue
        for at in range(0, len(own), LEAF):  # one block, or more where no vantage splits (a ball of near copies)
            d = np.bitwise_count(x[at : at + LEAF, None] ^ x[None, at:])
            a, b = np.nonzero((d if x.ndim == 1 else d.sum(2, dtype=np.int16)) <= radius)
            up = b > a
            held.append((own[a[up] + at], own[b[up] + at]))
            size += int(up.sum())
            if size > 1_000_000:
                label, held, size = merge(label, *map(np.concatenate, zip(*held, strict=True))), [], 0
    if held:
        label = merge(label, *map(np.concatenate, zip(*held, strict=True)))
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return linked, label[linked]


def links(distinct: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning forest, shard by shard, of all pairs of distinct fingerprints (column fp) within the radius."""
    sample = [r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    sample = np.array(sample, np.int64).view(np.uint64)
    nodes = grow(sample, max(64, len(sample) * SHARD_ROWS // max(1, count)), radius)

    def out(batches):
        for batch in batches:
            for shard, own in deal(nodes, batch.column("fp").to_numpy().view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard, np.int32)), pa.array(own.view(np.int64))], ["shard", "fp"])

    def join(table: pa.Table) -> pa.Table:
        fps = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        a, b = forest(fps, radius)
        return pa.table({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})

    return distinct.select("fp").mapInArrow(out, "shard int, fp long").groupBy("shard").applyInArrow(join, "a long, b long")


def near_dedup(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links within `radius` bits reach.

    Null, empty or blank text: fingerprint zero, linked like any other. Rows of equal text, and repeated rows, have equal
    fingerprints and so one component; a row with a null doc_id keeps its place and never names a component unless all
    of its members are null. Very long texts are hashed in blocks; an empty table gives an empty one; other columns are
    ignored. Copies collapse to one fingerprint before anything is compared.
    """
    fps = written(fingerprints(docs, width), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct")
    roots = connected_components(links(distinct, distinct.count(), radius))
    roots = written(roots, "roots")
    named = roots.join(distinct.withColumnRenamed("fp", "node"), "node")
    least = named.groupBy("root").agg(F.min("doc").alias("least"))
    lead = named.join(least, "root").select(F.col("node").alias("fp"), "least")
    lead = distinct.join(lead, "fp", "left").select("fp", F.coalesce("least", "doc").alias("component_id"))
    return fps.join(lead, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For near copies: words of a fingerprint, of a shingle, and the radius. At a similarity of 0.8 (Jaccard, shingles) distances are
#: 39 +- 6 of 256 bits, at 0.7 49 +- 6, at 0.5 69 +- 7, and 128 +- 8 between strangers.
WORDS, SHINGLE, NEAR = 4, 5, 50
#: Similarity that links are verified for, and rows of a block of a group whose parts are compared.
SIMILAR, BLOCK = 0.8, 1_024
#: Least shingles by which fingerprints are dealt to shards (at 0.8, 0.2 % of pairs share none), and the rows of a shard; beyond
#: them its rows go to blocks of half as many, and every two blocks meet in a shard of their own.
DEALS, LARGE = 4, 4_096


def shingle_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Five-word shingles of the batch's texts (a text of fewer words is one shingle), the row of each, and the first of each row (rows + 1)."""
    words = Words(batch.column("text"))
    whole = words.hashes()
    item, row, _ = shingles(whole, words.counts, SHINGLE)
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(short):
        extra = np.array([np.bitwise_xor.reduce(mix(whole[words.first[i] : words.first[i + 1]] + np.arange(words.counts[i], dtype=U))) for i in short.tolist()], U)
        order = np.argsort(np.concatenate([row, short]), kind="stable")
        item, row = np.concatenate([item, extra])[order], np.concatenate([row, short])[order]
    return item, row, np.searchsorted(row, np.arange(batch.num_rows + 1))


def set_hashes(item: np.ndarray, row: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A hash of each row's set of shingles, whatever their order and repeats; zero for none."""
    key = mix(item ^ mix(row.astype(U)))
    order = np.argsort(key)
    once = np.zeros(len(key), U)
    once[order[np.append(True, key[order[1:]] != key[order[:-1]])] if len(key) else order] = 1
    out, full = np.zeros(len(cut) - 1, U), np.flatnonzero(cut[1:] > cut[:-1])
    if len(full):
        out[full] = np.add.reduceat(mix(item ^ U(0x3C3C)) * once, cut[:-1][full])
    return out


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, same (a hash of the set of five-word shingles), fp (WORDS longs) and least (DEALS longs) of each row: fingerprints
    of the shingles, and the smallest by DEALS hash functions. Texts without words: zeros."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, most=1 << 20):
            item, row, cut = shingle_rows(batch)
            full = np.flatnonzero(cut[1:] > cut[:-1])
            at, size = cut[:-1][full], np.diff(cut)[full]
            fp = np.zeros((batch.num_rows, WORDS), U)
            least = np.zeros((batch.num_rows, DEALS), U)
            for k in range(WORDS if len(full) else 0):
                h = mix(item ^ U(0xA5A5 + k))
                ones = np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), at, 0, dtype=np.int32)
                fp[full, k] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(U)[:, 0]
            for k in range(DEALS if len(full) else 0):
                least[full, k] = np.minimum.reduceat(mix(item ^ U(0x5A5A + k)), at)
            same = pa.array(set_hashes(item, row, cut).view(np.int64))
            lists = (pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().view(np.int64)), x.shape[1]).cast(pa.list_(pa.int64())) for x in (fp, least))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), same, *lists], ["doc_id", "same", "fp", "least"])
            release()

    return docs_of(docs).mapInArrow(run, "doc_id long, same long, fp array<long>, least array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """same, items (the sorted set of shingles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, most=1 << 20):
            item, row, cut = shingle_rows(batch)
            items = [np.unique(item[a:b]).tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(set_hashes(item, row, cut).view(np.int64)), pa.array(items, pa.binary())], ["same", "items"])
            release()

    return docs_of(docs).mapInArrow(run, "same long, items binary")


def alike(x: np.ndarray, y: np.ndarray, similar: float = SIMILAR) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    if min(len(x), len(y)) < similar * max(len(x), len(y)) or not len(x):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similar * (len(x) + len(y) - both)


def alike_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are alike."""

    def verify(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("items", "others"))
            good = [alike(np.frombuffer(i, U), np.frombuffer(j, U)) for i, j in zip(x, y, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    both = pairs.join(sets.withColumnRenamed("same", "a"), "a").join(sets.select(F.col("same").alias("b"), F.col("items").alias("others")), "b")
    return both.select("a", "b", "items", "others").mapInArrow(verify, "a long, b long")


def rejoined(same: np.ndarray, part: np.ndarray, fp: np.ndarray, items: list[bytes], cross: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links of alike rows within the radius that join different parts (cross: the block of each row, of which only pairs across count)."""
    _, of = np.unique(part, return_inverse=True)
    top, found = list(range(len(of))), []

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    sets = [np.frombuffer(x, U) for x in items]
    for at in range(0, len(same), LEAF):
        close = np.bitwise_count(fp[at : at + LEAF, None] ^ fp[None, at:]).sum(2, dtype=np.int16) <= radius
        close &= of[at : at + LEAF, None] != of[None, at:]
        if cross is not None:
            close &= cross[at : at + LEAF, None] != cross[None, at:]
        for a, b in np.argwhere(np.triu(close, 1)).tolist():
            x, y = root(int(of[at + a])), root(int(of[at + b]))
            if x != y and alike(sets[at + a], sets[at + b]):
                top[max(x, y)] = min(x, y)
                found.append((int(same[at + a]), int(same[at + b])))
    return found


def near_copies(docs: DataFrame, radius: int = NEAR) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its group) of rows with an id: groups of texts whose sets of five-word shingles
    have a Jaccard similarity of 0.8 and more, as far as such links reach.

    Texts of equal sets collapse to one. Fingerprints are dealt to shards by their least shingles, since at this radius no
    distance to a vantage tells most strangers apart; each shard is split by vantages as far as that helps, and returns a forest
    of candidates. Its links are verified on the sets themselves. Where that leaves a group of candidates in several parts,
    the pairs across its parts are verified, too, until the parts are joined or no pair is left; those within its largest part
    are not.
    """
    spark = docs.sparkSession
    fps = written(wide_fingerprints(docs.where("doc_id is not null")), "wide")
    by = F.min_by(F.struct("fp", "least"), "doc_id").alias("by")
    distinct = written(fps.groupBy("same").agg(F.min("doc_id").alias("doc"), by).select("same", "doc", "by.*"), "distinct")
    dealt = distinct.select("same", "fp", F.explode("least").alias("key"))
    large = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LARGE)
    dealt = blocks(dealt.join(large, "key", "left").withColumn("n", F.coalesce("n", F.lit(1))), "same", LARGE // 2).where("n = 1 or lo <> hi")
    dealt = dealt.select("same", "fp", F.when(F.col("n") > 1, F.xxhash64("key", "lo", "hi")).otherwise(F.col("key")).alias("key"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def join(table: pa.Table) -> pa.Table:
        key, same = table.column("key").to_numpy(), table.column("same").to_numpy()
        fp = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(key), -1)
        order = np.argsort(key, kind="stable")
        key, same, fp = key[order], same[order], fp[order]
        cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        ends = []
        for i in np.flatnonzero(np.diff(cut) > 1).tolist():
            a, b = forest(fp[cut[i] : cut[i + 1]], radius)
            ends.append((same[cut[i] + a], same[cut[i] + b]))
        a, b = (np.concatenate(x) if ends else np.zeros(0, np.int64) for x in (zip(*ends, strict=True) if ends else ((), ())))
        return pa.table({"a": a, "b": b})

    found = dealt.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInArrow(lambda t: join(t), "a long, b long")
    found = written(found.distinct(), "candidates")
    groups = written(connected_components(found), "groups")
    chosen = distinct.join(groups.select(F.col("node").alias("same")), "same", "left_semi").select(F.col("doc").alias("doc_id")).distinct()
    sets = written(shingle_sets(docs.join(chosen, "doc_id", "left_semi")).dropDuplicates(["same"]), "sets")
    sure = written(alike_links(found, sets), "sure")
    part = connected_components(sure).withColumnRenamed("root", "part")
    state = written(groups.join(part, "node", "left").select(F.col("node").alias("same"), "root", F.coalesce("part", "node").alias("part")), "parts")
    open_ = state.groupBy("root").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("root")
    rest = blocks_apart(state.join(open_, "root"), "root", "same", "part", BLOCK).join(distinct.select("same", "fp"), "same").join(sets, "same")

    def join_parts(table: pa.Table) -> pa.Table:
        table = table.sort_by([("root", "ascending"), ("lo", "ascending"), ("hi", "ascending")])
        key = np.stack([table.column(c).to_numpy() for c in ("root", "lo", "hi")], 1)
        same, part, own = (table.column(c).to_numpy() for c in ("same", "part", "own"))
        fp = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(key), -1)
        items = table.column("items").to_pylist()
        cut = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(key)).tolist()
        links = []
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            links += rejoined(same[s:e], part[s:e], fp[s:e], items[s:e], own[s:e] if key[s, 1] != key[s, 2] else None, radius)
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    more = rest.groupBy(F.pmod(F.xxhash64("root", "lo", "hi"), F.lit(buckets)).alias("bucket")).applyInArrow(lambda t: join_parts(t), "a long, b long")
    shared = distinct.groupBy("doc").agg(F.min("same").alias("b"), F.count("*").alias("n")).where("n > 1")  # rows of one id
    shared = distinct.join(shared, "doc").select(F.col("same").alias("a"), "b")
    roots = connected_components(sure.unionByName(more).unionByName(shared))
    named = distinct.select("same", "doc").join(roots.withColumnRenamed("node", "same"), "same")
    lead = named.join(named.groupBy("root").agg(F.min("doc").alias("class_id")), "root").select("same", "class_id")
    named = distinct.join(lead, "same", "left").select("same", F.coalesce("class_id", "doc").alias("class_id"))
    return fps.select("doc_id", "same").join(named, "same").select("doc_id", "class_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs that are the first of their group of near copies, each once.

    The first is the row of the smallest id. Rows of one id with different texts, and rows of null ids, are documents of their
    own and come after the others; of equal ones a row stays. Null, empty and blank texts are one group; very long texts
    take part whole; an empty table gives an empty one. Numbers alone are joined to the rows, not texts.
    """
    name = free_name(docs, "number")
    rows = numbered(docs, name)
    gone = near_copies(numbered(docs_of(docs)).select(F.col("doc").alias("doc_id"), "text")).where("doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct()
    return rows.join(gone, name, "left_anti").dropDuplicates([name]).select(*docs.columns)
