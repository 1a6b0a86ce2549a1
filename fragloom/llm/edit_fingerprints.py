"""Document fingerprints by a randomised edit embedding.

A walk over the characters of a text shows the character it stands on at each step and then goes on or stays, by a random
bit that all texts share for that step and character. Texts at a small edit distance show strings at a small Hamming
distance: after an edit the walks soon stand on the same character again. A fingerprint samples the walk at a grid of
steps, one hex digit (a hash of the characters from there) a step. The grid's width doubles with the text's length class,
so that grids of two classes are nested and any two fingerprints can be compared.

Near pairs come from banding: digits at sampled grid places make keys, and the likeness of whole fingerprints verifies
documents that share one. First all of a key are compared with its smallest, which joins a group of copies at a link each;
where that leaves several parts of a key, the pairs across its parts are compared, too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import blocks_apart, docs_of, parts, written
from .textvec import U, mix, release, slices

#: Steps of a walk: three times the upper bound of the length class; grid places of a walk; the least class (2 ** 8 characters).
LENGTHS, PLACES, LEAST = 3, 192, 8
#: Steps that one table look-up makes, and the look-up tables after which the shared bits repeat.
HOP, TABLES = 4, 64
#: Bands; digits that a band samples from the first and the second half of SPAN places; likeness of near fingerprints.
BANDS, DIGITS, SPAN, NEAR = 16, (5, 3), 128, 0.8
#: A text of so many times its class's most digits may have a near one in the next class.
UPWARD = 0.65
#: Rows of a block of a key whose parts are compared.
BLOCK = 1_024
#: Bytes of text whose walks go on together (and as many of edited texts): about 25 bytes of memory for each.
SLICE = 2 << 20
_PAD = ord(".")


def _hops(seed: int = 20) -> np.ndarray:
    """[table, four characters of 16 kinds] -> how far a walk gets in four steps, from one random bit a step and kind."""
    bits = np.random.default_rng(seed).integers(0, 2, (TABLES, HOP, 16), dtype=np.uint8)
    code = np.arange(1 << 4 * HOP)
    far = np.zeros((TABLES, len(code)), np.uint8)
    for step in range(HOP):
        kind = code >> 4 * far & 15 if step else np.broadcast_to(code & 15, far.shape)
        far += np.take_along_axis(bits[:, step], kind, 1)
    return far


_FAR: np.ndarray | None = None


def _mix32(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    return h


def fingerprints_of(texts: list[np.ndarray]) -> list[str]:
    """Fingerprints of texts given as code points: class (two hex digits), then a digit for each grid place before the end."""
    global _FAR
    if _FAR is None:
        _FAR = _hops().reshape(-1)
    n = np.array([len(t) for t in texts], np.int64)
    pad = np.zeros(16, np.uint32)
    flat = np.concatenate([x for t in texts for x in (t, pad)]) if texts else pad
    base = np.cumsum(n + 16) - n - 16
    h = _mix32(flat + np.uint32(0x51ED2701))
    kind = (h & np.uint32(15)).astype(np.uint16)
    code = kind.copy()
    for i in range(1, HOP):
        code[:-i] |= kind[i:] << np.uint16(4 * i)
    shown = h.copy()  # a hash of eight characters
    for i in range(1, 8):
        shown[:-i] += h[i:] * np.uint32(2 * i * 0x9E3779B9 + 1 & 0xFFFFFFFF)
    digit = np.frombuffer(b"0123456789abcdef", np.uint8)[_mix32(shown) >> np.uint32(28)]
    del h, shown, kind, flat
    level = np.maximum(LEAST, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    out = np.full((len(texts), PLACES), _PAD, np.uint8)
    order = np.argsort(-level, kind="stable")
    at, end = base[order].astype(np.int32), (base + n)[order].astype(np.int32)
    every = (1 << level[order]) * LENGTHS // PLACES // HOP  # hops between grid places
    code32, live, hop = code.astype(np.int32), len(order), 0
    total = every * PLACES
    index, move = np.empty(len(at), np.int32), np.empty(len(at), np.uint8)
    every_list, total_list = every.tolist(), total.tolist()
    groups = sorted({e: (int(np.searchsorted(-every, -e, "left")), int(np.searchsorted(-every, -e, "right"))) for e in set(every_list)}.items())
    while live and hop < total_list[0]:
        for e, (lo, hi) in groups:
            if hop % e:
                break
            hi = min(hi, live)
            if lo < hi and hop // e < PLACES:
                here, rows = at[lo:hi], order[lo:hi]
                inside = here < end[lo:hi]
                out[rows[inside], hop // e] = digit[here[inside]]
        pos, ix, mv = at[:live], index[:live], move[:live]
        np.take(code32, pos, out=ix)
        ix += (hop % TABLES) << 4 * HOP
        np.take(_FAR, ix, out=mv)
        pos += mv
        np.minimum(pos, end[:live], out=pos)
        hop += 1
        while live and (hop >= total_list[live - 1]):
            live -= 1
        if hop % 64 == 0 and live and (at[:live] >= end[:live]).all():
            break
    return [f"{lv:02x}" + row.tobytes().decode().rstrip(".") for lv, row in zip(level.tolist(), out, strict=True)]


def likeness(a: str, b: str) -> float:
    """Share of equal digits at the grid places that both walks have or one has, less what chance gives; 0 to 1."""
    if a == b:
        return 1.0
    if int(a[:2], 16) < int(b[:2], 16):
        a, b = b, a
    apart = int(a[:2], 16) - int(b[:2], 16)
    x = np.frombuffer(a[2:].encode(), np.uint8)
    y = np.frombuffer(b[2:].encode(), np.uint8)[:: 1 << min(apart, 30)]
    n = max(len(x), len(y))
    if not n:
        return 0.0
    m = min(len(x), len(y))
    equal = int((x[:m] == y[:m]).sum())
    return float(max(0.0, (equal - m / 16) / (n - m / 16)))


def _points(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in column.to_pylist()]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row; null text counts as empty, whose fingerprint has no digit."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, most=SLICE):
            texts = _points(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(fingerprints_of(texts), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs_of(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in COMPARED.split(", ")]
#: Rows of ranges: compared ones, and one for each range, whose last text waits for the next range's first.
_RANGED = COMPARED + ", from long, first string, last string"


def _compare(ids: list, texts: list[np.ndarray], after: list[np.ndarray]) -> list[pa.Array]:
    """Columns of COMPARED for documents and the texts that follow them."""
    edited = []
    for t, u in zip(texts, after, strict=True):
        half = len(t) // 2
        edited.append(np.concatenate([t[: len(t) - half], u[:half]]))
    once = {id(t): t for t in (*texts, *after)}  # the text after a document is mostly the next document's own
    made = fingerprints_of([*once.values(), *edited])
    of = dict(zip(once, made, strict=False))
    own, new, next_ = [of[id(t)] for t in texts], made[len(once) :], [of[id(t)] for t in after]
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
        pa.array(own, pa.string()),
        pa.array(new, pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, new, strict=True)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, next_, strict=True)], pa.float64()),
    ]


def _text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row's text and of its edited text, and their likeness to the row's own and the next row's.

    Rows follow one another in descending doc_id (rows of equal id by their text, descending; null ids last), and the
    first follows the last. Texts are shuffled once, into ranges of ids, which are sorted on disk and read slice by slice.
    What a range's last row needs, the first text of the next range, is joined afterwards: a row for each range.
    """
    spark = docs.sparkSession
    rows = docs_of(docs).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "doc_id", "text")
    ranged = rows.repartitionByRange(max(1, parts(docs)), F.desc("id")).sortWithinPartitions(F.desc("id"), F.desc("text"))
    names = [x.split()[0] for x in _RANGED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        ids, texts, from_, first = [], [], None, ""
        for batch in slices(batches, most=SLICE):
            if from_ is None:
                from_, first = batch.column("id")[0].as_py(), batch.column("text")[0].as_py()
            ids += batch.column("doc_id").to_pylist()
            texts += _points(batch.column("text"))
            if len(ids) > 1:
                none = [pa.nulls(len(ids) - 1, k) for k in (pa.int64(), pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([*_compare(ids[:-1], texts[:-1], texts[1:]), *none], names)
                ids, texts = ids[-1:], texts[-1:]
            release()
        if ids:
            none = [pa.nulls(1, k) for k in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *none, pa.array([from_]), pa.array([first]), pa.array([_text(texts[0])])], names)

    made = written(ranged.mapInArrow(run, _RANGED), "ranges")
    ends = made.where("first is not null")
    order = sorted((r[0] for r in ends.select("from").collect()), reverse=True)  # a number for each range
    if not order:
        return spark.createDataFrame([], COMPARED)
    after = spark.createDataFrame(list(zip(order, [*order[1:], order[0]], strict=True)), "from long, to long")
    ends = ends.select("from", "doc_id", "last").join(after, "from").join(ends.select(F.col("from").alias("to"), "first"), "to")

    def finish(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "last", SLICE):
            yield pa.RecordBatch.from_arrays(_compare(batch.column("doc_id").to_pylist(), _points(batch.column("last")), _points(batch.column("first"))), _NAMES)

    return made.where("first is null").select(*_NAMES).unionByName(ends.select("doc_id", "last", "first").mapInArrow(finish, COMPARED))


def grid_of(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Class of each fingerprint, and its digits in a row of twice as many places as a walk has."""
    grid = np.full((len(prints), 2 * PLACES), _PAD, np.uint8)
    for i, p in enumerate(prints):
        grid[i, : len(p) - 2] = np.frombuffer(p[2:].encode(), np.uint8)
    return np.array([int(p[:2], 16) for p in prints], np.int64), grid


def band_keys(prints: list[str], bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): hashes of the digits at each band's places, for a fingerprint's own class and, where it may have a near text of
    the next class, for that one.

    Classes are those of length, whose grids are nested; the least class, whose texts may have few digits, is parted by
    their number, and places stand closer together in smaller parts. Places past the end count as such, so two near texts
    agree there.
    """
    picks = np.random.default_rng(5)
    places = [np.concatenate([picks.choice(SPAN // 2, n, replace=False) + half * (SPAN // 2) for half, n in enumerate(DIGITS)]) for _ in range(bands)]
    level, grid = grid_of(prints)
    digits, top = (grid != _PAD).sum(1), SPAN.bit_length() - 1
    part = np.where(level > LEAST, top, np.clip(np.ceil(np.log2(np.maximum(digits, 1))), 3, top)).astype(np.int64)
    rows, whole = np.arange(len(prints)), part == top
    ups = rows[digits >= UPWARD * (1 << part)]
    found = []
    for own, lv, pt, step in ((rows, level, part, np.ones_like(part)), (ups, level + whole, np.where(whole, part, part + 1), 1 + whole)):
        lv, pt, step = (x[own] for x in (lv, pt, step))
        for b, at in enumerate(places):
            h = mix((lv << 16 | pt << 8 | b).astype(U))
            for p in at.tolist():
                h = mix(h ^ grid[own, (p >> (top - pt)) * step].astype(U))
            found.append((own, h))
    return np.concatenate([x for x, _ in found]), np.concatenate([h for _, h in found])


def joined(ids: np.ndarray, part: np.ndarray, prints: list[str], cross: np.ndarray | None, near: float) -> list[tuple[int, int]]:
    """Links of near fingerprints of a key that join different parts (cross: the block of each row, of which only pairs across count)."""
    _, of = np.unique(part, return_inverse=True)
    level, grid = grid_of(prints)
    found = []
    for i in range(len(prints) - 1):
        for apart in (-1, 0, 1):
            at = i + 1 + np.flatnonzero((of[i + 1 :] != of[i]) & (level[i + 1 :] == level[i] + apart))
            if cross is not None:
                at = at[cross[at] != cross[i]]
            if not len(at):
                continue
            x, y = grid[i : i + 1], grid[at]
            x, y = x[:, :: 2 if apart == 1 else 1], y[:, :: 2 if apart == -1 else 1]
            wide = min(x.shape[1], y.shape[1])
            x, y = x[:, :wide], y[:, :wide]
            has, have = x != _PAD, y != _PAD
            m, n = np.minimum(has.sum(1), have.sum(1)), np.maximum(has.sum(1), have.sum(1))
            close = ((x == y) & has).sum(1) - m / 16 >= near * (n - m / 16) - 1e-9
            for j in at[close].tolist():
                if of[i] != of[j] and likeness(prints[i], prints[j]) >= near:
                    of[of == of[j]] = of[i]
                    found.append((int(ids[i]), int(ids[j])))
    return found


def near_classes(prints: DataFrame, near: float = NEAR, bands: int = BANDS) -> DataFrame:
    """fingerprint, class_id (smallest doc_id): classes of fingerprints (doc_id, fingerprint) linked by banding and verified.

    Copies collapse to one fingerprint first. Of a key, all are compared with the smallest, and where several parts are
    left, the rows outside the largest part with all others, in blocks; so any two near fingerprints that share a key are linked. Bands carry hashes of
    fingerprints; the fingerprints themselves join the pairs that are left.
    """
    spark = prints.sparkSession
    distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc")).withColumn("id", F.xxhash64("fingerprint")), "distinct")

    def keyed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            row, key = band_keys(batch.column("fingerprint").to_pylist(), bands)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(key.view(np.int64))], ["id", "key"])

    cut = distinct.where(F.length("fingerprint") > 2).select("id", "fingerprint").mapInArrow(keyed, "id long, key long")
    least = cut.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    shared = written(cut.join(least, "key"), "keys")
    texts = distinct.select("id", "fingerprint")
    pairs = shared.where("id <> least").select("id", "least").distinct()
    pairs = pairs.join(texts, "id").join(texts.select(F.col("id").alias("least"), F.col("fingerprint").alias("first")), "least")

    def verify(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            a, b = batch.column("fingerprint").to_pylist(), batch.column("first").to_pylist()
            yield batch.filter(pa.array([likeness(x, y) >= near for x, y in zip(a, b, strict=True)], pa.bool_())).select(["a", "b"])

    links = written(pairs.select(F.col("id").alias("a"), F.col("least").alias("b"), "fingerprint", "first").mapInArrow(verify, "a long, b long"), "links")
    part = connected_components(links).select(F.col("node").alias("id"), F.col("root").alias("part"))
    state = written(shared.join(part, "id", "left").select("key", "id", "n", F.coalesce("part", "id").alias("part")), "parts")
    open_ = state.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    rest = blocks_apart(state.join(open_, "key"), "key", "id", "part", BLOCK).join(texts, "id")
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("lo", "ascending"), ("hi", "ascending")])
        key = np.stack([table.column(c).to_numpy() for c in ("key", "lo", "hi")], 1)
        ids, part_, own = (table.column(c).to_numpy() for c in ("id", "part", "own"))
        prints_ = table.column("fingerprint").to_pylist()
        at = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(key)).tolist()
        found = []
        for s, e in zip(at[:-1], at[1:], strict=True):
            found += joined(ids[s:e], part_[s:e], prints_[s:e], own[s:e] if key[s, 1] != key[s, 2] else None, near)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    more = rest.groupBy(F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(buckets)).alias("bucket")).applyInArrow(lambda t: join(t), "a long, b long")
    roots = connected_components(links.unionByName(more))
    named = roots.withColumnRenamed("node", "id").join(distinct.select("id", "doc"), "id")
    lead = named.join(named.groupBy("root").agg(F.min("doc").alias("class_id")), "root").select("id", "class_id")
    return distinct.join(lead, "id", "left").select("fingerprint", F.coalesce("class_id", "doc").alias("class_id"))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """COMPARED and class_id of each row.

    Null or empty text: no characters, an empty edited text, fingerprints without digits, likeness 1 to another empty text
    and 0 to others, a class of their own. A single row follows itself. Repeated rows have equal fingerprints, and rows of
    one id follow one another by their texts; null ids come last and name no class that has another id; very long texts walk
    to their end; an empty table gives an empty one; other columns, whatever their names, are ignored.
    """
    rows = written(compared_with_next(docs), "fingerprints")
    return rows.join(near_classes(rows.select("doc_id", "fingerprint")), "fingerprint").select(*_NAMES, "class_id")
