"""Ranked lexical search over inverted treaps.

Documents are cut into shards where they are read. A shard has a treap for each term asked for: its postings in order of
doc_id are the search order, and their impacts (what the term adds to the document's score) are the heap order. Queries go
down the treaps of all their terms at once, range of documents by range: the roots' impacts in a range add up to a bound on
the scores in it; where that can't enter the query's best k any more, the range is dropped with all that hangs below it. Else
the document of the greatest root is scored and parts the range in two. Short ranges are scored as a whole. So each shard
gives its exact best k, and the best k of those are the answer.

Postings hold the terms of a block of queries and no others; blocks are bounded by the bytes of their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import docs_of, written
from .textvec import PUNCT, Words, release, slices

TOP = 10
#: Bytes of query texts that are worked on at once: they and the statistics of their terms go to every task.
BLOCK_BYTES = 4 << 20
#: Postings of a shard; documents of a range that is scored as a whole; terms of ranges that are looked at at once.
SHARD, RANGE, CELLS = 2_000_000, 64, 200_000

_PACKED = "docs array<long>, sizes binary, counts binary, terms binary, times binary"


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray, Words]:
    """Distinct terms (runs of ASCII letters, digits and other characters beyond ASCII; A-Z in lower case), the number of each place's, and the places."""
    words = Words(column, breaks=PUNCT)
    return *words.distinct(), words


def index(docs: DataFrame, asked: pa.Array) -> DataFrame:
    """Packed rows of documents: ids, terms with repeats, and the numbers in `asked` of the terms that each holds, with how often."""
    many = max(1, len(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, number, words = terms(batch.column("text"))
            known = pc.fill_null(pc.index_in(found, value_set=asked.cast(found.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = known[number] if len(number) else np.zeros(0, np.int64)
            cells, times = np.unique((words.row * many + known)[known >= 0], return_counts=True)
            counts = np.bincount(cells // many, minlength=batch.num_rows)
            blobs = [words.counts.astype(np.int64), counts.astype(np.int32), (cells % many).astype(np.int32), times.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], [x.split()[0] for x in _PACKED.split(", ")])
        release()

    return docs.mapInArrow(run, _PACKED)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    kinds = {"sizes": np.int64, "counts": np.int32, "terms": np.int32, "times": np.int32}
    for batch in batches:
        for row in batch.to_pylist():
            yield {"docs": row["docs"]} | {k: np.frombuffer(row[k], v) for k, v in kinds.items()}


def statistics(packed: DataFrame, many: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms with repeats, and for each of `many` terms the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full, all_ = np.zeros(many, np.int64), 0, 0
        for row in _unpacked(batches):
            held += np.bincount(row["terms"], minlength=many)
            full += int((row["sizes"] > 0).sum())
            all_ += int(row["sizes"].sum())
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-2, -1], at), pa.int64()), pa.array(np.append([full, all_], held[at]), pa.int64())], ["term", "n"])

    held = np.zeros(many + 2, np.int64)
    for r in packed.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term of the block
        held[r.term] = r.n
    return int(held[-2]), int(held[-1]), held[:many]


def weights(n: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(df) + 1))) for df in held], np.int64)


def _greater(rank: np.ndarray, first: np.ndarray, step: int) -> np.ndarray:
    """The nearest place before (step -1) or behind (1) in the same treap with a greater rank, or -1: links that skip smaller
    places are followed together, which doubles what they skip."""
    at = np.arange(len(rank)) + step
    at[first if step < 0 else np.append(first[1:], len(rank)) - 1] = -1
    low = np.flatnonzero(at >= 0)
    while len(low):
        low = low[rank[at[low]] < rank[low]]
        at[low] = at[at[low]]
        low = low[at[low] >= 0]
    return at


class Shard:
    """The treaps of some documents: root of each term, left and right of each posting."""

    def __init__(self, rows: list[dict], weight: np.ndarray, n: int, all_: int):
        """rows: of `index`; n, all_: documents with a term and their terms, in all shards."""
        ids = [d for row in rows for d in row["docs"]]
        null = np.array([d is None for d in ids], bool)
        ids = np.array([0 if d is None else d for d in ids], np.int64)
        size, count = (np.concatenate([row[k] for row in rows]) for k in ("sizes", "counts"))
        term, times = (np.concatenate([row[k] for row in rows]).astype(np.int64) for k in ("terms", "times"))
        order = np.lexsort((ids, null))  # null ids come last
        self.ids, self.null = ids[order], null[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(np.arange(len(ids)), count)
        m = 10 + 90 * size[doc] * n // max(all_, 1)
        impact = weight[term] * (1_000_000_000 * times // (1000 * times + 8 * m))
        self.width = len(ids)
        key = term * self.width + place[doc]
        keep = np.flatnonzero(impact > 0)
        keep = keep[np.argsort(key[keep])]
        self.key, self.impact = key[keep], np.append(impact[keep], 0)
        self._grow()

    def _grow(self) -> None:
        p = len(self.key)
        term = self.key // self.width if p else self.key
        self.doc = np.append(self.key - term * self.width, -1)
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if p else np.zeros(0, np.int64)
        rank = np.empty(p, np.int64)
        rank[np.lexsort((-np.arange(p), self.impact[:p]))] = np.arange(p)  # of equal impacts the first is the greater
        before, behind = _greater(rank, first, -1), _greater(rank, first, 1)
        under = (before >= 0) & ((behind < 0) | (rank[before] < rank[behind]))
        self.left, self.right = np.full(p + 1, -1), np.full(p + 1, -1)
        self.right[before[under]] = np.flatnonzero(under)
        over = ~under & (behind >= 0)
        self.left[behind[over]] = np.flatnonzero(over)
        top = np.flatnonzero((before < 0) & (behind < 0))
        self.roots = dict(zip(term[top].tolist(), top.tolist(), strict=True))

    def scores(self, query: np.ndarray, doc: np.ndarray, of: list[np.ndarray]) -> np.ndarray:
        """Exact scores of documents for queries, by looking each term of the query up in its treap's search order."""
        size = np.array([len(of[q]) for q in query], np.int64)
        key = np.concatenate([of[q] for q in query]) * self.width + np.repeat(doc, size) if len(query) else np.zeros(0, np.int64)
        at = np.searchsorted(self.key, key)
        hit = (at < len(self.key)) & (self.key[np.minimum(at, len(self.key) - 1)] == key)
        out = np.zeros(len(query), np.int64)
        np.add.at(out, np.repeat(np.arange(len(query)), size)[hit], self.impact[at[hit]])
        return out

    def search(self, queries: list[np.ndarray], top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of the best `top` documents of each query with a score above 0; of equal ones the first."""
        of = [np.array([t for t in q.tolist() if t in self.roots], np.int64) for q in queries]
        best = Best(len(queries), top)
        asked = [q for q in range(len(of)) if len(of[q])]
        if not asked:
            return best.found()
        node = np.concatenate([[self.roots[t] for t in of[q].tolist()] for q in asked])
        size = np.array([len(of[q]) for q in asked])
        self._score(np.repeat(asked, size), self.doc[node], of, best)  # the documents of all roots, for a first threshold
        n = len(asked)
        todo = [(np.array(asked), np.zeros(n, np.int64), np.full(n, self.width - 1), size, node)]
        while todo:
            held, parts = 0, []
            while todo and held < CELLS:
                parts.append(todo.pop())
                held += len(parts[-1][4])
            for part in _cut(tuple(np.concatenate(x) for x in zip(*parts, strict=True))):
                todo += self._step(*part, of, best)
        return best.found()

    def _score(self, query: np.ndarray, doc: np.ndarray, of: list[np.ndarray], best: Best) -> None:
        pair = np.unique(query * self.width + doc)
        query, doc = pair // self.width, pair % self.width
        best.add(query, doc, self.scores(query, doc, of))

    def _step(self, query: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: np.ndarray, node: np.ndarray, of: list[np.ndarray], best: Best) -> list[tuple]:
        """Ranges lo..hi of documents with the roots (size of them each) of their queries' treaps in them: what remains of them."""
        begin = np.cumsum(size) - size
        impact = self.impact[node]
        bound = np.add.reduceat(impact, begin)
        good = best.may_enter(query, bound, lo)
        whole = good & (hi - lo < RANGE)
        if whole.any():
            cell = np.repeat(whole, size)
            self._scan(query[whole], lo[whole], hi[whole], size[whole], node[cell], best)
        good &= ~whole
        if not good.any():
            return []
        cell = np.repeat(good, size)
        query, lo, hi, size, node, impact = query[good], lo[good], hi[good], size[good], node[cell], impact[cell]
        begin, state = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        most = np.flatnonzero(impact == np.maximum.reduceat(impact, begin)[state])
        split = self.doc[node[most[np.append(True, state[most[1:]] != state[most[:-1]])]]]
        self._score(query, split, of, best)
        out = []
        for left in (True, False):
            a, b = (lo, split - 1) if left else (split + 1, hi)
            at, out_of = node.copy(), np.arange(len(node))
            while len(out_of):  # down to the root of what lies in the range
                doc = self.doc[at[out_of]]
                high, low = out_of[doc > b[state[out_of]]], out_of[doc < a[state[out_of]]]
                at[high], at[low] = self.left[at[high]], self.right[at[low]]
                out_of = np.concatenate([high, low])
                out_of = out_of[at[out_of] >= 0]
            stays = at >= 0
            many = np.bincount(state[stays], minlength=len(size))
            some = many > 0
            if some.any():
                out.append((query[some], a[some], b[some], many[some], at[stays]))
        return out

    def _scan(self, query: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: np.ndarray, node: np.ndarray, best: Best) -> None:
        """Scores of all documents of short ranges: sums over their postings, which stand side by side."""
        state = np.repeat(np.arange(len(size)), size)
        base = self.key[node] - self.doc[node]
        from_, to = np.searchsorted(self.key, base + lo[state]), np.searchsorted(self.key, base + hi[state], "right")
        n = to - from_
        at = np.arange(int(n.sum())) + np.repeat(from_ - (np.cumsum(n) - n), n)
        state = np.repeat(state, n)
        sums = np.zeros(len(size) * RANGE, np.int64)
        np.add.at(sums, state * RANGE + self.doc[at] - lo[state], self.impact[at])
        hit = np.flatnonzero(sums)
        best.add(query[hit // RANGE], lo[hit // RANGE] + hit % RANGE, sums[hit])


def _cut(part: tuple) -> Iterator[tuple]:
    """Ranges in runs of at most CELLS roots, so that a wave's arrays are bounded."""
    query, lo, hi, size, node = part
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + CELLS, "right")))
        yield query[at:to], lo[at:to], hi[at:to], size[at:to], node[before : int(ends[to - 1])]
        at = to


class Best:
    """The best k documents of each query so far."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.rows = np.zeros((3, 0), np.int64)  # query, document, score
        self.bar, self.last = np.zeros(queries, np.int64), np.full(queries, np.iinfo(np.int64).max)

    def may_enter(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a document from `doc` on, with that score at most, could be one of the best."""
        return (score > self.bar[query]) | (score == self.bar[query]) & (doc < self.last[query]) & (score > 0)

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        good = self.may_enter(query, score, doc)
        if not good.any():
            return
        rows = np.concatenate([self.rows, np.stack([query[good], doc[good], score[good]])], 1)
        rows = rows[:, np.lexsort((rows[1], -rows[2], rows[0]))]
        again = np.append(False, (rows[:, 1:] == rows[:, :-1]).all(0))
        rows = rows[:, ~again]
        begin = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
        place = np.arange(rows.shape[1]) - np.repeat(begin, np.diff(np.append(begin, rows.shape[1])))
        full = place == self.top - 1
        self.rows = rows[:, place < self.top]
        self.bar[rows[0, full]], self.last[rows[0, full]] = rows[2, full], rows[1, full]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(self.rows)


def best_of_shards(packed: DataFrame, queries: list[np.ndarray], weight: np.ndarray, n: int, all_: int, top: int, shard: int = SHARD) -> DataFrame:
    """(query, doc_id, score) of the best `top` of each shard: packed rows of a partition, until they hold `shard` postings."""
    schema = "query long, doc_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows: list[dict]) -> pa.RecordBatch:
            found = Shard(rows, weight, n, all_)
            query, doc, score = found.search(queries, top)
            release()
            return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(found.ids[doc], pa.int64(), mask=found.null[doc]), pa.array(score, pa.int64())], ["query", "doc_id", "score"])

        rows, held = [], 0
        for row in _unpacked(batches):
            rows.append(row)
            held += len(row["terms"])
            if held >= shard:
                yield answer(rows)
                rows, held = [], 0
        if rows:
            yield answer(rows)

    return packed.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score of the `top` documents for each row of items (item_id, text) with a score above 0.

    Null and empty texts hold no term: such documents aren't found, such items find nothing. Of equal scores the smaller
    doc_id comes first, null ids last; rows of one id are documents of their own, equal rows of items items of their own (their
    answers are alike). Very long texts are indexed whole. Without documents or items there are no rows. Other columns, whatever
    their names, are left behind. Items are worked on in blocks by the bytes of their texts; each reads the documents again.
    """
    docs = docs_of(docs)
    asked = written(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()  # a block, bounded by its bytes
        found, number, words = terms(pa.array([r.text for r in rows], pa.string()))
        queries = [np.unique(number[words.first[i] : words.first[i + 1]]).astype(np.int64) for i in range(len(rows))]
        packed = written(index(docs, found), "postings")
        n, all_, held = statistics(packed, len(found))
        best = best_of_shards(packed, queries, weights(n, held), n, all_, top, shard)
        named = docs.sparkSession.createDataFrame([(i, r.item, r.item_id) for i, r in enumerate(rows)], f"query long, item long, item_id {dict(asked.dtypes)['item_id']}")
        best = best.join(F.broadcast(named), "query").drop("query")  # a row an item of the block
        out = best if out is None else out.unionByName(best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    cut = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return f"""
        with items as (select row_number() over () as item, item_id, text from benchmark), asked as (select distinct item, item_id, {cut} as term from items),
        docs as (select row_number() over () as d, doc_id, text from documents), places as (select d, doc_id, {cut} as term from docs),
        sizes as (select d, count(*)::bigint as n from places group by d), total as (select count(*)::bigint as docs, sum(n)::bigint as terms from sizes),
        times as (select d, any_value(doc_id) as doc_id, term, count(*)::bigint as tf from places where term in (select term from asked) group by d, term),
        weight as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from times, total group by term),
        impact as (select d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) as x from times join weight using (term) join sizes using (d), total),
        scored as (select item, item_id, d, any_value(doc_id) as doc_id, sum(x)::bigint as score from asked join impact using (term) group by item, item_id, d),
        ranked as (select *, row_number() over (partition by item order by score desc, doc_id) as rank from scored where score > 0)
        select item_id, rank::int as rank, doc_id, score from ranked where rank <= {TOP}
    """
