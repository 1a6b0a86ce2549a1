"""LM scoring by a hierarchical Pitman-Yor model that spells tokens, beside a smoothed unigram base.

A token's probability is that of its bytes and the byte that ends it, each given the ORDER - 1 bytes before it, over
tokens and their ends alike; so no token is unknown. Each context of k bytes is a restaurant whose parent is the context
of its last k - 1 bytes; contexts that end alike share parents, up to one root. Seating is sampled by Gibbs: all
customers of a dish leave a restaurant and are seated again one after another, given the parent's predictive
probabilities and the other tables, a quarter of a level's dishes at once; new tables are the parent's customers.
Concentrations are drawn given the tables; discounts follow from the dishes of one and of two customers (drawn ones fit the
corpus' repeats, and held-out text worse). Predictive probabilities are averaged over the kept samples.

Documents are dealt to blocks; a block asks once for each of its distinct words and byte strings, with its counts in
training rows, and buckets of keys add the counts up. Distinct byte strings alone go on to the group of their stem (the two
bytes before the last), where the restaurants of two bytes and more are sampled, and come back to the buckets, which answer
the blocks. The restaurants of one byte and the root, at most 65,536 dishes, are sampled on the driver from the groups' sums
of tables, between two rounds over the groups. Nothing that grows with the corpus reaches the driver or is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import docs_of, parts, written
from .textvec import LOWER, SPACE, U, Words, mix, planes, release, row_sums, slices, unplaned, utf8

ORDER = 6
#: Concentration to begin with; sweeps, how many of the first are not kept, and sweeps of the first round over the groups.
THETA, SWEEPS, BURN_IN, FIRST = 1.0, 6, 2, 2
#: Customers up to twice as many as this are seated one by one, then in runs of so small a share of those who sit.
SINGLY = 16
#: Lowest level of a stem's restaurants, and parts of a level's dishes whose customers leave at once.
LOW, PARTS = 2, 4
END = 10
WORD, GRAM = 0, 1
#: Bytes of text that are worked on at once.
SLICE = 1 << 20


def stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (string of ORDER bytes << 16 | row) of every byte to predict: words, one space after each, one end a row."""
    rows, size = len(words.counts), words.ends - words.starts
    byte = np.flatnonzero(np.repeat(True, size.sum()))
    word = np.repeat(np.arange(len(size)), size)
    lead = (words.row[word] + 1) * (ORDER - 1) + words.row[word]
    source = byte - np.repeat(np.cumsum(size) - size, size) + words.starts[word]
    length = size.sum() + len(size) + rows * ORDER
    out = np.full(length, 0x20, np.uint8)
    out[byte + word + lead] = words.buf[source]
    each = row_sums(size, words.first) + words.counts + ORDER
    last = np.cumsum(each) - 1
    out[last] = END
    first = last + 1 - each
    for i in range(ORDER - 1):
        out[first + i] = END
    row = np.repeat(np.arange(rows), each)
    key = np.zeros(max(0, length - ORDER + 1), U)
    for i in range(ORDER):
        key = key << U(8) | out[i : length - ORDER + 1 + i]
    whole = row[: len(key)] == row[ORDER - 1 :][: len(key)]
    key = key[whole] << U(16) | row[: len(whole)][whole].astype(U)
    key.sort()
    return key


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_ = np.concatenate(keys) if keys else np.zeros(0, U)
    distinct, each = np.unique(all_, return_inverse=True)
    return distinct, np.bincount(each, np.concatenate(counts) if counts else None, len(distinct)).astype(np.int64)


def bounded(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Slices of few enough bytes and rows (a row's number has 16 bits)."""
    for batch in slices(iter(table.to_batches()), most=SLICE):
        for at in range(0, batch.num_rows, 1 << 16):
            yield batch.slice(at, 1 << 16)
        release()


def ask(table: pa.Table, buckets: int) -> pa.Table:
    """A block's distinct words and byte strings with their counts in training rows, by bucket."""
    block = table.column("block")[0].as_py()
    found = {WORD: ([], []), GRAM: ([], [])}
    for batch in bounded(table):
        train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        words = Words(batch.column("text"))
        keys, each = np.unique(words.hashes(), return_inverse=True)
        found[WORD][0].append(keys)
        found[WORD][1].append(np.bincount(each, train[words.row], len(keys)))
        key = stream(words)
        gram = key >> U(16)
        at = runs(gram)
        found[GRAM][0].append(gram[at])
        found[GRAM][1].append(np.add.reduceat(train[(key & U(0xFFFF)).astype(np.int64)].astype(np.int64), at) if len(at) else at)
        del words, key, gram, each
        for kind, (keys, counts) in found.items():  # merged as they grow, so that a block is held about once
            if len(keys) > 1 and sum(map(len, keys[1:])) > len(keys[0]):
                found[kind] = tuple([x] for x in summed(keys, counts))
    out = {"block": [], "kind": [], "bucket": [], "keys": [], "counts": []}
    for kind, (keys, counts) in found.items():
        keys, counts = summed(keys, counts)
        bucket = (mix(keys) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(bucket.max(initial=-1) + 2))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            own = order[cut[b] : cut[b + 1]]
            for name, value in (("block", block), ("kind", kind), ("bucket", b), ("keys", planes(keys[own])), ("counts", planes(counts[own].astype(np.int32)))):
                out[name].append(value)
    kinds = {"block": pa.int32(), "kind": pa.int32(), "bucket": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})


def seat(customers: np.ndarray, base: np.ndarray, strength: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers sit down: the next opens a table with odds strength * base : seated - discount * tables.

    Customers are seated one by one up to twice SINGLY, then in runs, within which the odds are held.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    seated, active = 1, np.flatnonzero(customers > 1)
    while len(active):
        step = np.minimum(max(1, seated // SINGLY), customers[active] - seated)
        new = (strength[active] + discount * (tables[active] - 1)) * base[active]
        tables[active] += rng.binomial(step, np.clip(new / (new + seated - discount * tables[active]), 0, 1))
        seated += max(1, seated // SINGLY)
        active = active[customers[active] > seated]
    return tables


def concentration(customers: np.ndarray, tables: np.ndarray, of: np.ndarray, discount: float, theta: float, rng: np.random.Generator) -> float:
    """A draw of a level's concentration (a priori Gamma(1, 1)), given the customers and tables of each dish and its restaurant."""
    c, t = np.bincount(of, customers), np.bincount(of, tables)
    longer = np.cumsum(np.bincount(t.astype(np.int64))[::-1])[::-1][2:]  # restaurants of more than i tables, i = 1, 2, ...
    sits = rng.beta(theta + 1, c[c > 1] - 1)
    old = rng.binomial(longer, theta / (theta + discount * np.arange(1, len(longer) + 1))).sum()
    return float(np.clip(rng.gamma(1 + old, 1 / (1 - np.log(np.maximum(sits, 1e-300)).sum())), 1e-3, 1e4))


def reseated(customers: np.ndarray, tables: np.ndarray, of: np.ndarray, base: np.ndarray, discount: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after one sweep over a level; of: the restaurant of each dish, base: the parents' probabilities."""
    tables = tables.copy()
    total = np.bincount(of, tables) if len(of) else np.zeros(0)
    several = np.flatnonzero(customers > 1)  # one customer has one table
    part = rng.integers(0, PARTS, len(several))
    for k in range(PARTS):
        own = several[part == k]
        if len(own):
            others = total[of[own]] - tables[own]
            new = seat(customers[own].astype(np.int64), base[own], theta + discount * (others + 1), discount, rng)
            total += np.bincount(of[own], new - tables[own], len(total))
            tables[own] = new
    return tables


class Franchise:
    """Restaurants of all contexts of LOW bytes and more, from the counts of byte strings; base: the last byte's probability given
    the one before it, in the restaurants above them. Byte strings of one stem must be complete."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, base: np.ndarray, seed: int):
        self.rng, self.base = np.random.default_rng(seed), base
        self.pairs, self.parent = {}, {}
        keys, self.customers = keys[counts > 0], {ORDER - 1: counts[counts > 0].astype(np.float64)}
        for level in range(ORDER - 1, LOW - 1, -1):
            self.pairs[level] = keys
            keys, self.parent[level] = np.unique(keys & U((1 << 8 * level) - 1), return_inverse=True)
        self.above = keys.astype(np.int64)  # pairs of bytes
        self.contexts, self.of, self.tables, self.discount, self.theta = {}, {}, {}, {}, {}
        for level in range(ORDER - 1, LOW - 1, -1):
            self.contexts[level], self.of[level] = np.unique(self.pairs[level] >> U(8), return_inverse=True)
            c = self.customers[level]
            once, twice = (c == 1).sum(), (c == 2).sum()
            self.discount[level], self.theta[level] = float(np.clip(once / max(1, once + 2 * twice), 0.05, 0.95)), THETA
            self.tables[level] = np.minimum(c, 1)
            self.customers[level - 1] = np.bincount(self.parent[level], self.tables[level], len(self.pairs.get(level - 1, self.above)))
        self._totals()

    def _totals(self):
        self.total = {k: (np.bincount(self.of[k], self.customers[k], len(self.contexts[k])), np.bincount(self.of[k], self.tables[k], len(self.contexts[k]))) for k in self.pairs}

    def predictive(self) -> dict[int, np.ndarray]:
        p = {LOW - 1: self.base[self.above >> 8, self.above & 255]}
        for k in range(LOW, ORDER):
            c, t = (x[self.of[k]] for x in self.total[k])
            d, theta = self.discount[k], self.theta[k]
            p[k] = (self.customers[k] - d * self.tables[k] + (theta + d * t) * p[k - 1][self.parent[k]]) / (theta + c)
        return p

    def sweep(self):
        p = self.predictive()
        for k in range(ORDER - 1, LOW - 1, -1):
            self.tables[k] = np.minimum(self.tables[k], self.customers[k])  # who have changed with the level above
            self.theta[k] = concentration(self.customers[k], self.tables[k], self.of[k], self.discount[k], self.theta[k], self.rng)
            self.tables[k] = reseated(self.customers[k], self.tables[k], self.of[k], p[k - 1][self.parent[k]], self.discount[k], self.theta[k], self.rng)
            self.customers[k - 1] = np.bincount(self.parent[k], self.tables[k], len(p[k - 1]))
        self._totals()

    def places(self, asked: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level, the place of each asked string and of its context; -1: none."""
        found = []
        for k in range(LOW, ORDER):
            own = asked & U((1 << 8 * (k + 1)) - 1)
            both = []
            for table, key in ((self.pairs[k], own), (self.contexts[k], own >> U(8))):
                i = np.minimum(np.searchsorted(table, key), max(0, len(table) - 1))
                both.append(np.where(table[i] == key, i, -1) if len(table) else np.full(len(key), -1))
            found.append(tuple(both))
        return found

    def probability(self, asked: np.ndarray, places) -> np.ndarray:
        last = (asked & U(0xFFFF)).astype(np.int64)
        p = self.base[last >> 8, last & 255]
        for k, (pair, context) in enumerate(places, LOW):
            d, theta, (c, t) = self.discount[k], self.theta[k], self.total[k]
            if not len(c):
                continue
            own = np.where(pair >= 0, self.customers[k][pair] - d * self.tables[k][pair], 0)
            p = np.where(context >= 0, (own + (theta + d * t[context]) * p) / (theta + c[context]), p)
        return p


def averaged(keys: np.ndarray, counts: np.ndarray, base: np.ndarray, seed: int) -> np.ndarray:
    """Probability of the last byte of each key given the bytes before it, averaged over the kept samples."""
    model = Franchise(keys, counts, base, seed)
    places, sum_, kept = model.places(keys), np.zeros(len(keys)), 0
    for i in range(SWEEPS):
        model.sweep()
        if i >= BURN_IN:
            sum_, kept = sum_ + model.probability(keys, places), kept + 1
    return sum_ / kept


def top(customers: np.ndarray, sweeps: int = 8, seed: int = 3) -> np.ndarray:
    """[context byte, byte] -> predictive probability in the restaurants of one byte and their parent, the root, over equal chances,
    from the customers of their dishes (256 x 256), averaged over the later half of the sweeps."""
    rng = np.random.default_rng(seed)
    context, dish = np.nonzero(customers)
    c = customers[context, dish].astype(np.float64)
    tables, root_tables = np.minimum(c, 1), None
    d, theta, d0, theta0, out = 0.5, THETA, 0.5, THETA, np.zeros((256, 256))
    for i in range(sweeps):
        c0 = np.bincount(dish, tables, 256)
        open_ = np.flatnonzero(c0)
        root_tables = np.minimum(c0[open_], 1) if root_tables is None else np.minimum(root_tables, c0[open_])
        none = np.zeros(len(open_), np.int64)
        theta = concentration(c, tables, context, d, theta, rng)
        theta0 = concentration(c0[open_], root_tables, none, d0, theta0, rng)
        root_tables = reseated(c0[open_], root_tables, none, np.full(len(open_), 1 / 256), d0, theta0, rng)
        p0 = np.full(256, (theta0 + d0 * root_tables.sum()) / 256)
        p0[open_] += c0[open_] - d0 * root_tables
        p0 /= theta0 + c0.sum()
        tables = reseated(c, tables, context, p0[dish], d, theta, rng)
        t = np.bincount(context, tables, 256)
        p = (theta + d * t)[:, None] * p0
        p[context, dish] += c - d * tables
        if i >= sweeps // 2:
            out += p / (theta + np.bincount(context, c, 256))[:, None]
    return out / (sweeps - sweeps // 2)


def _columns(table: pa.Table, *names: str) -> list:
    kinds = {"keys": U, "counts": np.int32, "values": np.float32}
    return [[unplaned(x, kinds[n], len(x) // np.dtype(kinds[n]).itemsize) for x in table.column(n).to_pylist()] for n in names]


def _reply(table: pa.Table, asked: list[np.ndarray], keys: np.ndarray, values: np.ndarray, tokens: int = 0, types: int = 0) -> pa.Table:
    """The values of the keys that each row of table asks for; the bucket's sums stand in its first row."""
    n = table.num_rows
    once = lambda x: pa.array([x if i == 0 else 0 for i in range(n)], pa.int64())
    replies = pa.array([planes(values[np.searchsorted(keys, x)]) for x in asked], pa.binary())
    return pa.table({"block": table.column("block"), "kind": table.column("kind"), "keys": table.column("keys"), "values": replies, "tokens": once(tokens), "types": once(types)})


REPLY = "block int, kind int, keys binary, values binary, tokens long, types long"


def count_words(table: pa.Table) -> pa.Table:
    """What a bucket of words answers each block: their counts over all blocks."""
    asked, counts = _columns(table, "keys", "counts")
    keys, total = summed(asked, counts)
    return _reply(table, asked, keys, total, int(total.sum()), int((total > 0).sum()))


def total_grams(table: pa.Table, groups: int) -> pa.Table:
    """A bucket's byte strings and their counts over all blocks, by group: restaurants that hang together have one stem and so one group."""
    keys, total = summed(*_columns(table, "keys", "counts"))
    group = (mix(keys >> U(8) & U(0xFFFF)) % U(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    keys, total, group = keys[order], total[order], group[order]
    cut = np.append(runs(group), len(group)).tolist()
    rows = [(int(group[a]), table.column("bucket")[0].as_py(), planes(keys[a:b]), planes(total[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("stems", "bucket", "keys", "counts"), zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)})


def _of_group(table: pa.Table) -> tuple[int, list[np.ndarray], np.ndarray, np.ndarray]:
    asked = _columns(table, "keys")[0]
    return table.column("stems")[0].as_py(), asked, *summed(asked, [unplaned(x, np.int64, len(x) // 8) for x in table.column("counts").to_pylist()])


def customers_above(keys: np.ndarray, counts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(context byte << 8 | byte, customers) that the restaurants of two bytes send to those of one, after some sweeps."""
    sums = np.bincount((keys & U(0xFFFF)).astype(np.int64), counts, 1 << 16).reshape(256, 256) + 0.1
    model = Franchise(keys, counts, sums / sums.sum(1, keepdims=True), seed)
    for _ in range(FIRST):
        model.sweep()
    return model.above, model.customers[LOW - 1]


def sample_customers(table: pa.Table) -> pa.Table:
    group, _, keys, total = _of_group(table)
    pair, n = customers_above(keys, total, group)
    return pa.table({"pair": pa.array(pair.astype(np.int32)), "n": pa.array(n.astype(np.int64))})


def sample_stems(table: pa.Table, above: np.ndarray) -> pa.Table:
    """(bucket, keys, values): log10 probabilities of the byte strings of a group, from the seating of its restaurants."""
    group, asked, keys, total = _of_group(table)
    logs = np.log10(averaged(keys, total, above, group)).astype(np.float32)
    return pa.table({"bucket": table.column("bucket"), "keys": table.column("keys"), "values": pa.array([planes(logs[np.searchsorted(keys, x)]) for x in asked], pa.binary())})


def reply_grams(asked: pa.Table, model: pa.Table) -> pa.Table:
    keys, values = (np.concatenate(x) if x else np.zeros(0, np.float32) for x in _columns(model, "keys", "values"))
    order = np.argsort(keys)
    return _reply(asked, _columns(asked, "keys")[0], keys[order], values[order])


def look_up(rows: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    own = rows.filter(pa.compute.equal(rows.column("kind"), kind))
    keys, kept = _columns(own, "keys")[0], np.float32 if kind == GRAM else np.int64
    values = [unplaned(x, kept, len(x) // np.dtype(kept).itemsize) for x in own.column("values").to_pylist()]
    if not keys:
        return np.zeros(0, U), np.zeros(0)
    keys, values = np.concatenate(keys), np.concatenate(values).astype(np.float64)
    order = np.argsort(keys)
    return keys[order], values[order]


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: pa.Table, replies: pa.Table, ends: int, tokens: int, types: int) -> pa.Table:
    """Scores of a block's rows from the answers to it."""
    word_keys, word_counts = look_up(replies, WORD)
    gram_keys, gram_logs = look_up(replies, GRAM)
    floor = np.log10(tokens + 0.1 * (types + 1))
    logs = np.log10(word_counts + 0.1)
    out = []
    for batch in bounded(docs):
        words = Words(batch.column("text"))
        keys, each = np.unique(words.hashes(), return_inverse=True)
        at = np.searchsorted(word_keys, keys)
        n = words.counts + 1
        base = row_sums(logs[at][each], words.first) + np.log10(ends + 0.1) - n * floor
        known = row_sums((word_counts[at] > 0)[each].astype(np.int64), words.first) + (ends > 0)
        key = stream(words)
        gram = key >> U(16)
        begin = runs(gram)
        value = np.repeat(gram_logs[np.searchsorted(gram_keys, gram[begin])], np.diff(np.append(begin, len(gram))))
        score = np.bincount((key & U(0xFFFF)).astype(np.int64), value, batch.num_rows)
        out.append(
            pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(base), pa.array(score)],
                [x.split()[0] for x in SCORED.split(", ")],
            )
        )
    return pa.Table.from_batches(out)


def lm_scores(docs: DataFrame, fold: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities) of each row.

    Rows whose crc32(doc_id) mod fold is 0 are held out, the others (null ids too) are trained on. Null or empty text is
    one end token; very long texts are scored whole; repeated rows count as often as they stand there and score alike; an
    empty table gives an empty one; without training rows the base is 0 and bytes are equally likely. Other columns,
    whatever their names, are ignored.
    """
    blocks = parts(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == 0, F.lit(False))
    rows = docs_of(docs).withColumn("held_out", held).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = written(rows.groupBy("block").applyInArrow(lambda t: ask(t, blocks), "block int, kind int, bucket int, keys binary, counts binary"), "asked")
    words, grams = asked.where(F.col("kind") == WORD), asked.where(F.col("kind") == GRAM)
    groups = int(8 * blocks**0.5) + 8
    totals = written(grams.groupBy("bucket").applyInArrow(lambda t: total_grams(t, groups), "stems int, bucket int, keys binary, counts binary"), "totals")
    sent = totals.groupBy("stems").applyInArrow(lambda t: sample_customers(t), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 65,536 sums at most
    customers = np.zeros(1 << 16)
    customers[[r[0] for r in sent]] = [r[1] for r in sent]
    above = top(customers.reshape(256, 256))
    model = totals.groupBy("stems").applyInArrow(lambda t: sample_stems(t, above), "bucket int, keys binary, values binary")
    told = words.groupBy("bucket").applyInArrow(lambda t: count_words(t), REPLY)
    told = told.unionByName(grams.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(lambda a, b: reply_grams(a, b), REPLY))
    told = written(told, "answers")
    tokens, types = told.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    ends = rows.where("not held_out").count()
    tokens, types = tokens + ends, types + (ends > 0)
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda a, b: scored(a, b, ends, tokens, types), SCORED)


def perplexity(scores: DataFrame, column: str = "score") -> DataFrame:
    """held_out, tokens, perplexity a token."""
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens")).alias("perplexity"))
