"""Toxicity by non-negative positive-unlabelled learning on hashed words.

Confirmed toxic documents are the positives P; documents of the labelled table, whatever their labels, are the unlabelled
U. With the class prior p, the risk of a classifier g under the logistic loss l is
p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]): the negatives' part is what U has beyond the positives in it; where it
falls below zero (overfitting), a step goes back along its gradient alone. The prior is estimated from P and U, too: of a
classifier of P against U, the top scores hold hardly anything but positives, so there U's share is p times P's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import docs_of
from .textvec import PUNCT, U, Words, slices

BITS = 20
#: Bounds of the training sample: confirmed toxic documents, and documents of the labelled table, with the smallest hashes of their ids.
POSITIVES, UNLABELLED = 4_000, 12_000
#: Words whose rates in P and U differ by so many standard errors become features, the most different first.
DEVIATIONS, FEATURES = 4.5, 4_096
ROUNDS, RATE, DECAY = 800, 0.05, 3e-5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by hashed word; 0: not a feature
    bias: float

    def scores(self, words: Words) -> np.ndarray:
        h = (words.hashes() & U((1 << BITS) - 1)).astype(np.int64)
        used = self.weights[h] != 0
        key = np.unique(words.row[used] << BITS | h[used])
        g = np.bincount(key >> BITS, self.weights[key & (1 << BITS) - 1], len(words.counts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -60, 60)))


def train(rows: list[np.ndarray], positive: np.ndarray) -> Model:
    """A model from the distinct hashed words of each row and which rows are positive; the others are unlabelled."""
    if not positive.any() or positive.all():
        return Model(np.zeros(1 << BITS), 60.0 if positive.any() else -60.0)
    even = np.zeros(len(rows), bool)  # every second row of P and of U
    for side in (positive, ~positive):
        even[np.flatnonzero(side)[::2]] = True
    scores = np.zeros(len(rows))
    for learnt in (even, ~even):  # a row's score comes from the half that it isn't in
        half = descend([rows[i] for i in np.flatnonzero(learnt).tolist()], positive[learnt], None)
        scores[~learnt] = [half.weights[rows[i]].sum() + half.bias for i in np.flatnonzero(~learnt).tolist()]
    model = descend(rows, positive, share_in(scores[positive], scores[~positive]))
    return model if model.weights.any() else Model(model.weights, -60.0)  # no word tells them apart


def share_in(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in u: the least ratio of the tails of u's and p's scores, each with a standard error so that short tails count less."""
    bars = np.unique(p)
    tail = lambda x: 1 - np.searchsorted(np.sort(x), bars, "left") / len(x)
    in_p, in_u = tail(p), tail(u)
    best = int(np.argmin((in_u + np.sqrt(in_u / len(u)) + in_u / np.sqrt(in_p * len(p))) / in_p))
    return float(np.clip(in_u[best] / in_p[best], 1e-4, 0.95))


def descend(rows: list[np.ndarray], positive: np.ndarray, prior: float | None) -> Model:
    """A linear model of least risk, with the share of positives in U; None: of P against U, both of equal weight."""
    weights = np.zeros(1 << BITS)
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    flat, size = np.concatenate(rows), np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), size)
    in_p = np.bincount(flat[positive[row]], minlength=1 << BITS)
    in_u = np.bincount(flat[~positive[row]], minlength=1 << BITS)
    rate = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = np.abs(in_p / max(1, n_p) - in_u / max(1, n_u)) / np.sqrt(rate * (1 - rate) * (1 / max(1, n_p) + 1 / max(1, n_u)))
    chosen = np.argsort(-z, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[z[chosen] >= DEVIATIONS])
    column = np.full(1 << BITS, -1)
    column[chosen] = np.arange(len(chosen))
    keep = column[flat] >= 0
    row, col = row[keep], column[flat[keep]]
    p, u = positive / max(1, n_p), ~positive / max(1, n_u)
    w, bias = np.zeros(len(chosen)), float(np.log(prior / (1 - prior))) if prior else 0.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, ROUNDS + 1):
        g = np.bincount(row, w[col], len(rows)) + bias
        up = 1 / (1 + np.exp(-np.clip(g, -60, 60)))  # slope of l(-g); l(g) has up - 1
        if prior is None:
            slope = p * (up - 1) + u * up
        else:
            loss = np.logaddexp(0, g)
            beyond = u * up - prior * p * up
            slope = prior * p * (up - 1) + beyond if loss @ u - prior * (loss @ p) >= 0 else -beyond
        grad = np.append(np.bincount(col, slope[row], len(chosen)) + DECAY * w, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    weights[chosen] = w
    return Model(weights, bias)


def _held_out(fold: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % fold == 0


def distinct_words(docs: DataFrame) -> DataFrame:
    """positive, and the sorted distinct hashed words of each row as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            words = Words(batch.column("text"), PUNCT)
            h = (words.hashes() & U((1 << BITS) - 1)).astype(np.int64)
            key = np.unique(words.row << BITS | h)
            cut = np.searchsorted(key >> BITS, np.arange(batch.num_rows + 1))
            low = (key & (1 << BITS) - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("positive"), pa.array([low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["positive", "words"]
            )

    return docs.select("positive", "text").mapInArrow(run, "positive boolean, words binary")


def fit(docs: DataFrame, labels: DataFrame, fold: int = 5) -> Model:
    """A model from rows of labels whose crc32(doc_id) mod fold is not 0 (0: all rows): which are toxic, and which others there are.

    Ids are chosen by hash without their texts (of equal hashes the smaller id); then only the texts of the bounded sample
    are read, and only their hashed words reach the driver.
    """
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if fold:
        known = known.where(~_held_out(fold))
    p = known.where("toxic = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES).withColumn("positive", F.lit(True))
    u = known.select("doc_id").orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(UNLABELLED).withColumn("positive", F.lit(False))
    sample = docs_of(docs).join(F.broadcast(p.unionByName(u)), "doc_id")  # POSITIVES + UNLABELLED ids at most
    got = distinct_words(sample).toArrow()
    rows = [np.frombuffer(x, np.int32).astype(np.int64) for x in got.column("words").to_pylist()]
    return train(rows, np.array(got.column("positive").to_pylist(), bool))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row; null or empty text has the score of a document without words."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(Words(batch.column("text"), PUNCT)))], ["doc_id", "score"])

    return docs_of(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; without any confirmed toxic row every score is near 0, without any other near 1.

    Null or empty text is scored as a document without words; repeated rows have equal scores; a score of 0.5 counts as
    toxic; null ids are scored and count as not held out; very long texts are scored whole; an empty table gives an empty
    one; other columns of either table, whatever their names, are ignored. Of differing labels of an id the greater holds.
    """
    scored = score(docs, fit(docs, labels, fold))
    return scored.select("doc_id", F.coalesce(_held_out(fold), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows and columns of docs that the model, fitted on all labels, doesn't take for toxic.

    Rows are judged one by one by their whole text (null: empty), so repeated rows and null ids are kept or go alike; other
    columns stay as they are; an empty table gives an empty one.
    """
    columns = docs.columns
    model = fit(docs, labels, 0)
    schema = docs.schema

    def run(batches):
        for batch in slices(batches):
            good = model.scores(Words(batch.column("text"), PUNCT)) < 0.5
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, schema).select(*columns)
