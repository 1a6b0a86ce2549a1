"""Mixing sources to target weights with soft membership.

A classifier of hashed byte trigrams, trained on the labelled table's documents, gives each document a posterior over
domains. Document rates r >= 0 then make the expected token totals of the domains, sum_i n_i p_i r_i, match the targets in the
least-squares sense. Projected gradient steps start from rates of 1, in the metric of the second moments of those documents
whose rates aren't at the bound; a step needs sums over all documents, and a document's rate follows from its posterior and
the steps' vectors.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import docs_of, free_name, written
from .textvec import LOWER, SPACE, row_sums, slices, utf8

#: Hashed trigrams; bound of the training sample (labelled documents with the smallest hashes of their ids).
KINDS, SAMPLE = 8_192, 2_000
#: Steps at most, and the change of the totals, as a share of all tokens, below which they have settled.
STEPS, CLOSE = 60, 1e-6
#: Share of all documents' second moments in the metric, whatever their rates.
LEAST_MOMENT = 1e-3
#: Target weights of the query, by domain.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigram at each byte but a row's last two, their offsets by row, and the words and bytes of each row."""
    raw, at = utf8(column)
    b = LOWER[raw].astype(np.uint32)
    code = np.zeros(0, np.int32)
    size = np.diff(at)
    whole = np.ones(len(b), bool)
    for i in (1, 2):
        ends = at[1:][size >= i]
        whole[ends - i] = False
    if len(b) > 2:
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1]) * np.uint32(0x85EBCA6B) + b[2:]
        h *= np.uint32(0xC2B2AE35)
        code = (h >> np.uint32(19)).astype(np.int32)[whole[:-2]]
    space = SPACE[raw]
    begin = ~space
    begin[1:] &= space[:-1]
    first = at[:-1][size > 0]
    begin[first] = ~space[first]
    return code, np.append(0, np.cumsum(np.maximum(size - 2, 0))), row_sums(begin.astype(np.int64), at), size


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    prior: np.ndarray
    logs: np.ndarray  # domain x trigram
    sharpness: float  # trigrams that a document's mean counts for

    def posterior(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors (rows x domains) and words of each row; a row without trigrams has the prior."""
        code, at, words, _ = trigrams(column)
        n = np.diff(at)
        mean = np.stack([row_sums(w[code].astype(np.float64), at) for w in self.logs], 1) / np.maximum(n, 1)[:, None]
        return softmax(np.log(self.prior) + mean * np.minimum(n, self.sharpness)[:, None]), words


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(counts: np.ndarray, label: np.ndarray, domains: tuple[str, ...]) -> Classifier:
    """Naive Bayes over trigram counts (rows x KINDS); the sharpness that fits the second half best, after training on the first."""
    def fit(rows):
        sums = np.stack([counts[rows][label[rows] == d].sum(0) for d in range(len(domains))]) + 0.5
        logs = np.log(sums / sums.sum(1, keepdims=True))
        prior = np.bincount(label[rows], minlength=len(domains)) + 1.0
        return prior / prior.sum(), logs.astype(np.float32)

    half = np.arange(len(label)) < max(1, len(label) // 2)
    prior, logs = fit(half)
    best = (np.inf, 64.0)
    rest = ~half if (~half).any() else half
    n = counts[rest].sum(1)
    mean = counts[rest] @ logs.T / np.maximum(n, 1)[:, None]
    for sharp in 2.0 ** np.arange(0, 9):
        p = softmax(np.log(prior) + mean * np.minimum(n, sharp)[:, None])
        best = min(best, (float(-np.log(np.maximum(p[np.arange(len(p)), label[rest]], 1e-12)).mean()), float(sharp)))
    prior, logs = fit(np.ones(len(label), bool))
    return Classifier(domains, prior, logs, best[1])


def fit(docs: DataFrame, labels: DataFrame, domain: str = "lang") -> Classifier:
    """A classifier of `domain` (a column of docs) from documents that the labelled table lists, SAMPLE at most."""
    listed = labels.select("doc_id").where("doc_id is not null").distinct()
    ids = docs.select("doc_id", F.col(domain).cast("string").alias("domain")).where("domain is not null").join(listed, "doc_id", "left_semi")
    ids = ids.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            code, at, _, _ = trigrams(batch.column("text"))
            blobs = [np.stack(np.unique(code[a:b], return_counts=True)).astype("<u4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.array(blobs, pa.binary())], ["domain", "counts"])

    got = docs_of(docs).join(F.broadcast(ids), "doc_id").select("domain", "text").mapInArrow(run, "domain string, counts binary").toArrow()  # SAMPLE ids at most
    names = got.column("domain").to_pylist()
    domains = tuple(sorted(set(names))) or ("",)
    counts = np.zeros((max(1, len(names)), KINDS), np.float32)
    for i, blob in enumerate(got.column("counts").to_pylist()):
        kinds, n = np.frombuffer(blob, "<u4").reshape(2, -1)
        counts[i, kinds] = n
    return train(counts, np.array([domains.index(x) for x in names] or [0]), domains)


def memberships(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, n_tokens (words), posterior of each row."""

    def run(batches):
        for batch in slices(batches):
            p, words = classifier.posterior(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "posterior"])

    return docs_of(docs).mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


def rate(posterior: np.ndarray, steps: list[np.ndarray], least: float) -> np.ndarray:
    """Rates after the steps so far: each subtracts the posterior's product with a vector and projects onto r >= least."""
    r = np.ones(len(posterior))
    for g in steps:
        r = np.maximum(least, r - posterior @ g)
    return r


def rates(members: DataFrame, targets: dict[str, float] | None, domains: tuple[str, ...], least: float = 0.0, power: float = 0.7) -> tuple[list[np.ndarray], dict]:
    """Steps that make rates, and a report: targets, expected totals and their distance, in tokens, and the share that is unmet.

    targets: weights by domain (domains without one: 0), or None for the corpus' own shares to a power. The total stays
    the corpus' own, or with least > 0 grows as far as every domain needs. The weight of domains that aren't known isn't
    handed to the others: the total falls short by it, and `unmet` is its share of all weights.
    """
    def arrays(batch):
        flat = batch.column("posterior").flatten().to_numpy()
        return batch.column("n_tokens").to_numpy().astype(np.float64), flat.reshape(batch.num_rows, -1)

    def sums(what, width: int) -> np.ndarray:
        def run(batches):
            total = np.zeros(width)
            for batch in batches:
                if batch.num_rows:
                    total += what(*arrays(batch))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"s{i}" for i in range(width)])

        row = members.mapInArrow(run, ", ".join(f"s{i} double" for i in range(width))).agg(*(F.sum(f"s{i}") for i in range(width))).first()
        return np.array([x or 0.0 for x in row])

    d = len(domains)
    moment = sums(lambda n, p: (p.T * n @ p).ravel(), d * d).reshape(d, d)
    own = moment.sum(1)
    if not own.sum():
        return [], {"domains": domains, "targets": own.tolist(), "expected": own.tolist(), "distance": 0.0, "settled": True, "unmet": 0.0}
    share = own / own.sum()
    weight = np.array([targets.get(x, 0.0) for x in domains]) if targets else share**power
    unmet = 1 - weight.sum() / sum(targets.values()) if targets and weight.sum() else 0.0
    weight = weight / weight.sum() * (1 - unmet) if weight.sum() else share
    asked = weight > 0
    total = own.sum() * (max(least, float((least * share[asked] / weight[asked]).max())) if least else 1.0)
    goal = weight * total
    inverse = lambda m: np.linalg.pinv(m, rcond=1e-9, hermitian=True)
    steps, now, settled = [inverse(moment) @ (own - goal)], own, False

    def at(steps: tuple):
        """Totals at the rates so far, and the second moments of the documents that aren't at the bound."""
        def what(n, p):
            r = rate(p, steps, least)
            free = r > least
            return np.concatenate([p.T @ (n * r), (p[free].T * n[free] @ p[free]).ravel()])

        return what

    for _ in range(STEPS):
        before, got = now, sums(at(tuple(steps)), d + d * d)
        now = got[:d]
        settled = bool(min(np.abs(now - goal).sum(), np.abs(now - before).sum()) <= CLOSE * total)
        if settled:
            break
        steps.append(inverse(got[d:].reshape(d, d) + LEAST_MOMENT * moment) @ (now - goal))
    else:
        steps = steps[:-1]
    distance = float(np.abs(now - goal).sum())
    if not settled:
        warnings.warn(f"rates have not settled after {STEPS} steps; {distance:.0f} of {total:.0f} tokens are off", stacklevel=2)
    return steps, {"domains": domains, "targets": goal.tolist(), "expected": now.tolist(), "distance": distance, "settled": settled, "unmet": float(unmet)}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = TARGETS, domain: str = "lang") -> DataFrame:
    """doc_id, n_tokens, domain, posterior (of that likeliest domain), rate of each row, target and reached (that domain's share
    of the tokens of the mixture, as asked and as the rates make it), settled, unmet (weight asked of domains that no
    training document has: it isn't handed to the others, the mixture falls short by it).

    Rates are expected copies of a document in the mixture. Null or empty text has the prior as posterior and no tokens,
    and so a rate that no total depends on. Repeated rows and null ids are alike and each counts; very long texts count with
    all their words; of equally likely domains the first by name is given; an empty table gives an empty one; without
    labelled documents, or without one of any domain that has a target, rates stay 1; null domains don't train; other
    columns of either table, whatever their names, are ignored.
    """
    classifier = fit(docs, labels, domain)
    members = written(memberships(docs, classifier), "memberships")
    steps, report = rates(members, targets, classifier.domains)
    whole = max(sum(report["targets"]) / (1 - report["unmet"]), 1e-300)
    target, reached = (np.array(report[k]) / whole for k in ("targets", "expected"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p = batch.column("posterior").flatten().to_numpy().reshape(batch.num_rows, -1)
            best = p.argmax(1)
            values = (pa.array([classifier.domains[i] for i in best.tolist()]), *(pa.array(x) for x in (p[np.arange(len(p)), best], rate(p, steps, 0.0), target[best], reached[best])))
            values += (pa.array([report["settled"]] * len(p)), pa.array([report["unmet"]] * len(p)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), *values], ["doc_id", "n_tokens", "domain", "posterior", "rate", "target", "reached", "settled", "unmet"])

    return members.mapInArrow(run, "doc_id long, n_tokens long, domain string, posterior double, rate double, target double, reached double, settled boolean, unmet double")


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = TARGETS, domain: str = "lang") -> DataFrame:
    """docs with each row as often as its rate says: floor(rate), and once more where a hash of its id and text falls below the rest.

    Rates are at least 1, so that no document is lost: the mixture grows where a domain needs more. Copies keep their id and
    all columns. Null and empty texts have the prior's rate, repeated rows and null ids one rate each by their text, very
    long texts are read whole; an empty table gives an empty one.
    """
    classifier = fit(docs, labels, domain)
    members = written(memberships(docs, classifier), "memberships")
    steps, _ = rates(members, targets, classifier.domains, 1.0)
    chance = free_name(docs, "chance")

    def run(batches):
        for batch in slices(batches):
            p, _ = classifier.posterior(batch.column("text"))
            r, u = rate(p, steps, 1.0), batch.column(chance).to_numpy()
            times = np.floor(r + 1e-9 + u * (1 - 1e-9)).astype(np.int64)
            yield batch.drop_columns([chance]).take(pa.array(np.repeat(np.arange(batch.num_rows), times)))

    return docs.withColumn(chance, F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003.0).mapInArrow(run, docs.schema)
