"""Likeness, training, near passages and the last stages against plain versions."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from plain import edit_fingerprint, prose, words

import corpus_pipeline
from fragloom.llm import edit_fingerprints, mixing, pieces, shared, substrings, toxicity

SF = "/root/testdata/sf0.001"


def plain_likeness(a, b):
    """Digits that agree at the places of the coarser walk, less a sixteenth for chance, as a share."""
    if a == b:
        return 1.0
    (x, la), (y, lb) = sorted(((p[2:], int(p[:2], 16)) for p in (a, b)), key=lambda t: t[1])
    x = x[:: 2 ** (lb - la)]  # the shorter text has its places closer together
    most, least = max(len(x), len(y)), min(len(x), len(y))
    if not most:
        return 0.0
    equal = sum(p == q for p, q in zip(x, y, strict=False))
    return max(0.0, (equal - least / 16) / (most - least / 16))


def test_likeness_and_neighbours(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(r.choice([0, 1, 40, 300, 700])))) for i in range(25)]
    rows += [(30, rows[3][1]), (31, None), (32, "日本語 🙂" * 60)]
    bits = np.random.default_rng(20).integers(0, 2, (edit_fingerprints.TABLES, 4, 16), dtype=np.uint8).tolist()
    fp = lambda t: edit_fingerprint(t or "", bits)
    got = {x.doc_id: x for x in edit_fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half] if half else t
        x = got[d]
        assert (x.n_chars, x.fingerprint, x.edited_fingerprint) == (len(t), fp(t), fp(edited))
        assert math.isclose(x.near_edited, plain_likeness(fp(t), fp(edited))) and math.isclose(x.near_next, plain_likeness(fp(t), fp(after)))


def risk(w, bias, rows, positive, prior):
    """Non-negative risk of a linear model under the logistic loss, row by row."""
    g = [sum(w.get(x, 0.0) for x in r) + bias for r in rows]
    loss = lambda z: math.log1p(math.exp(-abs(z))) + max(0.0, -z)
    p, u = [x for x, y in zip(g, positive, strict=True) if y], [x for x, y in zip(g, positive, strict=True) if not y]
    mean = lambda v: sum(v) / len(v)
    return prior * mean([loss(x) for x in p]) + max(0.0, mean([loss(-x) for x in u]) - prior * mean([loss(-x) for x in p]))


def test_training_reaches_the_risk_of_a_plain_trainer():
    r, rows, positive, truth = random.Random(3), [], [], []
    for i in range(600):
        labelled = i < 150
        bad = labelled or r.random() < 0.25
        own = {r.randrange(20, 60) for _ in range(8)} | ({r.randrange(0, 6) for _ in range(3)} if bad else {r.randrange(6, 12) for _ in range(3)})
        rows.append(np.array(sorted(own)))
        positive.append(labelled)
        truth.append(bad)
    prior, positive = 0.25, np.array(positive)
    model = toxicity.descend(rows, positive, prior)
    chosen = np.flatnonzero(model.weights).tolist()
    assert set(range(12)) <= set(chosen)
    ours = {i: float(model.weights[i]) for i in chosen}
    # plain gradient descent with derivatives by differences
    w, bias = dict.fromkeys(chosen, 0.0), math.log(prior / (1 - prior))
    short = [[x for x in row.tolist() if x in w] for row in rows]
    for _ in range(60):
        base, step = risk(w, bias, short, positive, prior), {}
        for i in chosen:
            step[i] = (risk(w | {i: w[i] + 1e-5}, bias, short, positive, prior) - base) / 1e-5
        db = (risk(w, bias + 1e-5, short, positive, prior) - base) / 1e-5
        w, bias = {i: w[i] - 4.0 * step[i] for i in chosen}, bias - 4.0 * db
    assert risk(ours, model.bias, short, positive, prior) <= risk(w, bias, short, positive, prior) + 0.01
    says = lambda weights, b: [sum(weights[x] for x in row) + b > 0 for row in short]
    right = [a == b for a, b in zip(says(ours, model.bias), truth, strict=True)]
    assert np.mean(right) > 0.97 and np.mean([a == b for a, b in zip(says(ours, model.bias), says(w, bias), strict=True)]) > 0.97


def near_pairs(r, n, size, edits):
    """Documents in pairs that share a passage of `size` words with `edits` of them replaced, amid words of their own."""
    rows, similar = [], []
    for i in range(n):
        passage = prose(10_000 + r.randrange(1 << 30), size, 4_000).split()
        other = list(passage)
        for at in r.sample(range(5, size - 5), edits):
            other[at] = f"new{i}x{at}"
        a, b = ({tuple(x[k : k + 5]) for k in range(size - 4)} for x in (passage, other))
        similar.append(len(a & b) / len(a | b))
        for k, p in ((2 * i, passage), (2 * i + 1, other)):
            rows.append((k, " ".join([prose(r.randrange(1 << 30), r.randint(20, 120), 4_000), *p, prose(r.randrange(1 << 30), r.randint(20, 120), 4_000)])))
    return rows, similar


@pytest.mark.parametrize(("size", "edits"), [(60, 1), (100, 2), (150, 3)])
def test_near_passages_are_found(spark, size, edits):
    """The two texts of each pair are compared whole: of those with a similar stretch of 50 words, nearly all are found."""
    rows, _ = near_pairs(random.Random(size), 120, size, edits)
    code = {}
    items = []
    for _, t in rows:
        w = words(t)
        items.append(np.array([code.setdefault(tuple(w[i : i + 5]), len(code)) for i in range(len(w) - 4)]))
    needed = {i + 1 for i in range(0, len(rows), 2) if substrings.matching(items[i + 1], items[i])}
    got = {(x.doc_id, x.first_doc_id) for x in substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(b == a - 1 and a % 2 for a, b in got)  # strangers share nothing
    assert len(needed) >= 60 and len({a for a, _ in got} & needed) >= 0.95 * len(needed)


def test_pieces_stage_is_the_librarys(spark):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in corpus_pipeline.encode_pieces(spark, docs, SF).collect():
        assert np.frombuffer(r.ids, np.uint32).tolist() == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) // 4


def test_mixing_stage_follows_its_rates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    classifier = mixing.fit(docs, labels)
    steps, report = mixing.rates(mixing.memberships(docs, classifier), mixing.TARGETS, classifier.domains, 1.0)
    often = {}
    for r in corpus_pipeline.mix_sources(spark, docs, SF).select("doc_id").collect():
        often[r.doc_id] = often.get(r.doc_id, 0) + 1
    total = 0.0
    for r in docs.select("doc_id", "text").collect():
        p, _ = classifier.posterior(pa.array([r.text]))
        rate = 1.0
        for g in steps:
            rate = max(1.0, rate - sum(float(x) * float(y) for x, y in zip(p[0], g, strict=True)))
        assert math.floor(rate + 1e-6) <= often[r.doc_id] <= math.floor(rate) + 1
        total += rate * len(words(r.text))
    assert math.isclose(total, sum(report["expected"]), rel_tol=1e-6)


def test_blocks_apart(spark):
    """All pairs across parts meet, those within the largest part don't, and a key of 20,000 makes few rows."""
    r = random.Random(9)
    rows = [(k, 1000 * k + i, r.choice([0] * 30 + [1, 2, 3]) if k else 7) for k in range(3) for i in range(90)]
    df = spark.createDataFrame(rows, "key long, id long, part long").selectExpr("*", "1 as largest", "2 as own_")
    met = {}
    for x in shared.blocks_apart(df, "key", "id", "part", 16).collect():
        met.setdefault((x.key, x.lo, x.hi), []).append(x)
    pairs = set()
    for (_, lo, hi), own in met.items():
        for i, x in enumerate(own):
            pairs |= {frozenset((x.id, y.id)) for y in own[:i] if x.part != y.part and (lo == hi or x.own != y.own)}
    parts = {i: (k, p) for k, i, p in rows}
    expected = {frozenset((i, j)) for i in parts for j in parts if i < j and parts[i][0] == parts[j][0] and parts[i][1] != parts[j][1]}
    assert pairs == expected and not any(parts[i][0] == 0 for p in pairs for i in p)
    big = spark.range(20_000).selectExpr("1 as key", "id", "if(id < 10, id, 100) as part")
    assert shared.blocks_apart(big, "key", "id", "part", 1024).count() == 19_990 + 10 * (1 + 20)
