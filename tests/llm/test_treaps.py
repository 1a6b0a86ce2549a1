"""Ranked search against plain scoring of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from plain import lower, prose

from fragloom.llm import treaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, top=10):
    held = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    n, all_ = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = {t for t in TERM.findall(lower(text)) if df[t]}
        found = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n // max(all_, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(1)
    docs = [(i, prose(i % 150, 5 + i % 90, 300)) for i in range(400)]  # repeated texts: many equal scores
    docs += [(7, prose(999, 50)), (None, prose(3, 40)), (None, None), (500, ""), (501, " .,- "), (502, "Éa ÉA éa日本 x_y x-y " * 4000), (503, prose(4, 30_000, 300))]
    r.shuffle(docs)
    items = [(i, prose(1000 + i, 12, 300)) for i in range(25)] + [(3, "Éa x"), (3, "Éa x"), (None, prose(2, 4)), (90, None), (91, ""), (92, "nowhere"), (93, docs[0][1])]
    return docs, items


def test_search(spark, corpus):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 as item_id", "'x' as score", "2 as rank", "3 as query")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as item", "3 as score")
    assert rows(treaps.search(d, i)) == plain_search(docs, items)
    assert rows(treaps.search(d, i, top=3, shard=500, block_bytes=400)) == plain_search(docs, items, 3)


def test_no_rows(spark, corpus):
    docs, items = (spark.createDataFrame(x[:3], f"{n} long, text string") for x, n in zip(corpus, ("doc_id", "item_id"), strict=True))
    assert treaps.search(docs.limit(0), items).count() == 0 and treaps.search(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("range_", [1, 7, 64])
def test_treaps_prune_and_stay_exact(monkeypatch, range_):
    monkeypatch.setattr(treaps, "RANGE", range_)
    monkeypatch.setattr(treaps, "CELLS", 50)
    r = np.random.default_rng(2)
    docs, many = 3000, 40
    impact = np.floor(r.pareto(1.0, (docs, many)) * 100).astype(np.int64) * (r.random((docs, many)) < 0.3)
    d, t = np.nonzero(impact)
    shard = treaps.Shard.__new__(treaps.Shard)
    shard.width, order = docs, np.argsort(t * docs + d)
    shard.key, shard.impact = (t * docs + d)[order], np.append(impact[d, t][order], 0)
    shard._grow()
    for i in range(len(shard.key)):  # heap order of impacts, search order of documents
        for child, less in ((shard.left[i], True), (shard.right[i], False)):
            assert child < 0 or shard.impact[child] <= shard.impact[i] and (shard.doc[child] < shard.doc[i]) == less
    queries = [np.unique(r.integers(0, many, 6)) for _ in range(20)] + [np.zeros(0, np.int64)]
    scored = []
    plain, scan = shard.scores, shard._scan
    shard.scores = lambda q, d, of: scored.append(len(q)) or plain(q, d, of)
    shard._scan = lambda q, lo, hi, *a: scored.append(int((hi - lo + 1).sum())) or scan(q, lo, hi, *a)
    q, d, s = shard.search(queries)
    for i, terms in enumerate(queries):
        sums = impact[:, terms].sum(1)
        want = [x for x in sorted(range(docs), key=lambda x: (-sums[x], x))[:10] if sums[x]]
        assert d[q == i].tolist() == want and s[q == i].tolist() == sums[want].tolist()
    assert sum(scored) < 0.5 * docs * len(queries)


def test_links_to_greater_places():
    r = np.random.default_rng(3)
    for rank in (np.arange(500), np.arange(500)[::-1].copy(), r.permutation(500)):
        first = np.array([0, 100, 101])
        part = np.repeat([0, 1, 2], [100, 1, 399])
        for step in (-1, 1):
            got = treaps._greater(rank, first, step)
            for i in range(500):
                at = i + step
                while 0 <= at < 500 and part[at] == part[i] and rank[at] < rank[i]:
                    at += step
                assert got[i] == (at if 0 <= at < 500 and part[at] == part[i] else -1)


def test_terms_are_compared_by_bytes():
    found, _, _ = treaps.terms(pa.array(["Straße_1 straSSe", None, "a b"]))
    assert [x.decode() for x in found.to_pylist()] == ["straße", "1", "strasse", "a b"]


def test_sql_agrees(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet'")
    want = con.sql(treaps.oracle()).fetchall()
    assert want and sorted(want) == sorted(map(tuple, treaps.search(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")).collect()))
