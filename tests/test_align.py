"""Alignments against plain dynamic programming."""

import random

import numpy as np

from fragloom.functions import align as al


def distances(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def affine(q, s, match=2, mismatch=-4, o=4, e=2):
    low, n, m = -(10**9), len(q), len(s)
    h = [[low] * (m + 1) for _ in range(n + 1)]
    up, left = [r[:] for r in h], [r[:] for r in h]
    h[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                up[i][j] = max(h[i - 1][j] - o - e, up[i - 1][j] - e)
            if j:
                left[i][j] = max(h[i][j - 1] - o - e, left[i][j - 1] - e)
            if i or j:
                diag = h[i - 1][j - 1] + (match if q[i - 1] == s[j - 1] else mismatch) if i and j else low
                h[i][j] = max(diag, up[i][j], left[i][j])
    return h[n][m]


def test_random_pairs():
    r = random.Random(1)
    some = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    for _ in range(120):
        q, s = some(r.randint(0, 30)), some(r.randint(0, 30))
        if r.random() < 0.5:
            s = "".join(c for c in q if r.random() > 0.1)
        row = distances(q, s)
        for band in (None, 2, 8):
            a, b, d = al.edit_align(q, s, band)
            assert d == row[-1] == sum(x != y for x, y in zip(a, b, strict=True))
            assert al.fits(a, b, q, s)
        a, b, d = al.prefix_align(q, s)
        assert d == min(row) and s.startswith(b.replace("-", "")) and a.replace("-", "") == q
        a, b, score = al.affine_align(q, s)
        assert al.fits(a, b, q, s) and score == affine(q, s)


def test_measures():
    assert al.identity("AC-T", "ACGT") == 75.0
    assert al.gapped_score("AC-T", "ACGA") == 2 + 2 - 2 - 4
    assert al.effective_identity("A" + "-" * 20 + "C", "A" + "G" * 20 + "C") == 100.0
    assert al.anchored("T" + "A" * 8 + "C", "G" + "A" * 8 + "G") == (1, 9)
    assert al.distance_score(10, 10, 2) == 6 and al.distance_identity(10, 10, 2) == 80.0


def test_cigar_expansion():
    a, b, q, s = al.expand("2S3M1I2D2M", "TTACGTAC", "NNACGGGAC", 2)
    assert (a, b) == ("ACGT--AC", "ACG-GGAC")
    assert q.tolist() == [2, 3, 4, 5, 5, 5, 6, 7] and s.tolist() == [2, 3, 4, 4, 5, 6, 7, 8]


def test_identity_column(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("AC-T", "ACGT"), ("", "")], "a string, b string")
    assert [round(x[0], 6) for x in df.select(al.identity_column(F.col("a"), F.col("b"))).collect()] == [75.0, 0.0]


def test_a_band_bounds_memory_and_leaves_the_score():
    import tracemalloc

    r = random.Random(8)
    q = "".join(r.choice("ACGT") for _ in range(3_000))
    s = "".join(c if r.random() > 0.03 else r.choice(["", "A", c + "G"]) for c in q)
    tracemalloc.start()
    a, b, score = al.affine_align(q, s, band=40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert al.fits(a, b, q, s) and peak < 8_000_000
    short, other = q[:300], s[:290]
    assert al.affine_align(short, other, band=40)[2] == al.affine_align(short, other)[2]
