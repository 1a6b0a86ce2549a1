"""Near vectors against all pairs."""

import numpy as np
import pytest
from plain import components

from fragloom.llm import rotation_codes


def near(r, v, cosine):
    """A vector at that cosine from v."""
    w = r.standard_normal(len(v))
    w -= w @ v / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def unit(v):
    good = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    return np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if good else None


def plain_links(rows):
    u = [unit(v) for _, v in rows]
    link = lambda i, j: u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.9
    far = 1 << 60
    least = components([far if i is None else i for i, _ in rows], link)
    counts = [sum(link(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    return sorted(((i, n, None if c == far else c, i is not None and i == c) for (i, _), n, c in zip(rows, counts, least, strict=True)), key=str)


def odd_rows(dims):
    r = np.random.default_rng(dims)
    rows = []
    for i in range(40):
        v = r.standard_normal(dims)
        rows.append(v)
        rows += [near(r, v, 0.97) for _ in range(i % 7)]
        if i % 5 == 0:
            rows += [v * 3.0, v.copy(), near(r, v, 0.8), -v]
    hot = r.standard_normal(dims)
    rows += [near(r, hot, 0.99) for _ in range(60)] + [hot] * 50
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    rows = [rows[i] for i in r.permutation(len(rows))]
    some = rows[0][1]
    return rows + [(1000, None), (1001, []), (1002, [0.0] * dims), (1003, [None, *some[1:]]), (1004, [float("nan"), *some[1:]]), (1005, [float("inf"), *some[1:]]), (None, some), (rows[1][0], some), (1006, some + [0.0]), (1007, [x * 1e-30 for x in some]), (None, [1e30] * dims), (None, None)]


@pytest.mark.parametrize(("dims", "block"), [(64, 2048), (64, 16), (100, 2048), (3, 2048)])
def test_near_vectors(spark, dims, block):
    rows = odd_rows(dims)
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as node", "'x' as kept", "3 as size", "4 as n_links").repartition(3)
    got = sorted(map(tuple, rotation_codes.near_vectors(df, block=block).collect()), key=str)
    assert got == plain_links(rows)


def test_doubles_and_no_rows(spark):
    rows = [(i, [float(x) for x in v]) for i, v in ((1, [1e200, 0, 1e200]), (2, [1, 0, 1]), (3, [0, 1, 0]), (4, [1e-200, 1e-300, 1e-200]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rotation_codes.near_vectors(df).collect()} == {1: (2, 1, True), 2: (2, 1, False), 3: (0, 3, True), 4: (2, 1, False)}
    assert rotation_codes.near_vectors(df.limit(0)).count() == 0


def test_recall_right_at_the_threshold(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((1500, 64))
    rows = [(2 * i, v) for i, v in enumerate(base)] + [(2 * i + 1, near(r, v, 0.901)) for i, v in enumerate(base)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    assert rotation_codes.near_vectors(df).where("n_links > 0").count() >= 0.99 * 3000


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(6)
    for cosine in (0.0, 0.5, 0.9):
        v = rotation_codes.units(r.standard_normal(4000 * 64), 64)
        w = np.array([near(r, x, cosine) for x in v])
        a, b = rotation_codes.Codes(v, 1), rotation_codes.Codes(w, 1)
        found = rotation_codes.estimate(a.codes[:, 0], a.factor, b.planes, b.low, b.step, b.total)
        assert abs(found.mean() - cosine) < 0.01
        if cosine == 0.9:
            off = rotation_codes.slack(a.factor, b.step, 64, 0.9)
            assert (found >= 0.9 - off).all() and (found < 0.9 - off / 5).any()
        if cosine == 0.0:
            assert (found < 0.9 - rotation_codes.slack(a.factor, b.step, 64, 0.9)).all()


def test_bands_grow_slowly():
    for n in (1_000, 1_000_000, 1_000_000_000):
        bits, many = rotation_codes.bands(n)
        assert n / 2**bits <= 16 and 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** many >= 0.998


def test_pairs_of_runs():
    got = {(int(a), int(b)) for x, y in rotation_codes.pairs_of(np.array([3, 1, 4]), None, 4) for a, b in zip(x, y, strict=True)}
    assert got == {(1, 0), (2, 0), (2, 1), *((a, b) for a in range(4, 8) for b in range(4, a))}


def test_sql_agrees(spark):
    import duckdb

    rows = [(i, v) for i, v in odd_rows(8) if i is not None]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").cache()
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert sorted(con.sql(rotation_codes.oracle()).fetchall()) == sorted(map(tuple, rotation_codes.near_vectors(df).collect()))
