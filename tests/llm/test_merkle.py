"""Manifests against a plain tree, over odd rows and other fanouts."""

import hashlib
import zlib

import pytest

from fragloom.llm import merkle

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def climb(nodes, fanout):
    """The top of a tree, and of each node the siblings level by level as (left, right)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for w, i in zip(ways, at, strict=True):
            first = i // fanout * fanout
            w.append((nodes[first:i], nodes[i + 1 : first + fanout]))
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], ways


def plain_manifest(rows, fanout):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: H(*map(part, (r["doc_id"], r["source"], r["lang"], n, r["text"])))
    trees = {}
    for r in rows:
        broken = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["n_chars"]), leaf(r, r["n_chars"] + broken if broken else r["n_chars"]), r["doc_id"]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops = {t: climb([x[2] for x in sorted(trees[t], key=lambda x: x[:3])], fanout) for t in names}
    root, above = climb([tops[t][0] for t in names], fanout)
    out = []
    for name, up in zip(names, above, strict=True):
        for x, way in zip(sorted(trees[name], key=lambda x: x[:3]), tops[name][1], strict=True):
            again = x[3]
            for left, right in way + up:
                again = H(*left, again, *right)
            out.append((x[4], x[2], tops[name][0], root, H(*(d for left, right in way + up for d in left + right)), again, again == root))
    return out


key = lambda r: tuple(str(x) for x in r)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 10), (2, 1), (2, 3), (3, 2)])
def test_manifest(spark, fanout, levels):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r.asDict() for r in df.collect()]
    got = merkle.manifest(df, fanout=fanout, levels=levels).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(rows, fanout), key=key)
    assert 0 < sum(not r.verified for r in got) < len(got) / 4


def test_odd_rows(spark, odd):
    wide = odd.unionByName(odd.selectExpr("2 * 4503599627370497 + doc_id as doc_id", "null as lang", *(c for c in odd.columns if c not in ("doc_id", "lang"))))
    wide = wide.selectExpr("*", "'x' as tree", "'y' as digest", "'z' as number", "1 as read_at", "2 as place", "3 as bucket")
    rows = [r.asDict() for r in wide.collect()]
    assert any(r["lang"] is None for r in rows) and any(r["doc_id"] is None for r in rows)
    for fanout, levels in ((2, 10), (2, 2)):
        got = merkle.manifest(wide, fanout=fanout, levels=levels).collect()
        assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(rows, fanout), key=key)


def test_null_sizes_a_lone_leaf_and_no_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    tampered = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0)
    one = spark.createDataFrame([(tampered, "s", None, None, None)], schema)
    r = merkle.manifest(one).first()
    assert r.verified and r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == H()
    assert not merkle.manifest(spark.createDataFrame([(tampered, "s", None, 1, None)], schema)).first().verified
    assert merkle.manifest(one.limit(0)).count() == 0


def test_sql_agrees(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet'")
    assert sorted(con.sql(merkle.oracle()).fetchall()) == sorted(map(tuple, merkle.manifest(spark.read.parquet(f"{path}/documents.parquet")).collect()))
