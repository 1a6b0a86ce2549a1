"""Every query with SQL, on the smallest tables, against DuckDB."""

import os

import numpy as np
import pytest

from fragloom.operators import enzymes
from fragloom.operators import mapping as operators
from fragloom.plans import adapters, mapping
from fragloom.plans.catalog import DPNII, ORACLE_SQL, QUERIES, STRIDE, K

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    return None if v is None else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    other = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    at = [other.columns.index(c) for c in columns]
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in other.fetchall())
    assert ours == theirs


# Queries without SQL: what plain loops over the collected rows give, or what must hold of each row.


@pytest.fixture(scope="module")
def texts(spark):
    genome = {r.sid: r.seq for r in adapters.genome(spark, DATA).collect()}
    return genome, {r.qid: r.seq for r in adapters.reads(spark, DATA).collect()}


@pytest.fixture(scope="module")
def mapped(spark):
    return mapping.map_reads(adapters.reads(spark, DATA), adapters.genome(spark, DATA), DPNII, K, STRIDE).collect()


def test_coverage_capped_select(spark):
    got = {(r.read_id, r.frag_id) for r in QUERIES["coverage_capped_select"](spark, DATA).collect()}
    depth, total, expected = {}, {}, set()
    for r in sorted(adapters.frags(spark, DATA).collect(), key=lambda r: (r.subject_id, r.read_id * 64 + r.frag_id)):
        own = depth.setdefault(r.subject_id, [0] * 210_000)
        start = r.subject_offset // 500
        span = range(start, start + r.frag_size)
        if total.get(r.subject_id, 0) < 202_000 * 3 and sum(own[p] < 3 for p in span) >= 20:
            expected.add((r.read_id, r.frag_id))
            total[r.subject_id] = total.get(r.subject_id, 0) + r.frag_size
            for p in span:
                own[p] += 1
    assert got == expected and got


def test_candidate_chains_and_chromosome_ranks(spark, texts):
    seeds = {}
    for r in QUERIES["seed_match"](spark, DATA).collect():
        seeds.setdefault((r.qid, r.sid, r.strand), []).append((r.qoff, r.soff))
    expected = []
    for (qid, sid, strand), own in seeds.items():
        q, s = (np.array(x) for x in zip(*own, strict=True))
        expected += [(qid, sid, strand, *hit) for hit in operators.chain_seeds(q, s, K, len(texts[1][qid]))]
    got = [tuple(r) for r in QUERIES["candidate_chains"](spark, DATA).collect()]
    assert sorted(got) == sorted(expected) and got
    best = {}
    for qid, sid, *_, n in got:
        best[qid, sid] = max(n, best.get((qid, sid), 0))
    ranked = [(q, c, n, 1 + sum(p == q and (-m, d) < (-n, c) for (p, d), m in best.items())) for (q, c), n in best.items()]
    assert sorted(map(tuple, QUERIES["chromosome_ranks"](spark, DATA).collect())) == sorted(ranked)


def test_local_alignment(spark, texts):
    from test_waves import full

    genome, reads = texts
    first = {}
    for r in QUERIES["seed_match"](spark, DATA).collect():
        at = (r.qid, r.strand, r.sid)
        first[at] = min(first.get(at, (r.qoff, r.soff)), (r.qoff, r.soff))
    got = {(r.qid, r.strand, r.sid): r for r in QUERIES["local_alignment"](spark, DATA).collect()}
    assert set(got) == set(first) and got
    for i, (at, r) in enumerate(sorted(got.items())):
        q, s = reads[at[0]] if at[1] == 0 else operators.reverse(reads[at[0]]), genome[at[2]]
        q0, s0 = first[at]
        reach = 2 * len(q)
        assert r.qoff <= q0 < r.qend and r.soff <= s0 < r.send
        if i % 10 == 0:
            best = full(q[q0:], s[s0 : s0 + reach], 5) + full(q[:q0][::-1], s[max(0, s0 - reach) : s0][::-1], 5)
            assert r.qend - r.qoff + r.send - r.soff - 5 * r.errors >= 0.97 * best


def test_map_reads(spark, texts, mapped):
    genome, reads = texts
    by = {}
    for r in mapped:
        q, s = r.q_row.replace("-", ""), r.s_row.replace("-", "")
        lo, hi = (r.fwd_qoff, r.fwd_qend) if r.qdir == 0 else (r.qsize - r.fwd_qend, r.qsize - r.fwd_qoff)
        strand = reads[r.read_id] if r.qdir == 0 else operators.reverse(reads[r.read_id])
        assert q == strand[lo:hi] == r.frag_seq and s == genome[r.subject_id][r.soff : r.send]
        same = sum(x == y for x, y in zip(r.q_row, r.s_row, strict=True))
        assert r.matches == same and r.length == len(r.q_row) and abs(r.pi - 100 * same / r.length) < 1e-5 and 0 <= r.mapq <= 60
        by.setdefault(r.read_id, []).append((r.fwd_qoff, r.fwd_qend, r.frag_id))
    for spans in by.values():
        spans.sort()
        assert all(a[1] <= b[0] and a[2] < b[2] for a, b in zip(spans, spans[1:], strict=False))
    dropped = ("q_row", "s_row", "frag_seq")
    shown = lambda r: repr([(k, v) for k, v in sorted(r.asDict().items()) if k not in dropped])
    assert mapped and sorted(map(shown, QUERIES["map_reads"](spark, DATA).collect())) == sorted(map(shown, mapped))


def test_enzyme_by_alignment(spark, texts):
    genome, reads = texts
    hits = mapping.best_hits(adapters.reads(spark, DATA), adapters.genome(spark, DATA)).collect()
    chains = QUERIES["candidate_chains"](spark, DATA).collect()
    by = {}
    for r in chains:
        by.setdefault(r.qid, []).append(r.seeds)
    seen = {}
    for r in hits:
        seen[r.read_id] = seen.get(r.read_id, 0) + 1
        assert r.kind == "hit" and r.s_row.replace("-", "") == genome[r.subject_id][r.soff : r.send] and r.pi >= 75
    assert hits and all(n <= min(3, len(by[q])) for q, n in seen.items())
    counted = dict.fromkeys(enzymes.CATALOGUE, 0)
    for r in hits:
        lo, hi = (r.fwd_qoff, r.fwd_qend) if r.qdir == 0 else (r.qsize - r.fwd_qend, r.qsize - r.fwd_qoff)
        strand = reads[r.read_id] if r.qdir == 0 else operators.reverse(reads[r.read_id])
        for name, site in enzymes.CATALOGUE.items():
            motif = enzymes.parse(site).motif
            near = lambda text, at: 200 <= at <= len(text) - 200 and motif in text[max(0, at - 30) : at + 30 + len(motif)]  # noqa: B023, E731
            text = genome[r.subject_id]
            counted[name] += hi - lo >= 200 and r.send - r.soff >= 200 and near(strand, lo) and near(strand, hi) and near(text, r.soff) and near(text, r.send)
    got = {r.enzyme: r.n for r in mapping.infer_enzyme(adapters.reads(spark, DATA), adapters.genome(spark, DATA)).collect()}
    assert got == counted
    first = QUERIES["enzyme_by_alignment"](spark, DATA).first()
    top = sorted(counted.values(), reverse=True)
    assert (first.best, first.second) == tuple(top[:2]) and (first.enzyme is None) == (top[0] <= 2 * top[1])


def test_tag_reads(spark, mapped):
    got = {(r.step, r.hp): (r.frags, r.bases) for r in QUERIES["tag_reads"](spark, DATA).collect()}
    for step in ("tagged", "imputed"):
        assert sum(n for (s, _), (n, _) in got.items() if s == step) == len(mapped)
        assert sum(b for (s, _), (_, b) in got.items() if s == step) == sum(r.send - r.soff for r in mapped)
    assert got.get(("imputed", 0), (0, 0))[0] <= got.get(("tagged", 0), (0, 0))[0]


def test_every_query_is_tested():
    assert set(QUERIES) - set(ORACLE_SQL) == {"coverage_capped_select", "candidate_chains", "chromosome_ranks", "local_alignment", "map_reads", "enzyme_by_alignment", "tag_reads"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
