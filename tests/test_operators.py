"""Hand-made cases of the operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragloom.operators import enzymes, haplotypes, intervals, kmers, mapping, masking, pairs, pieces, scans, select, stats, variants


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


FRAGS = "read_id long, frag_id long, subject_id long, subject_offset long, frag_size long, mapq long, identity double, hp long"


def frags(spark, hps, mapq=10, offsets=None):
    offsets = offsets or [i * 1000 for i in range(len(hps))]
    return spark.createDataFrame([(1, i, 0, o, 100, mapq, 95.0, h) for i, (h, o) in enumerate(zip(hps, offsets, strict=True))], FRAGS)


def tags(df):
    return [r["hp"] for r in df.orderBy("frag_id").collect()]


def test_intervals(spark):
    iv = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 10, 12)], "chr long, start long, stop long")
    assert rows(intervals.merge(iv), "start", "stop") == [(0, 9), (10, 12)]
    assert rows(intervals.merge(iv, 1), "start", "stop") == [(0, 12)]
    sizes = spark.createDataFrame([(1, 20), (2, 7)], "chr long, length long")
    assert rows(intervals.complement(intervals.merge(iv), sizes), "chr", "start", "stop") == [(1, 9, 10), (1, 12, 20), (2, 0, 7)]
    assert rows(intervals.depth(spark.createDataFrame([(1, 0, 4), (1, 2, 6)], "chr long, start long, stop long")), "start", "stop", "depth") == [(0, 2, 1), (2, 4, 2), (4, 6, 1)]


def test_sites_leave_out_both_ends(spark):
    enzyme = enzymes.parse("^GATC")
    seq = spark.createDataFrame([(1, "GATCAAGATCAAGATC")], "sid long, seq string")
    assert [r["locus"] for r in enzymes.loci(seq, enzyme, "sid").orderBy("locus").collect()] == [0, 6, 16, 17]
    for bad in ("GATC", "^GANC", "^GATT", "^AAAAAAA"):
        with pytest.raises(ValueError):
            enzymes.parse(bad)


@pytest.mark.parametrize(("least", "cut"), [(1, 5), (6, 6)])
def test_cutoff(spark, least, cut):
    counted = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 1)], "kmer string, n long")
    limit = kmers.cutoff(counted, 0.25, least)
    assert limit.first()["cutoff"] == cut
    text = spark.createDataFrame([("a",), ("b",), ("d",)], "kmer string")
    assert rows(kmers.frequent_removed(text, counted, limit), "kmer") == [("b",), ("d",)]


def test_seed_multiplicity(spark):
    postings = spark.createDataFrame([("x", 1, 7), ("y", 1, 9)], "kmer string, sid long, soff long")
    asked = spark.createDataFrame([("x", 1, 0, i) for i in range(21)] + [("y", 1, i % 2, i) for i in range(20)], "kmer string, qid long, strand int, qoff long")
    assert {r["soff"] for r in kmers.seeds(asked, postings).collect()} == {9}


def test_hashes_agree(spark):
    seqs = spark.createDataFrame([(1, "ACGTTGCAAGT")], "sid long, seq string")
    a = kmers.extract(seqs, 5, 2).select("soff", kmers.kmer_hash(F.col("kmer")).alias("hash"))
    assert rows(a, "soff", "hash") == rows(kmers.extract_hashed(seqs, "sid", 5, 2), "soff", "hash")


def test_chain_bounds():
    size = 3000

    def chained(q, s):
        return len(mapping.chain_seeds(np.array(q), np.array(s), 15, size)) == 1

    assert chained([0, 400, 1200], [0, 400, 1200]) and not chained([0, 400, 1201], [0, 400, 1201])  # distance 800 / 801
    assert chained([0, 400, 800], [0, 400, 900]) and not chained([0, 400, 800], [0, 400, 901])  # shift and slope
    assert chained([0, 100, 200], [0, 100, 225]) and not chained([0, 100, 200], [0, 100, 226])  # slope 0.2


def test_chain_flags_on_reverse_strand(spark):
    base = "qdir int, qoff int, qend int, qsize int, soff int, send int, enzyme_qoff int, enzyme_qend int, enzyme_soff int, enzyme_send int"
    df = spark.createDataFrame([(0, 10, 90, 100, 5, 85, 10, 90, 5, 85), (1, 10, 90, 100, 5, 85, 10, 90, 5, 85), (1, 10, 90, 100, 5, 85, 11, 91, 5, 86)], base)
    out = [(r.is_perfect, r.is_pseudo_perfect, r.chain_qoff, r.chain_qend) for r in enzymes.chain_flags(df, 4).collect()]
    assert out == [(True, True, 10, 90), (True, True, 6, 86), (False, False, 10, 90)]


def test_vote_and_consensus(spark):
    assert tags(haplotypes.impute_by_vote(frags(spark, [1, 1, 1, 1, 2, 0]))) == [1, 1, 1, 1, 2, 0]
    assert tags(haplotypes.impute_by_vote(frags(spark, [1] * 8 + [2, 0]))) == [1] * 8 + [2, 1]
    assert tags(haplotypes.consensus(frags(spark, [1, 0, 0]))) == [1, 1, 1]
    assert tags(haplotypes.consensus(frags(spark, [1, 2, 0]))) == [1, 2, 0]
    assert tags(haplotypes.consensus(frags(spark, [1, 1, 1, 1, 2, 0]))) == [1, 1, 1, 1, 2, 0]
    assert tags(haplotypes.consensus(frags(spark, [1] * 5 + [2, 0]))) == [1] * 7


def test_distance_imputation(spark):
    near = haplotypes.imputed([0, 1, 2], [0, 10_000_000, 20_000_000], [1, 0, 2])
    assert near == [1, 0, 2]  # both claim the middle
    assert haplotypes.imputed([0, 5, 9], [0, 16_000_000, 33_000_000], [1, 0, 2]) == [1, 1, 2]
    assert tags(haplotypes.impute_by_distance(frags(spark, [1, 0, 2], offsets=[0, 10_000_000, 20_000_000]))) == near
    assert tags(haplotypes.impute_by_distance(frags(spark, [1, 0, 0]))) == [1, 1, 1]


def test_snp_votes(spark):
    seq = [("A", "A"), ("C", "C"), ("G", "G"), ("T", "T"), ("A", "A"), ("C", "C"), ("G", "G"), ("T", "T"), ("-", "A"), ("C", "C"), ("A", "T"), ("C", "C")]
    columns = spark.createDataFrame([(1, 0, 0, i, i, q, s) for i, (q, s) in enumerate(seq)], "read_id long, frag_id long, sid long, col long, soff long, q string, s string")
    snps = spark.createDataFrame([(0, 2, "G", "T", "x", 0, 1), (0, 7, "T", "C", "x", 1, 0), (0, 8, "A", "C", "x", 0, 1)], "sid long, soff long, ref string, alt string, phase_set string, gt0 long, gt1 long")
    assert rows(haplotypes.snp_columns(columns, snps), "soff", "strict", "loose") == [(2, 1, 1), (7, 0, 2), (8, 0, 0)]


def test_phase_set_tie_takes_the_smallest(spark):
    snps = spark.createDataFrame([(1, 10, "b"), (1, 20, "a"), (1, 30, "b"), (1, 40, "a")], "sid long, soff long, phase_set string")
    assert rows(variants.most_variants(snps), "soff") == [(20,), (40,)]


def test_upper_median_and_pairs(spark):
    df = spark.createDataFrame([(10,), (20,), (30,), (40,)], "v long")
    assert stats.upper_median(df, "v").first()["median"] == 30
    three = frags(spark, [1, 2, 0])
    assert stats.contact_stats(three).where("max_distance = 5000000").first()["contacts"] == 3
    assert pairs.ashic(three).count() == 2
    lines = three.select("read_id", "subject_id", "subject_offset", "frag_id", F.lit(1).alias("n_blocks"), F.lit("n_000").alias("name"), F.lit("5 0").alias("blocks"), F.lit("F").alias("quals"))
    assert pairs.hic(lines).count() == 3


def test_budget_takes_the_row_that_reaches_it(spark):
    df = spark.createDataFrame([(i, 10) for i in range(100)], "i long, n long")
    assert rows(select.take_budget(df, ["i"], "n", 95), "i") == [(i,) for i in range(10)]


def test_coverage_cap(spark):
    rows_ = spark.createDataFrame([(0, i, 0, 100) for i in range(5)], "subject_id long, ord long, start long, stop long")
    kept = select.coverage_capped(rows_, spark.createDataFrame([(0, 1000)], "subject_id long, length long"), 3)
    assert rows(kept, "ord") == [(0,), (1,), (2,)]


def test_coverage_cap_against_a_plain_loop(spark):
    rng = np.random.default_rng(7)
    lengths = {0: 300, 1: 900, 2: 50}
    frags_ = [(int(rng.integers(0, 4)), i, a, a + int(rng.integers(1, 120))) for i, a in enumerate(rng.integers(0, 400, 500).tolist())]
    taken, depth, total = [], {c: [0] * 2_000 for c in lengths}, dict.fromkeys(lengths, 0)
    for c, i, a, b in frags_:
        if c in lengths and total[c] < lengths[c] * 4 and sum(depth[c][p] < 4 for p in range(a, b)) >= 20:
            taken.append((c, i))
            total[c] += b - a
            for p in range(a, b):
                depth[c][p] += depth[c][p] < 6
    df = spark.createDataFrame([frags_[i] for i in rng.permutation(500)], "subject_id long, ord long, start long, stop long").repartition(3)
    got = select.coverage_capped(df, spark.createDataFrame(list(lengths.items()), "subject_id long, length long"), 4, cap=6)
    assert rows(got, "subject_id", "ord") == sorted(taken)
    assert select.coverage_capped(df.limit(0), spark.createDataFrame([(0, 10)], "subject_id long, length long"), 4).count() == 0


def plain_mask(score, k, n, threshold, extend):
    """Masked places of a sequence of n bases, place by place."""
    span = k + 4
    mean = [int(sum(score[i : i + 5])) // 5 for i in range(max(0, n - span))]
    best, masked = [0] * n, [False] * n
    if not mean:
        return masked
    for i, m in enumerate(mean):
        for p in range(i, i + span):
            best[p] = max(best[p], m)
            masked[p] |= m >= threshold
    i = 0
    while i < n:
        j = i
        while j < n and masked[j] == masked[i]:
            j += 1
        if not masked[i] and min(best[i:j]) >= extend:
            masked[i:j] = [True] * (j - i)
        i = j
    return masked


@pytest.mark.parametrize("size", [16, 37, 1 << 20])
def test_repeats_in_pieces_are_those_of_whole_sequences(spark, size):
    rng, k = np.random.default_rng(size), 5
    seqs = []
    for i in range(12):
        parts = ["".join(rng.choice(list("ACGT"), rng.integers(1, 250))) for _ in range(3)]
        seqs.append((i, ("ACACACAC" * int(rng.integers(0, 12))).join(parts)))
    seqs += [(20, "ACGTN"), (21, ""), (22, None), (23, "AC" * 200), (24, "acgt" * 3)]
    df = spark.createDataFrame(seqs, "sid long, seq string")
    both = {}
    turn = str.maketrans("ACGT", "TGCA")
    clean = {i: "".join(c if c in "ACGT" else "A" for c in (s or "").upper()) for i, s in seqs}
    for s in clean.values():
        for strand in (s, s[::-1].translate(turn)):
            for p in range(len(strand) - k + 1):
                both[strand[p : p + k]] = both.get(strand[p : p + k], 0) + 1
    counted = sorted(both.values(), reverse=True)
    t = {name: counted[int(len(counted) * (1.0 - share))] for name, share in kmers.THRESHOLDS}
    expected = []
    for i, s in clean.items():
        score = [min(n, t["t_high"]) if n >= t["t_low"] else t["t_low"] // 2 for n in (both[s[p : p + k]] for p in range(len(s) - k + 1))]
        masked = np.array([False, *plain_mask(score, k, len(s), t["t_threshold"], t["t_extend"]), False])
        edge = np.flatnonzero(np.diff(masked.astype(np.int8))).reshape(-1, 2)
        expected += [(i, int(a), int(b)) for a, b in edge]
    assert expected and rows(masking.repeat_regions(df, k, size=size, call=300), "chr", "start", "stop") == sorted(expected)
    assert masking.repeat_regions(df.limit(0), k).count() == 0


def test_runs_of_a_piece():
    hot = np.array([0, 1, 1, 0, 0, 1, 0, 0], bool)
    best = np.array([5, 9, 9, 5, 5, 9, 5, 1])
    assert masking.piece_runs(best, hot, 0, 8, 4) == [(0, 1, False, True, True), (1, 3, False, True, True), (3, 5, False, True, True), (5, 6, False, True, True)]
    # the same places inside a longer sequence: the first and last ones belong to the pieces beside
    assert masking.piece_runs(best, hot, 11, 30, 4) == [(11, 13, False, True, True), (13, 15, False, True, True), (15, 16, False, True, True)]
    warm = np.full(6, 5)
    assert masking.piece_runs(warm, np.zeros(6, bool), 10, 30, 4) == [(10, 14, True, True, True)]


@pytest.mark.parametrize("gap", [0, 7])
def test_scans_of_a_hot_chromosome(spark, gap):
    rng = np.random.default_rng(gap)
    spans = [(1 if rng.random() < 0.8 else int(rng.integers(2, 5)), int(a), int(a + rng.integers(1, 40))) for a in rng.integers(0, 6_000, 500)]
    spans += [(1, 50, 51)] * 200 + [(9, 10, 20), (None, 1, 4), (None, 3, 9)]
    df = spark.createDataFrame(spans, "chr long, start long, stop long")
    merged, depth = [], []
    for c in {x[0] for x in spans}:
        own = sorted(x[1:] for x in spans if x[0] == c)
        out = [list(own[0])]
        for a, b in own[1:]:
            if a <= out[-1][1] + gap:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        merged += [(c, *x) for x in out]
        places = sorted({p for x in own for p in x})
        by = {p: sum((x[0] == p) - (x[1] == p) for x in own) for p in places}
        places, run = [p for p in places if by[p]], 0
        for p, q in zip(places, [*places[1:], None], strict=True):
            run += by[p]
            depth += [(c, p, q, run)] if run else []
    by_text = lambda x: sorted(x, key=str)
    assert by_text(map(tuple, intervals.merge(df, gap).collect())) == by_text(merged)
    assert by_text(map(tuple, intervals.depth(df).collect())) == by_text(depth)
    binned = scans.binned(df.groupBy("chr", "start").agg(F.max("stop").alias("stop")), "start", 16)
    assert binned.where("chr = 1").groupBy(scans.BIN).count().agg(F.count("*"), F.max("count")).first()[0] >= 14
    sizes = [(1, 7_000), (9, 20), (30, 5)]
    gaps = []
    for c, n in sizes:
        at = 0
        for _, a, b in sorted(x for x in merged if x[0] == c):
            gaps += [(c, at, a)] if at < a else []
            at = b
        gaps += [(c, at, n)] if at < n else []
    assert rows(intervals.complement(intervals.merge(df, gap), spark.createDataFrame(sizes, "chr long, length long")), "chr", "start", "stop") == sorted(gaps)


def test_as_of_join(spark):
    rng = np.random.default_rng(5)
    loci = [(1 if rng.random() < 0.9 else 2, int(x)) for x in rng.integers(0, 1_000, 200)] + [(1, 400)] * 50
    queries = [(i, int(rng.integers(1, 4)), int(rng.integers(-5, 1_005))) for i in range(300)]
    got = intervals.nearest_before(spark.createDataFrame(queries, "q long, sid long, at long"), spark.createDataFrame(loci, "sid long, locus long"), "sid", "at", "locus")
    assert rows(got, "q", "locus") == [(q, max((x for c, x in loci if c == s and x <= at), default=None)) for q, s, at in queries]


def test_containment_looks_at_hits_taken(spark):
    rows_ = [(1, 0, 100, 0, 100, 9), (1, 8, 108, 8, 108, 8), (1, 16, 116, 16, 116, 7), (2, 16, 116, 16, 116, 7)]
    df = spark.createDataFrame(rows_, "read_id long, qbeg long, qend long, sbeg long, send long, score long")
    assert rows(intervals.not_contained(df, ["read_id"]), "read_id", "score") == [(1, 7), (1, 9), (2, 7)]


def test_budget_within_a_narrowed_range(spark):
    df = spark.range(5_000).selectExpr("id i", "id % 7 + 1 n")
    total, expected = 0, []
    for i in range(5_000):
        if total >= 9_000:
            break
        expected.append((i,))
        total += i % 7 + 1
    for most in (10, 1_000_000):
        assert rows(select.take_budget(df, ["i"], "n", 9_000, buckets=8, most=most), "i") == expected
    assert select.take_budget(df, ["i"], "n", 10**9).count() == 5_000
    same = df.selectExpr("1 i", "i j", "n")
    assert select.take_budget(same, ["i", "j"], "n", 100, most=10).count() == select.take_budget(df, ["i"], "n", 100).count()


def test_pieces_of_sequences(spark):
    r = random.Random(5)
    seqs = [(1, "".join(r.choice("ACGT") for _ in range(1234))), (2, "ACG"), (3, ""), (4, None), (5, "A" * 100)]
    got = {(x.sid, x.piece): (x.start, x.part, x.length) for x in pieces.pieces(spark.createDataFrame(seqs, "sid long, seq string"), 100, 7, 11).collect()}
    expected = {(i, n): (max(0, n * 100 - 7), s[max(0, n * 100 - 7) : n * 100 + 111], len(s)) for i, s in seqs if s for n in range(-(-len(s) // 100))}
    assert got == expected and len(got) == 15


@pytest.mark.parametrize("stride", [1, 4, 130])
def test_intervals_over_pieces(spark, monkeypatch, stride):
    r = random.Random(6)
    monkeypatch.setattr(kmers, "PIECE", 64)  # so that intervals lie across pieces
    seqs = {1: "".join(r.choice("ACGT") for _ in range(900)), 2: "ACGTACGTA"}
    regions = [(1, 0, 900), (1, 63, 64), (1, 50, 70), (1, 60, 260), (1, 128, 192), (1, 895, 2000), (1, 880, 2000), (1, 70, 70), (1, 90, 80), (2, 0, 9), (2, 3, 9), (3, 0, 50), (None, 0, 50), (1, None, 50)]
    df = spark.createDataFrame(list(seqs.items()), "sid long, seq string")
    got = kmers.extract_intervals(df, spark.createDataFrame(regions, "chr long, start long, stop long"), 8, stride).collect()
    expected = []
    for c, lo, hi in regions:
        text = seqs.get(c, "")
        if lo is not None:
            expected += [(c, int(kmers.hashes(text[i : i + 8].encode(), 8)[0]), i) for i in range(lo, min(hi, len(text)) - 7, stride)]
    assert sorted((x.sid, x.hash, x.soff) for x in got) == sorted(expected) and expected


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_streamed_keys(spark, batch):
    r = random.Random(7)
    rows = [(k, i, r.choice("abc") * r.randint(0, 5)) for k in range(40) for i in range(r.choice([1, 2, 9, 30]))] + [(None, 1, "x")]
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        each = lambda t: [(t.column("k")[0].as_py(), t.num_rows, "".join(t.column("s").to_pylist()))] * 7
        df = spark.createDataFrame(rows, "k long, i int, s string")
        got = scans.streamed(df, "k", ["i"], each, "k long, n int, s string").collect()
        assert scans.streamed(df.limit(0), "k", ["i"], each, "k long, n int, s string").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    by = {}
    for k, _, s in sorted(x for x in rows if x[0] is not None):
        by.setdefault(k, []).append(s)
    assert sorted(map(tuple, got)) == sorted((k, len(s), "".join(s)) for k, s in by.items() for _ in range(7))


def test_bases_of_places(spark):
    r = random.Random(8)
    seqs = {1: "".join(r.choice("ACGT") for _ in range(1000)), 2: "ACGT", 3: ""}
    places = [(1, 0, 1000), (1, 63, 65), (1, 64, 128), (1, 100, 900), (1, 990, 1200), (1, 1500, 1600), (2, 1, 3), (2, 2, 2), (3, 0, 4), (4, 0, 4), (1, 5, 2)]
    df = spark.createDataFrame([*places, (1, 63, 65)], "sid long, a long, b long")
    got = sorted(map(tuple, pieces.bases(df, spark.createDataFrame(list(seqs.items()), "sid long, seq string"), "a", "b", "s", 64).collect()), key=repr)
    assert got == sorted(((i, a, b, seqs.get(i, "")[a:b] or None) for i, a, b in places), key=repr)
