"""Simulated reads: pieces between sites of a random genome, on random strands, with errors, must come back."""

import random

import pytest

from fragloom.operators import enzymes, mapping
from fragloom.plans import mapping as plan
from fragloom.plans import tagging


@pytest.mark.parametrize("site", ["^GATC", "A^AGCTT", "CATG^"])
def test_simulated_reads(spark, site):
    r = random.Random(3)
    some = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    enzyme = enzymes.parse(site)
    genome = {0: some(40_000), 1: some(30_000)}
    if len(enzyme.motif) > 4:  # as often as a site of four bases
        genome = {c: "".join(g[i : i + 300] + enzyme.motif for i in range(0, len(g), 300)) for c, g in genome.items()}
    reads, truth = [], []
    for q in range(6):
        parts = []
        for _ in range(r.randint(2, 4)):
            sid = r.randint(0, 1)
            sites = enzymes.site_offsets(genome[sid], enzyme).tolist()
            i = r.choice([i for i in range(len(sites) - 1) if 250 <= sites[i + 1] - sites[i] <= 1500])
            a, b = sites[i] + enzyme.cut, sites[i + 1] + enzyme.cut
            if any(t[0] == q and t[1] == sid and t[3] == a for t in truth):
                continue
            x = "".join(c if r.random() > 0.05 else r.choice(["", "A", "C" + c]) for c in genome[sid][a:b])
            d = r.randint(0, 1)
            parts.append(mapping.reverse(x) if d else x)
            truth.append((q, sid, d, a, b))
        reads.append((q, "".join(parts)))
    out = plan.map_reads(spark.createDataFrame(reads, "qid long, seq string"), spark.createDataFrame(list(genome.items()), "sid long, seq string"), enzyme).collect()
    near = lambda x, t: (x.read_id, x.subject_id, x.qdir) == t[:3] and abs(x.soff - t[3]) <= 30 and abs(x.send - t[4]) <= 30
    found = sum(any(near(x, t) for x in out) for t in truth)
    assert found >= 0.9 * len(truth)
    by = {}
    for x in out:
        assert 0 <= x.mapq <= 60 and x.fwd_qend - x.fwd_qoff >= 50 and 0 <= x.fwd_qoff < x.fwd_qend <= x.qsize and 0 <= x.soff < x.send <= x.ssize
        by.setdefault(x.read_id, []).append((x.fwd_qoff, x.fwd_qend))
        clipped = sum(int(n) for n in __import__("re").findall(r"(\d+)[SMI]", x.cigar))
        assert clipped == x.qsize
    for spans in by.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_quality():
    assert mapping.mapping_quality(95.0, None, mapping.PERFECT) == 60
    assert mapping.mapping_quality(95.0, None, mapping.COMPLETE) == 50
    assert mapping.mapping_quality(95.0, None, mapping.MOST) == 30
    assert mapping.mapping_quality(95.0, 95.0, mapping.PERFECT) == 0


def test_neighbours_abut_where_the_enzyme_cuts():
    r = random.Random(9)
    some = lambda n: "".join(r.choice("CGT") for _ in range(n))  # noqa: E731  no site by chance
    for site, expected in (("^GATC", 0), ("A^AGCTT", 1), ("CATG^", 4)):
        enzyme = enzymes.parse(site)
        text = some(100) + enzyme.motif + some(90) + enzyme.motif + some(80)
        at = [100, 100 + len(enzyme.motif) + 90]
        for read, qdir in ((text, 0), (mapping.reverse(text), 1)):
            strand = text  # the strand that aligns with the reference
            ref = mapping.Reference([(0, 0, text)], {0: len(text)})
            ends = [0, *at, len(text)]
            parts = [mapping.Alignment(qdir, p, q, len(read), 0, p, q, text[p:q], text[p:q], 5, eq=(p, q), es=(p, q)) for p, q in zip(ends, ends[1:], strict=False)]
            parts = [mapping.at_cut(x, enzyme, strand, ref) for x in parts]
            by = expected if qdir == 0 else len(enzyme.motif) - expected
            assert [(x.qoff, x.soff) for x in parts[1:]] == [(x.qend, x.send) for x in parts[:-1]] == [(p + by, p + by) for p in at]
            assert "".join(x.a for x in parts) == text and all(x.a == x.b for x in parts)


def test_overlaps_on_the_reference_go_between_all_pairs():
    r = random.Random(2)
    text = "".join(r.choice("ACGT") for _ in range(2_000))
    made = lambda q, s, e: mapping.Alignment(0, q, q + e - s, 3_000, 0, s, e, text[s:e], text[s:e], 5, mapq=60)
    chain = [made(0, 0, 1_000), made(1_000, 300, 420), made(1_200, 500, 640), made(1_400, 950, 1_500)]
    out = mapping.trimmed(chain, mapping.COMPLETE, None)
    for i, x in enumerate(out):
        assert x.qend - x.qoff >= 50 and all(min(x.send, y.send) <= max(x.soff, y.soff) for y in out[:i])
    assert [(x.soff, x.send) for x in out] == [(0, 1_000), (1_000, 1_500)]


def test_only_the_best_of_one_place_is_weighed():
    text = "ACGT" * 100
    made = lambda a, b, bad=0: mapping.Alignment(0, a, b, 400, 0, a, b, "T" * bad + text[a + bad : b], "G" * bad + text[a + bad : b], 5)
    best, short, worse, low = made(0, 300), made(10, 200), made(120, 320, 30), made(350, 390)
    assert mapping.weighed([low, worse, short, best]) == [best]


def simulated(r, genome, enzyme, n, flips=None):
    """Reads of three fragments between sites; flips: {sid: {place: base}} of the second haplotype, which every other read has."""
    reads, truth = [], []
    for q in range(n):
        read = ""
        for _ in range(3):
            sid = r.randint(0, len(genome) - 1)
            text = genome[sid] if not flips or q % 2 == 0 else "".join(flips[sid].get(i, c) for i, c in enumerate(genome[sid]))
            sites = [x for x in enzymes.site_offsets(genome[sid], enzyme).tolist() if 500 < x < len(text) - 500]
            i = r.choice([i for i in range(len(sites) - 1) if 250 <= sites[i + 1] - sites[i] <= 1500])
            part = text[sites[i] : sites[i + 1]]
            read += mapping.reverse(part) if r.randint(0, 1) else part
        reads.append((q, read))
    return reads, truth


def test_enzymes_are_told_by_alignments(spark):
    r = random.Random(4)
    enzyme = enzymes.parse("^GATC")
    genome = {s: "".join(r.choice("ACGT") for _ in range(20_000)) for s in range(2)}
    reads, _ = simulated(r, genome, enzyme, 12)
    counted = plan.infer_enzyme(spark.createDataFrame(reads, "qid long, seq string"), spark.createDataFrame(list(genome.items()), "sid long, seq string"))
    got = {x.enzyme: x.n for x in counted.collect()}
    assert set(got) == set(enzymes.CATALOGUE)
    best = enzymes.winner(counted).first()
    assert enzymes.parse(enzymes.CATALOGUE[best.enzyme]).motif == "GATC" and best.best >= 2


def test_tags_of_simulated_haplotypes(spark, tmp_path):
    from fragloom.operators import haplotypes

    r = random.Random(6)
    enzyme = enzymes.parse("^GATC")
    genome = {s: "".join(r.choice("ACGT") for _ in range(20_000)) for s in range(2)}
    other = {"A": "C", "C": "A", "G": "T", "T": "G"}
    flips = {s: {i: other[g[i]] for i in range(60, len(g), 97) if "GATC" not in g[i - 4 : i + 5] and "GATC" not in g[i - 4 : i] + other[g[i]] + g[i + 1 : i + 5]} for s, g in genome.items()}
    reads, _ = simulated(r, genome, enzyme, 10, flips)
    snps = [(s, i, genome[s][i], b, 0, 1) for s, own in flips.items() for i, b in own.items()]
    fragments = plan.map_reads(spark.createDataFrame(reads, "qid long, seq string"), spark.createDataFrame(list(genome.items()), "sid long, seq string"), enzyme)
    tagged, imputed = haplotypes.tag_fragments(fragments, spark.createDataFrame(snps, "sid long, soff long, ref string, alt string, gt0 long, gt1 long"))
    rows = tagged.collect()
    assert len(rows) >= 20 and all(x.hp in (0, x.read_id % 2 + 1) for x in rows) and sum(x.hp > 0 for x in rows) >= 0.8 * len(rows)
    assert {(x.step, x.hp) for x in haplotypes.tag_counts(tagged, imputed).collect()} >= {("tagged", 1), ("imputed", 2)}
    named = plan.with_names(fragments, spark.createDataFrame([(q, f"r{q}", x, "I" * len(x)) for q, x in reads], "qid long, read_name string, seq string, qual string"), spark.createDataFrame([(s, f"c{s}") for s in genome], "sid long, sname string"))
    table = spark.createDataFrame(snps, "sid long, soff long, ref string, alt string, gt0 long, gt1 long")
    tagging.tag_files(named, table, str(tmp_path / "out"), [(f"c{s}", len(g)) for s, g in genome.items()])
    lists = tagging.read_tagged(spark, str(tmp_path / "out"))
    hp = lambda df, c="hp": sorted((x.read_id, x.frag_id, x[c] or 0) for x in df.collect())
    assert hp(lists[0]) == hp(tagged) and hp(lists[1]) == hp(imputed) == hp(lists[2], "HP")


def test_gaps_are_closed_by_a_neighbour():
    r = random.Random(21)
    text = "".join(r.choice("ACGT") for _ in range(1_200))
    for turned in (False, True):
        reads = (mapping.reverse(text), text) if turned else (text, mapping.reverse(text))
        ref = mapping.Reference([(0, 0, text)], {0: len(text)})
        made = lambda a, b, es: mapping.Alignment(int(turned), a, b, 1_200, 0, a, b, text[a:b], text[a:b], 5, eq=es, es=es)
        parts = [made(30, 400, (0, 400)), made(520, 1_180, (400, 1_200))]
        out = mapping.closed(sorted(parts, key=lambda x: x.span), reads, ref)
        assert sorted((x.qoff, x.qend, x.soff, x.send) for x in out) == [(0, 400, 0, 400), (400, 1_200, 400, 1_200)] and all(x.pi == 100 for x in out)
        assert mapping.is_complete(out) and mapping.kind_of(out) == mapping.PERFECT
    strange = mapping.Reference([(0, 0, text[:450] + "A" * 60 + text[510:])], {0: len(text)})
    assert mapping.closed([made(30, 400, (0, 400)), made(520, 700, (400, 700))], reads, strange)[-1].qoff in (400, 520)


def test_equal_chains_are_those_of_a_plain_enumerator():
    r = random.Random(31)
    for _ in range(150):
        n = r.randint(1, 8)
        spans = sorted(((a := r.randint(0, 60)), a + r.randint(5, 40)) for _ in range(n))
        spans = sorted(spans, key=lambda x: (x[1], x[0]))
        after = [[j for j in range(i + 1, n) if r.random() < 0.5 and spans[j][0] > spans[i][0]] for i in range(n)]
        chains = []

        def walk(chain, after=after, chains=chains):
            chains.append(chain)
            for j in after[chain[-1]]:
                walk((*chain, j))

        for i in range(n):
            walk((i,))
        cover = lambda c: sum(spans[i][1] - spans[i][0] for i in c) - sum(max(0, spans[i][1] - spans[j][0]) for i, j in zip(c, c[1:], strict=False))  # noqa: B023, E731
        best = max(map(cover, chains))
        expected = {c for c in chains if cover(c) == best and not after[c[-1]]}
        got = mapping.equal_chains(spans, after, most=1_000)
        assert set(got) == expected and len(got) == len(expected)
        assert len(mapping.equal_chains(spans, after)) == min(10, len(expected))


def test_a_clearly_better_chain_is_taken():
    text = "ACGT" * 100
    made = lambda a, b, bad=0: mapping.Alignment(0, a, b, 400, 0, a, b, "T" * bad + text[a + bad : b], "G" * bad + text[a + bad : b], 5)
    long, left, right = made(0, 400, 100), made(0, 200), made(200, 400)
    assert mapping.clearly_better([long], [left, right, long], mapping.Options(), None) == [left, right]
    assert mapping.clearly_better([long], [left, right, long], mapping.Options(), None, 30) == [long]


def test_collinear_runs_become_one_alignment():
    r = random.Random(12)
    text = "".join(r.choice("ACGT") for _ in range(900))
    ref = mapping.Reference([(0, 0, text)], {0: 900})
    made = lambda a, b: mapping.Alignment(0, a, b, 900, 0, a, b, text[a:b], text[a:b], 5)
    parts = [made(10, 200), made(260, 430), made(500, 700)]
    assert [[(x.qoff, x.qend) for x in run] for run in mapping.collinear_runs(parts)] == [[(10, 200), (260, 430), (500, 700)]]
    out = mapping.collinear(parts, text, ref)
    assert len(out) == 1 and out[0].qoff <= 10 and out[0].qend >= 700 and out[0].pi == 100
    other = "".join(r.choice("ACGT") for _ in range(900))  # the read between them is strange: nothing spans the run
    read = text[:110] + other[110:410] + text[410:500] + other[500:]
    pair = [made(10, 110), made(410, 500)]
    assert mapping.collinear_runs(pair) == [pair] and mapping.collinear(pair, read, ref) == pair
    far = [made(0, 100), made(420, 600)]
    assert mapping.collinear_runs(far) == []


def test_runs_are_replaced_by_what_spans_them():
    text = "ACGT" * 200
    made = lambda a, b, bad=0, d=0: mapping.Alignment(d, *((a, b) if d == 0 else (800 - b, 800 - a)), 800, 0, a, b, "T" * bad + text[a + bad : b], "G" * bad + text[a + bad : b], 5)
    chain = [made(0, 200), made(200, 400), made(400, 600), made(600, 800)]
    spanning, bad = made(200, 800, 60, 1), made(0, 800, 700)
    assert mapping.over_runs(chain, [bad, spanning]) == [chain[0], spanning]
    assert mapping.over_runs(chain, [bad]) == chain


@pytest.mark.parametrize("turned", [0, 1])
def test_ends_move_to_sites(turned):
    """Every start with every end: the rows are the read's and the reference's, the sites those that plain loops pair."""
    import numpy as np

    r, o = random.Random(40 + turned), mapping.Options()
    for _ in range(40):
        text = "".join(r.choice("ACGT") for _ in range(500))
        read = "".join(c if r.random() > 0.06 else r.choice(["", "A", "C" + c]) for c in text[20:480])
        ref = mapping.Reference([(7, 0, text)], {7: 500})
        a, b, _ = mapping.al.edit_align(read, text[20:480])
        x = mapping.Alignment(turned, 0, len(read), len(read), 7, 20, 480, a, b, 5)
        lo, hi = 40, len(a) - 40
        x = x.columns(lo, hi)
        own, other = (np.array(sorted(r.sample(range(n), 40))) for n in (len(read), 500))
        for first in (True, False):
            got = mapping.site_ends(x, own, other, first)
            q, s, far_q, far_s = (x.qoff, x.soff, x.qend, x.send) if first else (x.qend, x.send, x.qoff, x.soff)
            pairs = [(c, d) for c in own.tolist() for d in other.tolist() if abs(c - q) <= 30 and abs(d - s) <= 30 and (c < far_q and d < far_s if first else c > far_q and d > far_s) and abs(abs(far_q - c) - abs(far_s - d)) <= 50 and abs(1 - abs(far_q - c) / abs(far_s - d)) <= 0.2]
            assert [e[:2] for e in got if e[0] == e[2] and e[1] == e[3]][: len(pairs)] == pairs and got
            for c in own.tolist():
                if abs(c - q) <= 30 and x.qoff <= c <= x.qend and (c < far_q if first else c > far_q):
                    assert any(e[2] == c for e in got)
        out = mapping.snapped(x, own, other, read, ref)
        for y in out:
            assert y.a.replace("-", "") == read[y.qoff : y.qend] and y.b.replace("-", "") == text[y.soff : y.send] and y.pi >= 50
            assert all("-" not in (p, q) or p != q for p, q in zip(y.a, y.b, strict=True)) and len(y.a) == len(y.b)
        starts, ends = len(mapping.site_ends(x, own, other, True)), len(mapping.site_ends(x, own, other, False))
        assert len(out) <= starts * ends and len(out) >= 0.5 * starts * ends
    assert mapping.nearest_site(np.array([10, 20]), 15, True) == 10 and mapping.nearest_site(np.array([10, 20]), 15, False) == 20 and mapping.nearest_site(np.zeros(0), 3, True) == -1
