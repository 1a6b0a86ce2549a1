"""Waves against the whole table of a dynamic programme."""

import random

import numpy as np
import pytest

from fragloom.functions import waves


def full(q, s, cost):
    """The best score of a common beginning: bases less cost times edit distance."""
    row, best = list(range(len(s) + 1)), 0
    for i in range(len(q) + 1):
        if i:
            old, row = row, [i]
            for j in range(1, len(s) + 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (q[i - 1] != s[j - 1])))
        best = max(best, max(i + j - cost * d for j, d in enumerate(row)))
    return best


def edited(r, text, rate):
    return "".join(c if r.random() > rate else r.choice(["", r.choice("ACGT"), c + r.choice("ACGT")]) for c in text)


def check(pair, ends, p, cost):
    q, s = pair
    a, b = ends.rows[p]
    assert len(a) == len(b) and a.replace("-", "").encode() == q[: ends.q[p]] and b.replace("-", "").encode() == s[: ends.s[p]]
    assert sum(x != y for x, y in zip(a, b, strict=True)) == ends.errors[p]
    return int(ends.q[p] + ends.s[p] - cost * ends.errors[p])


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.15, 0.25, 0.35])
def test_scores_are_those_of_the_whole_table(rate):
    r, pairs = random.Random(int(100 * rate)), []
    for _ in range(40):
        text = "".join(r.choice("ACGT") for _ in range(r.randint(0, 160)))
        strange = "".join(r.choice("ACGT") for _ in range(r.choice([0, 60])))
        pairs.append((text.encode(), (edited(r, text, rate) + strange).encode()))
    pairs += [(b"", b""), (b"ACGT", b""), (b"", b"ACGT"), (b"A" * 300, b"A" * 300), (b"A" * 100, b"C" * 100)]
    ends = waves.extend(pairs)
    for p, (q, s) in enumerate(pairs):
        assert check((q, s), ends, p, waves.COST) == full(q.decode(), s.decode(), waves.COST)


def test_a_small_drop_loses_little_and_bounds_the_waves():
    r, pairs = random.Random(3), []
    for _ in range(30):
        text = "".join(r.choice("ACGT") for _ in range(400))
        pairs.append((text.encode(), edited(r, text, 0.2).encode()))
    wide, narrow = waves.extend(pairs, drop=400), waves.extend(pairs, drop=60)
    scores = [[check(pairs[p], e, p, waves.COST) for p in range(30)] for e in (wide, narrow)]
    assert all(b <= a for a, b in zip(*scores, strict=True)) and np.mean([b / a for a, b in zip(*scores, strict=True)]) >= 0.95
    # a gap of 25 bases costs 125 and is crossed, one of 60 isn't
    text = "".join(r.choice("ACGT") for _ in range(600))
    for gap, crossed in ((25, True), (60, False)):
        ends = waves.extend([(text.encode(), (text[:300] + text[300 + gap :]).encode())])
        assert (ends.q[0] == 600) == crossed


def test_local_alignments_through_a_seed(spark):
    r, rows = random.Random(5), []
    for i in range(60):
        core = "".join(r.choice("ACGT") for _ in range(300))
        own = edited(r, core, 0.1)
        left, right = ("".join(r.choice("ACGT") for _ in range(n)) for n in (80, 90))
        other, after = ("".join(r.choice("ACGT") for _ in range(n)) for n in (50, 40))
        at = next(x for x in range(100, 250) if core[x : x + 12] in own)
        rows.append((i, left + core + right, other + own + after, len(left) + at, len(other) + own.index(core[at : at + 12])))
    rows += [(100, None, "ACGT", 0, 0), (101, "", "", 5, 7), (102, "ACGT", "ACGT", 9, 9), (103, "ACGTACGT", "ACGTACGT", 4, 4)]
    df = spark.createDataFrame(rows, "id long, q string, s string, q0 long, s0 long").selectExpr("*", "1 as errors", "2 as qoff").repartition(3)
    got = {x.id: x for x in waves.local_alignments(df, "id").collect()}
    for i, q, s, _, _ in rows:
        x = got[i]
        q, s = q or "", s or ""
        assert x.q_row.replace("-", "") == q[x.qoff : x.qend] and x.s_row.replace("-", "") == s[x.soff : x.send]
        if i < 100:
            assert abs(x.qoff - 80) <= 25 and abs(x.qend - 380) <= 25 and x.errors <= 75
    assert (got[103].qoff, got[103].qend, got[103].errors) == (0, 8, 0) and got[101].qend == 0
    assert waves.local_alignments(df.limit(0), "id").count() == 0
