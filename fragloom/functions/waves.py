"""Local alignments by waves: how far along each diagonal a number of differences reaches, for a batch of pairs at once.

A pair is extended from a seed to both sides. Wave d holds, for each diagonal, the furthest place that d differences reach: from
the wave before by a substitution or a gap, and on over equal bases, eight at a time. An end scores its bases on both sequences
less `cost` for each difference; the furthest places are all that matters, so the best end of all waves is the best end there is.
Diagonals whose score has fallen `drop` below the best are given up, so that a wave holds 2 * drop / cost + 1 of them at most, and
memory grows in proportion to the differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A difference costs as much as that many bases (of both sequences together): stretches with fewer than 2 / COST differences a base gain.
COST, DROP = 5, 150
#: Bytes of sequences that are aligned at once.
BATCH = 1 << 20
_OUT = -(1 << 30)


@dataclass
class Ends:
    """Of each pair: bases of both sequences that its best extension takes, its differences, and its gapped rows."""

    q: np.ndarray
    s: np.ndarray
    errors: np.ndarray
    rows: list[tuple[str, str]]


def _laid(texts: list[bytes], end: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts one after another, each before eight bytes that equal none of the others', as words from each byte on; starts and sizes."""
    buf = np.frombuffer(b"".join(t + end * 8 for t in texts) + end * 8, np.uint8)
    words = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    size = np.array([len(t) for t in texts], np.int64)
    return words, np.cumsum(size + 8) - size - 8, size


def extend(pairs: list[tuple[bytes, bytes]], cost: int = COST, drop: int = DROP, trace: bool = True) -> Ends:
    """The best common beginnings of pairs."""
    n, half = len(pairs), drop // cost + 1
    width = 2 * half + 1
    qw, q0, qn = _laid([p[0] for p in pairs], b"\xff")
    sw, s0, sn = _laid([p[1] for p in pairs], b"\xfe")
    side = np.arange(width) - half
    centre = np.zeros(n, np.int64)
    best, best_at, best_i, best_d = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    reach = np.full((n, width), _OUT, np.int64)
    reach[:, half] = 0
    live, d, history = np.arange(n), 0, []
    while len(live):
        diagonal = centre[live][:, None] + side
        at = reach[live]
        row, col = np.nonzero(at >= 0)
        i, k, pair = at[row, col], diagonal[row, col], live[row]
        inside = (i <= qn[pair]) & (i + k <= sn[pair]) & (i + k >= 0)
        at[row[~inside], col[~inside]] = _OUT
        row, col, i, k, pair = (x[inside] for x in (row, col, i, k, pair))
        todo, i = np.arange(len(i)), i.copy()
        while len(todo):  # over equal bases
            x = qw[q0[pair[todo]] + i[todo]] ^ sw[s0[pair[todo]] + i[todo] + k[todo]]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
            i[todo] += same
            todo = todo[same == 8]
        at[row, col] = i
        score = np.where(at >= 0, 2 * at + diagonal - cost * d, _OUT)
        top = score.argmax(1)
        high = score[np.arange(len(live)), top]
        better = np.flatnonzero(high > best[live])
        to = live[better]
        best[to], best_d[to], best_i[to], best_at[to] = high[better], d, at[better, top[better]], diagonal[better, top[better]]
        at[score < (best[live] - drop)[:, None]] = _OUT
        reach[live] = at
        if trace:
            history.append((live, centre[live].copy(), at.astype(np.int32)))
        going = (at >= 0).any(1)
        live, at, top = live[going], at[going], top[going]
        if not len(live):
            break
        shift = side[top]  # the window follows the best diagonal
        centre[live] += shift
        wide = np.full((len(live), 3 * width + 2), _OUT, np.int64)
        wide[:, width + 1 : 2 * width + 1] = at
        from_ = np.arange(width)[None, :] + shift[:, None] + width + 1
        take = lambda by: np.take_along_axis(wide, from_ + by, 1)  # noqa: B023, E731
        reach[live] = np.maximum(np.maximum(take(0) + 1, take(1) + 1), take(-1))
        d += 1
    ends = Ends(best_i, best_i + best_at, best_d, [])
    if trace:
        ends.rows = _traced(pairs, ends, best_at, history, half)
    return ends


def _traced(pairs: list[tuple[bytes, bytes]], ends: Ends, diagonal: np.ndarray, history: list, half: int) -> list[tuple[str, str]]:
    """Gapped rows, from the best ends back through the waves."""
    place = [dict(zip(live.tolist(), range(len(live)), strict=True)) for live, _, _ in history]
    out = []
    for p, (q, s) in enumerate(pairs):
        i, k, a, b = int(ends.q[p]), int(diagonal[p]), [], []
        for d in range(int(ends.errors[p]), 0, -1):
            at = place[d - 1][p]
            _, centre, reach = history[d - 1]

            def before(j: int, at: int = at, centre=centre, reach=reach) -> int:
                x = j - int(centre[at]) + half
                return int(reach[at, x]) if 0 <= x <= 2 * half else _OUT

            from_ = {k: before(k) + 1, k + 1: before(k + 1) + 1, k - 1: before(k - 1)}
            source = max(from_, key=lambda x: (from_[x], x == k))
            begin = from_[source]
            a.append(q[begin:i])
            b.append(s[begin + k : i + k])
            if source == k:
                a.append(q[begin - 1 : begin])
                b.append(s[begin + k - 1 : begin + k])
            elif source == k + 1:
                a.append(q[begin - 1 : begin])
                b.append(b"-")
            else:
                a.append(b"-")
                b.append(s[begin + k - 1 : begin + k])
            i, k = begin - (source != k - 1), source
        a.append(q[:i])
        b.append(s[: i + k])
        out.append((b"".join(reversed(a)).decode(), b"".join(reversed(b)).decode()))
    return out


def local(pairs: list[tuple[bytes, bytes]], seeds: list[tuple[int, int]], cost: int = COST, drop: int = DROP) -> list[tuple[int, int, int, int, int, str, str]]:
    """(qoff, qend, soff, send, differences, gapped rows) of the best alignment through each pair's seed (places on both sequences)."""
    back = extend([(q[:i][::-1], s[:j][::-1]) for (q, s), (i, j) in zip(pairs, seeds, strict=True)], cost, drop)
    on = extend([(q[i:], s[j:]) for (q, s), (i, j) in zip(pairs, seeds, strict=True)], cost, drop)
    ends = zip(seeds, back.q.tolist(), on.q.tolist(), back.s.tolist(), on.s.tolist(), (back.errors + on.errors).tolist(), back.rows, on.rows, strict=True)
    return [(i - q0, i + q1, j - s0, j + s1, d, x[0][::-1] + y[0], x[1][::-1] + y[1]) for (i, j), q0, q1, s0, s1, d, x, y in ends]


LOCAL = "qoff long, qend long, soff long, send long, errors long, q_row string, s_row string"


def local_alignments(rows: DataFrame, *keys: str, cost: int = COST, drop: int = DROP) -> DataFrame:
    """(keys, LOCAL) of rows (keys, q, s, q0, s0): the best alignment of the sequences q and s through the places q0 and s0.

    Rows stay where they are; batches of about a megabyte are aligned together. A null or empty sequence has an empty alignment.
    """
    names = [f.split()[0] for f in LOCAL.split(", ")]
    kinds = [*[pa.int64()] * 5, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [((q or "").encode("ascii", "replace"), (s or "").encode("ascii", "replace")) for q, s in zip(batch.column("q").to_pylist(), batch.column("s").to_pylist(), strict=True)]
            seeds = list(zip(batch.column("q0").to_pylist(), batch.column("s0").to_pylist(), strict=True))
            part = np.cumsum([len(q) + len(s) for q, s in pairs]) // BATCH
            for at in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(part)) + 1) if pairs else []:
                at = at.tolist()
                found = local([pairs[i] for i in at], [(min(seeds[i][0] or 0, len(pairs[i][0])), min(seeds[i][1] or 0, len(pairs[i][1]))) for i in at], cost, drop)
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in keys), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*keys, *names])

    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "q", "s", "q0", "s0").mapInArrow(run, f"{schema}, {LOCAL}")
