"""Alignments of two sequences in numpy: global, prefix and affine, and measures of gapped rows.

A row of the table is one step of vector operations: what a cell takes from its left neighbour is a running minimum (or
maximum) over the row, so no loop over cells is needed. A band keeps rows short for sequences of like length.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_FAR = 1 << 28
DIAG, UP, LEFT = 0, 1, 2


def _bytes(x: str | bytes) -> np.ndarray:
    return np.frombuffer(x.encode() if isinstance(x, str) else x, np.uint8)


def _walk(q: str, s: str, moves: np.ndarray, starts: np.ndarray, i: int, j: int) -> tuple[str, str]:
    a, b = [], []
    while i or j:
        move = moves[i, j - starts[i]] if i else LEFT
        if not j:
            move = UP
        a.append("-" if move == LEFT else q[i - 1])
        b.append("-" if move == UP else s[j - 1])
        i, j = i - (move != LEFT), j - (move != UP)
    return "".join(reversed(a)), "".join(reversed(b))


def edit_align(q: str, s: str, band: int | None = None, free_end: bool = False) -> tuple[str, str, int]:
    """Gapped rows and distance of the best edit alignment of all of q with all of s (free_end: with a prefix of s).

    A band is doubled until the distance is under what leaving it would cost, so the result is exact.
    """
    n, m = len(q), len(s)
    if free_end:
        band = None
    elif band is not None:
        band = max(band, abs(n - m) + 1)
    while True:
        width = m + 1 if band is None else min(m + 1, 2 * band + 1)
        starts = np.zeros(n + 1, np.int64) if band is None else np.clip(np.arange(n + 1) * m // max(1, n) - band, 0, m + 1 - width)
        moves = np.full((n + 1, width), LEFT, np.uint8)
        row = np.arange(width) + starts[0]
        a, b = _bytes(q), _bytes(s)
        ar = np.arange(width)
        for i in range(1, n + 1):
            lo, step = starts[i], starts[i] - starts[i - 1]
            up = np.full(width, _FAR)
            up[: width - step] = row[step:]
            diag = np.full(width, _FAR)
            if step:
                diag[: width - step + 1] = row[step - 1 :]
            else:
                diag[1:] = row[:-1]
            same = np.zeros(width, bool)
            own = b[max(0, lo - 1) : lo + width - 1]
            same[width - len(own) :] = own == a[i - 1]
            diag = diag + ~same
            up = up + 1
            best = np.minimum(diag, up)
            if lo == 0:
                best[0], up[0] = i, i
            row = np.minimum.accumulate(best - ar) + ar
            moves[i] = np.where(row == diag, DIAG, np.where(row == up, UP, LEFT))
        j = int(row.argmin()) if free_end else m
        d = int(row[j - starts[n]])
        if band is None or d <= band or width > m:
            a_, b_ = _walk(q, s, moves, starts, n, j)
            return a_, b_, d
        band *= 2


def prefix_align(q: str, s: str) -> tuple[str, str, int]:
    return edit_align(q, s, free_end=True)


def affine_align(q: str, s: str, match: int = 2, mismatch: int = -4, gap_open: int = 4, gap_extend: int = 2, band: int | None = None) -> tuple[str, str, int]:
    """Gapped rows and score of the best global alignment where a gap of k costs open + k * extend; a band only narrows the search."""
    n, m = len(q), len(s)
    half = m if band is None else band + abs(n - m) + 1
    width = min(m + 1, 2 * half + 2)
    starts = np.clip(np.arange(n + 1) * m // max(1, n) - half, 0, m + 1 - width)  # the first place of each row's window
    a, b, window = _bytes(q), np.concatenate([[0], _bytes(s)]), np.arange(width)
    h = -(gap_open + gap_extend * window.astype(np.int64))
    h[0] = 0
    f = np.full(width, -_FAR, np.int64)
    take, longer_up, gap_left = np.zeros((n + 1, width), np.uint8), np.zeros((n + 1, width), bool), np.zeros((n + 1, width), np.int32)
    take[0], gap_left[0] = LEFT, window
    outside = np.full(width + 1, -_FAR, np.int64)
    for i in range(1, n + 1):
        by, ar = int(starts[i] - starts[i - 1]), window + starts[i]
        before = np.concatenate([outside[:1], h, outside])  # from one place left of the last window on
        h, f = before[by + 1 : by + 1 + width], np.concatenate([f, outside])[by : by + width]
        opened, extended = h - gap_open - gap_extend, f - gap_extend
        f = np.maximum(opened, extended)
        longer_up[i] = extended > opened
        diag = before[by : by + width] + np.where(b[ar] == a[i - 1], match, mismatch)
        if not ar[0]:
            diag[0] = -_FAR
        best = np.maximum(diag, f)
        run = np.maximum.accumulate(best + gap_extend * ar)
        e = np.full(width, -_FAR, np.int64)
        e[1:] = run[:-1] - gap_open - gap_extend * ar[1:]
        h = np.maximum(best, e)
        take[i] = np.where(h == diag, DIAG, np.where(h == f, UP, LEFT))
        at = np.maximum.accumulate(np.where(best + gap_extend * ar == run, ar, 0))
        gap_left[i, 1:] = ar[1:] - at[:-1]
    i, j, x, y = n, m, [], []
    while i or j:
        k = j - int(starts[i])
        move = take[i, k] if i and j else (UP if i else LEFT)
        if move == DIAG:
            x.append(q[i - 1])
            y.append(s[j - 1])
            i, j = i - 1, j - 1
        elif move == UP:
            while True:
                more = bool(longer_up[i, j - int(starts[i])])
                x.append(q[i - 1])
                y.append("-")
                i -= 1
                if not more or not i:
                    break
        else:
            size = max(1, int(gap_left[i, k])) if i else j
            x.append("-" * size)
            y.append(s[j - size : j])
            j -= size
    return "".join(reversed(x)), "".join(reversed(y)), int(h[m - int(starts[n])])


def identity(a: str, b: str) -> float:
    """Equal columns in percent of all columns of two gapped rows."""
    return 100.0 * int((_bytes(a) == _bytes(b)).sum()) / len(a) if a else 0.0


def gapped_score(a: str, b: str) -> int:
    """2 for each equal column, -4 for each other, -2 for each gap."""
    x, y = _bytes(a), _bytes(b)
    gap = (x == 45) | (y == 45)
    return int(2 * ((x == y) & ~gap).sum() - 4 * ((x != y) & ~gap).sum() - 2 * gap.sum())


def effective_identity(a: str, b: str, least: int = 20) -> float:
    """Identity without the columns of gaps of `least` and more."""
    keep = np.ones(len(a), bool)
    for row in (a, b):
        for m in re.finditer(f"-{{{least},}}", row):
            keep[m.start() : m.end()] = False
    x, y = _bytes(a)[keep], _bytes(b)[keep]
    return 100.0 * int((x == y).sum()) / len(x) if len(x) else 0.0


def distance_score(ql, tl, d):
    """Score of an edit distance: two for each base of the mean length that isn't edited, less five for each edit."""
    return ((ql + tl) / 2 - d) * 2 - 5 * d


def distance_identity(ql, tl, d):
    return 100 * (1 - 2 * d / (ql + tl))


def edit_columns(q: Column, t: Column) -> dict[str, Column]:
    """distance, score and identity of two ACGT columns, by Spark's own levenshtein."""
    d, n, m = F.levenshtein(q, t), F.length(q), F.length(t)
    return {"distance": d, "score": distance_score(n, m, d), "identity": distance_identity(n, m, d)}


def identity_column(a: Column, b: Column) -> Column:
    """Identity of two gapped rows in SQL expressions."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.when(F.length(a) > 0, 100.0 * same / F.length(a)).otherwise(0.0)


def anchored(a: str, b: str, run: int = 8) -> tuple[int, int]:
    """[from, to) of the columns between the first and the last run of `run` equal columns; (0, 0): none."""
    same = _bytes(a) == _bytes(b)
    if len(same) < run:
        return 0, 0
    sums = np.concatenate([[0], np.cumsum(same)])
    at = np.flatnonzero(sums[run:] - sums[:-run] == run)
    return (int(at[0]), int(at[-1]) + run) if len(at) else (0, 0)


_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")


def expand(cigar: str, seq: str, ref: str, start: int = 0) -> tuple[str, str, np.ndarray, np.ndarray]:
    """Gapped read and reference rows of a CIGAR, and the read and reference place of each column (of a gap: of the base before it)."""
    q, s, i, j = [], [], 0, start
    for n, op in ((int(n), op) for n, op in _CIGAR.findall(cigar)):
        if op in "M=X":
            q.append(seq[i : i + n])
            s.append(ref[j : j + n])
            i, j = i + n, j + n
        elif op == "I":
            q.append(seq[i : i + n])
            s.append("-" * n)
            i += n
        elif op in "DN":
            q.append("-" * n)
            s.append(ref[j : j + n])
            j += n
        elif op == "S":
            i += n
    a, b = "".join(q), "".join(s)
    clip = re.match(r"(?:\d+H)?(\d+)S", cigar)
    x, y = _bytes(a) != 45, _bytes(b) != 45
    return a, b, np.cumsum(x) - 1 + (int(clip[1]) if clip else 0), np.cumsum(y) - 1 + start


def fits(a: str, b: str, q: str, s: str) -> bool:
    """Whether gapped rows are the sequences with gaps, and no column is two gaps."""
    return a.replace("-", "") == q and b.replace("-", "") == s and len(a) == len(b) and not any(x == y == "-" for x, y in zip(a, b, strict=True))
