"""Mapping of reads: seeds are chained, chains are extended to alignments, and a chain of alignments is chosen for each read.

The steps look at earlier choices within a read, so they are plain functions of one read's rows; `map_reads` runs them in two
grouped Arrow stages with a join between them that brings only the reference around each chain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np

from ..functions import align as al
from .enzymes import Enzyme, site_offsets

_COMPLEMENT = str.maketrans("ACGT", "TGCA")


@dataclass(frozen=True)
class Options:
    """Limits of the mapper."""

    distance: int = 800  # between neighbouring seeds, on read and reference
    slope: float = 0.2  # |1 - read step / reference step|
    shift: int = 100  # |read step - reference step|
    seeds: int = 3  # of a chain
    cover: int = 10  # chains over a read place
    fresh: int = 20  # places under `cover` that a chain must add
    chains: int = 200
    slack: int = 10  # of containment
    identity: float = 75.0
    columns: int = 20
    block: int = 50
    tail: int = 90
    chromosomes: int = 3
    per_chromosome: int = 50
    join_gap: int = 300
    site_range: int = 30
    site_shift: int = 50
    overlap: int = 20
    gap: int = 50
    gaps: int = 200
    least: int = 50
    score: int = 50  # of an alignment that a chain may take
    near: int = 40  # by which the ends of two alignments of one part of the read may differ
    site: int = 20  # by which an end may miss a site and still tell of it
    pad: int = 300


def reverse(seq: str) -> str:
    return seq[::-1].translate(_COMPLEMENT)


def chain_seeds(qoff: np.ndarray, soff: np.ndarray, k: int, size: int, o: Options = Options()) -> list[tuple[int, int, int, int, int]]:
    """(qbeg, qend, sbeg, send, seeds) of the collinear chains of a read's seeds on one strand of a chromosome.

    A seed follows the nearest earlier one of the best score whose steps on read and reference are positive, at most `distance`,
    of like length. Chains are taken from their last seeds, most seeds first, unless they use a used seed, lie inside a
    taken chain, or add too few places of low coverage.
    """
    order = np.lexsort((qoff, soff))
    q, s = qoff[order].astype(np.int64), soff[order].astype(np.int64)
    n = len(q)
    score, back, last = np.ones(n, np.int64), np.full(n, -1), np.ones(n, bool)
    lows = np.searchsorted(s, s - o.distance)
    for i in range(1, n):
        lo = lows[i]
        if lo == i:
            continue
        dq, ds = q[i] - q[lo:i], s[i] - s[lo:i]
        ok = (ds > 0) & (dq > 0) & (dq <= o.distance) & (np.abs(dq - ds) <= o.shift)
        ok &= np.abs(1 - dq / np.maximum(ds, 1)) <= o.slope
        if ok.any():
            value = np.where(ok, score[lo:i], 0)
            j = lo + len(value) - 1 - int(value[::-1].argmax())
            score[i], back[i] = score[j] + 1, j
    last[back[back >= 0]] = False
    tails = [i for i in sorted(range(n), key=lambda i: (-score[i], i)) if last[i] and score[i] >= o.seeds]
    used, depth, taken = np.zeros(n, bool), np.zeros(size + 1, np.int32), []
    for i in tails:
        path = []
        while i >= 0 and not used[i]:
            path.append(i)
            i = back[i]
        if i >= 0 or len(path) < o.seeds:
            continue
        qb, qe, sb, se = int(q[path[-1]]), int(q[path[0]]) + k, int(s[path[-1]]), int(s[path[0]]) + k
        inside = any(qb + o.slack >= a and qe - o.slack <= b and sb + o.slack >= c and se - o.slack <= d for a, b, c, d, _ in taken)
        if inside or int((depth[qb:qe] < o.cover).sum()) < o.fresh:
            continue
        used[path] = True
        depth[qb:qe] += 1
        taken.append((qb, qe, sb, se, len(path)))
        if len(taken) == o.chains:
            break
    return taken


@dataclass
class Alignment:
    """An alignment on the read's strand `qdir`; a and b are the gapped read and reference rows."""

    qdir: int
    qoff: int
    qend: int
    qsize: int
    sid: int
    soff: int
    send: int
    a: str
    b: str
    seeds: int
    eq: tuple[int, int] = (-1, -1)  # sites at the two ends, on the read
    es: tuple[int, int] = (-1, -1)  # and on the reference
    mapq: int = 0
    other: int = -1
    pi: float = field(init=False)
    score: int = field(init=False)

    def __post_init__(self):
        self.pi, self.score = al.identity(self.a, self.b), al.gapped_score(self.a, self.b)

    @property
    def span(self) -> tuple[int, int]:
        """Place on the forward read."""
        return (self.qoff, self.qend) if self.qdir == 0 else (self.qsize - self.qend, self.qsize - self.qoff)

    @property
    def sites(self) -> tuple[bool, bool]:
        """Whether read and reference end on a site, at the left and right end on the forward read."""
        both = (self.qoff == self.eq[0] and self.soff == self.es[0]), (self.qend == self.eq[1] and self.send == self.es[1])
        return both if self.qdir == 0 else both[::-1]

    @property
    def near_sites(self) -> tuple[bool, bool]:
        one = (self.qoff == self.eq[0] or self.soff == self.es[0]), (self.qend == self.eq[1] or self.send == self.es[1])
        return one if self.qdir == 0 else one[::-1]

    @property
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Places on read and reference before the first column and after each."""
        return tuple(np.append(0, np.cumsum(np.frombuffer(row.encode(), np.uint8) != 45)) + at for row, at in ((self.a, self.qoff), (self.b, self.soff)))

    def columns(self, lo: int, hi: int) -> Alignment:
        """The alignment of columns [lo, hi) alone."""
        skip_q, skip_s = lo - self.a[:lo].count("-"), lo - self.b[:lo].count("-")
        a, b = self.a[lo:hi], self.b[lo:hi]
        q, s = self.qoff + skip_q, self.soff + skip_s
        return replace(self, qoff=q, qend=q + len(a) - a.count("-"), soff=s, send=s + len(b) - b.count("-"), a=a, b=b)


class Reference:
    """Pieces of chromosomes: text(sid, from, to) as far as it is known."""

    def __init__(self, pieces: list[tuple[int, int, str]], sizes: dict[int, int]):
        self.pieces, self.sizes = {}, sizes
        for sid, start, seq in sorted(pieces):
            own = self.pieces.setdefault(sid, [])
            if own and start <= own[-1][0] + len(own[-1][1]):
                at, text = own[-1]
                own[-1] = (at, text + seq[at + len(text) - start :] if start + len(seq) > at + len(text) else text)
            else:
                own.append((start, seq))

    def text(self, sid: int, start: int, stop: int) -> tuple[str, int]:
        """The known bases of [start, stop) from the first known one on, and where they begin."""
        for at, seq in self.pieces.get(sid, []):
            if at < stop and at + len(seq) > start:
                lo = max(start, at)
                return seq[lo - at : max(lo, stop) - at], lo
        return "", start


def extend(hit: tuple, read: str, ref: Reference, qdir: int, sid: int, o: Options = Options()) -> Alignment | None:
    """An alignment of a chain: the part between its seeds, cut to runs of equal columns, and then on to both sides in blocks
    for as long as they align; None if it is too short or too different."""
    qb, qe, sb, se, seeds = hit
    text, at = ref.text(sid, sb, se)
    if at != sb or len(text) < se - sb:
        return None
    a, b, _ = al.edit_align(read[qb:qe], text, 64)
    core = Alignment(qdir, qb, qe, len(read), sid, sb, se, a, b, seeds)
    for _ in range(2):
        lo, hi = al.anchored(core.a, core.b)
        core = core.columns(lo, hi)
    if len(core.a) < o.columns or core.pi < o.identity:
        return None
    left = _grow(read[: core.qoff][::-1], _before(ref, core, o)[::-1], o)
    right = _grow(read[core.qend :], _after(ref, core, len(read), o), o)
    a, b = left[0][::-1] + core.a + right[0], left[1][::-1] + core.b + right[1]
    gone = [len(x) - x.count("-") for x in (*left, *right)]
    out = Alignment(qdir, core.qoff - gone[0], core.qend + gone[2], len(read), sid, core.soff - gone[1], core.send + gone[3], a, b, seeds)
    return out if out.pi >= o.identity else None


def _before(ref: Reference, core: Alignment, o: Options) -> str:
    text, at = ref.text(core.sid, max(0, core.soff - core.qoff - o.tail), core.soff)
    return text if at + len(text) == core.soff else ""


def _after(ref: Reference, core: Alignment, size: int, o: Options) -> str:
    text, at = ref.text(core.sid, core.send, core.send + size - core.qend + o.tail)
    return text if at == core.send else ""


def _grow(q: str, s: str, o: Options) -> tuple[str, str]:
    """Gapped rows of what aligns of q and s from their beginnings: block after block, each to its last run of equal columns."""
    a, b, i, j = [], [], 0, 0
    while i < len(q) and j < len(s):
        size = len(q) - i if len(q) - i <= o.tail else o.block
        x, y, d = al.prefix_align(q[i : i + size], s[j : j + size + size // 3 + 8])
        if d > 0.35 * size:
            lo, hi = al.anchored(x, y)
            x, y = (x[:hi], y[:hi]) if hi and al.identity(x[:hi], y[:hi]) >= o.identity else ("", "")
            a.append(x)
            b.append(y)
            break
        _, hi = al.anchored(x, y)
        if not hi:
            break
        a.append(x[:hi])
        b.append(y[:hi])
        i, j = i + hi - x[:hi].count("-"), j + hi - y[:hi].count("-")
    return "".join(a), "".join(b)


def collinear_runs(found: list[Alignment], o: Options = Options()) -> list[list[Alignment]]:
    """Runs of two and more alignments of a strand of a chromosome that follow one another on read and reference without overlap, by
    `join_gap` at most and on about one diagonal: a dynamic programme over their scores, the best runs first.

    found: by reference place. A run begins at its last alignment and goes back as the scores say, also through alignments
    that an earlier run has; only ends that no run has are tried.
    """
    score, back = [x.score for x in found], [-1] * len(found)
    for i, x in enumerate(found):
        for j in range(i - 1, -1, -1):
            p = found[j]
            near = 0 <= x.qoff - p.qend <= o.join_gap and 0 <= x.soff - p.send <= o.join_gap
            if near and abs(1 - (x.qend - p.qoff) / (x.send - p.soff)) <= o.slope and score[j] + x.score > score[i]:
                score[i], back[i] = score[j] + x.score, j
    inner, used, runs = set(back), set(), []
    for i in sorted((i for i in range(len(found)) if i not in inner and score[i] > 0), key=lambda i: (-score[i], i)):
        if i in used:
            continue
        run = []
        while i >= 0:
            run.append(i)
            i = back[i]
        used.update(run)
        if len(run) > 1:
            runs.append([found[i] for i in reversed(run)])
    return runs


def uncontained(found: list[Alignment], slack: int = 10) -> list[Alignment]:
    """Alignments of a strand of a chromosome without those that one of a greater score contains on read and reference, within slack."""
    out: list[Alignment] = []
    for x in sorted(found, key=lambda x: -x.score):
        if not any(x.qoff + slack >= y.qoff and x.qend <= y.qend + slack and x.soff + slack >= y.soff and x.send <= y.send + slack for y in out):
            out.append(x)
    return out


def collinear(found: list[Alignment], read: str, ref: Reference, o: Options = Options()) -> list[Alignment]:
    """Alignments of a strand of a chromosome and those over whole collinear runs of them, without the contained ones."""
    found = sorted(found, key=lambda x: (x.soff, x.qoff))
    over = [extend((r[0].qoff, r[-1].qend, r[0].soff, r[-1].send, sum(x.seeds for x in r)), read, ref, r[0].qdir, r[0].sid, o) for r in collinear_runs(found, o)]
    return sorted(uncontained(found + [x for x in over if x], o.slack), key=lambda x: (x.qoff, x.soff))


def nearest_site(sites: np.ndarray, at: int, first: bool) -> int:
    """The site nearest to `at`; of two as near the left one at a start (first), the right one at an end; -1 without any."""
    if not len(sites):
        return -1
    far = np.abs(sites - at)
    near = sites[far == far.min()]
    return int(near[0] if first else near[-1])


def site_ends(x: Alignment, read_sites: np.ndarray, ref_sites: np.ndarray, first: bool, o: Options = Options()) -> list[tuple[int, int, int, int]]:
    """(read place, reference place, read site, reference site) where the alignment may start (first) or end.

    Sites of the read and of the reference near its end are paired where the parts from there to its other end are about as long
    (by `site_shift` and `slope`). A site without a partner takes the place that the alignment gives it, if it lies inside,
    and the nearest site there. Without any, the end stays.
    """
    q, s, far_q, far_s = (x.qoff, x.soff, x.qend, x.send) if first else (x.qend, x.send, x.qoff, x.soff)
    near = lambda sites, at, far: [c for c in sites[np.abs(sites - at) <= o.site_range].tolist() if (c < far if first else c > far)]
    own, other = near(read_sites, q, far_q), near(ref_sites, s, far_s)
    alike = lambda a, b: abs(a - b) <= o.site_shift and abs(1 - a / b) <= o.slope
    out = [(c, d, c, d) for c in own for d in other if alike(abs(far_q - c), abs(far_s - d))]
    at_q, at_s = x.places
    for c in (c for c in own if all(c != p[0] for p in out) and x.qoff <= c <= x.qend):
        out.append((c, int(at_s[np.searchsorted(at_q, c)]), c, nearest_site(ref_sites, s, first)))
    for d in (d for d in other if all(d != p[3] for p in out) and x.soff <= d <= x.send):
        out.append((int(at_q[np.searchsorted(at_s, d)]), d, nearest_site(read_sites, q, first), d))
    return out or [(q, s, nearest_site(read_sites, q, first), nearest_site(ref_sites, s, first))]


def _joint(x: Alignment, q: int, s: int, first: bool, read: str, ref: Reference) -> tuple[int, str, str] | None:
    """A column of x, and the gapped rows from (q, s) to it (first), or from it to (q, s): none where x itself meets (q, s), else the
    alignment of the few bases between; None where the reference isn't known."""
    at_q, at_s = x.places
    c = int(np.searchsorted(at_q, q, "left" if first else "right")) - (0 if first else 1)
    c = min(max(c, 0), len(at_q) - 1)
    on = np.flatnonzero((at_q == q) & (at_s == s))
    if len(on):
        return int(on[-1] if first else on[0]), "", ""
    margin = 8 + 2 * abs((q - s) - int(at_q[c] - at_s[c])) + max(0, x.qoff - q, x.soff - s, q - x.qend, s - x.send)
    inside = (at_q >= q + margin) & (at_s >= s + margin) if first else (at_q <= q - margin) & (at_s <= s - margin)
    if not inside.any():
        return None
    c = int(np.flatnonzero(inside)[0 if first else -1])
    lo, hi = (s, int(at_s[c])) if first else (int(at_s[c]), s)
    text, at = ref.text(x.sid, lo, hi)
    if at != lo or len(text) < hi - lo:
        return None
    return c, *al.edit_align(read[q : at_q[c]] if first else read[at_q[c] : q], text)[:2]


def snapped(x: Alignment, read_sites: np.ndarray, ref_sites: np.ndarray, read: str, ref: Reference, o: Options = Options()) -> list[Alignment]:
    """The alignment from each of its possible starts (`site_ends`) to each of its possible ends: what lies between is kept column by
    column, and only the bases around an end that x doesn't meet are aligned anew. At least half of the columns must agree."""
    starts = [(e, _joint(x, e[0], e[1], True, read, ref)) for e in site_ends(x, read_sites, ref_sites, True, o)]
    ends = [(e, _joint(x, e[0], e[1], False, read, ref)) for e in site_ends(x, read_sites, ref_sites, False, o)]
    out = []
    for (q, s, eq, es), head in starts:
        for (q1, s1, eq1, es1), tail in ends:
            if head and tail and q < q1 and s < s1 and tail[0] - head[0] >= o.columns:
                a, b = (head[i] + row[head[0] : tail[0]] + tail[i] for i, row in ((1, x.a), (2, x.b)))
                y = replace(x, qoff=q, qend=q1, soff=s, send=s1, a=a, b=b, eq=(eq, eq1), es=(es, es1))
                if y.pi >= 50:
                    out.append(y)
    return out or [replace(x, eq=tuple(nearest_site(read_sites, at, i == 0) for i, at in enumerate((x.qoff, x.qend))), es=tuple(nearest_site(ref_sites, at, i == 0) for i, at in enumerate((x.soff, x.send))))]


def distinct(found: list[Alignment]) -> list[Alignment]:
    """One alignment (of the greatest identity) for each span of read and reference."""
    best: dict[tuple, Alignment] = {}
    for x in found:
        key = (x.span, x.qdir, x.sid, x.soff, x.send)
        if key not in best or x.pi > best[key].pi:
            best[key] = x
    return list(best.values())


def follows(p: Alignment, x: Alignment, o: Options, perfect: bool | None) -> bool:
    """Whether x may stand after p in a chain; perfect: both ends on sites that meet; False: near sites; None: any."""
    a, b = p.span, x.span
    if b[0] - a[1] < -o.overlap or b[1] - a[1] <= 5 or b[0] - a[0] <= 5:
        return False
    if perfect is True and not (p.sites[1] and x.sites[0]) or perfect is False and not (p.near_sites[1] and x.near_sites[0]):
        return False
    return not (p.sid == x.sid and min(p.send, x.send) - max(p.soff, x.soff) > o.overlap)


def weighed(found: list[Alignment], o: Options = Options()) -> list[Alignment]:
    """Alignments that chains are made of: long and good enough, and, of those that begin or end at about one place of the read, none
    that a better one reaches beyond."""
    out: list[Alignment] = []
    for x in sorted(found, key=lambda x: -x.score):
        (a, b), good = x.span, x.score >= o.score and x.span[1] - x.span[0] >= o.least
        if good and not any(abs(p[0] - a) <= o.near and b <= p[1] + o.near or abs(p[1] - b) <= o.near and a + o.near >= p[0] for p in (y.span for y in out)):
            out.append(x)
    return out


def at_a_site(x: Alignment, o: Options = Options()) -> bool:
    """Whether an end of the alignment lies near its site of the reference."""
    return any(e >= 0 and abs(e - at) <= o.site for e, at in zip(x.es, (x.soff, x.send), strict=True))


def equal_chains(spans: list[tuple[int, int]], after: list[list[int]], most: int = 10) -> list[tuple[int, ...]]:
    """Chains, as places in spans, that cover most: up to `most` of them, depth first from the last start on.

    after: for each span those later in the list that may follow it. What a chain can still cover from a span on tells which
    steps lead to one that covers most; no other is taken. Chains end where nothing may follow.
    """
    own = [b - a for a, b in spans]
    over = lambda i, j: max(0, spans[i][1] - spans[j][0])
    reach = list(own)
    for i in reversed(range(len(spans))):
        reach[i] = max([own[i], *(own[i] - over(i, j) + reach[j] for j in after[i])])
    best = max(reach, default=0)
    waiting, found = [((i,), own[i]) for i in range(len(spans)) if reach[i] == best], []
    while waiting and len(found) < most:
        chain, cover = waiting.pop()
        i = chain[-1]
        if not after[i] and cover == best:
            found.append(chain)
        waiting += [((*chain, j), cover - over(i, j) + own[j]) for j in after[i] if cover - over(i, j) + reach[j] == best]
    return found


def clearly_better(chain: list[Alignment], usable: list[Alignment], o: Options, perfect: bool | None, by: float = 10.0) -> list[Alignment]:
    """The chain, or one that covers most if it is more identical by over `by` points (and as complete)."""
    after = [[j for j in range(i + 1, len(usable)) if follows(x, usable[j], o, perfect)] for i, x in enumerate(usable)]
    others = [[usable[i] for i in c] for c in equal_chains([x.span for x in usable], after)]
    others = [c for c in others if is_complete(c, o) >= is_complete(chain, o)]
    best = max(others, key=mean_pi, default=chain)
    return best if mean_pi(best) > mean_pi(chain) + by else chain


def best_chain(found: list[Alignment], o: Options, perfect: bool | None) -> list[Alignment]:
    """The chain that covers most of the read; within 30 bases the one of fewer fragments, then of greater identity."""
    usable = [x for x in weighed(found, o) if perfect is None or (all(x.sites) if perfect else all(x.near_sites))]
    usable.sort(key=lambda x: (x.span[1], x.span[0], -x.pi))
    best: list[tuple[int, int, float, int]] = []

    def rank(t):
        return t[0] - 30 * t[1], t[2]

    for i, x in enumerate(usable):
        own = (x.span[1] - x.span[0], 1, x.pi, -1)
        for j in range(i):
            if follows(usable[j], x, o, perfect):
                cover = best[j][0] + x.span[1] - max(x.span[0], usable[j].span[1])
                t = (cover, best[j][1] + 1, best[j][2] + x.pi, j)
                if rank(t) > rank(own):
                    own = t
        best.append(own)
    if not best:
        return []
    i, chain = max(range(len(best)), key=lambda i: rank(best[i])), []
    while i >= 0:
        chain.append(usable[i])
        i = best[i][3]
    return clearly_better(chain[::-1], usable, o, perfect)


def is_complete(chain: list[Alignment], o: Options = Options()) -> bool:
    """Whether no gap on the read, ends included, is over `gap` and all together are under `gaps`."""
    if not chain:
        return False
    at, gaps = 0, []
    for x in chain:
        gaps.append(max(0, x.span[0] - at))
        at = max(at, x.span[1])
    gaps.append(chain[0].qsize - at)
    return max(gaps) <= o.gap and sum(gaps) < o.gaps


PERFECT, PSEUDO, COMPLETE, MOST = "perfect", "pseudo-perfect", "complete", "max-cov"


def mean_pi(chain: list[Alignment]) -> float:
    return sum(x.pi for x in chain) / len(chain) if chain else 0.0


def choose(found: list[Alignment], o: Options = Options()) -> tuple[list[Alignment], str]:
    """The chain of a read and its kind: perfect on one chromosome, perfect on all, pseudo-perfect (of one chromosome or all, by
    identity; it counts as complete), complete, or greedy by length, with little overlap on the read and none on the reference."""
    order = list(dict.fromkeys(x.sid for x in sorted(found, key=lambda x: -x.seeds)))
    by = [[x for x in found if x.sid == c] for c in order]
    for group in (*by, found):
        chain = best_chain(group, o, True)
        if is_complete(chain, o):
            return chain, PERFECT
    chains = [c for group in (*by, found) if is_complete(c := best_chain(group, o, False), o)]
    if chains:
        return max(chains, key=mean_pi), COMPLETE
    chain = best_chain(found, o, None)
    if is_complete(chain, o):
        return chain, COMPLETE
    taken: list[Alignment] = []
    known = any(e >= 0 for x in found for e in x.es)
    for x in sorted(weighed([x for x in found if not known or at_a_site(x, o)], o), key=lambda x: (x.span[0] - x.span[1], -x.pi, x.span[0], x.sid, x.soff)):
        (a, b), size = x.span, x.span[1] - x.span[0]
        if size < o.least or any(min(b, y.span[1]) - max(a, y.span[0]) > 0.4 * size or min(x.send, y.send) > max(x.soff, y.soff) for y in taken):
            continue  # reference overlap is tested without the chromosome, as in the original rule
        taken.append(x)
    return sorted(taken, key=lambda x: x.span), MOST


def smoothed(chain: list[Alignment], found: list[Alignment], reads: tuple[str, str], ref: Reference, o: Options = Options()) -> list[Alignment]:
    """Neighbours that one alignment spans are replaced by it, fragments by better ones of the same span, and neighbours on one
    diagonal of a chromosome by their joint alignment."""
    mean = mean_pi(chain)
    out: list[Alignment] = []
    for x in chain:
        same = [y for y in found if abs(y.span[0] - x.span[0]) <= o.overlap and abs(y.span[1] - x.span[1]) <= o.overlap and y.pi > x.pi + 1]
        x = max([x, *same], key=lambda y: y.pi)
        if out and (p := out[-1]).sid == x.sid and p.qdir == x.qdir:
            first, last = (p, x) if p.qdir == 0 else (x, p)
            dq, ds = last.qend - first.qoff, last.send - first.soff
            if ds > 0 and last.soff >= first.send - o.overlap and abs(1 - dq / ds) <= o.slope:
                joint = extend((first.qoff, last.qend, first.soff, last.send, p.seeds + x.seeds), reads[p.qdir], ref, p.qdir, p.sid, o)
                if joint and (joint.pi >= mean - 4 or joint.pi >= 80) and joint.span[0] <= p.span[0] + o.overlap and joint.span[1] >= x.span[1] - o.overlap:
                    out[-1] = replace(joint, eq=(first.eq[0], last.eq[1]), es=(first.es[0], last.es[1]))
                    continue
        out.append(x)
    return over_runs(out, found)


def over_runs(chain: list[Alignment], found: list[Alignment]) -> list[Alignment]:
    """The chain with runs of two and more replaced by an alignment from the run's start to its end on the read, where that is
    about as identical (4 points less at most) or 80 % identical."""
    out = list(chain)
    for y in found:
        f = next((i for i, x in enumerate(out) if x.span[0] == y.span[0]), None)
        t = next((i for i, x in enumerate(out) if x.span[1] == y.span[1]), None)
        if f is not None and t is not None and f < t and (y.pi >= mean_pi(out[f : t + 1]) - 4 or y.pi >= 80):
            out[f : t + 1] = [y]
    return out


def _spanning(x: Alignment, q: tuple[int, int], s: tuple[int, int], read: str, ref: Reference) -> Alignment | None:
    """x over the read [q) and the reference [s) instead, both of its strand; None where the reference isn't known or lengths differ."""
    text, at = ref.text(x.sid, *s)
    if s[1] <= s[0] or at != s[0] or len(text) < s[1] - s[0] or q[1] <= q[0] or abs(1 - (q[1] - q[0]) / (s[1] - s[0])) > 0.2:
        return None
    a, b, _ = al.edit_align(read[q[0] : q[1]], text)
    return replace(x, qoff=q[0], qend=q[1], soff=s[0], send=s[1], a=a, b=b)


def _reach(x: Alignment, side: int, to: int, read: str, ref: Reference) -> Alignment | None:
    """x grown on a side (0: left, 1: right of the forward read) to a place of the forward read, and to its site on the reference."""
    left = (side == 0) == (x.qdir == 0)
    at = to if x.qdir == 0 else x.qsize - to
    if (x.es[0] if left else x.es[1]) < 0:
        return None
    y = _spanning(x, (at, x.qend) if left else (x.qoff, at), (x.es[0], x.send) if left else (x.soff, x.es[1]), read, ref)
    if not y or y.pi < x.pi - 5 and (side == 0 or y.pi < 75):
        return None
    return replace(y, eq=(at, x.eq[1]) if left else (x.eq[0], at))


def _to_the_end(x: Alignment, side: int, read: str, ref: Reference, most: int = 300, slack: int = 50) -> Alignment:
    """x grown to the read's end on that side, where little is left of it."""
    left = (side == 0) == (x.qdir == 0)
    free_q, free_s = (x.qoff, x.soff) if left else (x.qsize - x.qend, ref.sizes[x.sid] - x.send)
    n, m = min(free_q, free_s + slack), min(free_q + slack, free_s)
    if n > most or m > most or not n or not m:
        return x
    text, at = ref.text(x.sid, x.soff - m, x.soff) if left else ref.text(x.sid, x.send, x.send + m)
    if len(text) < m or at != (x.soff - m if left else x.send):
        return x
    own = read[x.qoff - n : x.qoff] if left else read[x.qend : x.qend + n]
    a, b, _ = al.prefix_align(own[::-1], text[::-1]) if left else al.prefix_align(own, text)
    q, s = n, len(b) - b.count("-")
    if left:
        y = replace(x, qoff=x.qoff - q, soff=x.soff - s, a=a[::-1] + x.a, b=b[::-1] + x.b)
        return replace(y, eq=(0, y.eq[1])) if y.qoff == 0 else y
    y = replace(x, qend=x.qend + q, send=x.send + s, a=x.a + a, b=x.b + b)
    return replace(y, eq=(y.eq[0], y.qsize)) if y.qend == y.qsize else y


def closed(chain: list[Alignment], reads: tuple[str, str], ref: Reference, near: int = 200) -> list[Alignment]:
    """The chain without gaps that a neighbour's alignment can fill: where one ends on a site of the read, the other grows to it, if it stays
    about as identical; and the outer ones grow to the read's ends."""
    out = list(chain)

    def on_site(x: Alignment, side: int) -> bool:
        left = (side == 0) == (x.qdir == 0)
        return x.qoff == x.eq[0] if left else x.qend == x.eq[1]

    if out and (0 < out[0].span[0] < near):
        out[0] = _to_the_end(out[0], 0, reads[out[0].qdir], ref)
    for i in range(len(out) - 1):
        p, x = out[i], out[i + 1]
        if p.span[1] >= x.span[0]:
            continue
        y = _reach(x, 0, p.span[1], reads[x.qdir], ref) if on_site(p, 1) else None
        if y:
            out[i + 1] = y
        elif on_site(x, 0) and (y := _reach(p, 1, x.span[0], reads[p.qdir], ref)):
            out[i] = y
    if out and (0 < out[-1].qsize - out[-1].span[1] < near):
        out[-1] = _to_the_end(out[-1], 1, reads[out[-1].qdir], ref)
    return out


def kind_of(chain: list[Alignment], o: Options = Options()) -> str:
    """What a chain is: complete or not, and with all, or some, of its ends on sites."""
    if not is_complete(chain, o):
        return MOST
    return PERFECT if all(all(x.sites) for x in chain) else PSEUDO if all(all(x.near_sites) for x in chain) else COMPLETE


#: Certainty of each kind of chain.
CERTAINTY = {PERFECT: 0.9999999, PSEUDO: 0.99999, COMPLETE: 0.99999, MOST: 0.999}


def mapping_quality(pi: float, second: float | None, kind: str) -> int:
    """ceil(-10 log10(1 - certainty * distance)), 0 to 60; distance: how much less identical the best competitor is, 1 without any."""
    apart = 1.0 if second is None else abs(1 - second / pi)
    return int(min(60, max(0, math.ceil(-10 * math.log10(1 - CERTAINTY[kind] * apart) - 1e-9))))


def same_span(x: Alignment, found: list[Alignment], o: Options = Options()) -> list[Alignment]:
    """Alignments of the same part of the read to another place."""
    return [
        y for y in found
        if abs(y.span[0] - x.span[0]) <= o.overlap and abs(y.span[1] - x.span[1]) <= o.overlap and not (y.sid == x.sid and min(x.send, y.send) > max(x.soff, y.soff))
    ]


def with_quality(chain: list[Alignment], found: list[Alignment], kind: str, o: Options = Options()) -> list[Alignment]:
    """The chain with mapping qualities. A fragment of quality under 5 may change for a homolog with clearly more seeds, or
    on a chromosome that clearly more of the read's fragments lie on."""
    support: dict[int, int] = {}
    for x in chain:
        support[x.sid] = support.get(x.sid, 0) + 1
    out = []
    for x in chain:
        others = same_span(x, found, o)
        second = max((y.pi for y in others), default=None)
        q = mapping_quality(x.pi, second, kind)
        if q < 5 and others:
            ties = [y for y in others if 1 - CERTAINTY[kind] * abs(1 - y.pi / x.pi) > 0 and -10 * math.log(1 - CERTAINTY[kind] * abs(1 - y.pi / x.pi)) < 5]
            more = [y for y in ties if y.seeds > x.seeds + 1] or [y for y in ties if support.get(y.sid, 0) > support.get(x.sid, 0) + 1]
            if more:
                x = max(more, key=lambda y: (y.seeds, y.pi))
                others = same_span(x, found, o)
        best = max(others, key=lambda y: y.pi, default=None)
        out.append(replace(x, mapq=q, other=found.index(best) if best is not None else -1))
    return out


def trimmed(chain: list[Alignment], kind: str, enzyme: Enzyme | None, o: Options = Options()) -> list[Alignment]:
    """The chain without doubtful fragments and overlaps on the read and the reference.

    Of an incomplete chain fragments of 500 bases, or that end within 20 of a site, stay; of a complete one all over 30. Of two
    fragments that overlap, the one with a site at the common end stays whole, else the longer one; under 50 bases a fragment goes.
    """
    chain = [x for x in chain if (x.qend - x.qoff > 30 if kind != MOST else x.qend - x.qoff >= 500) or at_a_site(x, o)]
    chain = sorted(chain, key=lambda x: x.span)
    out: list[Alignment] = []
    for x in chain:
        if out and (over := out[-1].span[1] - x.span[0]) > 0:
            p = out[-1]
            keep_p = p.sites[1] != x.sites[0] and p.sites[1] or p.sites[1] == x.sites[0] and p.qend - p.qoff >= x.qend - x.qoff
            if keep_p:
                x = _cut(x, over, 0, True)
            else:
                out[-1] = _cut(p, over, 1, True)
        out.append(x)
    out = [x for x in out if x.qend - x.qoff >= o.least]
    for i in range(len(out)):
        for j in range(i + 1, len(out)):
            left, right = (i, j) if out[i].soff < out[j].soff else (j, i)
            p, x = out[left], out[right]
            over = p.send - x.soff
            if p.sid != x.sid or over <= 0 or not p.a or not x.a:
                continue
            ends, begins = (p.qend == p.eq[1], p.send == p.es[1]), (x.qoff == x.eq[0], x.soff == x.es[0])
            if any(ends) and begins == (False, True):
                keep = left
            elif not any(ends) and any(begins):
                keep = right
            else:
                longer = p.send - p.soff - (x.send - x.soff)
                keep = left if longer > 0 or longer == 0 and all(ends) and all(begins) else right
            if keep == left:
                out[right] = _cut(x, over, 0, False)
            else:
                out[left] = _cut(p, over, 1, False)
    out = [x for x in out if x.qend - x.qoff >= o.least]
    return [x for x in out if kind != MOST or x.mapq >= 5]


def _cut(x: Alignment, by: int, side: int, on_read: bool) -> Alignment:
    """x without `by` bases at the left (0) or right (1) side of the forward read, or of the reference."""
    row = x.a if on_read else x.b
    if on_read and x.qdir == 1:
        side = 1 - side
    places = np.flatnonzero(np.frombuffer(row.encode(), np.uint8) != 45)
    if by >= len(places):
        return replace(x.columns(0, 0), a="", b="")
    return x.columns(int(places[by]), len(row)) if side == 0 else x.columns(0, int(places[len(places) - by - 1]) + 1)


def at_cut(x: Alignment, enzyme: Enzyme, read: str, ref: Reference) -> Alignment:
    """The alignment with ends on sites of both read and reference moved to where the enzyme cuts in them, so that neighbours abut.

    On the reverse strand the cut stands as far before the site's end as it stands after its start on the other.
    """
    size = len(enzyme.motif)
    by = enzyme.cut if x.qdir == 0 else size - enzyme.cut
    if not by:
        return x
    first = x.eq[0] > 0 and (x.qoff, x.soff) == (x.eq[0], x.es[0])
    last = x.eq[1] != x.qsize and (x.qend, x.send) == (x.eq[1], x.es[1])
    more, at = ref.text(x.sid, x.send, x.send + size) if last else ("", 0)
    if last and at == x.send and len(more) == size and x.qend + size <= x.qsize:
        x = replace(x, a=x.a + read[x.qend : x.qend + by], b=x.b + more[:by], qend=x.qend + by, send=x.send + by, eq=(x.eq[0], x.eq[1] + by), es=(x.es[0], x.es[1] + by))
    if first:
        q, s = x.a.replace("-", "")[by:], x.b.replace("-", "")[by:]
        if q and s:
            even = "-" not in x.a[:by] + x.b[:by]
            a, b = (x.a[by:], x.b[by:]) if even else al.edit_align(q, s)[:2]
            x = replace(x, a=a, b=b, qoff=x.qoff + by, soff=x.soff + by, eq=(x.eq[0] + by, x.eq[1]), es=(x.es[0] + by, x.es[1]))
    return x


def realigned(x: Alignment) -> Alignment:
    """x with the rows of an affine alignment of its ends, in a band that its identity asks for."""
    q, s = x.a.replace("-", ""), x.b.replace("-", "")
    band = int(len(q) * (100 - x.pi) / 100) + 16
    a, b, _ = al.affine_align(q, s, band=band)
    return replace(x, a=a, b=b)


def map_read(read: str, hits: list[tuple[int, int, tuple]], ref: Reference, enzyme: Enzyme | None, o: Options = Options()) -> tuple[list[Alignment], list[Alignment], str]:
    """The fragments of a read, all alignments that were weighed, and the kind of chain; hits: (sid, strand, chain)."""
    strands = (read, reverse(read))
    sites = tuple(np.concatenate([[0], site_offsets(s, enzyme), [len(s)]]) for s in strands) if enzyme else None
    top: dict[int, int] = {}
    for sid, _, hit in hits:
        top[sid] = max(top.get(sid, 0), hit[4])
    order = sorted(top, key=lambda c: (-top[c], c))
    seen, found = np.zeros(len(read), bool), []

    def take(sid: int, sparing: bool) -> None:
        mine, extended = sorted((h for h in hits if h[0] == sid), key=lambda h: (-h[2][4], h[2])), {}
        for again in (False, True):
            for _, strand, hit in mine:
                qb, qe = hit[:2] if strand == 0 else (len(read) - hit[1], len(read) - hit[0])
                if (strand, hit) in extended or len(extended) >= o.per_chromosome:
                    continue
                inside = any(d == strand and x.qoff <= hit[0] and x.qend >= hit[1] and x.soff <= hit[2] and x.send >= hit[3] for (d, _), x in extended.items())
                if inside or (again or sparing) and int((~seen[qb:qe]).sum()) < 2:
                    continue
                x = extend(hit, strands[strand], ref, strand, sid, o)
                if x:
                    extended[strand, hit] = x
                    seen[slice(*x.span)] = True
        for strand in (0, 1):
            for x in collinear([x for (d, _), x in extended.items() if d == strand], strands[strand], ref, o):
                if enzyme:
                    text, at = ref.text(sid, x.soff - o.pad, x.send + o.pad)
                    found.extend(snapped(x, sites[strand], site_offsets(text, enzyme) + at, strands[strand], ref, o))
                else:
                    found.append(x)

    for i, sid in enumerate(order):
        take(sid, i >= o.chromosomes)
    found = distinct(found)
    chain, kind = choose(found, o)
    chain = smoothed(chain, found, strands, ref, o)
    if kind != PERFECT and enzyme:
        chain = closed(chain, strands, ref)
        kind = kind_of(chain, o) if kind == MOST and is_complete(chain, o) else kind
    chain = with_quality(chain, found, kind, o)
    if enzyme:
        chain = [at_cut(x, enzyme, strands[x.qdir], ref) for x in chain]
    chain = [realigned(x) for x in chain if x.a]
    return trimmed(chain, kind, enzyme, o), found, kind
