"""Plain versions of what the operators compute."""

import math
import random
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def simhash(text, width=3):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    label = {i: i for i in range(len(ids))}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    least = {}
    for i, d in enumerate(ids):
        t = top(i)
        least[t] = min(d, least.get(t, d))
    return [least[top(i)] for i in range(len(ids))]


def unigram(texts, train):
    """(base score, tokens, known) of each text, and the training tokens."""
    tokens = [words(t) + [None] for t in texts]
    counts = Counter(x for w, t in zip(tokens, train, strict=True) if t for x in w)
    n, v = sum(counts.values()), len(counts)
    score = lambda w: sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
    return [(score(w), len(w), sum(counts[x] > 0 for x in w)) for w in tokens], n


def compact_windows(order, least):
    """(l, c, r) of a single row, by walking from each place; of equal values the first is the smaller."""
    out = []
    for c in range(len(order)):
        lo = c
        while lo and order[lo - 1] > order[c]:
            lo -= 1
        hi = c
        while hi + 1 < len(order) and order[hi + 1] >= order[c]:
            hi += 1
        if hi - lo + 1 >= least:
            out.append((lo, c, hi))
    return out


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    pool = random.Random(5)
    vocabulary = ["".join(pool.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(pool.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


def edit_fingerprint(text, bits, places=192, lengths=3, least=8):
    """A walk over the text one step at a time; bits[table][step][kind of character] says whether it goes on."""
    m32 = 0xFFFFFFFF

    def mix32(h):
        h ^= h >> 16
        h = h * 0x7FEB352D & m32
        h ^= h >> 15
        h = h * 0x846CA68B & m32
        return h ^ h >> 16

    n = len(text)
    hashes = [mix32(ord(c) + 0x51ED2701 & m32) for c in text] + [mix32(0x51ED2701)] * 16
    level = max(least, (n - 1).bit_length()) if n else least
    every, at, out = (1 << level) * lengths // places // 4, 0, f"{level:02x}"
    for hop in range(every * places):
        if hop % every == 0:
            if at >= n:
                break
            shown = sum(hashes[at + i] * (1 if not i else 2 * i * 0x9E3779B9 + 1 & m32) for i in range(8)) & m32
            out += "0123456789abcdef"[mix32(shown) >> 28]
        from_ = at
        for step in range(4):
            at += bits[hop % len(bits)][step][hashes[min(at, from_ + 3)] & 15]
        at = min(at, n)
    return out


def strings_of(text, order=6):
    """The byte strings of `order` that an LM sees in a text: words, a space after each, an end; ends stand before the text."""
    raw = b"\n" * (order - 1) + b"".join(w.encode() + b" " for w in words(text)) + b"\n"
    return [raw[i : i + order] for i in range(len(raw) - order + 1)]


class Restaurants:
    """Pitman-Yor restaurants of all contexts up to a base of a single byte's probabilities, seated a customer at a time."""

    def __init__(self, base, low, discount, theta, seed):
        self.base, self.low, self.d, self.theta, self.r = base, low, discount, theta, random.Random(seed)
        self.tables = {}  # context -> dish -> customers of each table

    def p(self, context, dish):
        if len(context) < self.low:
            return self.base[dish]
        own = self.tables.get(context, {})
        tables = sum(map(len, own.values()))
        customers = sum(sum(t) for t in own.values())
        mine = own.get(dish, [])
        return (sum(mine) - self.d * len(mine) + (self.theta + self.d * tables) * self.p(context[1:], dish)) / (self.theta + customers)

    def add(self, context, dish):
        if len(context) < self.low:
            return
        own = self.tables.setdefault(context, {})
        mine = own.setdefault(dish, [])
        new = (self.theta + self.d * sum(map(len, own.values()))) * self.p(context[1:], dish)
        at = self.r.choices(range(len(mine) + 1), [*(n - self.d for n in mine), new])[0]
        if at == len(mine):
            mine.append(1)
            self.add(context[1:], dish)
        else:
            mine[at] += 1

    def remove(self, context, dish):
        if len(context) < self.low:
            return
        mine = self.tables[context][dish]
        at = self.r.choices(range(len(mine)), mine)[0]
        mine[at] -= 1
        if not mine[at]:
            mine.pop(at)
            self.remove(context[1:], dish)
