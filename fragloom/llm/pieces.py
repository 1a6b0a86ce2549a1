"""SentencePiece encoding and decoding by a batched Viterbi over numpy arrays.

Texts are cut where a space follows another character: no piece continues there (longer chunks are also cut between
characters that stand side by side in no piece). Distinct chunks are encoded once a task;
chunks of equal length advance together, one character at a time. Hashes of their substrings probe the sorted hashes of
the pieces, and vectorised maxima over the pieces that end at a place store backpointers.

A unigram model takes the segmentation of the greatest score. In a BPE model only steps between two pieces that its merges
would leave as they are, side by side, are allowed; that leaves one path, the segmentation that the merges give.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import docs_of
from .textvec import U, distinct_spans, release, slices, utf8

MODEL = "piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
#: Characters from which a chunk is looked through for places that no piece spans.
LONG = 48
SPACE = "▁"
#: Distinct chunks that a task remembers (some 100 MB), and the bytes of them and of their ids; then it begins anew.
REMEMBERED, REMEMBERED_BYTES = 600_000, 32 << 20
_B = 0x9E3779B97F4A7C15
#: Pairs of pieces whose answer is remembered, each in its own slot (9 MB).
_SLOTS = 1 << 20
_SPREAD = U(0xD6E8FEB86659FD93)  # brings the low bits of short texts' hashes to the top
_POWERS = np.array([pow(_B, i, 1 << 64) for i in range(65)], U)


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * _B + ord(c) + 1) & (1 << 64) - 1
    return h


@dataclass
class Pieces:
    """A model's pieces as arrays; ids beyond the pieces stand for characters without a piece (spelled in bytes)."""

    texts: list[str]
    scores: np.ndarray
    kind: int
    bytes_at: int  # id of byte 0
    unknown: int
    keys: np.ndarray = field(init=False)  # sorted hashes
    ids: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self):
        usable = [i for i, t in enumerate(self.texts) if t]
        keys = np.array([_hash(self.texts[i]) for i in usable], U)
        spread = keys * _SPREAD
        order = np.argsort(spread)
        self.keys, self.ids = spread[order], np.array(usable, np.int32)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.hash = np.zeros(len(self.texts) + 1, U)
        self.hash[usable] = keys
        self.size = np.array([len(t) for t in self.texts] + [1], np.int64)
        self.longest = int(self.size.max())
        top = (self.keys >> U(46)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << 18) + 1)).astype(np.int32)  # of the keys with each leading 18 bits
        self.crowd = int(np.diff(self.first).max(initial=0))
        self.remembered = None
        self.pairs = np.array(sorted({ord(a) << 32 | ord(b) for i in usable for a, b in zip(self.texts[i], self.texts[i][1:], strict=False)}), np.int64)
        if self.kind == BPE:
            self._splits()

    def parts(self, word: str) -> list[str]:
        """A long word cut where no piece has the characters on either side next to each other: nothing spans such a place."""
        c = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair = c[:-1] << 32 | c[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        cut = np.flatnonzero(self.pairs[at] != pair) + 1 if len(self.pairs) else np.arange(1, len(c))
        return [word[a:b] for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(word)], strict=True)]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1: none. The leading bits say where in the sorted keys a hash would stand."""
        out = np.full(hashes.shape, -1, np.int32)
        hashes = hashes * _SPREAD
        top = (hashes.ravel() >> U(46)).astype(np.int32)
        at = self.first[top]
        live = np.flatnonzero(self.first[top + 1] > at)
        at, own, end = at[live], hashes.ravel()[live], self.first[top[live] + 1]
        flat = out.ravel()
        for _ in range(self.crowd):
            same = self.keys[at] == own
            flat[live[same]] = self.ids[at[same]]
            at += 1
            go = ~same & (at < end)
            if not go.any():
                break
            live, at, own, end = live[go], at[go], own[go], end[go]
        return out

    def _splits(self):
        """Order of merging (0: a character), the last merge of each piece, and whether merges of its characters give it."""
        n = len(self.texts)
        place = {t: i for i, t in enumerate(self.texts) if t}
        by_score = sorted((i for i in place.values() if len(self.texts[i]) > 1), key=lambda i: (-self.scores[i], i))
        self.rank = np.zeros(n + 1, np.int64)
        last = None
        for k, i in enumerate(by_score, 1):
            same = last is not None and self.scores[last] == self.scores[i]
            self.rank[i] = self.rank[last] if same else k
            last = i
        self.left, self.right = np.full(n + 1, -1), np.full(n + 1, -1)
        self.whole = np.ones(n + 1, bool)
        for i in by_score:
            symbols, made = list(self.texts[i]), None
            while len(symbols) > 1:
                best = min(((self.rank[place[a + b]], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in place), default=None)
                if best is None:
                    break
                k = best[1]
                made = symbols[k : k + 2]
                symbols[k : k + 2] = ["".join(made)]
            if len(symbols) > 1:
                self.whole[i] = False
            elif made[0] in place and made[1] in place:
                self.left[i], self.right[i] = place[made[0]], place[made[1]]
            else:
                self.left[i] = self.right[i] = n

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the pieces that a and b make together; -1: none."""
        size = self.size[b]
        out = self.find(self.hash[a] * _POWERS[np.minimum(size, 64)] + self.hash[b])
        return np.where((self.hash[a] == 0) | (self.hash[b] == 0), -1, out)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of a and b, side by side, gives a and b; answers are remembered by pair."""
        if self.remembered is None:
            self.remembered = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, bool)
        pairs, answers = self.remembered
        pair = a.astype(np.int64) << 32 | b
        slot = ((pair.view(U) * U(_B)) >> U(44)).astype(np.int64)
        ok = answers[slot]
        new = np.flatnonzero(pairs[slot] != pair)
        if len(new):
            ok[new] = self._apart(a[new], b[new])
            pairs[slot[new]], answers[slot[new]] = pair[new], ok[new]
        return ok

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same, worked out: no merge across comes earlier than those that make a and b."""
        ok = np.ones(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), 1 << 60)
        a, b = a.copy(), b.copy()
        while len(live):
            over = self.joined(a, b)
            bad = (over >= 0) & (self.rank[over] < limit)
            ok[live[bad]] = False
            first, second = self.rank[a], self.rank[b]
            go = ~bad & ((first > 0) | (second > 0))
            live, a, b, first, second = live[go], a[go], b[go], first[go], second[go]
            left = first > second
            limit = np.where(left, first, second + 1)
            a, b = np.where(left, self.right[a], a), np.where(left, b, self.left[b])
        return ok


def load(path: str) -> Pieces:
    """The pieces of a .model file; control pieces stand for no text, and byte pieces for bytes alone."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if proto.trainer_spec.model_type not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("only unigram and BPE models that leave texts as they are and put a space first can be read")
    model = SentencePieceProcessor(model_proto=proto.SerializeToString())
    special = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)
    texts = ["" if special(i) else model.id_to_piece(i) for i in range(len(model))]
    return Pieces(texts, np.array([model.get_score(i) for i in range(len(model))]), proto.trainer_spec.model_type, model.piece_to_id("<0x00>") if proto.trainer_spec.byte_fallback else -1, model.unk_id())


def viterbi(pieces: Pieces, chars: np.ndarray) -> list[list[int]]:
    """Ids of each row of chars (words of one length as code points); len(pieces.texts) stands for a character without a piece."""
    n, length = chars.shape
    none = len(pieces.texts)
    sums = np.zeros((n, length + 1), U)
    for j in range(length):
        sums[:, j + 1] = sums[:, j] * U(_B) + chars[:, j] + U(1)
    found = {}
    for size in range(1, min(length, pieces.longest) + 1):
        ids = pieces.find(sums[:, size:] - sums[:, :-size] * _POWERS[size])
        if size == 1:
            ids[ids < 0] = none
        if (ids >= 0).any():
            found[size] = ids
    floor = float(pieces.scores.min()) - 10
    scores = np.append(pieces.scores, floor)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back, last = np.zeros((n, length + 1), np.int16), np.full((n, length + 1), none, np.int32)
    for j in range(1, length + 1):
        for size, ids in found.items():
            if size > j:
                continue
            own = ids[:, j - size]
            at = np.flatnonzero((own >= 0) & (best[:, j - size] > -np.inf))
            if not len(at):
                continue
            own = own[at]
            if pieces.kind == BPE:
                ok = pieces.whole[own]
                if j > size:
                    ok &= pieces.apart(last[at, j - size], own)
                at, own = at[ok], own[ok]
                score = best[at, j - size] - 1  # of several allowed paths, which merges rule out, the shortest
            else:
                score = best[at, j - size] + scores[own]
            up = score > best[at, j]
            at = at[up]
            best[at, j], back[at, j], last[at, j] = score[up], size, own[up]
    rows, place, steps = np.arange(n), np.full(n, length), []
    while (place > 0).any():
        steps.append(np.where(place > 0, last[rows, place], -1))
        place = place - np.where(place > 0, back[rows, place], 0)
        if len(steps) > length:
            raise RuntimeError("no path through a word")
    return [[int(i) for i in row if i >= 0] for row in np.array(steps[::-1], np.int64).reshape(len(steps), n).T]


def encode_words(pieces: Pieces, words: list[str]) -> list[list[int]]:
    """Ids of words (spaces as SPACE); characters without a piece are spelled in byte pieces, or unknown where there are none."""
    out: list[list[int]] = [[] for _ in words]
    long = [i for i, w in enumerate(words) if len(w) > LONG]
    if long:
        parts = [pieces.parts(words[i]) for i in long]
        distinct = list({p for own in parts for p in own if len(own) > 1})
        ids = dict(zip(distinct, encode_words(pieces, distinct), strict=True))
        done = {i for i, own in zip(long, parts, strict=True) if len(own) > 1}
        for i, own in zip(long, parts, strict=True):
            out[i] = [x for p in own for x in ids[p]] if i in done else []
        words = ["" if i in done else w for i, w in enumerate(words)]
    length = np.array([len(w) for w in words], np.int64)
    none = len(pieces.texts)
    for size in np.unique(length[length > 0]).tolist():
        same = np.flatnonzero(length == size)
        step = max(1, 2_000_000 // (size * 8))
        for at in range(0, len(same), step):
            own = same[at : at + step].tolist()
            chars = np.frombuffer("".join(words[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), size).astype(U)
            for i, ids in zip(own, viterbi(pieces, chars), strict=True):
                if none in ids:
                    ids = _spelled(pieces, words[i], ids)
                out[i] = ids
    return out


def _spelled(pieces: Pieces, word: str, ids: list[int]) -> list[int]:
    out, at = [], 0
    for i in ids:
        if i == len(pieces.texts):
            out += [pieces.bytes_at + b for b in word[at].encode("utf-8", "surrogatepass")] if pieces.bytes_at >= 0 else [pieces.unknown]
        else:
            out.append(i)
        at += int(pieces.size[i])
    return out


class Encoder:
    """Encodes columns of texts, remembering chunks."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self):
        self.known: dict[bytes, int] = {}  # place in start and length
        self.start, self.length, self.pool, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), 0

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and len + 1 offsets of the rows."""
        raw, offsets = utf8(column)
        size = np.diff(offsets)
        full = np.flatnonzero(size)
        buf = np.insert(raw, offsets[full], 0x20)
        first = offsets[full] + np.arange(len(full))
        space = buf == 0x20
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[first] = True
        starts = np.flatnonzero(begin)
        distinct, each = distinct_spans(buf, np.append(starts, len(buf)) if len(starts) else np.zeros(1, np.int64))
        distinct = distinct.to_pylist()
        if len(self.known) > REMEMBERED or self.held + self.pool.nbytes > REMEMBERED_BYTES:
            self._forget()
        fresh = [w for w in distinct if w not in self.known]
        ids = encode_words(self.pieces, [w.decode("utf-8", "replace").replace(" ", SPACE) for w in fresh])
        length = np.array([len(x) for x in ids], np.int64)
        flat = np.array([i for x in ids for i in x], np.uint32)
        self.known.update(zip(fresh, range(len(self.length), len(self.length) + len(fresh)), strict=True))
        self.start, self.length = np.append(self.start, len(self.pool) + np.cumsum(length) - length), np.append(self.length, length)
        self.pool, self.held = np.concatenate([self.pool, flat]), self.held + sum(map(len, fresh))
        use = np.fromiter((self.known[w] for w in distinct), np.int64, len(distinct))[each]
        length = self.length[use]
        ends_ = np.cumsum(length)
        index = np.arange(ends_[-1] if len(ends_) else 0) + np.repeat(self.start[use] - ends_ + length, length)
        rows = np.zeros(len(size) + 1, np.int64)
        chunks = np.searchsorted(starts, np.append(first, len(buf)))
        total = np.append(0, ends_)
        rows[full + 1] = total[chunks[1:]] - total[chunks[:-1]]
        return self.pool[index], np.cumsum(rows)


class Decoder:
    def __init__(self, pieces: Pieces):
        said = [t.replace(SPACE, " ").encode() for t in pieces.texts]
        if pieces.bytes_at >= 0:
            said[pieces.bytes_at : pieces.bytes_at + 256] = [bytes([b]) for b in range(256)]
        said[pieces.unknown] = " ⁇ ".encode()
        self.size = np.array([len(s) for s in said], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.said = np.frombuffer(b"".join(said), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the space that encoding puts first."""
        size = self.size[ids]
        ends = np.cumsum(size)
        out = self.said[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[ids] - ends + size, size)].tobytes()
        return out[1:] if out[:1] == b" " else out


def _pieces(path: str | None) -> Pieces:
    import public_tokenizers

    return load(path or public_tokenizers.path(MODEL))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers) of each row.

    Null or empty text: no ids. Rows are independent: repeated rows and null ids stay; very long texts are encoded whole;
    an empty table gives an empty one; other columns are ignored.
    """
    pieces = _pieces(path)

    def run(batches: Iterator[pa.RecordBatch]):
        encoder = Encoder(pieces)
        for batch in slices(batches):
            ids, at = encoder(batch.column("text"))
            blob = pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), blob], ["doc_id", "n_tokens", "ids"])
            release()

    return docs_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of each row of ids. Texts come back exactly, but for U+2581, which the format keeps for the space."""
    pieces = _pieces(path)

    def run(batches):
        decoder = Decoder(pieces)
        for batch in slices(batches, "ids"):
            texts = [decoder(np.frombuffer(x or b"", "<u4").astype(np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_sha256, round_trip (the decoded text is the text) of each row, in one pass."""
    pieces = _pieces(path)

    def run(batches):
        encoder, decoder = Encoder(pieces), Decoder(pieces)
        for batch in slices(batches):
            ids, at = encoder(batch.column("text"))
            rows = []
            for text, a, b in zip(batch.column("text").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = ids[a:b]
                same = decoder(own.astype(np.int64)) == text.replace(SPACE, " ").encode("utf-8", "surrogatepass")
                rows.append((len(text), b - a, hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), same))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_chars", "n_tokens", "ids_sha256", "round_trip"])

    return docs_of(docs).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, ids_sha256 string, round_trip boolean")
