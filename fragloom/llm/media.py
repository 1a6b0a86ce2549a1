"""MPEG transport streams as a column: bytes in 188-byte packets, read back through their program tables.

The writer makes one program: a table of programs (PID 0), its map, and one private stream whose elementary packets
carry the payload. The first transport packet of each elementary packet has an adaptation field with the random-access
flag and a clock reference; every elementary packet has a presentation timestamp. The reader is general: it takes any
188-byte stream, finds its packets again after stray or lost bytes, follows its tables across packets, checks continuity
counters and gathers the elementary packets of every stream.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import docs_of
from .textvec import slices, utf8

PACKET = 188
SYNC = 0x47
MAP_PID, DATA_PID, PRIVATE = 0x1000, 0x0100, 0x06
#: Payload bytes and clock ticks (90 kHz) of one elementary packet.
UNIT, TICKS = 32_768, 3_600
#: Payloads are padded with zero bytes to a positive multiple of this.
GRAIN = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << np.uint32(24)
    for _ in range(8):
        table = np.where(table >> np.uint32(31), (table << np.uint32(1)) ^ np.uint32(0x04C11DB7), table << np.uint32(1)).astype(np.uint32)
    return table


_CRC = _crc_table().tolist()


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ b]
    return crc


def _section(table_id: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + b"\x00\x01\xc1\x00\x00" + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, struct.pack(">HH", 1, 0xE000 | MAP_PID))) + _table_packet(
    MAP_PID, _section(2, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + struct.pack(">BHH", PRIVATE, 0xE000 | DATA_PID, 0xF000))
)


def _stamp(ticks: int) -> bytes:
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 255, ticks >> 14 & 0xFE | 1, ticks >> 7 & 255, ticks << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream; equal payloads give equal streams."""
    out, count = [_TABLES], 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        part, ticks = payload[at : at + UNIT], unit * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01\xbd" + struct.pack(">H", len(part) + 8) + b"\x84\x80\x05" + _stamp(ticks) + part
        clock = struct.pack(">Q", (ticks << 15 | 0x7E00) << 16)[:6]
        lead = PACKET - 12  # what the first packet holds beside header, field length, flags and clock reference
        body = max(0, -(-(len(pes) - lead) // 184))
        grid = np.full((body + 1, PACKET), 0xFF, np.uint8)
        grid[:, 0], grid[:, 1], grid[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
        grid[0, 1] |= 0x40
        grid[:, 3] = 0x10 | (count + np.arange(body + 1)) & 15
        count += body + 1
        data = np.frombuffer(pes, np.uint8)
        spare = max(0, lead - len(pes))
        grid[0, 3] |= 0x20
        grid[0, 4], grid[0, 5] = 7 + spare, 0x50
        grid[0, 6:12] = np.frombuffer(clock, np.uint8)
        grid[0, 12 + spare :] = data[: lead - spare]
        rest = data[lead:]
        full = len(rest) // 184
        grid[1 : 1 + full, 4:] = rest[: full * 184].reshape(full, 184)
        if left := len(rest) - full * 184:
            pad = 184 - left
            grid[-1, 3] |= 0x20
            grid[-1, 4] = pad - 1
            if pad > 1:
                grid[-1, 5] = 0
            grid[-1, 4 + pad :] = rest[full * 184 :]
        out.append(grid.tobytes())
    return b"".join(out)


def _packets(data: np.ndarray) -> tuple[np.ndarray, int]:
    """Where packets begin, and how often packets didn't follow one another: there, the next place counts from which two more
    sync bytes stand at a packet's distance (or the end comes first). A packet that the next one cuts short is left out."""
    n = len(data)
    sync = data == SYNC
    sure = sync.copy()
    for away in (PACKET, 2 * PACKET):
        sure[: max(0, n - away)] &= sync[away:]
    sure = np.flatnonzero(sure[: max(0, n - PACKET + 1)])
    starts, at, losses, step = [], 0, 0, 64
    while at + PACKET <= n:
        most = min(step, (n - at) // PACKET)
        good = sync[at : at + most * PACKET : PACKET]
        run = most if good.all() else int(np.argmin(good))
        if run:
            starts.append(at + PACKET * np.arange(run))
            at += run * PACKET
        step = 2 * step if run == most else 64
        if run < most:
            losses += 1
            last = int(starts[-1][-1]) if starts else -1
            to = np.searchsorted(sure, last + 1)
            if to == len(sure):
                return (np.concatenate(starts) if starts else np.zeros(0, np.int64)), losses
            if starts and sure[to] < at:
                starts[-1] = starts[-1][:-1]
                starts = starts if len(starts[-1]) else starts[:-1]
            at = int(sure[to])
    return (np.concatenate(starts) if starts else np.zeros(0, np.int64)), losses + (at < n)


def _repeated(grid: np.ndarray, at: np.ndarray, from_: np.ndarray, counter: np.ndarray, carries: np.ndarray) -> np.ndarray:
    """Which packets of one PID (places at) say the payload of the one before again, under the same count."""
    again = np.zeros(len(at), bool)
    for i in (np.flatnonzero((counter[at[1:]] == counter[at[:-1]]) & carries[at[1:]] & carries[at[:-1]]) + 1).tolist():
        again[i] = grid[at[i], from_[at[i]] :].tobytes() == grid[at[i - 1], from_[at[i - 1]] :].tobytes()
    return again


def _sections(grid: np.ndarray, at: np.ndarray, begins: np.ndarray, from_: np.ndarray) -> list[bytes]:
    """Sections with a right checksum in the packets at these places; the pointer of a packet in which sections begin says how
    many bytes before them still end an earlier one."""
    found, held = [], b""

    def take(held: bytes) -> bytes:
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= (size := 3 + ((held[1] & 15) << 8 | held[2])):
            if size >= 12 and crc32_mpeg(held[:size]) == 0:
                found.append(held[:size])
            held = held[size:]
        return held

    for i in at.tolist():
        body = grid[i, from_[i] :].tobytes()
        if begins[i] and body:
            take(held + body[1 : 1 + body[0]] if held else b"")
            held = take(body[1 + body[0] :])
        else:
            held = take(held + body) if held else b""
    return found


def demux(media: bytes) -> dict:
    """Programs and streams of a transport stream.

    Returns {"packets", "bad_sync", "programs": {number: map PID}, "streams": [{"pid", "kind", "payload", "units",
    "stamps", "random_access", "offsets", "breaks"}]}: the bytes of each stream's elementary packets put together, their
    number, presentation timestamps (-1: none), which of them are random-access points, the bytes of the stream at which
    they begin, and continuity-counter breaks. bad_sync counts the places where bytes between packets had to be skipped.
    """
    data = np.frombuffer(media, np.uint8)
    starts, losses = _packets(data)
    grid = np.lib.stride_tricks.sliding_window_view(data, PACKET)[starts] if len(starts) else np.zeros((0, PACKET), np.uint8)
    out = {"packets": len(starts), "bad_sync": losses, "programs": {}, "streams": []}
    pids = (grid[:, 1].astype(np.int32) & 31) << 8 | grid[:, 2]
    begins, control, counter = grid[:, 1] & 0x40 > 0, grid[:, 3] >> 4 & 3, grid[:, 3] & 15
    field, carries = control & 2 > 0, control & 1 > 0
    length = np.where(field, grid[:, 4].astype(np.int32) + 1, 0)
    from_ = np.minimum(np.where(carries, 4 + length, PACKET), PACKET)
    flags = np.where(field & (length > 1), grid[:, 5], 0)

    def own(pid: int) -> tuple[np.ndarray, int]:
        """The places of a PID's packets, repeated ones left out, and the breaks of its count."""
        at = np.flatnonzero(pids == pid)
        again = _repeated(grid, at, from_, counter, carries)
        at = at[~again]
        step = (counter[at[1:]].astype(np.int32) - counter[at[:-1]]) & 15
        return at, int(((step != carries[at[1:]]) & (flags[at[1:]] & 0x80 == 0)).sum())

    for s in _sections(grid, own(0)[0], begins, from_):
        for i in range(8, len(s) - 4, 4):
            number, pid = struct.unpack(">HH", s[i : i + 4])
            if s[0] == 0 and number:
                out["programs"][number] = pid & 0x1FFF
    kinds: dict[int, int] = {}
    for map_pid in dict.fromkeys(out["programs"].values()):
        for s in _sections(grid, own(map_pid)[0], begins, from_):
            i = 12 + ((s[10] & 15) << 8 | s[11])
            while s[0] == 2 and i + 5 <= len(s) - 4:
                kinds[(s[i + 1] & 31) << 8 | s[i + 2]] = s[i]
                i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
    for pid, kind in kinds.items():
        at, breaks = own(pid)
        mask = np.arange(PACKET)[None, :] >= from_[at][:, None]
        flat, ends = grid[at][mask].tobytes(), np.cumsum(PACKET - from_[at])
        first = np.flatnonzero(begins[at])
        bounds = [*(ends[first] - (PACKET - from_[at[first]])).tolist(), len(flat)]
        parts, stamps, points, offsets = [], [], [], []
        for k, i in enumerate(first.tolist()):
            pes = flat[bounds[k] : bounds[k + 1]]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                continue
            size = pes[4] << 8 | pes[5]
            parts.append(pes[9 + pes[8] : 6 + size if size else None])
            stamps.append((pes[9] >> 1 & 7) << 30 | pes[10] << 22 | pes[11] >> 1 << 15 | pes[12] << 7 | pes[13] >> 1 if pes[7] & 0x80 and len(pes) > 13 else -1)
            points.append(bool(flags[at[i]] & 0x40))
            offsets.append(int(starts[at[i]]))
        out["streams"].append({"pid": pid, "kind": kind, "payload": b"".join(parts), "units": len(parts), "stamps": stamps, "random_access": points, "offsets": offsets, "breaks": breaks})
    return out


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % GRAIN or (0 if text else GRAIN))


SCHEMA = "doc_id long, n_bytes long, media binary"
PARSED = (
    "doc_id long, n_bytes long, media_bytes long, packets long, bad_sync long, programs int, pid int, kind int, payload binary,"
    " units int, breaks int, stamps array<long>, random_access array<boolean>, offsets array<long>"
)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as a transport stream. Null or empty text: 64 zero bytes are stored.

    Rows are independent: repeated rows and null ids stay, very long texts get more elementary packets, an empty table gives
    an empty one; other columns, whatever their names, are left behind.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            data, at = utf8(batch.column("text"))
            media = [mux(padded(data[a:b].tobytes())) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs_of(docs).mapInArrow(run, SCHEMA)


def parse(media: DataFrame) -> DataFrame:
    """One row for each stream of each media value: payload, and the timestamps, random-access points and byte offsets of its units in order."""

    def run(batches):
        for batch in slices(batches, "media"):
            rows = []
            for doc, n, m in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
                found = demux(m or b"")
                for s in found["streams"]:
                    rows.append((doc, n, len(m), found["packets"], found["bad_sync"], len(found["programs"]), s["pid"], s["kind"], s["payload"], s["units"], s["breaks"], s["stamps"], s["random_access"], s["offsets"]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
            names = [x.split()[0] for x in PARSED.split(", ")]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return media.mapInArrow(run, PARSED)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps string, access_points string"


def digests(media: DataFrame) -> DataFrame:
    """What is read back from each stored stream: hashes, a feature of its packets, clock and bytes, and its index.

    feature: units, continuity breaks, random-access points, first and last timestamp, and a 16-bin histogram of the
    payload's high nibbles as shares of 255 in hex. timestamps: those of all units, by commas; access_points: timestamp@byte
    of each unit that is one. Values depend on the text alone, so equal texts and repeated rows have equal values; rows of
    any id (null, too) stay; very long texts have more units; an empty table gives an empty one.
    """

    def run(batches):
        for batch in slices(batches, "media"):
            rows = []
            for m in batch.column("media").to_pylist():
                stream = demux(m)["streams"][0]
                payload = stream["payload"]
                bins = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16) * 255 // len(payload)
                feature = f"u{stream['units']}b{stream['breaks']}r{sum(stream['random_access'])}t{stream['stamps'][0]}-{stream['stamps'][-1]}h{bytes(bins.astype(np.uint8)).hex()}"
                index = ",".join(f"{t}@{o}" for t, o, r in zip(stream["stamps"], stream["offsets"], stream["random_access"], strict=True) if r)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-GRAIN:]), len(m), hashlib.sha256(m).hexdigest(), feature, ",".join(map(str, stream["stamps"])), index))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], [x.split()[0] for x in DIGEST.split(", ")])

    return media.mapInArrow(run, DIGEST)
