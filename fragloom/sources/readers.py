"""Readers of sequence, interval, alignment and variant files. Spark reads the bytes, compressed or not."""

from __future__ import annotations

import re
import struct
import zlib
from binascii import hexlify
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.kmers import normalised
from .scratch import written

FRAGHAP = "read_id long, frag_id long, subject_id long, subject_offset long, frag_size long, mapq long, identity double, hp long"
COMMENTS = "!#;"


def sniff(first: Column) -> Column:
    """Format of a file by its first non-blank character."""
    c = F.substring(F.trim(first), 1, 1)
    return F.when(F.coalesce(c, F.lit("")) == "", "empty").when(c == ">", "fasta").when(c == "@", "fastq").otherwise("unknown")


def sniff_files(spark: SparkSession, paths) -> DataFrame:
    """(path, format) of text files, by the first line that is neither blank nor a comment.

    Of each split a number alone is kept, of the line's place and format in one, so lines are neither sorted nor shuffled.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    kinds = ("fasta", "fastq", "unknown")
    kind = F.coalesce(*(F.when(sniff(F.col("value")) == k, i) for i, k in enumerate(kinds))).cast("long")
    counts = (F.trim("value") != "") & ~F.substring("value", 1, 1).isin(*COMMENTS)
    splits = lines.groupBy("path", "block").agg(F.min(F.when(counts, F.shiftleft("at", 2).bitwiseOR(kind))).alias("first"))
    first = splits.groupBy("path").agg(F.min_by("first", F.when(F.col("first").isNotNull(), F.col("block"))).alias("first"))
    return first.select("path", F.coalesce(*(F.when(F.col("first").bitwiseAND(F.lit(3)) == i, k) for i, k in enumerate(kinds)), F.lit("empty")).alias("format"))


def read_fasta(spark: SparkSession, paths) -> DataFrame:
    """(name, seq, qual): one record after each line that begins with >; the name ends at the first white space.

    Splits of a large file meet between records, since a record's mark is the separator.
    """
    records = spark.read.option("lineSep", "\n>").text(paths)
    body = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(body, r"^([^\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(body, r"^[^\n]*", ""), r"(?m)^[!#;].*$|\s", "")
    rows = records.where(~F.col("value").rlike(r"^\s*$") & ~F.col("value").rlike("^[!#;]")).select(F.regexp_extract(head, r"^\s*(\S+)", 1).alias("name"), seq.alias("raw"))
    return rows.select("name", normalised(F.col("raw")).alias("seq"), F.lit(None).cast("string").alias("qual"), F.length("raw").alias("seq_size"))


def numbered_lines(spark: SparkSession, paths) -> DataFrame:
    """(path, line, value): lines of each file from 0 on, however Spark splits it. A count of each split's lines comes first."""
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    splits = text.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("path", "block", (before - F.col("first")).alias("shift"))  # a row a split
    return text.join(starts, ["path", "block"]).select("path", (F.col("at") + F.col("shift")).alias("line"), "value")


def read_fastq(spark: SparkSession, paths) -> DataFrame:
    """(name, seq, qual, seq_size) of four-line records; a record of another shape raises an error when it is read."""
    lines = numbered_lines(spark, paths)
    part = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
    rec = lines.groupBy("path", F.floor(F.col("line") / 4).alias("record")).agg(*(part(i).alias(f"l{i}") for i in range(4)))
    rec = rec.where("not (trim(l0) = '' and l1 is null)")
    fine = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3"))
    checked = F.when(F.coalesce(fine, F.lit(False)), F.col("l1")).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.coalesce("l0", F.lit("")))))
    return rec.select(F.regexp_extract("l0", r"^@(\S*)", 1).alias("name"), normalised(checked).alias("seq"), F.col("l3").alias("qual"), F.length("l1").alias("seq_size"))


_RESIDUES = re.compile(r"[A-Za-z*.\-]*")


def parse_fastx(text: str, strict: bool = True) -> Iterator[tuple[str, str, str | None]]:
    """(name, seq, qual) of FASTA and FASTQ records. A record with an illegal residue or qualities of another length is an error,
    or is left out (strict=False) together with what follows up to the next header."""
    lines, at = text.splitlines(), 0

    def bad(what: str):
        if strict:
            raise ValueError(what)

    while at < len(lines):
        line = lines[at]
        at += 1
        if not line.strip() or line[0] in COMMENTS:
            continue
        name = (line[1:].split() or [""])[0]
        if line[0] == ">":
            parts = []
            while at < len(lines) and lines[at][:1] not in (">", "@"):
                if lines[at].strip() and lines[at][0] not in COMMENTS:
                    parts.append(lines[at].strip())
                at += 1
            seq = "".join(parts)
            if _RESIDUES.fullmatch(seq):
                yield name, seq, None
            else:
                bad(f"illegal residue in {name}")
        elif line[0] == "@":
            seq, plus, qual = (lines[at + i].strip() if at + i < len(lines) else "" for i in range(3))
            if _RESIDUES.fullmatch(seq) and plus.startswith("+") and len(qual) == len(seq):
                at += 3
                yield name, seq, qual
            else:
                bad(f"not a FASTQ record: {name}")
        else:
            bad(f"neither > nor @: {line[:40]}")


def read_fastx(spark: SparkSession, paths, strict: bool = True) -> DataFrame:
    """(name, seq, qual, seq_size) of small files of either format, each read whole."""
    def run(batches):
        for batch in batches:
            for text in batch.column("value").to_pylist():
                rows = list(parse_fastx(text, strict))
                names, seqs, quals = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seqs, pa.string()), pa.array(quals, pa.string())], ["name", "raw", "qual"])

    rows = spark.read.text(paths, wholetext=True).mapInArrow(run, "name string, raw string, qual string")
    return rows.select("name", normalised(F.col("raw")).alias("seq"), "qual", F.length("raw").alias("seq_size"))


def in_ranges(rows: DataFrame, by: str) -> DataFrame:
    """rows in order of `by` over range partitions, written once, with the number of each one's partition (_part) and its place (_at) in all."""
    ranged = rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id())
    return written(ranged, "ranges").withColumn("_part", F.shiftright("_at", 33))


def with_ids(seqs: DataFrame) -> DataFrame:
    """seqs with seq_id: dense numbers by name, from sums over ranges of names (a row a range), not from one sorted task."""
    ranged = in_ranges(seqs, "name")
    sums = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = sums.select("_part", (before - F.col("_first")).alias("_shift"))
    return ranged.join(F.broadcast(lead), "_part").withColumn("seq_id", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")  # a row a partition


def batches_of(seqs: DataFrame, bases: int) -> DataFrame:
    """seqs (name, seq_size) with batch, in order of names: a batch ends with the sequence that its bases reach `bases` with.

    Ranges of names are sorted apart; of each, its sum alone is added up before it. A batch may so begin within a sequence's
    own bases of its even share, and never holds more than `bases` and its last sequence.
    """
    ranged = in_ranges(seqs, "name")
    sums = ranged.groupBy("_part").agg(F.sum("seq_size").alias("_own"))
    lead = sums.select("_part", F.coalesce(F.sum("_own").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    own = F.sum("seq_size").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    upto = F.col("_before") + own - F.col("seq_size")
    return ranged.join(F.broadcast(lead), "_part").withColumn("batch", F.floor(upto / bases)).drop("_part", "_at", "_before")


def read_bed(spark: SparkSession, paths, names: DataFrame) -> DataFrame:
    """(chr, start, stop) of BED lines; names: (name, chr). A name without a number raises an error."""
    rows = spark.read.text(paths).where(~F.col("value").rlike("^(#|track|browser|\\s*$)")).select(F.split("value", "\t").alias("c"))
    rows = rows.select(F.col("c")[0].alias("name"), F.col("c")[1].cast("long").alias("start"), F.col("c")[2].cast("long").alias("stop"))
    return numbered(rows, names, "name", "chr").drop("name")


def numbered(rows: DataFrame, names: DataFrame, name: str, number: str) -> DataFrame:
    """rows with the number of their name; an unknown name is an error."""
    joined = rows.join(names.select(F.col("name").alias(name), number), name, "left")
    return joined.withColumn(number, F.when(F.col(number).isNull(), F.raise_error(F.concat(F.lit("unknown name "), F.col(name)))).otherwise(F.col(number)))


def read_fraghap(spark: SparkSession, paths) -> DataFrame:
    """Fragment haplotypes: eight columns between white space, # begins a comment."""
    rows = spark.read.text(paths).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.split(F.trim("value"), r"\s+").alias("c"))
    fields = [f.split() for f in FRAGHAP.split(", ")]
    return rows.select(*(F.col("c")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(fields)))


def read_paf(spark: SparkSession, paths, containing: str | None = None) -> DataFrame:
    """(qname, qlen, qstart, qend, strand, tname, tlen, tstart, tend, matches, block, mapq, tags) of PAF lines, or of those with a text."""
    rows = spark.read.text(paths).where(F.trim("value") != "")
    rows = (rows.where(F.col("value").contains(containing)) if containing else rows).select(F.split("value", "\t").alias("c"))
    kinds = "qname string, qlen long, qstart long, qend long, strand string, tname string, tlen long, tstart long, tend long, matches long, block long, mapq long"
    return rows.select(*(F.col("c")[i].cast(k).alias(n) for i, (n, k) in enumerate(f.split() for f in kinds.split(", "))), F.slice("c", 13, 1000).alias("tags"))


def read_vcf(spark: SparkSession, paths) -> DataFrame:
    """(chrom, pos, id, ref, alt, qual, filter, info, format, sample) of VCF records; of several samples the first."""
    rows = spark.read.text(paths).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("c"))
    names = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample")
    return rows.select(*((F.col("c")[i].cast("long") if n == "pos" else F.get("c", F.lit(i))).alias(n) for i, n in enumerate(names)))


def tokens(value: Column, delimiter: str = " ") -> Column:
    """Parts between delimiters; several in a row count as one."""
    return F.filter(F.split(value, re.escape(delimiter)), lambda x: x != "")


NAME = r"^(.*)_(\d+):(\d+):(\d+):(\d+)$"


def parse_name(name: Column) -> dict[str, Column]:
    """Parts of a fragment's name <read>_<read_id>:<frag_id>:<subject_id>:<offset>, from the last _ on."""
    part = lambda i: F.regexp_extract(name, NAME, i)
    return {"read_name": part(1)} | {n: part(i).cast("long") for i, n in enumerate(("read_id", "frag_id", "subject_id", "subject_offset"), 2)}


def read_hapcut(spark: SparkSession, paths) -> DataFrame:
    """(n_blocks, name, blocks, quals, first_var, last_var and the name's parts) of single-fragment variant lines."""
    c = F.col("c")
    rows = spark.read.text(paths).select(tokens(F.col("value")).alias("c")).where(F.size("c") >= 5)
    body = F.slice(c, F.lit(3), F.size(c) - 3)
    rows = rows.select(F.element_at(c, 1).cast("int").alias("n_blocks"), F.element_at(c, 2).alias("name"), F.array_join(body, " ").alias("blocks"), F.element_at(c, -1).alias("quals"), body.alias("b"))
    last = F.element_at("b", -2).cast("long") + F.length(F.element_at("b", -1)) - 1
    return rows.withColumns({"first_var": F.element_at("b", 1).cast("long"), "last_var": last, **parse_name(F.col("name"))}).drop("b")


_SAM = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string"


def _tag(tags: Column, name: str, kind: str) -> Column:
    """The value of a tag among texts like NM:i:3; null where it is absent."""
    return F.substring(F.get(F.filter(tags, lambda t: t.startswith(f"{name}:")), F.lit(0)), 6, 1 << 30).cast(kind)


def read_sam(spark: SparkSession, paths, tags: dict[str, str] | None = None) -> DataFrame:
    """SAM records with the named tags (name: type) as columns; pos counts from 1 as in the file."""
    rows = spark.read.text(paths).where(~F.col("value").startswith("@") & (F.trim("value") != "")).select(F.split("value", "\t").alias("c"))
    rest = F.slice("c", 12, 1000)
    return rows.select(*(F.col("c")[i].cast(k).alias(n) for i, (n, k) in enumerate(f.split() for f in _SAM.split(", "))), *(_tag(rest, n, k).alias(n) for n, k in (tags or {}).items()))


_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_SIZES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
#: Hexadecimal digits as letters, and values of qualities as characters.
_LETTERS = bytearray(256)
for _i, _c in enumerate(_BASES):
    _LETTERS[ord(f"{_i:x}")] = ord(_c)
_CHARACTERS = bytes((i + 33) % 256 for i in range(256))
_FIXED, _INT = struct.Struct("<iiBBHHHiiii"), struct.Struct("<i")


@lru_cache(4096)
def _cigar(ops: bytes) -> str:
    return "".join(f"{o >> 4}{_OPS[o & 15]}" for o in struct.unpack(f"<{len(ops) // 4}I", ops)) or "*"


@lru_cache(4096)
def _tag_kind(head: bytes) -> tuple[str, str, struct.Struct | None]:
    """Name and kind of a tag, and how its value is packed, if it is a number."""
    kind = chr(head[2])
    return head[:2].decode(), kind, struct.Struct("<" + _SIZES[kind]) if kind in _SIZES else None


def bam_header(raw: bytes) -> tuple[list[str], int] | None:
    """Names of the references and where the first record begins, or None if the header goes on beyond these bytes."""
    try:
        if raw[:4] != b"BAM\1"[: len(raw)]:
            raise ValueError("not a BAM file")
        at = 8 + struct.unpack_from("<i", raw, 4)[0]
        (n,), names = struct.unpack_from("<i", raw, at), []
        at += 4
        for _ in range(n):
            (size,) = struct.unpack_from("<i", raw, at)
            struct.unpack_from("<i", raw, at + 4 + size)
            names.append(raw[at + 4 : at + 3 + size].decode())
            at += 8 + size
        return names, at
    except struct.error:
        return None


def bam_record(raw: bytes, at: int, end: int) -> tuple:
    """The record in raw[at:end], after its size: tid, ntid, SAM's fields (names of references left out) and tags."""
    tid, pos, l_name, mapq, _, n_op, flag, l_seq, ntid, npos, tlen = _FIXED.unpack_from(raw, at)
    at += 32
    name = raw[at : at + l_name - 1].decode()
    at += l_name
    cigar = _cigar(raw[at : at + 4 * n_op])
    at += 4 * n_op
    seq = hexlify(raw[at : at + (l_seq + 1) // 2]).translate(_LETTERS)[:l_seq].decode() or "*"
    at += (l_seq + 1) // 2
    qual = raw[at : at + l_seq]
    at += l_seq
    tags = []
    while at < end:
        tag, kind, number = _tag_kind(raw[at : at + 3])
        at += 3
        if number:
            tags.append((tag, str(number.unpack_from(raw, at)[0])))
            at += number.size
        elif kind in "ZH":
            to = raw.index(0, at)
            tags.append((tag, raw[at:to].decode()))
            at = to + 1
        elif kind == "A":
            tags.append((tag, chr(raw[at])))
            at += 1
        elif kind == "B":
            f = "<" + str(_INT.unpack_from(raw, at + 1)[0]) + _SIZES[chr(raw[at])]
            tags.append((tag, ",".join(map(str, struct.unpack_from(f, raw, at + 5)))))
            at += 5 + struct.calcsize(f)
        else:
            raise ValueError(f"{name}: a tag of kind {kind}")
    return tid, ntid, name, flag, pos + 1, mapq, cigar, npos + 1, tlen, seq, "*" if not qual or qual[0] == 255 else qual.translate(_CHARACTERS).decode(), tags


def plausible(raw: bytes, at: int) -> int | None:
    """The end of what looks like a record at a place, or None: its parts must fill its size, and its name be printable and end in a zero.
    A record that goes on beyond the bytes is judged by what is there."""
    if len(raw) < at + 36:
        return None
    size, tid, pos, l_name, _, _, n_op, _, l_seq, ntid, npos, _ = struct.unpack_from("<iiiBBHHHiiii", raw, at)
    fixed = 32 + l_name + 4 * n_op + (l_seq + 1) // 2 + l_seq
    if size < fixed or size > fixed + (1 << 24) or l_name < 2 or l_seq < 0 or min(tid, pos, ntid, npos) < -1:
        return None
    name = raw[at + 36 : at + 36 + l_name]
    if any(not 33 <= c <= 126 for c in name[: l_name - 1]) or len(name) == l_name and name[-1]:
        return None
    return at + 4 + size


def first_record(raw: bytes, whole: bool, chain: int = 4) -> int | None:
    """Where the first record begins: the first place from which `chain` plausible records follow one another, or all up to the end, two
    at least (one, if the whole split is here)."""
    for at in range(max(0, len(raw) - 35)):
        to, n = plausible(raw, at), 1
        while to is not None and to < len(raw) - 36 and n < chain:
            to, n = plausible(raw, to), n + 1
        if to is not None and (n > 1 or whole):
            return at
    return None


#: In the head of each member of a BAM file, and nowhere else (but by a chance of 2 ** -48 a byte): size of the extra field, its name and size.
_MEMBER = "\x06\x00BC\x02\x00"
_KIND = "path string, block long, kind string, tid int, ntid int, qname string, flag int, pos long, mapq int, cigar string, pnext long, tlen long, seq string, qual string, tags map<string,string>, edge binary"
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
#: Inflated bytes that are searched for the first record, and rows of a batch.
_SEARCH, _BATCH = 1 << 18, 4_000


class _Split:
    """The records of one split of a BAM file, as its members come."""

    def __init__(self, path: str, block: int):
        self.path, self.block, self.names = path, block, None
        self.raw, self.rest, self.found, self.search = b"", b"", False, _SEARCH

    def row(self, kind: str, *fields, edge: bytes | None = None) -> tuple:
        return (self.path, self.block, kind, *(fields or (None,) * 12), edge)

    def feed(self, chunk: bytes) -> None:
        """What stands between two marks: the rest of a member from its size on, and the beginning of the next one's head."""
        chunk = self.rest + chunk
        size = int.from_bytes(chunk[:2], "little") - 17 + 2  # of these bytes, the member's
        if len(chunk) < size:
            self.rest = chunk + _MEMBER.encode()  # a mark by chance
            return
        self.rest = b""
        self.raw += zlib.decompress(chunk[2 : size - 8], -15)

    def records(self, last: bool) -> Iterator[tuple]:
        if not self.found and self.block == 0:
            if not (header := bam_header(self.raw)):
                if last:
                    raise ValueError(f"{self.path}: its header is longer than a split; raise spark.sql.files.maxPartitionBytes")
                return
            self.found, (names, at) = True, header
            yield from (self.row("reference", i, None, n, *(None,) * 9) for i, n in enumerate(names))
            self.raw = self.raw[at:]
        elif not self.found:
            if len(self.raw) < self.search and not last:
                return
            at = first_record(self.raw, last)
            if at is None:
                self.search *= 2
                if last:
                    yield self.row("no record", edge=self.raw)
                return
            yield self.row("head", edge=self.raw[:at])
            self.found, self.raw = True, self.raw[at:]
        at = 0
        while at + 4 <= len(self.raw):
            end = at + 4 + struct.unpack_from("<i", self.raw, at)[0]
            if end > len(self.raw):
                break
            yield self.row("record", *bam_record(self.raw, at + 4, end))
            at = end
        self.raw = self.raw[at:]
        if last:
            yield self.row("tail", edge=self.raw)


def bam_table(spark: SparkSession, paths) -> DataFrame:
    """What the splits of BAM files hold: references, records that lie in one split, and the bytes of those at the splits' edges.

    Spark's line reader cuts the files at the marks of their members, so files are read split by split on any file system.
    A split's first record is found by the looks of it and of those that follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], [x.split()[0] for x in _KIND.split(", ")])

        split = None
        for batch in batches:
            for path, block, chunk in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "value")), strict=True):
                if split is None or (path, block) != (split.path, split.block):
                    if split:
                        held += split.records(True)
                    split = _Split(path, block)
                    if block == 0:
                        continue  # the beginning of the first member's head
                split.feed(chunk)
                if len(split.raw) >= _SEARCH:
                    held += split.records(False)
                if len(held) >= _BATCH:
                    yield packed()
                    held = []
        if split:
            held += split.records(True)
        if held:
            yield packed()

    members = spark.read.option("lineSep", _MEMBER).text(paths)
    return members.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")).mapInArrow(run, _KIND)


def read_bam(spark: SparkSession, paths, with_path: bool = False) -> DataFrame:
    """SAM's columns and tags (a map) of BAM files, of which each split is a task's (spark.sql.files.maxPartitionBytes); with_path: and
    the file of each record.

    Bytes before a split's first record and after its last whole one make the records that cross the border: they must come to whole
    records, else an error is raised. Their table is written once (scratch).
    """
    table = written(bam_table(spark, paths), "bam")
    splits = Window.partitionBy("path").orderBy("block", F.when(F.col("kind") == "tail", 1).otherwise(0))  # two rows a split at most
    edges = table.where("edge is not null").select("path", "block", "kind", "edge", F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(splits).alias("of"))

    def cross(border: pa.Table) -> pa.Table:
        border = border.sort_by([("block", "ascending")])
        tails = border.filter(pc.equal(border.column("kind"), "tail")).column("edge").to_pylist()
        rest = border.filter(pc.not_equal(border.column("kind"), "tail")).column("edge").to_pylist()
        raw, at, rows = b"".join(tails + rest), 0, []
        path, block = border.column("path")[0].as_py(), border.column("block")[0].as_py()
        while at + 4 <= len(raw):
            end = at + 4 + struct.unpack_from("<i", raw, at)[0]
            if end > len(raw) or end < at + 36:
                break
            rows.append((path, block, "record", *bam_record(raw, at + 4, end), None))
            at = end
        if at < len(raw):
            raise ValueError(f"{path}: after byte {block} the records at the splits' border don't fit together")
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(_KINDS)
        return pa.table({x.split()[0]: pa.array(c, k) for x, c, k in zip(_KIND.split(", "), columns, _KINDS, strict=True)})

    crossing = edges.groupBy("path", "of").applyInArrow(lambda t: cross(t), _KIND)
    records = table.where("kind = 'record'").unionByName(crossing)
    own = F.array_sort(F.collect_list(F.struct("tid", "qname")))
    heads = table.where("kind = 'reference'").groupBy("path").agg(F.transform(own, lambda x: x["qname"]).alias("names"))
    heads = heads.withColumn("head", F.sha2(F.to_json("names"), 256))
    # a row a file, and one a header (files of one writer have the same): records stay where they are
    records = records.join(F.broadcast(heads.select("path", "head")), "path", "left").join(F.broadcast(heads.groupBy("head").agg(F.first("names").alias("names"))), "head", "left")
    name = lambda c: F.when(F.col(c) >= 0, F.get("names", F.col(c)))
    same = F.when(F.col("ntid") < 0, "*").when(F.col("ntid") == F.col("tid"), "=").otherwise(name("ntid"))
    return records.withColumns({"rname": F.coalesce(name("tid"), F.lit("*")), "rnext": same}).select(*(f.split()[0] for f in _SAM.split(", ")), "tags", *(["path"] if with_path else []))


def fraghap_of_records(records: DataFrame) -> DataFrame:
    """Fragment haplotypes of alignment records (qname, seq, mapq, pi, HP): ids from the name, pi required, HP 0 where absent."""
    parts = {k: v for k, v in parse_name(F.col("qname")).items() if k != "read_name"}
    pi = F.when(F.col("pi").isNull(), F.raise_error(F.lit("a record has no pi tag")).cast("double")).otherwise(F.col("pi").cast("double"))
    return records.select(*(v.alias(k) for k, v in parts.items()), F.length("seq").cast("long").alias("frag_size"), F.col("mapq").cast("long").alias("mapq"), pi.alias("identity"), F.coalesce("HP", F.lit(0)).cast("long").alias("hp"))
