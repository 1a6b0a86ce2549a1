"""Writers: alignments as PAF, SAM and BAM, fragment lists, BED, FASTQ, and tables split by chromosome."""

from __future__ import annotations

import re
import struct
import zlib
from binascii import unhexlify
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pieces import pieces

FORMATS = ("sam", "frag-sam", "bam", "frag-bam", "paf")
DEFAULT_FORMAT = "paf"
VERSION = "0.1"


def frag_name() -> Column:
    return F.format_string("%s_%010d:%03d:%010d:%010d", "read_name", "read_id", "frag_id", "subject_id", "soff")


def number_fragments(chain: DataFrame) -> DataFrame:
    """Fragments with frag_id: their place on the read, by forward offset."""
    w = Window.partitionBy("read_id").orderBy("fwd_qoff", "fwd_qend", "subject_id", "soff")
    return chain.withColumn("frag_id", F.row_number().over(w) - 1)


def _tags(*named: tuple[str, str, str]) -> list[Column]:
    return [F.concat(F.lit(f"{tag}:{kind}:"), F.col(c).cast("string")) for tag, kind, c in named]


SA = lambda: F.when(F.col("sa").isNotNull(), F.concat(F.lit("SA:Z:"), F.col("sa")))


def sa_tag(strand: str, chain_qoff: str, chain_qend: str, sname: str, soff: str, send: str, pi: str) -> Column:
    """The best other place of a fragment, as a value of the SA tag."""
    return F.concat_ws(":", F.when(F.col(strand) == 0, "+").otherwise("-"), chain_qoff, chain_qend, sname, soff, send, F.round(pi, 4))


def paf_lines(rows: DataFrame) -> DataFrame:
    """PAF lines of fragments: twelve columns (matches and length of the gapped rows), site tags, identity, id and the best other place."""
    columns = ["read_name", "qsize", "fwd_qoff", "fwd_qend", F.when(F.col("qdir") == 0, "+").otherwise("-"), "sname", "ssize", "soff", "send", "matches", "length", "mapq"]
    tags = _tags(("qS", "i", "enzyme_qoff"), ("qE", "i", "enzyme_qend"), ("vS", "i", "enzyme_soff"), ("vE", "i", "enzyme_send"), ("pi", "f", "pi"), ("qi", "i", "read_id"))
    return rows.select(F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns), *tags, SA()).alias("value"))


def _cigar_runs(q: str, s: str) -> list[list]:
    out: list[list] = []
    for a, b in zip(q, s, strict=True):
        op = "D" if a == "-" else "I" if b == "-" else "M"
        if out and out[-1][1] == op:
            out[-1][0] += 1
        else:
            out.append([1, op])
    return out


def cigar(q: str, s: str, left: int = 0, right: int = 0) -> str:
    """Runs of a gapped read row against a gapped reference row, with clipped ends."""
    ends = ([[left, "S"]] if left else []), ([[right, "S"]] if right else [])
    return "".join(f"{n}{op}" for n, op in ends[0] + _cigar_runs(q, s) + ends[1])


def cigar_fits(value: Column, size: Column) -> Column:
    """Whether clipped, matched and inserted bases add up to the read's size."""
    runs = F.regexp_extract_all(value, F.lit(r"(\d+)[SMI=X]"), F.lit(1))
    return F.aggregate(runs, F.lit(0), lambda n, x: n + x.cast("int")) == size


def sam_lines(rows: DataFrame, fragments: bool = False) -> DataFrame:
    """SAM lines of fragments: whole reads with clipped ends, or the fragments alone under their own names."""
    name = frag_name() if fragments else F.col("read_name")
    seq, qual, text = ("frag_seq", "frag_qual", "frag_cigar") if fragments else ("seq", "qual", "cigar")
    columns = [name, F.when(F.col("qdir") == 1, 16).otherwise(0), "sname", F.col("soff") + 1, "mapq", text, F.lit("*"), F.lit(0), F.lit(0), seq, F.coalesce(qual, F.lit("*"))]
    tags = _tags(
        ("qi", "i", "read_id"), ("qd", "i", "qdir"), ("qs", "i", "fwd_qoff"), ("qe", "i", "fwd_qend"), ("qS", "i", "enzyme_qoff"), ("qE", "i", "enzyme_qend"), ("ql", "i", "qsize"), ("si", "i", "subject_id"),
        ("ss", "i", "soff"), ("se", "i", "send"), ("vS", "i", "enzyme_soff"), ("vE", "i", "enzyme_send"), ("sl", "i", "ssize"), ("pi", "f", "pi"),
    )
    haplotype = [F.when(F.col("HP").isNotNull(), F.concat(F.lit("HP:i:"), F.col("HP").cast("string")))] if "HP" in rows.columns else []
    return rows.select(F.concat_ws("\t", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in columns), *tags, SA(), *haplotype).alias("value"))


def sam_header(names: list[tuple[str, int]], program: str = "fragloom") -> list[str]:
    return ["@HD\tVN:1.6\tSO:unknown\tGO:query", *(f"@SQ\tSN:{n}\tLN:{size}" for n, size in names), f"@PG\tID:{program}\tPN:{program}\tVN:{VERSION}"]


def write_lines(lines: DataFrame, path: str, header: list[str] | None = None, mode: str = "error", compression: str | None = None) -> None:
    """Lines as text files; a header goes to a file that sorts before them."""
    lines.select("value").write.mode(mode).text(path, compression=compression)
    if header:
        lines.sparkSession.createDataFrame([(x,) for x in header], "value string").coalesce(1).write.mode(mode).text(f"{path.rstrip('/')}-header")


#: Bytes of records in a compressed block, and how SAM's letters are numbered in BAM.
BLOCK = 65_280
_OPS, _LETTERS = "MIDNSHP=X", {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}


def bgzf(data: bytes) -> bytes:
    """A block: a gzip member that says its own size, so that readers can begin at any."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def _bin(start: int, stop: int) -> int:
    """The smallest of the nested bins (512 Mb, and eight times less each) that holds [start, stop)."""
    stop -= 1
    for level, shift in ((5, 14), (4, 17), (3, 20), (2, 23), (1, 26)):
        if start >> shift == stop >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


#: Letters as the hexadecimal digits of their codes, and characters of qualities as their values.
_DIGITS = bytearray(b"f" * 256)
for _c, _i in _LETTERS.items():
    _DIGITS[ord(_c)] = _DIGITS[ord(_c.lower())] = ord(f"{_i:x}")
_VALUES = bytes((i - 33) % 256 for i in range(256))
_FIXED, _INT, _FLOAT = struct.Struct("<iiBBHHHiiii"), struct.Struct("<i"), struct.Struct("<f")


@lru_cache(4096)
def _cigar_codes(value: str) -> tuple[int, bytes, int]:
    """How many operations a CIGAR has, their codes, and the reference bases that they cover (one at least)."""
    runs = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", value)]
    return len(runs), struct.pack(f"<{len(runs)}I", *(n << 4 | _OPS.index(op) for n, op in runs)), sum(n for n, op in runs if op in "MDN=X") or 1


@lru_cache(4096)
def _tag_head(head: str) -> tuple[bytes, str]:
    """What a tag begins with, of texts like NM:i:, and its kind."""
    key, kind, _ = head.split(":")
    return key.encode() + (kind if kind in "if" else "Z").encode(), kind


def bam_record(line: str, ids: dict[str, int]) -> bytes:
    """A SAM line as a BAM record; ids: numbers of the reference sequences."""
    name, flag, rname, pos, mapq, cigar_, rnext, pnext, tlen, seq, qual, *tags = line.split("\t")
    n_op, runs, reach = _cigar_codes(cigar_)
    tid, at = ids.get(rname, -1), int(pos) - 1
    size, seq = (0, "") if seq == "*" else (len(seq), seq)
    digits = seq.encode("latin-1", "replace").translate(_DIGITS) + b"0" * (size & 1)
    if qual == "*":
        quality = b"\xff" * size
    elif qual and min(qual) < "!":
        raise ValueError(f"{name}: a quality below 0")
    else:
        quality = qual.encode("latin-1").translate(_VALUES)
    name = name.encode()
    parts = [
        _FIXED.pack(tid, at, len(name) + 1, int(mapq), _bin(max(at, 0), max(at, 0) + reach), n_op, int(flag), size, tid if rnext == "=" else ids.get(rnext, -1), int(pnext) - 1, int(tlen)),
        name, b"\0", runs, unhexlify(digits), quality,
    ]
    for tag in tags:
        head, kind = _tag_head(tag[:5])
        value = tag[5:]
        parts += head, _INT.pack(int(value)) if kind == "i" else _FLOAT.pack(float(value)) if kind == "f" else value.encode() + b"\0"
    body = b"".join(parts)
    return _INT.pack(len(body)) + body


def bam_head(names: list[tuple[str, int]]) -> bytes:
    text = ("\n".join(sam_header(names)) + "\n").encode()
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(names))
    for name, size in names:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    return out


def bam_blocks(lines: Iterator[str], names: list[tuple[str, int]]) -> Iterator[bytes]:
    """The blocks of a BAM file of SAM lines, the empty one at the end included; a record may go on in the next block."""
    ids = {n: i for i, (n, _) in enumerate(names)}
    held = bytearray(bam_head(names))
    for line in lines:
        held += bam_record(line, ids)
        while len(held) >= BLOCK:
            yield bgzf(held[:BLOCK])
            del held[:BLOCK]
    if held:
        yield bgzf(held)
    yield bgzf(b"")


def write_bam(lines: DataFrame, path: str, names: list[tuple[str, int]]) -> None:
    """SAM lines as BAM files, one of each partition, through Spark's own writer: any file system, and no file of a failed attempt.

    A block's last byte is zero (of its size, which is below 65,537), so blocks without it are the lines of a text whose line
    separator is a zero.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for block in bam_blocks((x for batch in batches for x in batch.column("value").to_pylist()), names):
            yield pa.RecordBatch.from_arrays([pa.array([block[:-1]], pa.binary())], ["value"])

    blocks = lines.select("value").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    blocks.write.option("lineSep", "\0").option("compression", "none").text(path)
    spark = lines.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            files.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name[:-4] + ".bam"))


def write_alignments(rows: DataFrame, path: str, form: str = DEFAULT_FORMAT, names: list[tuple[str, int]] = ()) -> None:
    if form not in FORMATS:
        raise ValueError(f"{form}: one of {', '.join(FORMATS)}")
    if form == "paf":
        write_lines(paf_lines(rows), path)
    elif form.endswith("bam"):
        write_bam(sam_lines(rows, form == "frag-bam"), path, list(names))
    else:
        write_lines(sam_lines(rows, form == "frag-sam"), path, sam_header(list(names)))


def fraghap_lines(frags: DataFrame) -> DataFrame:
    columns = ["read_id", "frag_id", "subject_id", "subject_offset", "frag_size", "mapq"]
    return frags.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns), F.format_string("%g", "identity"), F.col("hp").cast("string")).alias("value"))


FRAGHAP_HEADER = ["## fragment haplotypes; haplotype 0 is untagged", "##read_id\tfrag_id\tchr_id\tchr_pos\tfrag_length\tmapQ\tidentity\thaplotype"]


def bed_lines(regions: DataFrame, names: DataFrame, seqs: DataFrame | None = None, shown: int = 500) -> DataFrame:
    """BED lines of (chr, start, stop); shorter regions than `shown` get their bases as a fourth column (seqs: chr, seq)."""
    rows = regions.join(names, "chr")
    columns = ["name", F.col("start").cast("string"), F.col("stop").cast("string")]
    if seqs is not None:
        size = 1 << 16
        parts = pieces(seqs, size, after=shown, key="chr").select("chr", "piece", F.col("start").alias("_from"), "part")
        short = F.col("stop") - F.col("start") < shown
        rows = rows.join(seqs.select("chr"), "chr", "left_semi").withColumn("piece", F.when(short, F.floor(F.col("start") / size).cast("int")))
        rows = rows.join(parts, ["chr", "piece"], "left")
        bases = F.substring("part", (F.col("start") - F.col("_from") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
        columns.append(F.when(short, F.coalesce(bases, F.lit(""))))
    return rows.select(F.concat_ws("\t", *columns).alias("value"))


def fastq_lines(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def concat_fastq(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All reads of several files, and (files, reads, bases)."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows, rows.agg(F.lit(len(parts)).alias("files"), F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"))


def fasta_subset(seqs: DataFrame, names: list[str]) -> DataFrame:
    return seqs.where(F.col("name").isin(names))


def fasta_index(seqs: DataFrame, width: int = 60) -> DataFrame:
    """(name, length, offset) of sequences as a FASTA file of one name order and line width would hold them."""
    size = F.length("name") + 2 + F.length("seq") + F.ceil(F.length("seq") / width)
    w = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)  # a row a chromosome
    return seqs.select("name", F.length("seq").alias("length"), (F.coalesce(F.sum(size).over(w), F.lit(0)) + F.length("name") + 2).alias("offset"))


def sorted_by_place(rows: DataFrame, chromosome: str, at: str, *ties: str, files: int | None = None) -> DataFrame:
    """Rows in order of chromosome and place over range partitions (`files` of them, by default as many as their bytes ask for):
    files of few chromosomes, whose statistics serve as an index (`regions`)."""
    dealt = rows.repartitionByRange(files, chromosome, at) if files else rows.repartitionByRange(chromosome, at)
    return dealt.sortWithinPartitions(chromosome, at, *ties)


def split_by(rows: DataFrame, chromosome: str, path: str, compression: str = "zstd") -> None:
    """A folder for each chromosome; a chromosome without rows has none, and reads as empty."""
    rows.write.partitionBy(chromosome).option("compression", compression).parquet(path)


def split_vcf(records: DataFrame, path: str, snp: bool = False, passed: bool = False, names: list[str] = ()) -> None:
    """A folder for each chromosome, SNPs or passed records alone if asked for; listed chromosomes without rows get an empty one."""
    keep = F.lit(True)
    if snp:
        keep &= F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT](,[ACGT])*$")
    if passed:
        keep &= F.col("filter") == "PASS"
    kept = records.where(keep)
    split_by(kept, "chrom", path)
    if names:
        there = {r[0] for r in kept.select("chrom").where(F.col("chrom").isin(list(names))).distinct().collect()}  # listed names at most
        for name in sorted(set(names) - there):
            kept.limit(0).drop("chrom").coalesce(1).write.parquet(f"{path.rstrip('/')}/chrom={name}")


def merge_split(spark: SparkSession, path: str, chromosome: str, order: list) -> DataFrame:
    """Rows of split_by in the order of chromosomes; unlisted ones are left out."""
    ranks = F.create_map(*(F.lit(x) for i, c in enumerate(order) for x in (c, i)))
    return spark.read.parquet(path).where(F.col(chromosome).isin(order)).withColumn("_rank", ranks[F.col(chromosome)]).orderBy("_rank").drop("_rank")
