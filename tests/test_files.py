"""Readers and writers."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from fragloom.sources import readers, writers
from fragloom.streaming import ingest


def test_fastx(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nNN\n\n>two\nGG\n")
    got = sorted((r.name, r.seq, r.seq_size) for r in readers.read_fasta(spark, str(tmp_path / "a.fa")).collect())
    assert got == [("one", "ACGTAA", 6), ("two", "GG", 2)]
    (tmp_path / "b.fq").write_text("@r1 x\nACGT\n+\n@III\n@r2\nGGN\n+\n#!I\n")
    expected = [("r1", "ACGT", "@III"), ("r2", "GGA", "#!I")]
    assert sorted((r.name, r.seq, r.qual) for r in readers.read_fastq(spark, str(tmp_path / "b.fq")).collect()) == expected
    assert sorted((r.name, r.seq, r.qual) for r in readers.read_fastx(spark, str(tmp_path / "b.fq")).collect()) == expected
    kinds = {r.path.rsplit("/", 1)[1]: r.format for r in readers.sniff_files(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fq")]).collect()}
    assert kinds == {"a.fa": "fasta", "b.fq": "fastq"}
    ids = sorted((r.name, r.seq_id) for r in readers.with_ids(readers.read_fasta(spark, str(tmp_path / "a.fa"))).collect())
    assert ids == [("one", 0), ("two", 1)]


def test_split_fastq(spark, tmp_path):
    reads = [(f"r{i}", "ACGT"[i % 4] * (i % 50 + 1), "@" * (i % 50 + 1)) for i in range(3000)]
    (tmp_path / "c.fq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in reads))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = readers.read_fastq(spark, str(tmp_path / "c.fq")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.name, r.seq, r.qual) for r in got) == sorted(reads)


def test_bad_records():
    assert list(readers.parse_fastx("@a\nAC\n+\nI\n>b\nAC1\n>c\nGT\n", strict=False)) == [("c", "GT", None)]
    with pytest.raises(ValueError):
        list(readers.parse_fastx(">b\nAC1\n"))


def test_tables(spark, tmp_path):
    names = spark.createDataFrame([("chr1", 0)], "name string, chr long")
    (tmp_path / "a.bed").write_text("chr1\t5\t9\n")
    assert [(r.chr, r.start, r.stop) for r in readers.read_bed(spark, str(tmp_path / "a.bed"), names).collect()] == [(0, 5, 9)]
    (tmp_path / "b.bed").write_text("chrX\t5\t9\n")
    with pytest.raises(Exception, match="unknown name"):
        readers.read_bed(spark, str(tmp_path / "b.bed"), names).collect()
    frags = spark.createDataFrame([(1, 0, 2, 300, 40, 9, 98.5, 1)], readers.FRAGHAP)
    writers.write_lines(writers.fraghap_lines(frags), str(tmp_path / "frags"), writers.FRAGHAP_HEADER)
    assert readers.read_fraghap(spark, [str(tmp_path / "frags"), str(tmp_path / "frags-header")]).collect() == frags.collect()
    (tmp_path / "h").write_text("2 r_0000000001:002:0000000003:0000000400 7 01 12 1 FFF\n")
    h = readers.read_hapcut(spark, str(tmp_path / "h")).first()
    assert (h.n_blocks, h.blocks, h.quals, h.first_var, h.last_var, h.read_id, h.frag_id, h.subject_id, h.subject_offset) == (2, "7 01 12 1", "FFF", 7, 12, 1, 2, 3, 400)
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\nchr1\t10\t.\tA\tC\t.\tPASS\t.\tGT:PS\t0|1:5\n")
    assert readers.read_vcf(spark, str(tmp_path / "v.vcf")).first().sample == "0|1:5"
    row = spark.createDataFrame([("a  b c",)], "v string").select(readers.tokens(F.col("v")).alias("t")).first()
    assert row.t == ["a", "b", "c"]


def bgzf(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def test_bam(spark, tmp_path):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    name, seq = b"r1\0", bytes([0x12, 0x48])
    body = struct.pack("<iiBBHHHiiii", 0, 9, len(name), 33, 0, 1, 16, 4, -1, -1, 0) + name + struct.pack("<I", 4 << 4) + seq + bytes([40] * 4) + b"HPi" + struct.pack("<i", 2) + b"SAZab\0"
    (tmp_path / "x.bam").write_bytes(bgzf(head) + bgzf(struct.pack("<i", len(body)) + body))
    r = readers.read_bam(spark, str(tmp_path / "x.bam")).first()
    assert (r.qname, r.flag, r.rname, r.pos, r.mapq, r.cigar, r.seq, r.qual) == ("r1", 16, "chr1", 10, 33, "4M", "ACGT", "IIII")
    assert r.tags == {"HP": "2", "SA": "ab"}


def test_sam_and_cigar(spark, tmp_path):
    assert writers.cigar("AC-GT", "A-CGT", 2, 1) == "2S1M1I1D2M1S"
    df = spark.createDataFrame([("2S1M1I1D2M1S", 7), ("3M", 4)], "c string, n int")
    assert [r[0] for r in df.select(writers.cigar_fits(F.col("c"), F.col("n"))).collect()] == [True, False]
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\nq\t0\tchr1\t5\t60\t4M\t*\t0\t0\tACGT\t*\tpi:f:98.5\tHP:i:1\n")
    r = readers.read_sam(spark, str(tmp_path / "a.sam"), {"pi": "double", "HP": "int", "XX": "int"}).first()
    assert (r.qname, r.pos, r.pi, r.HP, r.XX) == ("q", 5, 98.5, 1, None)


def test_split_and_merge(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "chrom string, v int")
    writers.split_by(df, "chrom", str(tmp_path / "s"))
    assert [r.v for r in writers.merge_split(spark, str(tmp_path / "s"), "chrom", ["b", "a"]).collect()] == [1, 2]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fq").write_text("@r1\nAC\n+\nII\n@r2\nGN\n+\nII\n")
    seen = []
    query = ingest.each_batch(ingest.fastq_stream(spark, str(tmp_path / "in")), lambda df, i: seen.extend((r.name, r.seq) for r in df.collect()), str(tmp_path / "cp"))
    query.awaitTermination()
    assert sorted(seen) == [("r1", "AC"), ("r2", "GA")]


def test_bam_round_trip(spark, tmp_path):
    from fragloom.plans import catalog
    from fragloom.sources import readers, writers

    rows = catalog._named(spark, "/root/testdata/sf0.001")
    names = [(f"chr{i}", 100_050_000) for i in range(5)]
    for form in ("bam", "frag-bam"):
        writers.write_alignments(rows, str(tmp_path / form), form, names)
        lines = {x.value for x in writers.sam_lines(rows, form == "frag-bam").collect()}
        back = readers.read_bam(spark, str(tmp_path / form)).collect()
        assert len(back) == rows.count() and all(x.name.endswith(".bam") for x in (tmp_path / form).iterdir() if x.name[0] not in "._")
        shown = lambda x: "\t".join(map(str, (x.qname, x.flag, x.rname, x.pos, x.mapq, x.cigar, x.rnext, x.pnext, x.tlen, x.seq, x.qual)))
        assert {shown(x) for x in back} == {"\t".join(x.split("\t")[:11]) for x in lines}
        tags = {x.qname: x.tags for x in back}
        one = next(iter(lines)).split("\t")
        assert all(tags[one[0]][t[:2]] == t[5:] or t[:2] == "pi" for t in one[11:]) or form == "bam"
    line = "r\t16\tchr1\t100\t7\t2S3M1D2I1M\t*\t0\t0\tACGTNACG\tIIIIIII!\tpi:f:93.5\tSA:Z:x:y"
    (tmp_path / "one.bam").write_bytes(b"".join(writers.bam_blocks(iter([line]), names)))
    (record,) = readers.read_bam(spark, str(tmp_path / "one.bam")).collect()
    assert record.seq == "ACGTNACG" and record.qual == "IIIIIII!" and record.cigar == "2S3M1D2I1M" and record.tags == {"pi": "93.5", "SA": "x:y"} and record.pos == 100
    assert writers.bgzf(b"") == bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
    assert (writers._bin(0, 1), writers._bin(0, 1 << 29), writers._bin(1 << 14, (1 << 14) + 5), writers._bin((1 << 14) - 1, (1 << 14) + 1)) == (4681, 0, 4682, 585)


def test_batches_by_bases(spark):
    sizes = [(f"r{i:03d}", 10 + i % 7) for i in range(200)]
    got = readers.batches_of(spark.createDataFrame(sizes, "name string, seq_size long"), 100).orderBy("name").collect()
    batch = [x.batch for x in got]
    assert batch == sorted(batch) and set(batch) == set(range(max(batch) + 1))
    for b in set(batch):
        own = [x.seq_size for x in got if x.batch == b]
        assert sum(own) - own[-1] <= 100


def test_sizes():
    from fragloom.functions import sizes

    assert [sizes.parse_size(x) for x in ("17", "4k", "8MB", "1,000", "2g")] == [17, 4096, 8 << 20, 1000, 2 << 30]
    for bad in ("", "x", "3T", "-1", "1.5K", "99999999999999999999"):
        with pytest.raises(ValueError):
            sizes.parse_size(bad)
    assert [sizes.size_text(x) for x in (0, 999, 1000, 1_234_567, 999_999, 25_600_000_000)] == ["0", "999", "1.00KB", "1.23MB", "1.00MB", "25.6GB"]
    assert sizes.with_separators(1234567) == "1,234,567"


def test_listed_chromosomes_without_rows(spark, tmp_path):
    rows = spark.createDataFrame([("chr1", 5, "A", "C", "PASS"), ("chr1", 9, "AT", "C", "PASS")], "chrom string, pos long, ref string, alt string, filter string")
    writers.split_vcf(rows, str(tmp_path / "v"), snp=True, names=["chr1", "chr2"])
    assert spark.read.parquet(str(tmp_path / "v/chrom=chr1")).count() == 1 and spark.read.parquet(str(tmp_path / "v/chrom=chr2")).count() == 0


def test_names_indices_and_tags(spark, tmp_path):
    from fragloom.operators import enzymes, variants

    df = spark.createDataFrame([(0, 10, 20, "chr1", 5, 15, 93.14159)], "qdir int, qb long, qe long, sname string, s long, e long, pi double")
    assert df.select(writers.sa_tag("qdir", "qb", "qe", "sname", "s", "e", "pi")).first()[0] == "+:10:20:chr1:5:15:93.1416"
    loci = F.array(*(F.lit(x) for x in (0, 50, 90, 120, 121)))
    assert [r[0] for r in spark.createDataFrame([(0,), (49,), (50,), (119,), (121,)], "at int").select(enzymes.bounded_index(F.col("at"), loci)).collect()] == [0, 0, 1, 2, 2]


def test_written_bam_is_made_of_whole_blocks(spark, tmp_path):
    lines = spark.range(2_000).selectExpr("concat('r', id, '\\t0\\tc\\t', id + 1, '\\t9\\t40M\\t*\\t0\\t0\\t', repeat('ACGTTGCA', 5), '\\t*\\tHP:i:', id % 2 + 1) value").repartition(3)
    writers.write_bam(lines, str(tmp_path / "b"), [("c", 9_999)])
    files = sorted(x for x in (tmp_path / "b").iterdir() if x.suffix == ".bam" and x.name[0] != ".")
    assert len(files) == 3
    for x in files:
        data = x.read_bytes()
        assert data.endswith(bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"))
        at = 0
        while at < len(data):  # block after block, each of the size that it says
            assert data[at : at + 4] == b"\x1f\x8b\x08\x04"
            size = int.from_bytes(data[at + 16 : at + 18], "little") + 1
            zlib.decompress(data[at : at + size], 31)
            at += size
        assert at == len(data)
    back = readers.read_bam(spark, str(tmp_path / "b")).collect()
    assert {(x.qname, x.pos, x.tags["HP"]) for x in back} == {(f"r{i}", i + 1, str(i % 2 + 1)) for i in range(2_000)}


def test_a_bam_file_in_many_splits(spark, tmp_path):
    """The records are those of the file read in one split: short ones, and some longer than several splits."""
    import random

    r = random.Random(5)
    names = [(f"contig{i}", 10_000 + i) for i in range(40)]
    lines = []
    for i in range(900):
        n = r.choice([30, 400, 3_000]) if i % 100 else 150_000
        seq = "".join(r.choice("ACGT") for _ in range(n))
        qual = "".join(chr(r.randint(34, 73)) for _ in range(n))
        lines.append("\t".join(map(str, (f"read{i}/x", 0, names[i % 40][0] if i % 7 else "*", i + 1, 60, f"{n}M", "=" if i % 5 else names[3][0], 77, -5, seq, qual, f"NM:i:{i}", "XZ:Z:BC"))))
    (tmp_path / "a.bam").write_bytes(b"".join(writers.bam_blocks(iter(lines), names)))
    (tmp_path / "b.bam").write_bytes(b"".join(writers.bam_blocks(iter(lines[:3]), names[::-1])))
    (tmp_path / "c.bam").write_bytes(b"".join(writers.bam_blocks(iter([]), names)))
    shown = lambda x: "\t".join(map(str, (x.qname, x.flag, x.rname, x.pos, x.mapq, x.cigar, x.rnext, x.pnext, x.tlen, x.seq, x.qual)))
    expected = sorted("\t".join(x.split("\t")[:11]) if x.split("\t")[6] == "=" and x.split("\t")[2] != "*" else "" for x in [*lines, *lines[:3]])
    whole = readers.read_bam(spark, str(tmp_path / "*.bam")).collect()
    assert len(whole) == 903 and {x for x in expected if x} <= {shown(x) for x in whole} and {x.tags["NM"] for x in whole} == {str(i) for i in range(900)}
    for size in (60_000, 131_072, 700_001):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            members = readers.bam_table(spark, str(tmp_path / "a.bam")).groupBy("block").count().count()
            split = readers.read_bam(spark, str(tmp_path / "*.bam")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert members > (tmp_path / "a.bam").stat().st_size / size / 2
        assert sorted(map(shown, split)) == sorted(map(shown, whole)) and sorted(str(sorted(x.tags.items())) for x in split) == sorted(str(sorted(x.tags.items())) for x in whole)


def test_first_record_of_a_split():
    record = writers.bam_record("r\t16\tchr1\t100\t7\t4M\t*\t0\t0\tACGT\tIIII\tpi:f:93.5", {"chr1": 0})
    raw = record * 6
    for cut in range(len(record)):
        assert readers.first_record(raw[cut:], False) == (len(record) - cut) % len(record)
    assert readers.first_record(b"\0" * 500, True) is None and readers.first_record(b"", True) is None
    assert readers.bam_header(b"BAM\1") is None
    with pytest.raises(ValueError):
        readers.bam_header(b"SAM\1" + b"\0" * 20)


def test_regions_are_read_from_the_files_that_hold_them(spark, tmp_path):
    from fragloom.sources import regions

    rows = spark.range(3_000).selectExpr("id", "concat('c', id % 3) chrom", "(id * 7919) % 100000 start").selectExpr("*", "start + id % 50 + 1 stop")
    path = str(tmp_path / "placed")
    writers.sorted_by_place(rows, "chrom", "start", files=8).write.parquet(path)
    index = regions.index_of(spark.read.parquet(path), F.col("_metadata.file_path"), "chrom", "start", "stop").cache()
    all_files = index.select("path").distinct().count()
    for chrom, lo, hi in (("c0", 500, 900), ("c1", 0, 100_100), ("c2", 99_990, 99_999)):
        got = regions.read_region(spark, index, regions.read_parquet, chrom, "chrom", "start", "stop", lo, hi)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in rows.where(f"chrom = '{chrom}' and start < {hi} and stop > {lo}").collect())
        assert len(got.inputFiles()) <= len(regions.files_of(index, chrom, lo, hi)) < all_files
    assert regions.read_region(spark, index, regions.read_parquet, "c9", "chrom", "start", "stop", 0, 10).count() == 0
    with pytest.raises(ValueError):
        regions.read_region(spark, index.limit(0), regions.read_parquet, "c9", "chrom", "start", "stop", 0, 10)
    # BAM files in order of place
    lines = writers.sorted_by_place(rows, "chrom", "start", files=8).selectExpr("concat_ws('\\t', concat('r', id), 0, chrom, start + 1, 9, concat(stop - start, 'M'), '*', 0, 0, '*', '*') value")
    writers.write_bam(lines, str(tmp_path / "bam"), [(f"c{i}", 200_000) for i in range(3)])
    records = readers.read_bam(spark, str(tmp_path / "bam"), with_path=True)
    begin, end = F.col("pos") - 1, F.col("pos") - 1 + regions.reference_length(F.col("cigar"))
    index = regions.index_of(records, "path", "rname", begin, end).cache()
    got = regions.read_region(spark, index, readers.read_bam, "c1", "rname", begin, end, 500, 900).collect()
    assert sorted(int(r.qname[1:]) for r in got) == sorted(r.id for r in rows.where("chrom = 'c1' and start < 900 and stop > 500").collect()) and got
    assert len(regions.files_of(index, "c1", 500, 900)) < index.select("path").distinct().count()


def test_sequence_lengths_and_offsets(spark):
    seqs = {"b": "ACGT" * 40, "a": "AC", "c": ""}
    got = {r.name: (r.length, r.offset) for r in writers.fasta_index(spark.createDataFrame(list(seqs.items()), "name string, seq string"), 60).collect()}
    text, expected = "", {}
    for name in sorted(seqs):
        text += f">{name}\n"
        expected[name] = (len(seqs[name]), len(text))
        text += "".join(seqs[name][i : i + 60] + "\n" for i in range(0, len(seqs[name]), 60))
    assert got == expected


def test_batches_up_to_a_limit(spark):
    df = spark.range(3)
    assert ingest.up_to(df, 100, 99).count() == 3 and ingest.up_to(df, 100, 100).count() == 0


def test_ranks_of_snps(spark):
    from fragloom.operators import variants

    snps = spark.createDataFrame([(2, 5), (1, 9), (1, 3), (2, 1)], "sid long, soff long")
    ranked = variants.with_rank(snps)
    at = next(c for c in ranked.columns if c not in snps.columns)
    assert [r[at] - ranked.agg(F.min(at)).first()[0] for r in ranked.where("sid = 1").orderBy("soff").collect()] == [0, 1]


def test_bases_of_short_regions(spark):
    text = "".join("ACGT"[i * i % 7 % 4] for i in range(70_000))
    regions = [(1, 65_530, 65_545), (1, 0, 3), (1, 10, 40_000), (1, 69_998, 70_003), (1, 70_010, 70_012), (2, 0, 5), (3, 0, 5)]
    rows, names = spark.createDataFrame(regions, "chr long, start long, stop long"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "chr long, name string")
    seqs = spark.createDataFrame([(1, text), (2, "")], "chr long, seq string")
    got = sorted(r.value for r in writers.bed_lines(rows, names, seqs).collect())
    shown = lambda c, a, b: "\t".join(["ab"[c - 1], str(a), str(b), *([text[a:b] if c == 1 else ""] if b - a < 500 else [])])
    assert got == sorted(shown(*x) for x in regions if x[0] < 3)


def test_formats_are_told_by_each_parts_first_line(spark, tmp_path, monkeypatch):
    """Files of several splits and parts, comments longer than a split, and files without a line that counts."""
    (tmp_path / "a.txt").write_text("! none\n" * 3000 + "\n  \n@r\nAC\n+\nII\n" + ">x\n" * 2000)
    (tmp_path / "b.txt").write_text("; only\n\n")
    (tmp_path / "c.txt").write_text("ACGT\n>x\n")
    (tmp_path / "d.txt").write_text("  >x\nACGT\n" * 2000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    try:
        found = readers.sniff_files(spark, str(tmp_path))
        got = {r.path.rsplit("/", 1)[1]: r.format for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"a.txt": "fastq", "b.txt": "empty", "c.txt": "unknown", "d.txt": "fasta"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1  # lines are read once


def test_formats_query_writes_in_parallel(spark, tmp_path, monkeypatch):
    from fragloom.plans import catalog, file_queries

    spark.createDataFrame([(i, "some words of a text " * 3) for i in range(40)], "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    parts, stored = [], file_queries._stored
    monkeypatch.setattr(file_queries, "_stored", lambda lines, *a, **b: (parts.append(lines.rdd.getNumPartitions()), stored(lines, *a, **b))[1])
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        got = {r.format: r.files for r in catalog.QUERIES["sniffed_formats"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {"fasta": 1, "fastq": 1, "unknown": 1} and min(parts) > 1


def test_records_meet_their_names_without_a_shuffle(spark, tmp_path):
    """References are looked up by a broadcast list a header; letters of either case, other letters, odd lengths and all kinds of tags."""
    names = [("chr0", 1000), ("chr1", 2000)]
    seqs = ("ACGTN", "acgtnrz", "A" * 500, "*")
    lines = ["\t".join([f"q{i}", "0", f"chr{i % 2}", str(i + 1), "9", f"{len(s)}M" if s != "*" else "*", "=" if i % 3 else "chr0", "5", "0", s, "*" if i % 2 else "I" * len(s) if s != "*" else "*", f"ab:i:{-i}", "cd:f:1.5", "ef:Z:x:y"]) for i, s in enumerate(seqs * 3)]
    writers.write_bam(spark.createDataFrame([(x,) for x in lines], "value string").repartition(3), str(tmp_path / "b"), names)
    read = readers.read_bam(spark, str(tmp_path / "b"))
    got = {r.qname: r for r in read.collect()}
    for i, s in enumerate(seqs * 3):
        r = got[f"q{i}"]
        letters = "".join(c if c in "ACGTNR" else "N" for c in s.upper()) if s != "*" else "*"
        assert (r.rname, r.rnext, r.seq, r.qual) == (f"chr{i % 2}", "=" if i % 3 or i % 2 == 0 else "chr0", letters, "*" if i % 2 or s == "*" else "I" * len(s))
        assert r.tags == {"ab": str(-i), "cd": "1.5", "ef": "x:y"}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_tagged_lists_may_be_compressed(spark, tmp_path):
    from fragloom.plans import catalog, tagging

    spark.range(30).selectExpr("id div 3 l_orderkey", "id l_partkey", "id l_suppkey", "cast(id % 3 as int) l_linenumber", "cast(id + 1 as double) l_quantity", "1.0D l_extendedprice", "0.01D l_discount", "0.0D l_tax", "'A' l_returnflag", "'O' l_linestatus", "timestamp'2020-01-01' l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    paths, write = [], tagging.write_tagged
    tagging.write_tagged = lambda *a, **b: (paths.append(a[3]), write(*a, **b))[1]
    try:
        rows = catalog.QUERIES["tagged_files"](spark, str(tmp_path)).collect()
    finally:
        tagging.write_tagged = write
    files = spark._jvm.java.io.File(paths[0].removeprefix("file:") + "/" + tagging.IMPUTED).list()
    assert [f for f in files if f.startswith("part")] and all(f.endswith(".txt.gz") for f in files if f.startswith("part"))
    assert len(rows) == 30 and all(r.imputed == r.record == 1 and r.tagged == 0 for r in rows)
