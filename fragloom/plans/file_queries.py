"""Queries over files: the driver's tables are written in each format, into the scratch folder, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import align
from ..operators import variants
from ..sources import readers, writers
from ..sources.scratch import folder, written
from . import adapters as A
from . import catalog
from .catalog import query

NAMED = "named as (select sid, 'doc' || sid \"name\", seq from genome)"


def _path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stored(lines: DataFrame, name: str, **options: str) -> str:
    path = _path(lines.sparkSession, name)
    lines.select("value").write.options(**options).text(path)
    return path


def _sequences(spark, d) -> DataFrame:
    return A.genome(spark, d).select(F.concat(F.lit("doc"), F.col("sid").cast("string")).alias("name"), "seq")


def _fastq(spark, d) -> str:
    return _stored(writers.fastq_lines(_sequences(spark, d).withColumn("qual", F.expr("repeat('@', length(seq))"))), "fastq")


@query(A.GENOME, NAMED, sql="select \"name\", cast(length(seq) as integer) seq_size, md5(seq) seq from named")
def fasta_scan(spark, d):
    """Compressed FASTA with lines of 70 bases, comments and blank lines."""
    lines = _sequences(spark, d).select(F.concat(F.lit(">"), "name", F.lit(" of a table\n"), F.regexp_replace("seq", "(.{70})", "$1\n"), F.lit("\n; a comment\n")).alias("value"))
    return readers.read_fasta(spark, _stored(lines, "fasta", compression="gzip")).select("name", "seq_size", F.md5("seq").alias("seq"))


@query(A.GENOME, NAMED, sql="select \"name\", md5(seq) seq, cast(length(seq) as integer) qual from named")
def fastq_scan(spark, d):
    """Records whose qualities begin with the mark of a header."""
    return readers.read_fastq(spark, _fastq(spark, d)).select("name", F.md5("seq").alias("seq"), F.length("qual").alias("qual"))


@query(A.GENOME, sql="select 2 files, 2 * count(*) reads, cast(2 * sum(length(seq)) as bigint) bases from genome")
def fastq_concat(spark, d):
    reads = readers.read_fastq(spark, _fastq(spark, d))
    return writers.concat_fastq([reads, reads])[1]


@query(A.GENOME, NAMED, sql="select \"name\", cast(row_number() over (order by \"name\") - 1 as bigint) seq_id from named")
def sequence_ids(spark, d):
    return readers.with_ids(_sequences(spark, d)).select("name", "seq_id")


@query(A.GENOME, NAMED, sql="select \"name\", cast(floor((sum(length(seq)) over (order by \"name\" rows unbounded preceding) - length(seq)) / 20000) as bigint) batch from named")
def batched_scan(spark, d):
    return readers.batches_of(_sequences(spark, d).select("name", F.length("seq").alias("seq_size")), 20_000).select("name", "batch")


@query(A.GENOME, sql="select 'fasta' format, count(distinct 1) files from genome union all select 'fastq', count(distinct 1) from genome union all select 'unknown', count(distinct 1) from genome")
def sniffed_formats(spark, d):
    """All sequences as three compressed files (Spark's, of as many parts as tasks write); each part is looked at, and a file counts once a format."""
    seqs = written(_sequences(spark, d).where(F.length("seq") > 0), "sequences")
    kinds = (F.concat(F.lit("\n! none\n>"), "name", F.lit("\n"), "seq"), F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "seq"), F.col("seq"))
    paths = [_stored(seqs.select(k.alias("value")), "kind", compression="gzip") for k in kinds]
    return readers.sniff_files(spark, paths).groupBy("format").agg(F.countDistinct(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).alias("files"))


@query(A.GENOME, NAMED, sql="select \"name\", cast(length(seq) as integer) length, cast(coalesce(sum(length(\"name\") + 2 + length(seq) + cast(ceil(length(seq) / 60) as bigint)) over (order by \"name\" rows between unbounded preceding and 1 preceding), 0) + length(\"name\") + 2 as bigint) \"offset\" from named")
def sequence_index(spark, d):
    return writers.fasta_index(_sequences(spark, d), 60).withColumn("offset", F.col("offset").cast("long"))


@query(A.GENOME, NAMED, sql="select \"name\", seq from named where sid in (3, 17, 40)")
def fasta_subset(spark, d):
    return writers.fasta_subset(_sequences(spark, d), ["doc3", "doc17", "doc40", "doc-none"])


@query(A.INTERVALS, sql="select chr, \"start\", stop from intervals")
def bed_scan(spark, d):
    rows = A.intervals(spark, d)
    names = rows.select("chr").distinct().select("chr", F.format_string("chr%d", "chr").alias("name"))
    return readers.read_bed(spark, _stored(writers.bed_lines(rows, names), "bed"), names)


_RECORD = """printf('read%d', read_id) qname, cast(case mapq % 2 when 1 then 16 else 0 end as integer) flag, printf('chr%d', subject_id) rname, subject_offset + 1 pos, cast(mapq as integer) mapq, frag_size || 'M' cigar,
 read_id, cast(frag_id * 1000 as bigint) qs, round("identity", 4) pi"""


def _record(rows: DataFrame, tag) -> DataFrame:
    return rows.select("qname", "flag", "rname", "pos", "mapq", "cigar", tag("qi").cast("long").alias("read_id"), tag("qs").cast("long").alias("qs"), F.round(tag("pi").cast("double"), 4).alias("pi"))


@query(A.FRAGS, sql=f"select {_RECORD} from frags")
def sam_scan(spark, d):
    """Whole-read records with a header, as SAM."""
    path = _path(spark, "sam")
    writers.write_lines(writers.sam_lines(catalog._named(spark, d)), path, writers.sam_header([(f"chr{i}", 100_050_000) for i in range(5)]))
    return _record(readers.read_sam(spark, [path, f"{path}-header"], {"qi": "long", "qs": "long", "pi": "double"}), F.col)


@query(A.FRAGS, sql=f"select {_RECORD} from frags")
def bam_scan(spark, d):
    """The same as BAM, read split by split."""
    path = _path(spark, "bam")
    writers.write_alignments(catalog._named(spark, d), path, "bam", [(f"chr{i}", 100_050_000) for i in range(5)])
    return _record(readers.read_bam(spark, path), lambda n: F.col("tags")[n])


@query(A.FRAGS, sql="select read_id, frag_id, subject_id, subject_offset, frag_size, mapq, round(\"identity\", 2) \"identity\", hp from frags")
def fraghap_of_bam(spark, d):
    """Fragment haplotypes of tagged records."""
    path = _path(spark, "bam")
    rows = catalog._named(spark, d).withColumn("frag_seq", F.expr("repeat('A', cast(length as int))"))
    rows = rows.withColumn("HP", F.nullif("hp", F.lit(0)))  # in place of hp
    writers.write_bam(writers.sam_lines(rows, fragments=True), path, [(f"chr{i}", 100_050_000) for i in range(5)])
    records = readers.read_bam(spark, path).select("qname", "seq", "mapq", F.col("tags")["pi"].alias("pi"), F.col("tags")["HP"].cast("long").alias("HP"))
    return readers.fraghap_of_records(records).withColumn("identity", F.round("identity", 2))


@query(A.FRAGS, sql="select read_id, frag_id, subject_id, subject_offset, frag_size, mapq, round(\"identity\", 3) \"identity\", hp from frags")
def fraghap_scan(spark, d):
    path = _path(spark, "fraghap")
    writers.write_lines(writers.fraghap_lines(A.frags(spark, d)), path, writers.FRAGHAP_HEADER)
    return readers.read_fraghap(spark, [path, f"{path}-header"]).withColumn("identity", F.round("identity", 3))


@query(
    A.FRAGS,
    sql="""select cast(1 as integer) n_blocks, printf('read%d', read_id) read_name, read_id, frag_id, subject_id, subject_offset, printf('%d %s', subject_offset + 3, substring('0110', 1, cast(mapq % 4 + 1 as integer))) blocks,
 'F' || mapq quals, subject_offset + 3 first_var, subject_offset + 3 + mapq % 4 last_var from frags""",
)
def hapcut_scan(spark, d):
    """Variant fragments of one block, under the fragments' names."""
    named = catalog._named(spark, d)
    name, alleles = writers.frag_name(), F.substring(F.lit("0110"), F.lit(1), (F.col("mapq") % 4 + 1).cast("int"))
    lines = named.select(F.concat_ws(" ", F.lit("1"), name, (F.col("soff") + 3).cast("string"), alleles, F.concat(F.lit("F"), F.col("mapq").cast("string"))).alias("value"))
    return readers.read_hapcut(spark, _stored(lines, "hapcut")).drop("name")


@query(A.FRAGS, sql="select printf('read%d', read_id) qname, frag_id * 1000 qstart, frag_id * 1000 + frag_size qend, printf('chr%d', subject_id) tname, subject_offset tstart, mapq from frags where subject_id = 2")
def paf_scan(spark, d):
    path = _path(spark, "paf")
    writers.write_alignments(catalog._named(spark, d), path, "paf")
    return readers.read_paf(spark, path, "\tchr2\t").select("qname", "qstart", "qend", "tname", "tstart", "mapq")


_VCF = "'chr' || (p_partkey % 5) chrom, p_partkey * 10 + 1 pos, substring('ACGT', p_size % 4 + 1, 1) \"ref\", case when p_partkey % 11 = 0 then 'AC' else substring('ACGT', (p_size + 1) % 4 + 1, 1) end alt"


def _vcf_file(spark, d) -> str:
    columns = ("chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), "filter", F.lit("."), "format", "sample")
    rows = catalog.vcf(spark, d).select(F.concat_ws("\t", *columns).alias("value"))
    header = spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS",)], "value string")
    return _stored(header.unionByName(rows), "vcf", compression="gzip")


@query(sql=catalog.ORACLE_SQL["phased_het_filter"])
def vcf_scan(spark, d):
    """Phased heterozygous SNPs of a compressed VCF file."""
    return variants.phased_het(readers.read_vcf(spark, _vcf_file(spark, d)))


@query(sql=f"select {_VCF} from part where p_partkey % 11 <> 0")
def vcf_split(spark, d):
    """SNPs that passed, in a folder for each chromosome; chr7, which has none, gets an empty one."""
    path = _path(spark, "split")
    writers.split_vcf(readers.read_vcf(spark, _vcf_file(spark, d)), path, True, True, [f"chr{i}" for i in (0, 1, 2, 3, 4, 7)])
    if spark.read.parquet(f"{path}/chrom=chr7").count():
        raise AssertionError("an absent chromosome has rows")
    return spark.read.parquet(path).select("chrom", "pos", "ref", "alt")


@query(A.FRAGS, sql="select read_id, frag_id, subject_id from frags where subject_id in (0, 2)")
def chromosome_files(spark, d):
    """Fragments split by chromosome, of which two, and one that isn't there, are merged again."""
    path = _path(spark, "split")
    writers.split_by(A.frags(spark, d).select("read_id", "frag_id", "subject_id"), "subject_id", path)
    return writers.merge_split(spark, path, "subject_id", [2, 9, 0]).select("read_id", "frag_id", F.col("subject_id").cast("long").alias("subject_id"))


@query(sql="select doc_id, cast(len(list_filter(string_split(text, ' '), lambda x: x <> '')) as integer) parts, list_filter(string_split(text, ' '), lambda x: x <> '')[1] \"first\" from documents where text is not null")
def token_split(spark, d):
    parts = readers.tokens(F.col("text"))
    return A.table(spark, d, "documents").where("text is not null").select("doc_id", F.size(parts).alias("parts"), F.get(parts, F.lit(0)).alias("first"))


@query(A.FRAGS, sql="select read_id, subject_offset, cast(row_number() over (partition by read_id order by frag_id * 7919 % 1000, frag_size, subject_id, subject_offset) - 1 as integer) frag_id from frags")
def fragment_numbers(spark, d):
    rows = A.frags(spark, d).select("read_id", "subject_id", "subject_offset", F.col("subject_offset").alias("soff"), (F.col("frag_id") * 7919 % 1000).alias("fwd_qoff"), F.col("frag_size").alias("fwd_qend"))
    return writers.number_fragments(rows).select("read_id", "subject_offset", "frag_id")


@query(A.FRAGS, sql="select read_id, frag_id, (mapq + frag_size + 3 = frag_size + mapq + hp + 2) fits from frags")
def cigar_checks(spark, d):
    value = F.format_string("%dS%dM2D3I4N", "mapq", "frag_size")
    return A.frags(spark, d).select("read_id", "frag_id", writers.cigar_fits(value, F.col("frag_size") + F.col("mapq") + F.col("hp") + 2).alias("fits"))


@query(A.FRAGS, sql="select read_id, frag_id, concat_ws(':', case mapq % 2 when 0 then '+' else '-' end, frag_id * 1000, frag_id * 1000 + frag_size, printf('chr%d', subject_id), subject_offset, subject_offset + frag_size, \"identity\") sa from frags")
def sa_tags(spark, d):
    return catalog._named(spark, d).withColumn("pi", F.col("pi").cast("double")).select("read_id", "frag_id", writers.sa_tag("qdir", "fwd_qoff", "fwd_qend", "sname", "soff", "send", "pi").alias("sa"))


@query(A.SNPS, sql="select sid, soff, cast(row_number() over (partition by sid order by soff) as integer) \"rank\" from snps")
def snp_ranks(spark, d):
    return variants.with_rank(A.snps(spark, d)).select("sid", "soff", "rank")


@query(
    A.READS, "p as (select a.qid, a.seq x, rpad(b.seq, cast(length(a.seq) as integer), '-') y from reads a join reads b on b.qid = a.qid + 1 where length(a.seq) > 0)",
    sql="select qid, round(100.0 * len(list_filter(range(1, length(x) + 1), lambda i: substring(x, i, 1) = substring(y, i, 1))) / length(x), 6) \"identity\" from p",
)
def gapped_identity(spark, d):
    """Equal columns of gapped rows: a read and the next one, filled up with gaps or cut to its length."""
    a = A.reads(spark, d).select("qid", F.col("seq").alias("x"))
    b = a.select((F.col("qid") - 1).alias("qid"), F.col("x").alias("y"))
    rows = a.where(F.length("x") > 0).join(b, "qid").withColumn("y", F.expr("rpad(y, length(x), '-')"))
    return rows.select("qid", F.round(align.identity_column(F.col("x"), F.col("y")), 6).alias("identity"))
