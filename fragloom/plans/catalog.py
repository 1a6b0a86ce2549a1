"""Queries over the driver's tables, one for each operator, and the SQL that checks them in DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import align, waves
from ..operators import enzymes, haplotypes, intervals, kmers, masking, pairs, select, sets, stats, variants
from ..operators.pieces import bases
from ..sources import readers, regions, writers
from ..sources.scratch import folder, written
from . import adapters as A
from . import mapping, tagging

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

K, STRIDE = 15, 4
DPNII = enzymes.parse(enzymes.CATALOGUE["DpnII"])


def query(*ctes: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, and its SQL after the common table expressions."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"with recursive {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def _hp(frags: DataFrame) -> DataFrame:
    return frags.select("read_id", "frag_id", "hp")


def _other(spark, d):
    """A second tagging: fragments of open orders have no tag."""
    return A.frags(spark, d).withColumn("hp", F.when(F.col("status") == "O", 0).otherwise(F.col("hp")).cast("long"))


OTHER = "other as (select read_id, frag_id, case when status = 'O' then 0 else hp end hp from frags)"

# ---- fragments: views, filters, selections -------------------------------------------------------------------------


@query(A.FRAGS, sql="select read_id, frag_id, subject_id, subject_offset, frag_size, mapq, \"identity\", hp from frags")
def frag_view(spark, d):
    return A.frags(spark, d).drop("status")


@query(A.FRAGS, sql="select read_id, frag_id from frags where frag_size >= 100 and mapq >= 5 and \"identity\" >= 90")
def quality_filter(spark, d):
    return select.quality(A.frags(spark, d)).select("read_id", "frag_id")


@query(A.FRAGS, sql="select read_id, frag_id from (select *, sum(frag_size) over (order by read_id, frag_id rows unbounded preceding) run from frags) where run - frag_size < 2000000")
def take_budget(spark, d):
    return select.take_budget(A.frags(spark, d), ["read_id", "frag_id"], "frag_size", 2_000_000).select("read_id", "frag_id")


@query()
def coverage_capped_select(spark, d):
    rows = A.frags(spark, d).select(
        "subject_id", "read_id", "frag_id", (F.col("read_id") * 64 + F.col("frag_id")).alias("ord"), F.floor(F.col("subject_offset") / 500).alias("start"), (F.floor(F.col("subject_offset") / 500) + F.col("frag_size")).alias("stop")
    )
    lengths = rows.select("subject_id").distinct().withColumn("length", F.lit(202_000).cast("long"))
    return select.coverage_capped(rows, lengths, 3)


@query(A.FRAGS, sql="select read_id, frag_id from frags where (read_id * 7919 + 104729) % 1000 < 250")
def hash_sample(spark, d):
    return select.hash_sample(A.frags(spark, d), "read_id", 0.25).select("read_id", "frag_id")


@query(A.GENOME, sql="select sid \"name\", cast(length(seq) as bigint) length from genome")
def chrom_sizes(spark, d):
    return select.chromosome_sizes(A.genome(spark, d))


@query(A.FRAGS, sql="select subject_id, count(*) n, cast(sum(frag_size) as bigint) bases from frags group by subject_id")
def chrom_split_counts(spark, d):
    return A.frags(spark, d).groupBy("subject_id").agg(F.count("*").alias("n"), F.sum("frag_size").alias("bases"))


@query(A.FRAGS, sql="select read_id, frag_id from frags where subject_id in (1, 3)")
def chrom_filter(spark, d):
    return select.on_chromosomes(A.frags(spark, d), "subject_id", [1, 3]).select("read_id", "frag_id")


@query(A.FRAGS, sql="select read_id, frag_id, cast(row_number() over (partition by subject_id order by subject_offset, read_id, frag_id) as bigint) place from frags")
def coord_sort_rank(spark, d):
    w = Window.partitionBy("subject_id").orderBy("subject_offset", "read_id", "frag_id")
    return A.frags(spark, d).select("read_id", "frag_id", F.row_number().over(w).cast("long").alias("place"))


@query(A.FRAGS, sql="select read_id, frag_id from (select *, row_number() over (partition by read_id order by frag_size desc, subject_id, subject_offset, frag_id, hp) k from frags) where k <= 3")
def topk_hits(spark, d):
    hits = A.frags(spark, d).select("read_id", "frag_id", F.col("frag_size").alias("score"), F.col("subject_id").alias("sid"), F.col("subject_offset").alias("sbeg"), F.col("frag_id").alias("qbeg"), F.col("hp").alias("strand"))
    return enzymes.top_hits(hits, "read_id").select("read_id", "frag_id")


@query(A.FRAGS, sql="select read_id, frag_id, subject_offset from frags where subject_id = 2 and subject_offset < 30000000 and subject_offset + frag_size > 20000000")
def region_read(spark, d):
    """Fragments of a region, by a position index over files in order of place."""
    path = f"{folder(spark)}/placed-{uuid.uuid4().hex}"
    writers.sorted_by_place(A.frags(spark, d).select("read_id", "frag_id", "subject_id", "subject_offset", "frag_size"), "subject_id", "subject_offset", files=2 * spark.sparkContext.defaultParallelism).write.parquet(path)
    stop = F.col("subject_offset") + F.col("frag_size")
    index = regions.index_of(spark.read.parquet(path), F.col("_metadata.file_path"), "subject_id", "subject_offset", stop)
    return regions.read_region(spark, index, regions.read_parquet, "2", "subject_id", "subject_offset", stop, 20_000_000, 30_000_000).select("read_id", "frag_id", "subject_offset")


# ---- statistics ----------------------------------------------------------------------------------------------------

PAIRS = "pairs as (select a.hp h, b.hp h2, abs(a.subject_offset - b.subject_offset) d from frags a join frags b on a.read_id = b.read_id and a.subject_id = b.subject_id and a.frag_id < b.frag_id)"


@query(
    A.FRAGS, PAIRS, "far as (select cast(unnest([5000000, 50000000, 2147483647]) as bigint) max_distance)",
    sql="""select max_distance, count(*) contacts, count(*) filter (h > 0 and h2 > 0) phased, count(*) filter (h = 1 and h2 = 1) h1, count(*) filter (h = 2 and h2 = 2) h2,
 count(*) filter (h > 0 and h2 > 0 and h <> h2) trans from far join pairs on d <= max_distance group by max_distance""",
)
def contact_stats(spark, d):
    return stats.contact_stats(A.frags(spark, d))


@query(
    A.FRAGS, "r as (select read_id, count(*) n, count(*) filter (hp > 0) p, count(*) filter (hp = 1) a, count(*) filter (hp = 2) b from frags group by read_id)",
    "s as (select count(*) reads, count(*) filter (p > 0) phased_reads, cast(sum(n) as bigint) frags, cast(sum(p) as bigint) phased, cast(sum(a) as bigint) h1, cast(sum(b) as bigint) h2 from r)",
    sql="select *, round(100.0 * phased_reads / reads, 6) phased_reads_pct, round(100.0 * phased / frags, 6) phased_pct, round(100.0 * h1 / frags, 6) h1_pct, round(100.0 * h2 / frags, 6) h2_pct from s",
)
def frag_stats(spark, d):
    return stats.frag_stats(A.frags(spark, d))


@query(
    A.FRAGS, OTHER, "s as (select count(*) total, count(*) filter (o.hp > 0) tagged, count(*) filter (o.hp = f.hp) accurate from frags f join other o using (read_id, frag_id) where f.hp > 0)",
    sql="select *, round(accurate / tagged, 6) accuracy, round(accurate / total, 6) recall from s",
)
def tag_eval_frags(spark, d):
    return stats.eval_frags(A.frags(spark, d), _other(spark, d))


@query(
    A.FRAGS, OTHER, "t as (select f.read_id, f.frag_id, f.hp, o.hp o from frags f join other o using (read_id, frag_id) where f.hp > 0)",
    "s as (select count(*) total, count(*) filter (a.o > 0 and b.o > 0) tagged, count(*) filter (a.o > 0 and b.o > 0 and a.o = a.hp and b.o = b.hp) accurate from t a join t b on a.read_id = b.read_id and a.frag_id < b.frag_id)",
    sql="select *, round(accurate / tagged, 6) accuracy, round(accurate / total, 6) recall from s",
)
def tag_eval_contacts(spark, d):
    return stats.eval_contacts(A.frags(spark, d), _other(spark, d))


@query(
    A.FRAGS, "r as (select read_id, count(*) n from frags group by read_id)", "x as (select frag_size, row_number() over (order by frag_size) - 1 i, count(*) over () c from frags)", "y as (select n, row_number() over (order by n) - 1 i, count(*) over () c from r)",
    sql="""select cast(sum(n) as bigint) frags, count(*) reads, cast(sum(n * (n - 1) // 2) as bigint) contacts, (select frag_size from x where i = c // 2) size_median, (select round(avg(frag_size), 6) from x) size_mean,
 (select n from y where i = c // 2) reads_median, (select round(avg(n), 6) from y) reads_mean from r""",
)
def frag_length_median(spark, d):
    return stats.read_frag_stats(A.frags(spark, d))


@query(A.FRAGS, sql="select count(*) frags, cast(sum(frag_size) // count(*) as bigint) avg_size, cast(sum(mapq) // count(*) as bigint) avg_mapq, round(avg(\"identity\"), 6) avg_identity from frags")
def record_summary(spark, d):
    return stats.summary(A.frags(spark, d))


@query(A.FRAGS, sql="select count(distinct read_id) reads, 2 * count(*) frags, cast(2 * count(*) filter (hp > 0) as bigint) phased from frags")
def stats_over_files(spark, d):
    one = A.frags(spark, d)
    return stats.over_files([one, one])[0].select("reads", "frags", "phased")


@query(
    A.FRAGS, "c as (select read_id, frag_id * 100 a, frag_id * 100 + frag_size b, \"identity\" pi from frags)",
    "w as (select *, max(b) over (partition by read_id order by a, b rows between unbounded preceding and 1 preceding) seen from c)",
    sql="select read_id, round(avg(pi), 6) avg_pi, cast(sum(greatest(0, b - greatest(a, coalesce(seen, 0)))) as bigint) covered from w group by read_id",
)
def chain_summary(spark, d):
    rows = A.frags(spark, d).select("read_id", (F.col("frag_id") * 100).alias("fwd_qoff"), (F.col("frag_id") * 100 + F.col("frag_size")).alias("fwd_qend"), F.col("identity").alias("pi"))
    return stats.chain_summary(rows, "read_id")


# ---- haplotypes, variants, pairs -----------------------------------------------------------------------------------

READ_COUNTS = "n as (select *, count(*) over r n, count(*) filter (hp = 0) over r n0, count(*) filter (hp = 1) over r n1, count(*) filter (hp = 2) over r n2 from frags window r as (partition by read_id))"


@query(
    A.FRAGS, READ_COUNTS,
    sql="""select read_id, frag_id, cast(case when n0 > 0 and n1 + n2 > 0 and mapq >= 1 and (n2 = 0 or n1 / (n1 + n2) > 0.8) then 1 when n0 > 0 and n1 + n2 > 0 and mapq >= 1 and (n1 = 0 or n2 / (n1 + n2) > 0.8) then 2 else hp end as bigint) hp from n""",
)
def consensus_impute(spark, d):
    return _hp(haplotypes.consensus(A.frags(spark, d)))


@query(
    A.FRAGS, READ_COUNTS,
    sql="select read_id, frag_id, cast(case when hp > 0 then hp when n1 > 0 and (n2 = 0 or n1 / n >= 0.8) then 1 when n2 > 0 and (n1 = 0 or n2 / n >= 0.8) then 2 else 0 end as bigint) hp from n",
)
def vote_impute(spark, d):
    return _hp(haplotypes.impute_by_vote(A.frags(spark, d)))


@query(
    A.FRAGS, "x as (select *, mapq % 3 amb, hp = 0 and mapq >= 5 l from frags)",
    "y as (select *, count(*) filter (hp = 1) over r h1, count(*) filter (hp = 2) over r h2, count(*) filter (l and amb = 1) over r a1, count(*) filter (l and amb = 2) over r a2 from x window r as (partition by read_id))",
    sql="""select read_id, frag_id, cast(case when not l or amb = 0 then hp when h1 > 0 and h2 = 0 then case when amb = 1 then 1 else hp end when h2 > 0 and h1 = 0 then case when amb = 2 then 2 else hp end
 when (a1 > 0) <> (a2 > 0) then amb else hp end as bigint) hp from y""",
)
def amb_promotion(spark, d):
    return _hp(haplotypes.promote(A.frags(spark, d).withColumn("amb_hp", F.col("mapq") % 3)))


@query(
    A.FRAGS, "g as (select *, count(*) filter (hp = 1) over w > 0 and count(*) filter (hp = 2) over w > 0 mixed from frags window w as (partition by read_id, subject_id))",
    """near as (select f.read_id, f.subject_id, f.frag_id f, f.hp, g.frag_id from g f join g using (read_id, subject_id)
 where f.hp > 0 and f.mixed and abs(f.subject_offset - g.subject_offset) <= case when abs(f.frag_id - g.frag_id) = 1 then 29500000 else 16500000 end)""",
    """claims as (select read_id, subject_id, frag_id, hp from near union select g.read_id, g.subject_id, g.frag_id, a.hp from near a join near b using (read_id, subject_id, f) join g on g.read_id = a.read_id and g.subject_id = a.subject_id
 and g.frag_id = a.frag_id + 1 and b.frag_id = a.frag_id + 2)""",
    "sides as (select read_id, subject_id, frag_id, bool_or(hp = 1) one, bool_or(hp = 2) two from claims group by all)",
    """new as (select read_id, subject_id, frag_id, case when not mixed then hp when coalesce(one, false) and (not coalesce(two, false) or hp = 1) then 1 when coalesce(two, false) and (not coalesce(one, false) or hp = 2) then 2 else 0 end hp
 from g left join sides using (read_id, subject_id, frag_id))""",
    "n as (select *, count(*) over r n, count(*) filter (hp = 1) over r n1, count(*) filter (hp = 2) over r n2 from new window r as (partition by read_id, subject_id))",
    sql="select read_id, frag_id, cast(case when hp > 0 then hp when n1 > 0 and (n2 = 0 or n1 / n >= 0.8) then 1 when n2 > 0 and (n1 = 0 or n2 / n >= 0.8) then 2 else 0 end as bigint) hp from n",
)
def distance_impute(spark, d):
    return _hp(haplotypes.impute_by_distance(A.frags(spark, d)))


@query(A.SNPS, sql="select sid, soff, phase_set from snps where (sid, phase_set) in (select (sid, phase_set) from (select sid, phase_set, row_number() over (partition by sid order by count(*) desc, phase_set) k from snps group by sid, phase_set) where k = 1)")
def mvp_phase_set(spark, d):
    return variants.most_variants(A.snps(spark, d)).select("sid", "soff", "phase_set")


@query(A.SNPS, "f as (select sid, phase_set, min(soff) p from snps group by sid, phase_set)", sql="select sid, phase_set, cast(row_number() over (partition by sid order by p, phase_set) - 1 as bigint) ps from f")
def phase_set_ids(spark, d):
    return variants.phase_set_ids(A.snps(spark, d)).withColumn("ps", F.col("ps").cast("long"))


def vcf(spark, d):
    """VCF records of the parts: some unphased, homozygous, long, or without a phase set."""
    size, key = F.col("p_size"), F.col("p_partkey")
    base = lambda n: F.substring(F.lit("ACGT"), (n % 4 + 1).cast("int"), F.lit(1))
    gt = F.element_at(F.array(*map(F.lit, ("0|1", "1|0", "0/1", "1|1", "0|1"))), (size % 5 + 1).cast("int"))
    return A.table(spark, d, "part").select(
        F.concat(F.lit("chr"), (key % 5).cast("string")).alias("chrom"), (key * 10 + 1).alias("pos"), base(size).alias("ref"),
        F.when(key % 11 == 0, "AC").otherwise(base(size + 1)).alias("alt"), F.lit("PASS").alias("filter"), F.when(key % 7 == 0, "GT").otherwise("GT:PS").alias("format"),
        F.when(key % 7 == 0, gt).otherwise(F.concat(gt, F.lit(":"), F.col("p_brand"))).alias("sample"),
    )


@query(sql="""select 'chr' || (p_partkey % 5) chrom, p_partkey * 10 pos0, substring('ACGT', p_size % 4 + 1, 1) "ref", substring('ACGT', (p_size + 1) % 4 + 1, 1) alt, p_brand phase_set,
 cast(case when p_size % 5 = 1 then 1 else 0 end as bigint) gt0, cast(case when p_size % 5 = 1 then 0 else 1 end as bigint) gt1 from part where p_partkey % 11 <> 0 and p_partkey % 7 <> 0 and p_size % 5 in (0, 1, 4)""")
def phased_het_filter(spark, d):
    return variants.phased_het(vcf(spark, d))


OVERLAP = "o as (select read_id, frag_id, mapq, \"identity\", s.sid, s.soff, s.gt0, s.gt1, frag_size from frags f join snps s on s.sid = f.subject_id and s.soff >= f.subject_offset and s.soff < f.subject_offset + f.frag_size)"


@query(A.FRAGS, A.SNPS, OVERLAP, sql="select read_id, frag_id, sid, soff from o")
def snp_frag_overlap(spark, d):
    return haplotypes.overlapping(A.frags(spark, d), A.snps(spark, d)).select("read_id", "frag_id", "sid", "soff")


@query(
    A.FRAGS, A.SNPS, OVERLAP, "v as (select read_id, frag_id, case (soff + frag_size) % 3 when 1 then gt0 + 1 when 2 then gt1 + 1 else 0 end v from o)",
    "c as (select read_id, frag_id, count(*) filter (v = 1) v1, count(*) filter (v = 2) v2 from v group by read_id, frag_id)",
    sql="""select f.read_id, f.frag_id, cast(case when f.mapq < 5 or f."identity" < 85 then 0 when coalesce(v1, 0) > coalesce(v2, 0) then 1 when coalesce(v2, 0) > coalesce(v1, 0) then 2 else 0 end as bigint) hp,
 cast(case when f.mapq < 5 then 0 when coalesce(v1, 0) > coalesce(v2, 0) then 1 when coalesce(v2, 0) > coalesce(v1, 0) then 2 else 0 end as bigint) amb_hp from frags f left join c using (read_id, frag_id)""",
)
def snp_vote(spark, d):
    allele = (F.col("soff") + F.col("frag_size")) % 3
    v = F.when(allele == 1, F.col("gt0") + 1).when(allele == 2, F.col("gt1") + 1).otherwise(0)
    votes = haplotypes.overlapping(A.frags(spark, d), A.snps(spark, d)).select("read_id", "frag_id", v.alias("strict"), v.alias("loose"))
    return haplotypes.vote(A.frags(spark, d), votes).select("read_id", "frag_id", "hp", "amb_hp")


@query(A.FRAGS, sql="select f.read_id, f.frag_id, nullif(f.hp, 0) \"HP\" from frags f")
def tag_records(spark, d):
    rows = A.frags(spark, d)
    return haplotypes.tag_records(rows.select("read_id", "frag_id", F.lit(9).alias("HP")), rows).select("read_id", "frag_id", "HP")


ALLELE = "case {} when 0 then 'both-ref' when 1 then 'ref' else 'alt' end"


@query(
    A.FRAGS, sql=f"""select a.read_id, a.subject_offset offset1, {ALLELE.format('a.hp')} allele1, b.subject_offset offset2, {ALLELE.format('b.hp')} allele2
 from frags a join frags b on a.read_id = b.read_id and a.frag_id = 0 and b.frag_id > 0 where a.mapq >= 10 and b.mapq >= 10""",
)
def ashic_pairs(spark, d):
    return pairs.ashic(A.frags(spark, d), 10)


@query(
    A.FRAGS, "v as (select *, printf('r%d_%03d', read_id, frag_id) nm, printf('%d 01', subject_offset // 50000) b, 'F' q, count(*) over (partition by read_id, subject_id) n from frags)",
    sql="""select read_id, subject_id, '1 ' || nm || ' 1 -1 -1 ' || b || ' ' || q line from v where n = 1 union all
 select x.read_id, x.subject_id, case when x.subject_offset < y.subject_offset then '2 ' || x.nm || '-' || right(y.nm, 3) || ' 1 ' || split_part(y.b, ' ', 1) || ' ' || (y.subject_offset - x.subject_offset) || ' ' || x.b || ' ' || y.b || ' FF'
 else '2 ' || x.nm || '-' || right(y.nm, 3) || ' 1 ' || split_part(x.b, ' ', 1) || ' ' || (x.subject_offset - y.subject_offset) || ' ' || y.b || ' ' || x.b || ' FF' end
 from v x join v y on x.read_id = y.read_id and x.subject_id = y.subject_id and x.frag_id < y.frag_id""",
)
def hic_pairs(spark, d):
    rows = A.frags(spark, d).select(
        "read_id", "subject_id", "subject_offset", "frag_id", F.lit(1).alias("n_blocks"), F.format_string("r%d_%03d", "read_id", "frag_id").alias("name"),
        F.format_string("%d 01", F.floor(F.col("subject_offset") / 50000)).alias("blocks"), F.lit("F").alias("quals"),
    )
    return pairs.hic(rows)


@query(
    A.FRAGS, "a as (select read_id, frag_id from frags where hp = 1)", "b as (select read_id, frag_id from frags where mapq >= 25)",
    sql="select 'union' op, count(*) n from (select * from a union all select * from b) union all select 'intersection', count(*) from (select * from a intersect all select * from b) union all select 'difference', count(*) from (select * from a except all select * from b)",
)
def set_ops(spark, d):
    rows = A.frags(spark, d)
    a, b = rows.where("hp = 1").select("read_id", "frag_id"), rows.where("mapq >= 25").select("read_id", "frag_id")
    keys = ["read_id", "frag_id"]
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(sets.union(a, b), "union").unionByName(count(sets.intersection(a, b, keys), "intersection")).unionByName(count(sets.difference(a, b, keys), "difference"))


# ---- intervals -----------------------------------------------------------------------------------------------------

MERGED = """m0 as (select *, max(stop) over (partition by chr order by "start", stop rows between unbounded preceding and 1 preceding) seen from intervals),
 m1 as (select *, sum(case when seen is null or "start" > seen + {gap} then 1 else 0 end) over (partition by chr order by "start", stop rows unbounded preceding) island from m0),
 merged as (select chr, min("start") "start", max(stop) stop from m1 group by chr, island)"""
CHROMOSOMES = "chromosomes as (select c_custkey chr, cast(1900000000 as bigint) length from customer)"


def chromosomes(spark, d):
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("chr"), F.lit(1_900_000_000).cast("long").alias("length"))


@query(A.INTERVALS, MERGED.format(gap=0), sql='select chr, "start", stop from merged')
def interval_merge(spark, d):
    return intervals.merge(A.intervals(spark, d))


@query(A.INTERVALS, MERGED.format(gap=10), sql='select chr, "start", stop from merged')
def interval_merge_gap(spark, d):
    return intervals.merge(A.intervals(spark, d), 10)


@query(
    A.INTERVALS, MERGED.format(gap=0), CHROMOSOMES,
    sql="""select chr, "start", stop from (select chr, coalesce(lag(stop) over (partition by chr order by "start"), 0) "start", "start" stop from merged where chr in (select chr from chromosomes) union all
 select chr, max(stop), 1900000000 from merged where chr in (select chr from chromosomes) group by chr union all select chr, 0, length from chromosomes where chr not in (select chr from merged)) where "start" < stop""",
)
def interval_complement(spark, d):
    return intervals.complement(intervals.merge(A.intervals(spark, d)), chromosomes(spark, d))


@query(A.INTERVALS, sql='select chr, count(*) n, cast(sum(stop - "start") as bigint) bases, min(stop - "start") shortest, max(stop - "start") longest, arg_max("start", (stop - "start") * 10000000000 - "start") longest_start from intervals group by chr')
def interval_stats(spark, d):
    return intervals.stats(A.intervals(spark, d))


@query(
    A.INTERVALS, 'e as (select chr, "start" p, 1 by_ from intervals union all select chr, stop, -1 from intervals)', "s as (select chr, p, sum(by_) by_ from e group by chr, p having sum(by_) <> 0)",
    "r as (select chr, p \"start\", lead(p) over (partition by chr order by p) stop, sum(by_) over (partition by chr order by p rows unbounded preceding) depth from s)",
    sql='select chr, "start", stop, cast(depth as bigint) depth from r where depth > 0',
)
def coverage_depth(spark, d):
    return intervals.depth(A.intervals(spark, d))


HITS = 'hits as (select read_id, frag_id * 30 qbeg, frag_id * 30 + frag_size qend, subject_id * 40 sbeg, subject_id * 40 + frag_size send, mapq score from frags)'


@query(
    A.FRAGS, HITS, "ranked as (select *, row_number() over (partition by read_id order by score desc, qbeg, sbeg, qend, send) k from hits)",
    """taking as (select read_id, cast(0 as bigint) k, false taken, cast([] as struct(a bigint, b bigint, c bigint, d bigint)[]) held from (select distinct read_id from hits) union all
 select r.read_id, r.k, x.free, case when x.free then list_append(held, {'a': cast(qbeg as bigint), 'b': cast(qend as bigint), 'c': cast(sbeg as bigint), 'd': cast(send as bigint)}) else held end from taking t join ranked r on r.read_id = t.read_id and r.k = t.k + 1,
 lateral (select len(list_filter(held, lambda h: h.a <= qbeg + 10 and h.b >= qend - 10 and h.c <= sbeg + 10 and h.d >= send - 10)) = 0 free) x)""",
    sql="select r.* exclude (k) from ranked r join taking t using (read_id, k) where taken",
)
def not_contained(spark, d):
    hits = A.frags(spark, d).select(
        "read_id", (F.col("frag_id") * 30).alias("qbeg"), (F.col("frag_id") * 30 + F.col("frag_size")).alias("qend"), (F.col("subject_id") * 40).alias("sbeg"), (F.col("subject_id") * 40 + F.col("frag_size")).alias("send"), F.col("mapq").alias("score")
    )
    return intervals.not_contained(hits, ["read_id"])


# ---- enzymes -------------------------------------------------------------------------------------------------------

SITES = "sites as (select sid, cast(i as bigint) locus, length(seq) n from (select sid, seq, unnest(range(1, length(seq) - 4)) i from genome) where substring(seq, i + 1, 4) = 'GATC')"
LOCI = "loci as (select sid, locus from sites union all select sid, 0 from genome union all select sid, length(seq) from genome union all select sid, length(seq) + 1 from genome)"


@query(A.GENOME, SITES, sql="select sid, count(*) n, cast(sum(locus) as bigint) places from sites group by sid")
def enzyme_sites(spark, d):
    return enzymes.loci(A.genome(spark, d), DPNII, "sid", ends=False).groupBy("sid").agg(F.count("*").alias("n"), F.sum("locus").alias("places"))


@query(A.GENOME, SITES, LOCI, sql="select sid, cast(locus as bigint) locus from loci")
def enzyme_loci(spark, d):
    return enzymes.loci(A.genome(spark, d), DPNII, "sid")


@query(
    A.GENOME, SITES, LOCI, "x as (select sid, locus a, lead(locus) over (partition by sid order by locus) b from loci)",
    sql='select x.sid, cast(a as bigint) "start", cast(b as bigint) stop from x join genome g on g.sid = x.sid where b <= length(seq)',
)
def fragment_digest(spark, d):
    return enzymes.digest(A.genome(spark, d), DPNII, "sid")


@query(
    A.READS, "b as (select qid, 0 strand, seq from reads union all select qid, 1, translate(reverse(seq), 'ACGT', 'TGCA') from reads)",
    "s as (select qid, strand, cast(i as bigint) locus from (select qid, strand, seq, unnest(range(1, length(seq) - 4)) i from b) where substring(seq, i + 1, 4) = 'GATC')",
    sql="select qid, cast(strand as bigint) strand, locus from s union all select qid, strand, unnest([0, length(seq), length(seq) + 1]) from b",
)
def read_loci(spark, d):
    return enzymes.read_loci(A.reads(spark, d), DPNII).select("qid", F.col("strand").cast("long").alias("strand"), "locus")


PLACES = "places as (select sid, cast(length(seq) // 2 as bigint) p from genome)"


def _places(spark, d):
    return A.genome(spark, d).select("sid", F.floor(F.length("seq") / 2).alias("p"))


@query(A.GENOME, SITES, LOCI, PLACES, sql="select sid, p, (select max(locus) from loci l where l.sid = x.sid and l.locus <= x.p) locus from places x")
def nearest_site(spark, d):
    return intervals.nearest_before(_places(spark, d), enzymes.loci(A.genome(spark, d), DPNII, "sid"), "sid", "p", "locus")


@query(A.GENOME, SITES, LOCI, PLACES, sql="select x.sid, x.p, cast(l.locus as bigint) locus from places x join loci l on l.sid = x.sid and abs(l.locus - x.p) <= 30")
def nearby_sites(spark, d):
    return enzymes.nearby(_places(spark, d), enzymes.loci(A.genome(spark, d), DPNII, "sid"), "sid", "p")


MOTIFS = "motifs as (" + " union all ".join(f"select '{n}' enzyme, '{s.replace('^', '')}' motif" for n, s in enzymes.CATALOGUE.items()) + ")"
COUNTED = "counted as (select enzyme, cast(sum(len(string_split(seq, motif)) - 1) as bigint) n from reads cross join motifs group by enzyme)"


def _counted(spark, d):
    rows = A.reads(spark, d)
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("enzyme"), F.lit(s.replace("^", "")).alias("motif")) for n, s in enzymes.CATALOGUE.items())))
    rows = rows.withColumn("e", kinds)
    return rows.groupBy(F.col("e.enzyme").alias("enzyme")).agg(F.sum((F.length("seq") - F.length(F.replace("seq", F.col("e.motif"), F.lit("")))) / F.length("e.motif")).cast("long").alias("n"))


@query(A.READS, MOTIFS, COUNTED, sql="select enzyme, n from counted")
def enzyme_counts(spark, d):
    return _counted(spark, d)


@query(
    A.READS, MOTIFS, COUNTED, "k as (select *, row_number() over (order by n desc, enzyme) k from counted)",
    sql="select case when max(case when k = 1 then n end) > 2 * max(case when k = 2 then n end) then max(case when k = 1 then enzyme end) end enzyme, max(case when k = 1 then n end) best, max(case when k = 2 then n end) \"second\" from k",
)
def enzyme_infer(spark, d):
    return enzymes.winner(_counted(spark, d))


@query(
    A.FRAGS, "e as (select read_id, frag_id, mapq % 2 qdir, frag_id * 100 qoff, frag_id * 100 + frag_size qend, subject_offset soff, subject_offset + frag_size send, hp from frags)",
    "x as (select *, hp > 0 lq, hp = 1 ls, hp = 2 rq, hp <> 1 rs from e)",
    sql="""select read_id, frag_id, case when qdir = 0 then lq and ls else rq and rs end lp, case when qdir = 0 then rq and rs else lq and ls end rp, lq and ls and rq and rs is_perfect, (lq or ls) and (rq or rs) is_pseudo_perfect,
 cast(case when qdir = 0 then qoff else 100000 - qend - case when rq then 4 else 0 end end as bigint) chain_qoff, cast(case when qdir = 0 then qend else 100000 - qoff - case when lq then 4 else 0 end end as bigint) chain_qend from x""",
)
def chain_flags(spark, d):
    rows = A.frags(spark, d).select(
        "read_id", "frag_id", (F.col("mapq") % 2).alias("qdir"), (F.col("frag_id") * 100).alias("qoff"), (F.col("frag_id") * 100 + F.col("frag_size")).alias("qend"),
        F.col("subject_offset").alias("soff"), (F.col("subject_offset") + F.col("frag_size")).alias("send"), F.lit(100_000).cast("long").alias("qsize"), "hp",
    )
    off = lambda c, hit: F.when(hit, F.col(c)).otherwise(F.col(c) + 1)
    hp = F.col("hp")
    rows = rows.withColumns({"enzyme_qoff": off("qoff", hp > 0), "enzyme_soff": off("soff", hp == 1), "enzyme_qend": off("qend", hp == 2), "enzyme_send": off("send", hp != 1)})
    return enzymes.chain_flags(rows, 4).select("read_id", "frag_id", "lp", "rp", "is_perfect", "is_pseudo_perfect", "chain_qoff", "chain_qend")


@query(
    A.FRAGS, READ_COUNTS, OTHER,
    "c as (select read_id, frag_id, cast(case when n0 > 0 and n1 + n2 > 0 and mapq >= 1 and (n2 = 0 or n1 / (n1 + n2) > 0.8) then 1 when n0 > 0 and n1 + n2 > 0 and mapq >= 1 and (n1 = 0 or n2 / (n1 + n2) > 0.8) then 2 else hp end as bigint) hp from n)",
    sql="select read_id, frag_id, o.hp tagged, c.hp imputed, case when c.hp > 0 then c.hp end \"record\" from c join other o using (read_id, frag_id)",
)
def tagged_files(spark, d):
    """Both lists and the tagged records, written and read again."""
    path = f"{folder(spark)}/tagged-{uuid.uuid4().hex}"
    tagging.write_tagged(_other(spark, d), haplotypes.consensus(A.frags(spark, d)), _named(spark, d), path, [(f"chr{i}", 100_050_000) for i in range(5)], compression="gzip")
    tagged, imputed, records = tagging.read_tagged(spark, path)
    hp = lambda rows, name: rows.select("read_id", "frag_id", F.col("hp").alias(name))
    return hp(tagged, "tagged").join(hp(imputed, "imputed"), ["read_id", "frag_id"]).join(hp(records, "record"), ["read_id", "frag_id"])


# ---- k-mers --------------------------------------------------------------------------------------------------------

def _kmers_sql(name: str, source: str, key: str, k: int, stride: int) -> str:
    return f"{name} as (select {key}, cast(i as bigint) soff, substring(seq, i + 1, {k}) kmer from (select {key}, seq, unnest(range(0, length(seq) - {k} + 1, {stride})) i from {source}))"


REF = _kmers_sql("ref", "genome", "sid", K, STRIDE)
COUNTS = "counts as (select kmer, count(*) n from ref group by kmer)"
CUTOFF = "cut as (select greatest(coalesce((select n from (select n, row_number() over (order by n desc) - 1 i, count(*) over () c from counts) where i = cast(floor(c * {}) as bigint)), 0), {}) cutoff)"


def _ref(spark, d):
    return kmers.extract_hashed(A.genome(spark, d).repartition(4 * spark.sparkContext.defaultParallelism, "sid"), "sid", K, STRIDE)


def _counted_ref(ref: DataFrame) -> DataFrame:
    """Counts of k-mers, made once: the cutoff and the kept k-mers both read them."""
    return written(kmers.counts(ref, "hash"), "counts")


@query(A.GENOME, REF, COUNTS, sql="select n, count(*) kmers from counts group by n")
def kmer_index(spark, d):
    return kmers.counts(_ref(spark, d), "hash").groupBy("n").agg(F.count("*").alias("kmers"))


@query(A.GENOME, REF, COUNTS, CUTOFF.format("0.0001", 100), sql="select cast(cutoff as bigint) cutoff from cut")
def kmer_cutoff(spark, d):
    return kmers.cutoff(kmers.counts(_ref(spark, d), "hash"), 1e-4, 100)


@query(A.GENOME, REF, COUNTS, CUTOFF.format("0.1", 1), sql="select sid, count(*) n from ref where kmer in (select kmer from counts, cut where n <= cutoff) group by sid")
def kmer_filter(spark, d):
    ref = _ref(spark, d)
    counted = _counted_ref(ref)
    return kmers.frequent_removed(ref, counted, kmers.cutoff(counted, 0.1, 1), "hash").groupBy("sid").agg(F.count("*").alias("n"))


@query(A.GENOME, REF, COUNTS, CUTOFF.format("0.0001", 100), sql="select cast(sum(n) as bigint) total, count(*) distinct_kmers, cast(coalesce(sum(n) filter (n > cutoff), 0) as bigint) removed, count(*) filter (n > cutoff) removed_distinct from counts, cut")
def kmer_stats(spark, d):
    counted = kmers.counts(_ref(spark, d), "hash")
    return kmers.index_stats(counted, kmers.cutoff(counted, 1e-4, 100))


def _halves(spark, d):
    """The first and the second half of each sequence, as two kinds of regions."""
    seqs = A.genome(spark, d)
    n, half = F.length("seq").cast("long"), F.floor(F.length("seq") / 2)
    return seqs, seqs.select(F.col("sid").alias("chr"), F.lit(0).cast("long").alias("start"), half.alias("stop")), seqs.select(F.col("sid").alias("chr"), half.alias("start"), n.alias("stop"))


def _half_sql(name: str, lo: str, hi: str, frac: str, least: int) -> list[str]:
    rows = f"{name} as (select sid, cast(i as bigint) soff, substring(seq, cast(i as integer) + 1, 15) kmer from (select sid, seq, unnest(range({lo}, {hi} - 14, 4)) i from genome))"
    count = f"{name}c as (select kmer, count(*) n from {name} group by kmer)"
    cut = f"{name}k as (select greatest(coalesce((select n from (select n, row_number() over (order by n desc) - 1 i, count(*) over () c from {name}c) where i = cast(floor(c * {frac}) as bigint)), 0), {least}) cutoff)"
    return [rows, count, cut]


@query(
    A.GENOME, *_half_sql("x", "0", "length(seq) // 2", "0.1", 1), *_half_sql("y", "length(seq) // 2", "length(seq)", "0.0001", 100),
    sql="""select sid, cast(count(*) as bigint) n, cast(sum(soff) as bigint) places from (select sid, soff from x where kmer in (select kmer from xc, xk where n <= cutoff) union all
 select sid, soff from y where kmer in (select kmer from yc, yk where n <= cutoff)) group by sid""",
)
def index_build(spark, d):
    seqs, repeats, others = _halves(spark, d)
    postings = kmers.index(kmers.extract_intervals(seqs, repeats, K, STRIDE), kmers.extract_intervals(seqs, others, K, STRIDE), "hash")
    return postings.groupBy("sid").agg(F.count("*").alias("n"), F.sum("soff").alias("places"))


HASH = "+".join(f"(instr('ACGT', substring(kmer, {i + 1}, 1)) - 1) * {4 ** (K - 1 - i)}" for i in range(K))


@query(A.READS, _kmers_sql("r", "reads", "qid", K, STRIDE), sql=f"select qid, soff, cast({HASH} as bigint) hash from r")
def kmer_hashes(spark, d):
    return kmers.extract_hashed(A.reads(spark, d), "qid", K, STRIDE).select("qid", "soff", "hash")


RC = "translate(reverse(seq), 'ACGT', 'TGCA')"
BOTH = f"both_ as (select qid, 0 strand, seq from reads union all select qid, 1, {RC} from reads)"


@query(A.READS, BOTH, _kmers_sql("k8", "both_", "qid", 8, 1), sql="select kmer, count(*) n from k8 group by kmer")
def kmer_both_strands(spark, d):
    counted = kmers.counts(kmers.of_reads(A.reads(spark, d), 8), "hash")
    return counted.select(kmers.text_of(F.col("hash"), 8).alias("kmer"), "n")


MASK_COUNTS = "c8 as (select kmer, count(*) n from k8 group by kmer), p as (select n, row_number() over (order by n desc) - 1 i, count(*) over () c from c8)"
_AT = ", ".join(f"(select n from p where i = cast(floor(c * cast({1.0 - s!r} as double)) as bigint)) {n}" for n, s in kmers.THRESHOLDS)


@query(A.READS, BOTH, _kmers_sql("k8", "both_", "qid", 8, 1), MASK_COUNTS, sql=f"select {_AT}")
def mask_thresholds(spark, d):
    return kmers.score_thresholds(kmer_both_strands(spark, d))


QUERY_KMERS = _kmers_sql("q", "both_", "qid, strand", K, 1)


def _seeds(spark, d, most: int = 20):
    ref = _ref(spark, d)
    counted = _counted_ref(ref)
    postings = kmers.frequent_removed(ref, counted, kmers.cutoff(counted, 1e-4, 100), "hash")
    return kmers.seeds(kmers.of_reads(A.reads(spark, d), K), postings, "hash", most)


@query(
    A.GENOME, A.READS, REF, COUNTS, CUTOFF.format("0.0001", 100), BOTH, QUERY_KMERS,
    "hits as (select q.qid, strand, q.soff qoff, sid, ref.soff, count(*) over (partition by q.qid, sid, ref.soff) n from q join ref using (kmer) where kmer in (select kmer from counts, cut where n <= cutoff))",
    sql="select qid, cast(strand as bigint) strand, cast(qoff as bigint) qoff, sid, cast(soff as bigint) soff from hits where n <= 20",
)
def seed_match(spark, d):
    return _seeds(spark, d).select("qid", F.col("strand").cast("long").alias("strand"), F.col("qoff").cast("long").alias("qoff"), "sid", F.col("soff").cast("long").alias("soff"))


@query(
    A.GENOME, REF, COUNTS, CUTOFF.format("0.1", 1), "kept as (select sid chr, soff \"start\", soff + 15 stop from ref where kmer in (select kmer from counts, cut where n <= cutoff))",
    MERGED.format(gap=0).replace("from intervals", "from kept"), "len as (select sid chr, length(seq) length from genome)",
    """gaps as (select chr, "start" - coalesce(lag(stop) over (partition by chr order by "start"), 0) g from merged union all select m.chr, max(length) - max(stop) from merged m join len l using (chr) group by m.chr
 union all select chr, length from len where chr not in (select chr from merged))""",
    sql="""select l.chr sid, cast(coalesce((select sum(stop - "start") from merged m where m.chr = l.chr), 0) as bigint) covered, cast(greatest(0, coalesce((select max(g) from gaps where gaps.chr = l.chr), 0)) as bigint) longest_gap from len l""",
)
def kmer_coverage(spark, d):
    ref, seqs = _ref(spark, d), A.genome(spark, d)
    counted = _counted_ref(ref)
    kept = kmers.frequent_removed(ref, counted, kmers.cutoff(counted, 0.1, 1), "hash")
    return kmers.coverage(kept, seqs.select("sid", F.length("seq").alias("length")), K)


@query(A.READS, sql=f"select qid, {RC} seq from reads")
def reverse_complement(spark, d):
    return A.reads(spark, d).withColumn("seq", kmers.reverse_complement(F.col("seq")))


# ---- alignments and reads ------------------------------------------------------------------------------------------


@query(
    A.READS, "p as (select a.qid, a.seq x, b.seq y from reads a join reads b on b.qid = a.qid + 1)", "d as (select *, levenshtein(x, y) d, length(x) n, length(y) m from p)",
    sql="select qid, cast(d as bigint) distance, round(((n + m) / 2 - d) * 2 - 5 * d, 6) score, round(100 * (1 - 2 * d / (n + m)), 6) \"identity\" from d",
)
def align_identity(spark, d):
    a = A.reads(spark, d).select("qid", F.col("seq").alias("x"))
    b = a.select((F.col("qid") - 1).alias("qid"), F.col("x").alias("y"))
    c = align.edit_columns(F.col("x"), F.col("y"))
    return a.join(b, "qid").select("qid", c["distance"].cast("long").alias("distance"), *(F.round(c[n].cast("double"), 6).alias(n) for n in ("score", "identity")))


@query(
    A.FRAGS, "x as (select read_id, frag_id, \"identity\" pi, case hp when 0 then 'max-cov' when 1 then 'complete' else 'perfect' end kind, case hp when 0 then 0.999 when 1 then 0.99999 else 0.9999999 end p from frags)",
    "r as (select *, row_number() over (partition by read_id order by pi desc) i, max(pi) over (partition by read_id) best from x)", "s as (select read_id, max(case when i = 2 then pi end) nxt from r group by read_id)",
    """q as (select read_id, frag_id, ceil(round(-10 * log10(1 - p * coalesce(abs(1 - case when pi = best then nxt else best end / pi), 1)), 6)) q from r join s using (read_id))""",
    sql="select read_id, frag_id, cast(least(60, greatest(0, q)) as bigint) mapq from q",
)
def mapq(spark, d):
    kind = F.when(F.col("hp") == 0, "max-cov").when(F.col("hp") == 1, "complete").otherwise("perfect")
    rows = A.frags(spark, d).select("read_id", "frag_id", F.col("identity").alias("pi"), kind.alias("kind"))
    return mapping.mapping_quality(rows, ["read_id"], "pi", "kind").select("read_id", "frag_id", "mapq")


def _named(spark, d):
    """Fragments with the columns of the writers, made of the fragment view."""
    at = F.col("frag_id") * 1000
    return A.frags(spark, d).select(
        "read_id", "frag_id", "subject_id", F.format_string("read%d", "read_id").alias("read_name"), F.lit(100_000).alias("qsize"), at.alias("fwd_qoff"), (at + F.col("frag_size")).alias("fwd_qend"),
        (F.col("mapq") % 2).alias("qdir"), F.format_string("chr%d", "subject_id").alias("sname"), F.lit(100_050_000).alias("ssize"), F.col("subject_offset").alias("soff"), (F.col("subject_offset") + F.col("frag_size")).alias("send"),
        F.col("frag_size").alias("matches"), F.col("frag_size").alias("length"), "mapq", at.alias("enzyme_qoff"), (at + F.col("frag_size")).alias("enzyme_qend"), F.col("subject_offset").alias("enzyme_soff"),
        (F.col("subject_offset") + F.col("frag_size")).alias("enzyme_send"), F.format_string("%.4f", "identity").alias("pi"), F.lit(None).cast("string").alias("sa"),
        F.concat(F.col("frag_size").cast("string"), F.lit("M")).alias("frag_cigar"), F.lit("*").alias("frag_seq"), F.lit(None).cast("string").alias("frag_qual"),
        F.concat(F.col("frag_size").cast("string"), F.lit("M")).alias("cigar"), F.lit("*").alias("seq"), F.lit(None).cast("string").alias("qual"), "hp",
    )


_TAGS = "printf('qS:i:%d', frag_id * 1000), printf('qE:i:%d', frag_id * 1000 + frag_size), printf('vS:i:%d', subject_offset), printf('vE:i:%d', subject_offset + frag_size), printf('pi:f:%.4f', \"identity\"), printf('qi:i:%d', read_id)"


@query(
    A.FRAGS,
    sql=f"""select concat_ws(chr(9), printf('read%d', read_id), 100000, frag_id * 1000, frag_id * 1000 + frag_size, case mapq % 2 when 0 then '+' else '-' end, printf('chr%d', subject_id), 100050000, subject_offset, subject_offset + frag_size,
 frag_size, frag_size, mapq, {_TAGS}) "value" from frags""",
)
def paf_text(spark, d):
    return writers.paf_lines(_named(spark, d))


@query(
    A.FRAGS,
    sql="""select concat_ws(chr(9), printf('read%d_%010d:%03d:%010d:%010d', read_id, read_id, frag_id, subject_id, subject_offset), case mapq % 2 when 1 then 16 else 0 end, printf('chr%d', subject_id), subject_offset + 1, mapq, frag_size || 'M', '*', 0, 0, '*', '*',
 printf('qi:i:%d', read_id), printf('qd:i:%d', mapq % 2), printf('qs:i:%d', frag_id * 1000), printf('qe:i:%d', frag_id * 1000 + frag_size), printf('qS:i:%d', frag_id * 1000), printf('qE:i:%d', frag_id * 1000 + frag_size), 'ql:i:100000',
 printf('si:i:%d', subject_id), printf('ss:i:%d', subject_offset), printf('se:i:%d', subject_offset + frag_size), printf('vS:i:%d', subject_offset), printf('vE:i:%d', subject_offset + frag_size), 'sl:i:100050000', printf('pi:f:%.4f', "identity")) "value" from frags""",
)
def sam_text(spark, d):
    return writers.sam_lines(_named(spark, d), fragments=True)


@query(A.FRAGS, sql="select printf('read%d', read_id) read_name, read_id, frag_id, subject_id, subject_offset from frags")
def frag_name_roundtrip(spark, d):
    names = _named(spark, d).select(writers.frag_name().alias("name"))
    return names.select(*(c.alias(n) for n, c in readers.parse_name(F.col("name")).items()))


_MAY = "y.a - x.b >= -20 and y.b - x.b > 5 and y.a - x.a > 5"


@query(
    A.FRAGS, "c as (select read_id, frag_id, frag_id * 100 a, frag_id * 100 + frag_size b, \"identity\" pi from frags)",
    f"""paths as (select read_id, a, b, [frag_id] ids, b - a cov, pi total from c
 union all select x.read_id, y.a, y.b, list_append(x.ids, y.frag_id), x.cov + y.b - y.a - greatest(0, x.b - y.a), x.total + y.pi from paths x join c y on x.read_id = y.read_id and {_MAY})""",
    f"most as (select *, max(cov) over (partition by read_id) best from paths), ends as (select * from most x where cov = best and not exists (select 1 from c y where y.read_id = x.read_id and {_MAY}))",
    "ranked as (select *, row_number() over (partition by read_id order by total / len(ids) desc, ids) k, count(*) over (partition by read_id) n from ends)",
    sql="select read_id, array_to_string(ids, ',') ids, cast(cov as bigint) covered, cast(n as integer) chains, round(total / len(ids), 6) mean_pi from ranked where k = 1",
)
def equal_cover_chains(spark, d):
    rows = A.frags(spark, d).select("read_id", F.col("frag_id").alias("id"), (F.col("frag_id") * 100).alias("beg"), (F.col("frag_id") * 100 + F.col("frag_size")).alias("end"), F.col("identity").alias("pi"))
    return mapping.equal_cover(rows).select("read_id", F.array_join("ids", ",").alias("ids"), "covered", "chains", F.round("mean_pi", 6).alias("mean_pi"))


def _pair_sql(start: bool) -> str:
    q, s, far_q, far_s, inner = ("qoff", "soff", "qend", "send", "<") if start else ("qend", "send", "qoff", "soff", ">")
    return f"""select h.read_id, h.frag_id, q.locus q, s.locus s from hits h join rsites q on q.read_id = h.read_id and abs(q.locus - h.{q}) <= 30 and q.locus {inner} h.{far_q}
 join ssites s on s.sid = h.subject_id and abs(s.locus - h.{s}) <= 30 and s.locus {inner} h.{far_s}
 where abs(abs(h.{far_q} - q.locus) - abs(h.{far_s} - s.locus)) <= 50 and abs(1 - abs(h.{far_q} - q.locus) / abs(h.{far_s} - s.locus)) <= 0.2"""


@query(
    A.FRAGS, A.SNPS, "hits as (select read_id, frag_id, subject_id, frag_id * 1000 qoff, frag_id * 1000 + frag_size qend, subject_offset soff, subject_offset + frag_size send from frags)",
    "rsites as (select distinct read_id, unnest([frag_id * 1000 + mapq, frag_id * 1000 + frag_size + mapq - 25]) locus from frags)", "ssites as (select distinct sid, soff locus from snps)",
    sql=f"select 'start' \"end\", * from ({_pair_sql(True)}) union all select 'end', * from ({_pair_sql(False)})",
)
def site_pairs(spark, d):
    frags, at = A.frags(spark, d), F.col("frag_id") * 1000
    hits = frags.select(F.struct("read_id", "frag_id").alias("hit"), "read_id", F.col("subject_id").alias("sid"), at.alias("qoff"), (at + F.col("frag_size")).alias("qend"), F.col("subject_offset").alias("soff"), (F.col("subject_offset") + F.col("frag_size")).alias("send"))
    own = frags.select("read_id", F.explode(F.array(at + F.col("mapq"), at + F.col("frag_size") + F.col("mapq") - 25)).alias("locus")).distinct()
    other = A.snps(spark, d).select("sid", F.col("soff").alias("locus")).distinct()
    found = [enzymes.site_pairs(hits, own, other, "hit", "read_id", "sid", start).select(F.lit("start" if start else "end").alias("end"), "hit.read_id", "hit.frag_id", "q", "s") for start in (True, False)]
    return found[0].unionByName(found[1])


@query()
def candidate_chains(spark, d):
    return mapping.candidates(_seeds(spark, d), A.reads(spark, d), K)


@query()
def local_alignment(spark, d):
    """For each read, strand and sequence that share seeds, the best alignment through the first of them."""
    first = _seeds(spark, d).groupBy("qid", "strand", "sid").agg(F.min(F.struct("qoff", "soff")).alias("at")).select("qid", "strand", "sid", "at.qoff", "at.soff")
    strands = kmers.both_strands(A.reads(spark, d)).withColumnRenamed("seq", "q")
    reach = F.length("q") * 2
    places = first.join(strands, ["qid", "strand"]).select("qid", "strand", "sid", "qoff", "soff", F.greatest(F.lit(0), F.col("soff") - reach).alias("start"), (F.col("soff") + reach).alias("stop"))
    rows = bases(places, A.genome(spark, d), "start", "stop", "s").join(strands, ["qid", "strand"])
    rows = rows.select("qid", "strand", "sid", "start", "q", "s", F.col("qoff").alias("q0"), (F.col("soff") - F.col("start")).alias("s0"))
    found = waves.local_alignments(rows, "qid", "strand", "sid", "start")
    return found.select("qid", "strand", "sid", "qoff", "qend", (F.col("start") + F.col("soff")).alias("soff"), (F.col("start") + F.col("send")).alias("send"), "errors")


@query()
def chromosome_ranks(spark, d):
    return mapping.ranked_chromosomes(candidate_chains(spark, d))


@query()
def map_reads(spark, d):
    return mapping.map_reads(A.reads(spark, d), A.genome(spark, d), DPNII, K, STRIDE).drop("q_row", "s_row", "frag_seq")


BASES = "bases as (select k from (select unnest(range(1, 32)) k) where (select sum(length(seq)) from genome) / power(4, k) < 5 order by k limit 1)"
ALL_KMERS = """forward as (select sid, cast(i as bigint) soff, substring(seq, i + 1, k) kmer, k, length(seq) length from (select sid, seq, k, unnest(range(0, length(seq) - k + 1)) i from genome, bases)),
 c8 as (select kmer, count(*) n from (select kmer from forward union all select translate(reverse(kmer), 'ACGT', 'TGCA') from forward) group by kmer), p as (select n, row_number() over (order by n desc) - 1 i, count(*) over () c from c8)"""
MASKED = f"""t as (select {_AT}),
 scored as (select sid, soff, k, length, case when n >= t_high then t_high when n < t_low then t_low // 2 else n end score from forward join c8 using (kmer), t),
 means as (select sid, soff, case when soff < length - k - 4 then sum(score) over (partition by sid order by soff rows between current row and 4 following) // 5 end mean from scored),
 places as (select sid, k, unnest(range(0, length)) p from (select sid, length(seq) length, k from genome, bases where length(seq) > k + 4)),
 best as (select x.sid, x.p, coalesce(max(m.mean) over (partition by x.sid order by x.p rows between x.k + 3 preceding and current row), 0) best from places x left join means m on m.sid = x.sid and m.soff = x.p),
 hot as (select sid, p, best, best >= t_threshold hot, t_extend from best, t),
 runs as (select *, p - row_number() over (partition by sid, hot order by p) run from hot),
 low as (select *, min(best) over (partition by sid, hot, run) low from runs),
 kept as (select sid, p, p - row_number() over (partition by sid order by p) run from low where hot or low >= t_extend)"""


@query(A.GENOME, BASES, ALL_KMERS, MASKED, sql="select sid chr, cast(min(p) as bigint) start, cast(max(p) + 1 as bigint) stop from kept group by sid, run")
def repeat_mask(spark, d):
    return masking.repeat_regions(A.genome(spark, d))


@query()
def enzyme_by_alignment(spark, d):
    return enzymes.winner(mapping.infer_enzyme(A.reads(spark, d), A.genome(spark, d)))


@query()
def tag_reads(spark, d):
    """Fragments of mapped reads, tagged by SNPs (every 50th base of the genome, the other allele its complement) and imputed."""
    genome = A.genome(spark, d)
    at = genome.where(F.length("seq") > 25).select("sid", F.explode(F.sequence(F.lit(25), F.length("seq") - 1, F.lit(50))).alias("soff"), "seq")
    ref = F.substring("seq", F.col("soff") + 1, F.lit(1))
    even = (F.col("soff") / 50).cast("long") % 2
    snps = at.select("sid", F.col("soff").cast("long").alias("soff"), ref.alias("ref"), F.translate(ref, "ACGT", "TGCA").alias("alt"), even.alias("gt0"), (1 - even).alias("gt1"))
    fragments = mapping.map_reads(A.reads(spark, d), genome, DPNII, K, STRIDE)
    tagged, imputed = haplotypes.tag_fragments(fragments, snps)
    return haplotypes.tag_counts(tagged, imputed)


@query(A.FRAGS, sql="select count(distinct read_id) reads, count(*) frags, cast(coalesce(sum(frag_size), 0) as bigint) bases from frags")
def mapped_totals(spark, d):
    return stats.mapped_totals(A.frags(spark, d))


@query(
    A.FRAGS, "g as (select read_id, coalesce(list(distinct mapq % 4) filter (hp > 0), []) a, coalesce(list(distinct mapq % 4) filter (hp = 0), []) b from frags group by read_id)",
    sql="select read_id, len(list_filter(a, lambda x: not list_contains(b, x))) = 0 inside from g",
)
def subset_test(spark, d):
    kind = F.col("mapq") % 4
    tagged, others = F.collect_set(F.when(F.col("hp") > 0, kind)), F.collect_set(F.when(F.col("hp") == 0, kind))
    return A.frags(spark, d).groupBy("read_id").agg(tagged.alias("a"), others.alias("b")).select("read_id", sets.is_subset(F.col("a"), F.col("b")).alias("inside"))


from . import file_queries  # noqa: E402, F401  registers its queries
