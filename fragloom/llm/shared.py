"""Reading tables and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the cluster's spark.checkpoint.dir. Where that is unset, a temporary one on a single machine
    (tests); on a cluster that is an error, since its executors share no such folder."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(context, "_fragloom_dir", None)
        if not path:
            path = tempfile.mkdtemp(prefix="fragloom-")
            context._fragloom_dir = path
            atexit.register(shutil.rmtree, path, True)
    return f"{path.rstrip('/')}/fragloom-{context.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fragloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    _delete(df.sparkSession, df._fragloom_path)


def clean_up(spark: SparkSession) -> None:
    """Deletes all tables that this application has written. Results that haven't been read or stored by then are lost."""
    _delete(spark, shared_dir(spark))


def parts(df: DataFrame) -> int:
    """Partitions of df: of a table its splits, which grow with its bytes, and nothing runs for this (exchanges in df would)."""
    return max(1, df.rdd.getNumPartitions())


#: Bytes of the Arrow batches that go to Python and back.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches by bytes: Spark's default counts 10,000 rows, which of long texts is too much for an executor's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(BATCH_BYTES))


def docs_of(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty); other columns, whatever their names, are left behind."""
    bounded_batches(df.sparkSession)
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, longer by underscores until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Ids with several texts that are broadcast; beyond them, rows are shuffled to meet them.
BROADCAST = 1_000_000


def numbered(docs: DataFrame, name: str = "doc") -> DataFrame:
    """docs and a column that tells documents apart: the id of a row, but for rows whose id is null or has several texts: of
    those, all but the text of the least hash get a number beyond 2 ** 62 by id and text. Equal rows have one number. A null
    text counts as empty."""
    at, hash_ = free_name(docs, "id_of"), F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(at)).agg(F.min(hash_).alias(at + "l"), F.max(hash_).alias(at + "h"))
    several = written(several.where(F.col(at + "l") != F.col(at + "h")).select(at, at + "l"), "several")
    own = F.shiftrightunsigned(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), 2) + F.lit(1 << 62)
    n = several.count()
    if not n:
        return docs.withColumn(name, F.coalesce("doc_id", own))
    joined = docs.join(F.broadcast(several) if n <= BROADCAST else several, F.col("doc_id") == F.col(at), "left")
    id_ = F.when(F.col(at).isNull() | (hash_ == F.col(at + "l")), F.col("doc_id"))
    return joined.withColumn(name, F.coalesce(id_, own)).drop(at, at + "l")


def blocks(rows: DataFrame, by: str, size: int) -> DataFrame:
    """rows with own, lo and hi: the n rows of a group are dealt to blocks of about `size` by a hash of a column, and each row
    goes to every pair (lo, hi) of blocks that has its own. So any two rows of a group meet."""
    many = F.ceil(F.col("n") / size).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64(by), many).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), many - 1)))
    return dealt.withColumn("lo", F.least("own", "with")).withColumn("hi", F.greatest("own", "with")).drop("with")


def blocks_apart(rows: DataFrame, key: str, by: str, part: str, size: int) -> DataFrame:
    """rows with own, lo and hi, as `blocks` has them, for keys whose rows are joined to parts already: the rows outside a key's largest
    part meet one another and those of the largest, which need not meet among themselves.

    Of n rows, r of them outside, about r * n / size more are made, and not n * n / size.
    """
    least = free_name(rows, "largest")
    parts = rows.groupBy(F.col(key).alias(f"{least}k"), F.col(part).alias(f"{least}p")).agg(F.count("*").alias("n_part"))
    largest = parts.groupBy(f"{least}k").agg(F.max(F.struct("n_part", f"{least}p")).alias(least), F.sum("n_part").alias(f"{least}n"))
    joined = rows.join(largest, F.col(key) == F.col(f"{least}k"))
    inside, rest = F.col(f"{least}.n_part"), F.col(f"{least}n") - F.col(f"{least}.n_part")
    inner, outer = (F.greatest(F.lit(1), F.ceil(n / size)).cast("int") for n in (inside, rest))
    main, hashed = F.col(part) == F.col(f"{least}.{least}p"), F.xxhash64(by)
    own = F.when(main, -1 - F.pmod(hashed, inner)).otherwise(F.pmod(hashed, outer)).cast("int")
    others = F.sequence(F.lit(0), outer - 1)
    with_ = F.when(main, others).otherwise(F.concat(others, F.sequence(-inner, F.lit(-1))))
    dealt = joined.where(rest > 0).withColumn("own", own).withColumn("with", F.explode(with_))
    return dealt.withColumn("lo", F.least("own", "with")).withColumn("hi", F.greatest("own", "with")).drop("with", least, f"{least}k", f"{least}n")
