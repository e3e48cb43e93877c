"""Helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; sets one in the warehouse, which is shared too, only where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", named)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


#: Lets Spark remove what was shuffled for an execution at its end, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _tidy_shuffles(spark: SparkSession):
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by an eager checkpoint in the shared folder; what was shuffled for it goes."""
    checkpoint_dir(df.sparkSession)
    with _tidy_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again; unlike a checkpoint it is planned by its true size."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    with _tidy_shuffles(spark):
        df.select("*").write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def discard(table: DataFrame) -> None:
    """Deletes the files of a table made by stored() that nothing will read any more."""
    sc = table.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(table._folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Groups that one task of a grouped exchange should see at most.
PER_TASK = 16


def dealt(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """df dealt by keys to as many partitions as its number of groups wants, where the session's number
    of shuffle partitions is too small for that; else as it is, and the grouping itself will deal it."""
    have = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    want = -(-groups // PER_TASK)
    return df.repartition(want, *keys) if want > have else df


#: Rows of one key that one task of a join takes; a key with more is salted. Heavy keys that are broadcast, at most.
HEAVY, FEW_HEAVY = 1_000, 10_000


def heavy_join(left: DataFrame, right: DataFrame, key: str, salt: str, counts: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has one row a key, by key; a heavy key's rows are dealt by a hash of salt.

    counts(key, k): how often left has a key, where it is known already. Only right's rows of heavy keys are
    repeated. The heavy keys themselves are few: they are looked up first, and where there are none the join
    is a plain one; only more than FEW_HEAVY of them are joined without being gathered."""
    counts = left.groupBy(key).agg(F.count("*").alias("k")) if counts is None else counts
    heavy = counts.where(F.col("k") > HEAVY).select(key, F.ceil(F.col("k") / HEAVY).cast("int").alias("__salts"))
    some = heavy.limit(FEW_HEAVY + 1).collect()
    if not some:
        return left.join(right, key)
    if len(some) <= FEW_HEAVY:
        heavy = F.broadcast(left.sparkSession.createDataFrame(some, heavy.schema))
    salts = F.coalesce("__salts", F.lit(1))
    a = left.join(heavy, key, "left").withColumn("__salt", F.pmod(F.xxhash64(salt), salts).cast("int")).drop("__salts")
    b = right.join(heavy, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return a.join(b, [key, "__salt"]).drop("__salt")


def tidied(result):
    """result, after the worker's allocators have given back what its task no longer uses: workers serve
    one operator after another, and would else keep the most that each of them ever needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    return result


def ascii_lower(c):
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_text(c: str = "doc_id"):
    """An integer id as text: pandas would turn a column with nulls into floats."""
    return F.col(c).cast("long").cast("string").alias(c)


def parsed(i) -> int | None:
    return None if i is None else int(i)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
