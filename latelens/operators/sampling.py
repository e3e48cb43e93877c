"""Deterministic samplers: recent window and hash-priority reservoir."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latelens.functions.hashing import priority
from latelens.sources.scratch import stored


def recent(records: DataFrame, now: int, window: int) -> DataFrame:
    return records.where(F.col("available_at").between(now - window, now))


def reservoir(records: DataFrame, now: int, window: int, capacity: int, seed: int) -> DataFrame:
    """The capacity older records of least priority: a distributed top-k, no window over all rows."""
    old = records.where(F.col("available_at") < now - window)
    return old.withColumn("priority", priority(seed, F.col("record_id"))).orderBy("priority", "record_id").limit(capacity)


def pools(records: DataFrame, now: int, window: int, capacity: int, seed: int, excluded: DataFrame | None = None) -> DataFrame:
    """Both pools by name; excluded clicks never enter."""
    r = records if excluded is None else records.join(excluded, "click_id", "left_anti")
    r = r.where(F.col("available_at") <= now)
    a = recent(r, now, window).withColumn("pool", F.lit("recent"))
    return a.unionByName(reservoir(r, now, window, capacity, seed).drop("priority").withColumn("pool", F.lit("reservoir")))


def draw_number(seed: int, draw: Column) -> Column:
    """60 bits of a hash of seed and draw."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), draw.cast("string"))), 1, 15), 16, 10).cast("long")


def batch(pooled: DataFrame, size: int, seed: int) -> DataFrame:
    """size draws with replacement, half from each pool, or all from the one that isn't empty.

    Draw i of a pool of n takes the record at draw_number(seed, i) mod n in record order; the ranks come
    from counts per range, so that no task sees the whole pool."""
    pools_ = pooled.where(F.col("pool").isNotNull())
    counts = {r["pool"]: r["n"] for r in pools_.groupBy("pool").agg(F.count("*").alias("n")).collect()}
    if not counts:
        raise ValueError("INSUFFICIENT_LEGAL_POOL")
    spark, out = pooled.sparkSession, None
    share = {p: size for p in counts} if len(counts) == 1 else {"recent": size // 2, "reservoir": size - size // 2}
    for name, k in share.items():
        at = ranked(pools_.where(F.col("pool") == name), ["record_id"])
        draws = spark.range(k).select(F.col("id").alias("draw"), (draw_number(seed, F.col("id")) % counts[name]).alias("rank"))
        part = draws.join(at, "rank").drop("rank")
        out = part if out is None else out.unionByName(part)
    return out


#: Rows of a range that one task ranks, about.
RANGE_ROWS = 2_000_000


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """df with the dense rank (from 0) of each row in order, which should tell all rows apart.

    Rows are dealt to ranges and written; the table that is counted is then the one that is ranked. Counts of
    ranges, one row each, are all that is gathered."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    d = stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    start, begin = 0, []
    for r in sorted(d.groupBy("__part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["__part"]):
        begin.append((r["__part"], start))
        start += r["n"]
    b = df.sparkSession.createDataFrame(begin, "__part int, __start long")
    own = Window.partitionBy("__part").orderBy(*order)
    # one row for each range: as many as RANGE_ROWS makes of all rows
    return d.join(b, "__part").withColumn("rank", F.row_number().over(own) - 1 + F.col("__start")).drop("__part", "__start")
