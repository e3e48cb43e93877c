"""Readers: raw click text, tar members, day ranges of partitioned stores, evaluation files."""

from __future__ import annotations

import io
import json
import tarfile
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The click log's fields in file order.
FIELDS = (
    "Sale", "SalesAmountInEuro", "time_delay_for_conversion", "click_timestamp", "nb_clicks_1week", "product_price",
    "product_age_group", "device_type", "audience_id", "product_gender", "product_brand", "product_category1",
    "product_category2", "product_category3", "product_category4", "product_category5", "product_category6",
    "product_category7", "product_country", "product_id", "product_title", "partner_id", "user_id",
)
RAW_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])


def with_row_index(df: DataFrame, name: str = "raw_row_index") -> DataFrame:
    """df with a dense index from 0 in partition order: offsets come from counts per partition."""
    d = df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    start, rows = 0, []
    for r in sorted(d.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("a")).collect(), key=lambda r: r["__p"]):
        rows.append((r["__p"], start - r["a"]))
        start += r["n"]
    offsets = df.sparkSession.createDataFrame(rows, "__p int, __o long")
    return d.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__i") + F.col("__o")).drop("__p", "__i", "__o")


def read_raw_text(spark: SparkSession, path: str, header: bool = False, sep: str = "\t") -> DataFrame:
    """(raw_row_index, line, n_fields, the fields): each line split, whatever its number of fields.

    A first line that equals the header is skipped where header is asked for."""
    lines = with_row_index(spark.read.text(path).withColumnRenamed("value", "line"))
    if header:
        expected = sep.join(FIELDS)
        first = lines.where("raw_row_index = 0").first()
        if first is None or first["line"] != expected:
            raise ValueError("header differs from the schema")
        lines = lines.where("raw_row_index > 0").withColumn("raw_row_index", F.col("raw_row_index") - 1)
    v = F.split("line", sep, -1)
    return lines.select("raw_row_index", "line", F.size(v).alias("n_fields"), *[F.get(v, F.lit(i)).alias(f) for i, f in enumerate(FIELDS)])


def read_accepted(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Strings throughout; nothing is inferred."""
    return spark.read.schema(RAW_SCHEMA).option("sep", sep).option("quote", '"').csv(path)


def check_tar(path: str, members: list[str] | None = None, max_members: int = 64, max_bytes: int = 32 << 30, max_ratio: float = 64.0) -> list[str]:
    """Names of the archive's files; raises for unsafe paths, links, devices, duplicates or excess."""
    names, total, packed = [], 0, 0
    with open(path, "rb") as f:
        packed = f.seek(0, io.SEEK_END)
    with tarfile.open(path) as tar:
        for m in tar:
            p = PurePosixPath(m.name)
            if p.is_absolute() or ".." in p.parts:
                raise ValueError(f"unsafe path {m.name}")
            if m.isdir():
                continue
            if not m.isreg():
                raise ValueError(f"not a plain file: {m.name}")
            if m.name in names:
                raise ValueError(f"duplicate member {m.name}")
            names.append(m.name)
            total += m.size
            if len(names) > max_members or total > max_bytes or total > max_ratio * max(packed, 1):
                raise ValueError("archive exceeds its limits")
    if members is not None and names != members:
        raise ValueError("members differ from the expected ones")
    return names


def tar_member(spark: SparkSession, path: str, member: str, to: str) -> DataFrame:
    """Copies a member of a local archive to a folder that Spark reads, and reads it as raw text."""
    check_tar(path)
    fs = spark._jvm.org.apache.hadoop.fs.Path(to).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(to), True)
    try:
        with tarfile.open(path) as tar, tar.extractfile(member) as f:
            while data := f.read(1 << 20):
                out.write(data)
    finally:
        out.close()
    return read_raw_text(spark, to)


def read_days(spark: SparkSession, path: str, first: int, last: int, column: str = "click_day") -> DataFrame:
    """A day range of a store that is partitioned by day: other days' files aren't opened."""
    return spark.read.parquet(path).where(F.col(column).between(first, last))


def read_truth(spark: SparkSession, root: str, first: int, last: int) -> DataFrame:
    """Both truth tables over a range of their own days, as one."""
    a = read_days(spark, f"{root}/reveal", first, last, "reveal_day").drop("reveal_day")
    b = read_days(spark, f"{root}/maturity", first, last, "maturity_day").drop("maturity_day")
    return a.unionByName(b)


EXAMPLES = "click_id string, click_day int, final_label int, probability double, cold_user boolean, cold_product boolean, prior_user_clicks long, prior_product_clicks long, product_price_bin int, device_type string, conversion_delay_days double"


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation files: method and seed beside their examples."""
    schema = f"method string, seed int, ranking_eligible boolean, sealed boolean, examples array<struct<{EXAMPLES.replace(' ', ':').replace(',:', ',')}>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("method", "seed", "ranking_eligible", "sealed", F.inline("examples"))


def read_object(path: str) -> dict:
    """A JSON file that must hold one object."""
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict):
        raise ValueError(f"{path}: not an object")
    return value


def read_selection(path: str) -> dict:
    """Selection results from JSON or, by any other suffix, YAML; candidates must have configurations of their own."""
    if path.lower().endswith(".json"):
        value = read_object(path)
    else:
        import yaml

        with open(path, encoding="utf-8") as f:
            value = yaml.safe_load(f)
    if not isinstance(value, dict) or not isinstance(value.get("candidates"), list):
        raise ValueError(f"{path}: no candidates")
    digests = [c.get("config_sha256") for c in value["candidates"]]
    if None in digests or len(set(digests)) < len(digests):
        raise ValueError(f"{path}: configuration digests must be there and differ")
    return value


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, i, value) of one-dimensional numpy arrays in .npy and .npz files, read where the files are.

    For compact evidence: a file is one task's work and must fit in its memory. Pickled objects are refused."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                got = np.load(io.BytesIO(data), allow_pickle=False)
                for name, x in got.items() if hasattr(got, "items") else [("", got)]:
                    if x.ndim != 1:
                        raise ValueError(f"{p}: {name} isn't one-dimensional")
                    yield pd.DataFrame({"path": p, "name": name, "i": np.arange(len(x)), "value": x.astype(np.float64)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, name string, i long, value double")


def count_rows(spark: SparkSession, path: str) -> int:
    """From the footers alone."""
    return spark.read.parquet(path).count()


# ---- fixtures ------------------------------------------------------------------------------------------

DAY = 86_400


def boundary_fixture(spark: SparkSession) -> DataFrame:
    """Six clicks at the edges of ticks and days, with their truth."""
    m = 30 * DAY
    rows = [("click-000", 0, 1.0, 1, 3600), ("click-001", 3599, -1.0, 0, 3599 + m), ("click-002", 3600, 0.5, 1, 3600), ("click-003", DAY + 1, 1.5, 1, DAY + 3600), ("click-004", 2 * DAY - 1, -1.5, 0, 2 * DAY - 1 + m), ("click-005", 2 * DAY + 1, -0.5, 0, 2 * DAY + 1 + m)]
    return spark.createDataFrame(rows, "click_id string, click_time long, feature double, final_label int, available_at long")


def study_a_fixture(spark: SparkSession, days: int = 34) -> DataFrame:
    """Four clicks a day: positives after six hours and two days, and two negatives."""
    d = spark.range(days).select(F.col("id").alias("day"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    t = F.col("day") * DAY + F.col("k")
    delay = F.when(F.col("k") == 0, 6 * 3600).when(F.col("k") == 1, 2 * DAY).otherwise(30 * DAY)
    label = (F.col("k") < 2).cast("int")
    return d.select(F.concat_ws("-", F.lit("a"), "day", "k").alias("click_id"), t.alias("click_time"), F.when(label == 1, 1.0).otherwise(-1.0).alias("feature"), label.alias("final_label"), (t + delay).alias("available_at"))


def monitoring_fixture(spark: SparkSession, days: int = 59, rows: int = 1000, shift_day: int = 3, seed: int = 20260813) -> DataFrame:
    """rows member clicks per day 1..days; labels alternate, and are all 1 on the shift day."""
    from pyspark.sql import Window

    from latelens.functions.hashing import is_member

    ids = spark.range(rows * 14).select(F.col("id").alias("candidate"), F.explode(F.sequence(F.lit(1), F.lit(days))).alias("click_day"))
    d = ids.withColumn("click_id", F.concat_ws("-", F.lit("monitor"), "click_day", "candidate")).where(is_member(F.col("click_id"), seed))
    n = F.row_number().over(Window.partitionBy("click_day").orderBy("candidate"))
    d = d.withColumn("i", n).where(F.col("i") <= rows)
    return d.select("click_id", "click_day", F.when(F.col("click_day") == shift_day, 1).otherwise(F.col("i") % 2).cast("int").alias("final_label"))


def training_fixture(spark: SparkSession, days: int = 60, rows: int = 16, seed: int = 20260813) -> DataFrame:
    """rows mature records a day of clicks outside the monitoring sample; targets alternate, and the feature tells them."""
    from pyspark.sql import Window

    from latelens.functions.hashing import is_member

    d = spark.range(days * rows * 2).select("id", F.concat(F.lit("training-"), F.col("id").cast("string")).alias("click_id"))
    d = d.where(~is_member(F.col("click_id"), seed))
    # a fixture of some thousand candidates
    d = d.withColumn("i", F.row_number().over(Window.orderBy("id")) - 1).where(F.col("i") < days * rows)
    target = (F.col("i") % rows % 2 == 0).cast("double")
    at = (F.floor(F.col("i") / rows) + 30) * DAY
    return d.select(
        F.concat(F.lit("complete_wait:"), "click_id", F.lit(":final")).alias("record_id"), "click_id", at.alias("available_at"), F.lit("FINAL").alias("kind"),
        target.alias("target"), F.lit(1.0).alias("weight"), F.lit("complete_wait").alias("method"), (2 * target - 1).alias("feature"),
    )
