"""Leak-free features and separate truth tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latelens.functions.hashing import categorical_bucket
from latelens.functions.numeric import log1p_or_null, standardised
from latelens.sources.scratch import stored


def prior_counts(clicks: DataFrame, keys: dict[str, str], order: tuple[str, ...] = ("click_time", "click_id")) -> DataFrame:
    """clicks with prior_<name>_clicks and cold_<name> for each name: key column.

    Counts clicks of the same key strictly before, in order."""
    for name, key in keys.items():
        w = Window.partitionBy(key).orderBy(*order)
        clicks = clicks.withColumn(f"prior_{name}_clicks", (F.row_number().over(w) - 1).cast("long"))
        clicks = clicks.withColumn(f"cold_{name}", F.col(f"prior_{name}_clicks") == 0)
    return clicks


def nearest_quantiles(df: DataFrame, value: Column, quantiles: tuple[float, ...]) -> dict[float, float]:
    """Quantiles by the nearest rank (half away from zero), exact.

    Equal values are counted first; the counts are dealt to ranges and written, so that the ranges that are
    counted are those that are looked into. Only counts of ranges and the picked values come back."""
    g = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("k"))
    d = stored(g.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["n"]) for r in d.groupBy("part").agg(F.sum("k").alias("n")).collect())
    total = sum(n for _, n in sizes)
    if not total:
        return dict.fromkeys(quantiles)
    wanted: dict[float, tuple[int, int]] = {}
    for q in quantiles:
        rank = int((total - 1) * q + 0.5)
        for part, n in sizes:
            if rank < n:
                wanted[q] = (part, rank)
                break
            rank -= n
    places = sorted(set(wanted.values()))
    upto = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    picked = d.where(F.col("part").isin([p for p, _ in places])).withColumn("upto", F.sum("k").over(upto))
    asked = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(i).cast("long").alias("i")) for p, i in places])).alias("x")
    hit = picked.select("*", asked).where("part = x.p and x.i < upto and x.i >= upto - k")
    got = {(r["p"], r["i"]): r["v"] for r in hit.select("x.p", "x.i", "v").collect()}
    return {q: got[wanted[q]] for q in quantiles}


def fit_numeric(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> dict:
    """Clip bounds, mean and population deviation of log1p over burn-in rows; a bad deviation is 1."""
    v = log1p_or_null(F.col(column))
    q = nearest_quantiles(df, v, (low, high))
    x = F.least(F.greatest(v, F.lit(q[low])), F.lit(q[high]))
    r = df.where(v.isNotNull()).agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).first()
    return {"lower": q[low], "upper": q[high], "mean": r["m"], "scale": r["s"] if r["s"] and r["s"] > 0 else 1.0}


def transform_numeric(df: DataFrame, column: str, stat: dict) -> DataFrame:
    c = F.col(column)
    d = df.withColumn(f"{column}_missing", c == -1)
    return d.withColumn(f"{column}_value", standardised(c, *[F.lit(float(stat[k])) for k in ("lower", "upper", "mean", "scale")]))


def invalid_numeric(df: DataFrame, column: str) -> DataFrame:
    """Rows that must not reach transform_numeric."""
    c = F.col(column)
    return df.where(((c < 0) & (c != -1)) | F.isnan(c) | (F.abs(c) == float("inf")))


def hash_buckets(df: DataFrame, fields: dict[str, int], seed: int) -> DataFrame:
    return df.select("*", *[categorical_bucket(f, F.col(f).cast("string"), seed, n).alias(f"{f}_bucket") for f, n in fields.items()])


def price_quartile(df: DataFrame, burn_in: DataFrame, column: str = "price") -> DataFrame:
    """Codes 0-3 by linear quartiles of the burn-in rows."""
    q = burn_in.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).first()["q"]
    c = F.col(column)
    return df.withColumn(f"{column}_bin", sum(((c >= x).cast("int") for x in q), F.lit(0)))


def route_truth(truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reveal table (positives) and the maturity table (negatives)."""
    cols = ["click_id", "final_label", "click_time", "available_at"]
    return truth.where("final_label = 1").select(*cols), truth.where("final_label = 0").select(*cols)


def reconcile(features: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: clicks without truth, truth without clicks, duplicates and unequal times."""
    t = truth.groupBy("click_id").agg(F.count("*").alias("n_truth"), F.min("click_time").alias("t1"))
    f = features.groupBy("click_id").agg(F.count("*").alias("n_features"), F.min("click_time").alias("t0"))
    j = f.join(t, "click_id", "full_outer")
    return j.agg(
        F.count_if(F.col("n_truth").isNull()).alias("missing_truth"), F.count_if(F.col("n_features").isNull()).alias("missing_features"),
        F.count_if((F.col("n_truth") > 1) | (F.col("n_features") > 1)).alias("duplicates"),
        F.count_if(F.coalesce(F.col("t0") != F.col("t1"), F.lit(False))).alias("unequal_times"),
    )


def lookup(features: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features of the ids in a hash join, and the ids that have none."""
    return ids.join(features, "click_id"), ids.join(features, "click_id", "left_anti")


ALLOWED_SUFFIXES = ("_bucket", "_value", "_missing")
#: Columns that tell the outcome or its time.
FORBIDDEN = ("Sale", "SalesAmountInEuro", "time_delay_for_conversion", "final_label", "available_at", "conversion_delay_days", "availability_day")


def check_model_columns(columns: list[str], expected: list[str]) -> None:
    """Raises unless the model's columns are exactly the expected ones."""
    missing, extra = sorted(set(expected) - set(columns)), sorted(set(columns) - set(expected))
    if missing or extra:
        raise ValueError(f"model columns: missing {missing}, not allowed {extra}")


def leaked_columns(columns: list[str]) -> list[str]:
    return sorted(set(columns) & set(FORBIDDEN))


def period_of(day: Column, bounds: dict[str, tuple[int, int]]) -> Column:
    out = F.lit("outside")
    for name, (a, b) in bounds.items():
        out = F.when(day.between(a, b), F.lit(name)).otherwise(out)
    return out


PERIODS = {"burn_in": (0, 14), "training": (15, 24), "selection": (25, 34), "embargo": (35, 64), "final": (65, 89)}


def mature_split(truth: DataFrame, cutoff: int, maturity: int) -> tuple[DataFrame, DataFrame]:
    """Rows that are fully mature by the cutoff, and clicks strictly after it."""
    return truth.where((F.col("click_time") <= cutoff) & (F.col("click_time") + maturity <= cutoff) & (F.col("available_at") <= cutoff)), truth.where(F.col("click_time") > cutoff)


def offline_features(df: DataFrame, buckets: dict[str, int]) -> DataFrame:
    cols = [(F.col(f"{f}_bucket") / n).alias(f"{f}_scaled") for f, n in buckets.items()]
    return df.select("*", *cols, F.log1p("prior_user_clicks").alias("log_prior_user"), F.log1p("prior_product_clicks").alias("log_prior_product"))
