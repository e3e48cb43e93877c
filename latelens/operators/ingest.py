"""Validation, quarantine and profile of raw click logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space that strip() of the text layer removes.
BLANK = r"^[\s\x1c-\x1f\x85 ]*$"
NUMBERS = ("SalesAmountInEuro", "time_delay_for_conversion", "click_timestamp", "nb_clicks_1week", "product_price")
MULTIPLIERS = (1.0, 1e-3, 1e-6, 1e-9)


#: A number as text: digits with single underscores between them, a point, an exponent; or nan or an infinity.
NUMBER = r"^[+-]?(?:(?:D\.?(?:D)?|\.D)(?:[eE][+-]?D)?|[nN][aA][nN]|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)$".replace("D", "[0-9]+(?:_[0-9]+)*")


def number(c: Column) -> Column:
    """A float where the text is one, else null; nan and infinities stay."""
    s = F.trim(c)
    return F.when(s.rlike(NUMBER), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))


def is_finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def sale_of(c: Column) -> Column:
    """0 or 1, or -1 where the text is neither as a whole number."""
    s = F.trim(c)
    n = F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("long"))
    return F.coalesce(F.when(n.isin(0, 1), n), F.lit(-1))


def reason_codes(df: DataFrame, fields: list[str], n_fields: Column | None = None) -> DataFrame:
    """df with reasons (ordered, distinct), failing_fields (ordered, distinct), sale_flag and the parsed numbers.

    n_fields: how many fields the line had, where it was split from text; a wrong count is the only
    reason then. Columns absent from df are taken as valid."""
    own = [f for f in NUMBERS if f in df.columns]
    d = df.withColumn("sale_flag", sale_of(F.col("Sale")))
    for f in own:
        d = d.withColumn(f"{f}__n", number(F.col(f)))
    n = lambda f: F.col(f"{f}__n")
    fin = lambda f: n(f).isNotNull() & is_finite(n(f))
    rules = [("INVALID_SALE", "Sale", F.col("sale_flag") == -1)]
    for f in own:
        rules += [("INVALID_NUMBER", f, n(f).isNull()), ("NONFINITE_NUMBER", f, n(f).isNotNull() & ~is_finite(n(f)))]
    rules += [("EMPTY_FIELD", f, F.coalesce(F.col(f).rlike(BLANK), F.lit(True))) for f in fields]
    rules.append(("MISSING_OR_NEGATIVE_CLICK_TIME", "click_timestamp", fin("click_timestamp") & (n("click_timestamp") <= 0)))
    rules += [("INVALID_NEGATIVE_VALUE", f, fin(f) & (n(f) < -1)) for f in ("nb_clicks_1week", "product_price") if f in own]
    for code, f in (("SALE_AMOUNT_INCONSISTENT", "SalesAmountInEuro"), ("SALE_DELAY_INCONSISTENT", "time_delay_for_conversion")):
        if f in own:
            rules.append((code, f, fin(f) & (((F.col("sale_flag") == 0) & (n(f) != -1)) | ((F.col("sale_flag") == 1) & (n(f) < 0)))))
    broken = F.array(*[F.when(F.coalesce(r, F.lit(False)), F.struct(F.lit(c).alias("code"), F.lit(f).alias("field"))) for c, f, r in rules])
    if n_fields is not None:
        count = F.struct(F.lit("FIELD_COUNT").alias("code"), F.lit(None).cast("string").alias("field"))
        broken = F.when(n_fields != len(fields), F.array(count)).otherwise(broken)
    d = d.withColumn("__broken", F.filter(broken, lambda x: x.isNotNull()))
    d = d.withColumn("reasons", F.array_distinct(F.transform("__broken", lambda x: x["code"])))
    failing = F.filter(F.transform("__broken", lambda x: x["field"]), lambda x: x.isNotNull())
    return d.withColumn("failing_fields", F.array_distinct(failing)).drop("__broken")


def split_rows(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantined rows."""
    return validated.where(F.size("reasons") == 0), validated.where(F.size("reasons") > 0)


def field_profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: rows, missing, sentinel, invalid, nonfinite and negative counts, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v"), F.lit(f in NUMBERS).alias("is_number")) for f in fields])).alias("x")
    d = df.select(pairs).select("x.*").withColumn("n", F.when(F.col("is_number"), number(F.col("v"))))
    missing = F.coalesce(F.col("v").rlike(BLANK), F.lit(True))
    return d.groupBy("field").agg(
        F.count("*").alias("n_rows"),
        F.count_if(missing).alias("n_missing"),
        F.count_if(F.trim("v") == "-1").alias("n_sentinel"),
        F.count_if(F.col("is_number") & ~missing & F.col("n").isNull()).alias("n_invalid"),
        F.count_if(F.col("n").isNotNull() & ~is_finite(F.col("n"))).alias("n_nonfinite"),
        F.count_if(F.coalesce((F.col("n") < 0) & is_finite(F.col("n")), F.lit(False))).alias("n_negative"),
    )


def profile(validated: DataFrame) -> DataFrame:
    """One row of counters over accepted and quarantined rows."""
    ok = F.size("reasons") == 0
    t, delay = F.col("click_timestamp__n"), F.col("time_delay_for_conversion__n")
    positive = ok & (F.col("sale_flag") == 1)
    return validated.agg(
        F.count("*").alias("parsed"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("quarantined"),
        F.min(F.when(ok, t)).alias("first_click"), F.max(F.when(ok, t)).alias("last_click"),
        F.count_if(positive).alias("positives"), F.sum(F.when(positive, delay)).alias("delay_sum"),
        F.min(F.when(positive, delay)).alias("delay_min"), F.max(F.when(positive, delay)).alias("delay_max"),
    )


#: The reason codes, in the order of the rules.
CODES = (
    "FIELD_COUNT", "INVALID_SALE", "INVALID_NUMBER", "NONFINITE_NUMBER", "EMPTY_FIELD", "MISSING_OR_NEGATIVE_CLICK_TIME",
    "INVALID_NEGATIVE_VALUE", "SALE_AMOUNT_INCONSISTENT", "SALE_DELAY_INCONSISTENT",
)


def _histogram(validated: DataFrame, column: str, values: list[str], name: str) -> DataFrame:
    """(name, n) of the values that column's arrays hold: one row of counts, turned; exploding a made array would
    have its rules repeated in the filter that the optimiser infers."""
    counts = validated.agg(*[F.count_if(F.array_contains(column, v)).alias(f"c{i}") for i, v in enumerate(values)])
    pairs = F.array(*[F.struct(F.lit(v).alias(name), F.col(f"c{i}").alias("n")) for i, v in enumerate(values)])
    return counts.select(F.inline(pairs)).where("n > 0")


def reason_histogram(validated: DataFrame) -> DataFrame:
    return _histogram(validated, "reasons", list(CODES), "reason")


def field_histogram(validated: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n): rows that fail in each field."""
    return _histogram(validated, "failing_fields", list(fields), "field")


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose line digest was seen before: all rows less the distinct digests."""
    digest = F.sha2(F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in columns]), 256)
    return df.select(digest.alias("h")).agg((F.count("*") - F.count_distinct("h")).alias("n_duplicates"))


def column_counts(lines: DataFrame, column: str = "value", sep: str = "\t") -> DataFrame:
    return lines.groupBy(F.size(F.split(column, sep, -1)).alias("n_columns")).agg(F.count("*").alias("n"))


def consistency(validated: DataFrame) -> DataFrame:
    """Counts of sale against delay."""
    d = F.col("time_delay_for_conversion__n")
    kind = F.when(d.isNull(), "invalid").when(d == -1, "sentinel").when(d < 0, "negative").otherwise("present")
    return validated.groupBy("sale_flag", kind.alias("delay")).agg(F.count("*").alias("n"))


def time_units(first: float, last: float, max_delay: float, spark, span: tuple[float, float] = (89, 91), most_days: float = 30, day: float = 86_400):
    """Candidate multipliers and whether each fits; exactly one must."""
    rows = spark.createDataFrame([(m,) for m in MULTIPLIERS], "multiplier double")
    days = (F.lit(float(last)) - F.lit(float(first))) * F.col("multiplier") / day
    delay = F.lit(float(max_delay)) * F.col("multiplier") / day
    return rows.withColumn("span_days", days).withColumn("max_delay_days", delay).withColumn("fits", days.between(*span) & delay.between(0, most_days))


def inferred_unit(candidates: DataFrame) -> float:
    got = [r.multiplier for r in candidates.where("fits").limit(len(MULTIPLIERS)).collect()]
    if len(got) != 1:
        raise ValueError("AMBIGUOUS_TIME_UNIT")
    return got[0]


def day_stats(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("click_day").agg(F.count("*").alias("n_rows"), F.sum("final_label").alias("n_positive"), F.avg("final_label").alias("rate"))


def event_horizon(truth: DataFrame) -> DataFrame:
    return truth.agg(
        F.max("click_time").alias("last_click"),
        F.max(F.when(F.col("final_label") == 1, F.col("available_at"))).alias("last_reveal"),
        F.max(F.when(F.col("final_label") == 0, F.col("available_at"))).alias("last_maturity"),
    )


def monotonic_violations(df: DataFrame, order: str, value: str) -> DataFrame:
    """Rows whose value is below the one before in order, without a window over all rows in one task.

    Rows are range-partitioned by order; each partition counts inside itself, and the partitions' ends,
    one row each, are compared in a second step."""
    d = df.select(F.col(order).alias("o"), F.col(value).alias("v")).repartitionByRange("o").withColumn("part", F.spark_partition_id())
    own = Window.partitionBy("part").orderBy("o")
    d = d.withColumn("before", F.lag("v").over(own))
    ends = d.groupBy("part").agg(F.count_if(F.col("v") < F.col("before")).alias("n"), F.min_by("v", "o").alias("first"), F.max_by("v", "o").alias("last"))
    # one row per partition
    across = ends.withColumn("prev", F.lag("last").over(Window.orderBy("part")))
    return across.agg(F.coalesce(F.sum(F.col("n") + F.when(F.col("first") < F.col("prev"), 1).otherwise(0)), F.lit(0)).alias("violations"))
