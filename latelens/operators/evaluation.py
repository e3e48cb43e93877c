"""Metrics, calibration, slices and comparison tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latelens.functions.numeric import clipped, day_block, delay_band, frequency_band, log_loss_term, logit, probability_bin



def point_metrics(df: DataFrame, keys: list[str] = (), label: str = "final_label", p: str = "probability", clip_brier: bool = False) -> DataFrame:
    """Per key: n, positives, log loss and Brier score."""
    y, q = F.col(label), F.col(p)
    shown = clipped(q) if clip_brier else q
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(label).alias("positives"), F.avg(log_loss_term(y, q)).alias("log_loss"), F.avg((shown - y) * (shown - y)).alias("brier"))


def _ties(df: DataFrame, keys: list[str], label: str, p: str) -> DataFrame:
    """One row per key and distinct score with its positives and negatives, and what stands above it.

    Scores are pre-aggregated before the window, so it runs over distinct values."""
    g = df.groupBy(*keys, F.col(p).alias("__p")).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    above = Window.partitionBy(*keys).orderBy(F.col("__p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("tp", F.sum("pos").over(above)).withColumn("fp", F.sum("neg").over(above))


def ranking_metrics(df: DataFrame, keys: list[str] = (), label: str = "final_label", p: str = "probability") -> DataFrame:
    """Average precision with ties grouped, and ROC-AUC with average ranks; null for a single class."""
    one = [] if keys else [F.lit(1).alias("__one")]
    d = df.select("*", *one)
    by = list(keys) or ["__one"]
    g = _ties(d, by, label, p)
    both = (F.sum("pos") > 0) & (F.sum("neg") > 0)
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")
    # a positive beats the negatives below it, and half of those it ties with
    roc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / (F.sum("pos") * F.sum("neg"))
    out = g.groupBy(*by).agg(F.when(both, ap).alias("pr_auc"), F.when(both, roc).alias("roc_auc"))
    return out if keys else out.drop("__one")


def reliability(df: DataFrame, bins: int = 10, label: str = "final_label", p: str = "probability") -> DataFrame:
    """All equal-width bins with counts; means are null where a bin is empty."""
    g = df.groupBy(probability_bin(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_probability"), F.avg(label).alias("rate"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(g, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_probability") - F.col("rate"))) / F.sum("n")).alias("ece"))


def calibration_errors(df: DataFrame, keys: list[str], bins: int = 10, label: str = "final_label", p: str = "probability") -> DataFrame:
    """The expected calibration error of each key."""
    g = df.groupBy(*keys, probability_bin(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.avg(label).alias("rate"))
    return g.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean") - F.col("rate"))) / F.sum("n")).alias("ece"))


def calibration_fit(df: DataFrame, label: str = "final_label", p: str = "probability", rounds: int = 25, tol: float = 1e-10) -> tuple[float, float] | None:
    """Intercept and slope of the label on logit(p) by Newton steps of five sums each; null for one class.

    The loop is over rounds, not rows; df should be cached by the caller where it is costly."""
    d = df.select(F.col(label).cast("double").alias("y"), logit(clipped(F.col(p))).alias("x"))
    first = d.agg(F.sum("y"), F.count("*")).first()
    if not first[1] or first[0] in (0, first[1]):
        return None
    a, b = 0.0, 1.0
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w, r = q * (1 - q), F.col("y") - q
        g0, g1, h00, h01, h11 = d.agg(F.sum(r), F.sum(r * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x"))).first()
        det = h00 * h11 - h01 * h01
        if not det:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < tol:
            break
    return a, b


def slice_rows(df: DataFrame) -> DataFrame:
    """Each example once per slice dimension: (dimension, value, final_label, probability).

    One generate over the row; nothing is scanned eight times."""
    delay = F.when(F.col("final_label") == 1, delay_band(F.col("conversion_delay_days")))
    dims = {
        "cold_user": F.col("cold_user").cast("string"), "cold_product": F.col("cold_product").cast("string"),
        "user_frequency": frequency_band(F.col("prior_user_clicks")), "product_frequency": frequency_band(F.col("prior_product_clicks")),
        "product_price_bin": F.col("product_price_bin").cast("string"), "device_type": F.col("device_type"),
        "click_day_block": day_block(F.col("click_day")), "positive_conversion_delay": delay,
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in dims.items()])
    return df.select("final_label", "probability", F.explode(pairs).alias("s")).where("s.value is not null").select("s.dimension", "s.value", "final_label", "probability")


#: Groups that are listed even when they are empty.
DECLARED = {"cold_user": ("false", "true"), "cold_product": ("false", "true"), "user_frequency": ("0", "1-2", "3-9", "10+"), "product_frequency": ("0", "1-2", "3-9", "10+"), "product_price_bin": ("0", "1", "2", "3"), "positive_conversion_delay": ("[0,1)", "[1,3)", "[3,7)", "[7,14)", "[14,30]")}


def slices(df: DataFrame, min_rows: int = 10_000, min_positives: int = 100) -> DataFrame:
    """Metrics per slice with suppression of small groups; counts always stay."""
    by, rows = ["dimension", "value"], slice_rows(df)
    g = point_metrics(rows, by).join(ranking_metrics(rows, by), by, "left").join(calibration_errors(rows, by), by, "left")
    declared = df.sparkSession.createDataFrame([(k, v) for k, vs in DECLARED.items() for v in vs], "dimension string, value string")
    d = g.join(declared, ["dimension", "value"], "full_outer").withColumns({"n": F.coalesce("n", F.lit(0)), "positives": F.coalesce("positives", F.lit(0))})
    reason = F.when(F.col("n") == 0, "empty").when(F.col("n") < min_rows, "insufficient_examples").when(F.col("positives") < min_positives, "insufficient_positives")
    d = d.withColumn("reason", reason)
    shown = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return d.select("dimension", "value", "n", "positives", *[shown(c) for c in ("log_loss", "brier", "pr_auc", "roc_auc", "ece")], "reason").orderBy("dimension", "value")


def key_mismatch(predictions: DataFrame, labels: DataFrame, key: str = "click_id") -> DataFrame:
    """Ids that stand on one side only, with the side that lacks them."""
    a = predictions.select(key).join(labels.select(key), key, "left_anti").select(key, F.lit("label").alias("missing"))
    b = labels.select(key).join(predictions.select(key), key, "left_anti").select(key, F.lit("prediction").alias("missing"))
    return a.unionByName(b)


def paired(control: DataFrame, candidate: DataFrame, keys: tuple[str, ...] = ("seed", "click_id")) -> DataFrame:
    """Rows of both methods side by side."""
    c = candidate.select(*keys, F.col("probability").alias("candidate"))
    return control.withColumnRenamed("probability", "control").join(c, list(keys))


def pareto(table: DataFrame) -> DataFrame:
    """Methods that none beats in loss and in total examples at once."""
    # by examples first, the least loss of fewer examples and of as many say whether any method beats one
    g = table.groupBy("total_examples").agg(F.min("log_loss").alias("__own"))
    fewer = Window.orderBy("total_examples").rowsBetween(Window.unboundedPreceding, -1)
    best = g.withColumn("__fewer", F.min("__own").over(fewer))
    kept = (F.col("log_loss") <= F.col("__own")) & (F.col("__fewer").isNull() | (F.col("log_loss") < F.col("__fewer")))
    return table.join(best, "total_examples").where(kept).select(*table.columns).orderBy("total_examples", "log_loss")


#: Fractions of the budget that are looked at.
FRACTIONS = (0.25, 0.5, 0.75, 1.0)


def budget_violations(table: DataFrame) -> DataFrame:
    """Methods without all fractions, or whose examples don't rise from one to the next."""
    w = Window.partitionBy("method").orderBy("fraction")
    d = table.withColumn("before", F.lag("examples").over(w))
    g = d.groupBy("method").agg(F.sort_array(F.collect_set("fraction")).alias("fractions"), F.count_if(F.col("examples") <= F.col("before")).alias("flat"))
    return g.where((F.col("flat") > 0) | (F.col("fractions") != F.array(*[F.lit(x) for x in FRACTIONS])))


def example_violations(df: DataFrame) -> DataFrame:
    """Counts of rows that break the invariants of an evaluation example."""
    rules = {
        "cold_user": F.col("cold_user") != (F.col("prior_user_clicks") == 0),
        "cold_product": F.col("cold_product") != (F.col("prior_product_clicks") == 0),
        "delay": F.col("conversion_delay_days").isNotNull() != (F.col("final_label") == 1),
        "probability": ~F.col("probability").between(0, 1) | F.isnan("probability"),
    }
    return df.agg(*[F.count_if(F.coalesce(r, F.lit(True))).alias(k) for k, r in rules.items()])


def mean_over_seeds(metrics: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def same_value(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys under which the columns don't have a single value."""
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*columns)).alias("n")).where("n > 1")
