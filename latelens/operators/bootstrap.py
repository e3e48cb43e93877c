"""Paired block bootstrap over days."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latelens.functions.numeric import log_loss_term
from latelens.sources.scratch import stored

MIN_REPLICATES = 2000


def day_weights(days: list[int], block: int, replicates: int, seed: int) -> np.ndarray:
    """How often each day is drawn per replicate: truncated blocks of contiguous days."""
    if replicates < MIN_REPLICATES:
        raise ValueError(f"at least {MIN_REPLICATES} replicates")
    if days != list(range(days[0], days[0] + len(days))):
        raise ValueError("days must be contiguous")
    n = len(days)
    per = -(-n // block)
    first = np.random.default_rng(seed).integers(0, n - block + 1, size=(replicates, per))
    # a block counts from its first day up to the day behind its last; the last block ends with the n-th drawn day
    steps, row = np.zeros((replicates, n + 1), np.int64), np.arange(replicates)
    for k in range(per):
        steps[row, first[:, k]] += 1
        steps[row, first[:, k] + min(block, n - k * block)] -= 1
    return steps.cumsum(axis=1)[:, :n]


def weights_table(spark: SparkSession, days: list[int], block: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, click_day, weight) with weight > 0: replicates times days rows, a bounded product."""
    w = day_weights(days, block, replicates, seed)
    r, d = np.nonzero(w)
    rows = [(int(i), days[int(j)], int(w[i, j])) for i, j in zip(r, d)]
    return spark.createDataFrame(rows, "replicate int, click_day int, weight int")


def hashed_weights(spark: SparkSession, days: int, block: int, replicates: int) -> DataFrame:
    """Weights from md5 draws instead of a generator's, so that any engine can redo them."""
    per = -(-days // block)
    draws = spark.range(replicates * per).select((F.col("id") / per).cast("int").alias("replicate"), (F.col("id") % per).cast("int").alias("k"))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", "replicate", "k")), 1, 8), 16, 10).cast("long") % (days - block + 1)
    d = draws.withColumn("start", start).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("k") * block + F.col("o") < days)
    return d.groupBy("replicate", (F.col("start") + F.col("o")).cast("int").alias("click_day")).agg(F.count("*").alias("weight"))


def day_sums(df: DataFrame, keys: list[str], p: str = "probability") -> DataFrame:
    """Per key and day: rows and summed losses."""
    y, q = F.col("final_label"), F.col(p)
    return df.groupBy(*keys, "click_day").agg(F.count("*").alias("n"), F.sum(log_loss_term(y, q)).alias("ll"), F.sum((q - y) * (q - y)).alias("br"))


def replicate_metrics(sums: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Log loss and Brier per key and replicate: the day sums joined with the weights, not the rows."""
    j = sums.join(weights, "click_day")
    w = F.col("weight")
    n = F.sum(w * F.col("n"))
    return j.groupBy(*keys, "replicate").agg((F.sum(w * F.col("ll")) / n).alias("log_loss"), (F.sum(w * F.col("br")) / n).alias("brier"))


#: Replicates whose sums a task holds at once beside its range of scores.
TOGETHER = 256


def _weight_matrix(weights: DataFrame) -> tuple[list[int], list[int], np.ndarray]:
    """Replicates, days and the weights between them: a bounded product."""
    rows = weights.collect()
    reps, days = sorted({r["replicate"] for r in rows}), sorted({r["click_day"] for r in rows})
    at, on, w = {x: i for i, x in enumerate(reps)}, {x: i for i, x in enumerate(days)}, np.zeros((len(reps), len(days)))
    for r in rows:
        w[at[r["replicate"]], on[r["click_day"]]] = r["weight"]
    return reps, days, w


def replicate_auc(df: DataFrame, weights: DataFrame, keys: list[str], p: str = "probability") -> DataFrame:
    """Weighted ROC-AUC and average precision per key and replicate, ties grouped; null for a single class.

    Rows collapse to counts by score and day, which are dealt to ranges of scores. A range's sums by
    replicate, and then its share of the metrics above those of the higher ranges, are products of the
    counts and the weights, so no row is repeated for a replicate."""
    reps, days, w = _weight_matrix(weights)
    y, by = F.col("final_label"), [*keys, "__part"]
    d = df.where(F.col("click_day").isin(days)).groupBy(*keys, F.col(p).alias("p"), "click_day").agg(F.sum(y).alias("a"), F.sum(1 - y).alias("b"))
    d = d.groupBy(*keys, "p").agg(F.collect_list(F.struct("click_day", "a", "b")).alias("x"))
    d = stored(d.repartitionByRange(*keys, "p").withColumn("__part", F.spark_partition_id()))
    kinds = dict(d.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in by)
    place = {x: i for i, x in enumerate(days)}

    def counts(g) -> tuple[np.ndarray, np.ndarray]:
        """Positives and negatives by score, from the highest on, and day."""
        a, b = np.zeros((len(g), len(days))), np.zeros((len(g), len(days)))
        for i, x in enumerate(g.sort_values("p", ascending=False)["x"]):
            for r in x:
                a[i, place[r["click_day"]]], b[i, place[r["click_day"]]] = r["a"], r["b"]
        return a, b

    def sums(key, g: pd.DataFrame) -> pd.DataFrame:
        a, b = counts(g)
        out = pd.DataFrame({"replicate": reps, "pos": w @ a.sum(axis=0), "neg": w @ b.sum(axis=0)})
        for name, x in zip(reversed(by), reversed(key)):
            out.insert(0, name, x)
        return out

    total = d.groupBy(*by).applyInPandas(sums, schema + "replicate int, pos double, neg double")
    above = Window.partitionBy(*keys, "replicate").orderBy(F.col("__part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    total = stored(total.withColumn("tp", F.coalesce(F.sum("pos").over(above), F.lit(0.0))).withColumn("fp", F.coalesce(F.sum("neg").over(above), F.lit(0.0))))

    def shares(key, g: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        a, b = counts(g)
        t, out = t.sort_values("replicate"), []
        for i in range(0, len(reps), TOGETHER):
            own = t.iloc[i : i + TOGETHER]
            pos, neg = a @ w[i : i + TOGETHER].T, b @ w[i : i + TOGETHER].T
            tp, fp = pos.cumsum(axis=0) + own["tp"].to_numpy(), neg.cumsum(axis=0) + own["fp"].to_numpy()
            ap = np.divide(pos * tp, tp + fp, out=np.zeros_like(pos), where=pos > 0).sum(axis=0)
            out.append(own[["replicate", "pos", "neg"]].assign(roc=(neg * (tp - pos / 2)).sum(axis=0), ap=ap))
        out = pd.concat(out)
        for name, x in zip(reversed(by), reversed(key)):
            out.insert(0, name, x)
        return out

    one = d.groupBy(*by).cogroup(total.groupBy(*by)).applyInPandas(shares, schema + "replicate int, pos double, neg double, roc double, ap double")
    both, pos, neg = (F.sum("pos") > 0) & (F.sum("neg") > 0), F.sum("pos"), F.sum("neg")
    return one.groupBy(*keys, "replicate").agg(F.when(both, F.sum("ap") / pos).alias("pr_auc"), F.when(both, F.sum("roc") / (pos * neg)).alias("roc_auc"))


def interval(control: DataFrame, candidate: DataFrame, metric: str) -> DataFrame:
    """The 95 % interval of candidate - control, averaged over seeds within each replicate."""
    c = candidate.select("seed", "replicate", F.col(metric).alias("x"))
    d = control.select("seed", "replicate", F.col(metric).alias("y")).join(c, ["seed", "replicate"])
    r = d.groupBy("replicate").agg(F.avg(F.col("x") - F.col("y")).alias("d"))
    return r.agg(F.count("*").alias("replicates"), F.percentile("d", F.lit(0.025)).alias("lower"), F.percentile("d", F.lit(0.975)).alias("upper"))


#: Metrics that are compared.
METRICS = ("log_loss", "brier", "pr_auc", "roc_auc")


def seed_metrics(df: DataFrame) -> DataFrame:
    """All metrics of each seed, with its calibration error."""
    from latelens.operators import evaluation

    m = evaluation.point_metrics(df, ["seed"]).join(evaluation.ranking_metrics(df, ["seed"]), "seed")
    return m.join(evaluation.calibration_errors(df, ["seed"]), "seed")


def compare(control: DataFrame, candidate: DataFrame, replicates: int = MIN_REPLICATES, seed: int = 17, blocks: tuple[int, ...] = (1, 3, 7)) -> list[dict]:
    """Point differences, also by seed, and intervals of all metrics for each block length."""
    spark, both = control.sparkSession, {"control": control, "candidate": candidate}
    days = sorted(r["click_day"] for r in control.select("click_day").distinct().collect())
    sums = {k: stored(day_sums(d, ["seed"])) for k, d in both.items()}
    points = {k: {r["seed"]: r.asDict() for r in seed_metrics(d).collect()} for k, d in both.items()}
    seeds = sorted(points["control"])
    if len(seeds) < 3:
        raise ValueError("at least three seeds")
    out = []
    for block in blocks:
        w = weights_table(spark, days, block, replicates, seed)
        reps = {k: stored(replicate_metrics(sums[k], w, ["seed"]).join(replicate_auc(d, w, ["seed"]), ["seed", "replicate"])) for k, d in both.items()}
        for metric in METRICS:
            by_seed = {s: points["candidate"][s][metric] - points["control"][s][metric] for s in seeds if None not in (points["candidate"][s][metric], points["control"][s][metric])}
            i = interval(reps["control"], reps["candidate"], metric).first()
            out.append(
                {
                    "metric": metric, "block_days": block, "difference": float(np.mean(list(by_seed.values()))) if by_seed else None, "by_seed": by_seed,
                    "lower": i["lower"], "upper": i["upper"], "same_sign": len({np.sign(x) for x in by_seed.values()}) == 1,
                }
            )
    return out


def scheduler_success(rows: list[dict], ece_difference: float, equal_budget: bool) -> bool:
    """Log loss surely lower, Brier and calibration error not worse than allowed, at the same budget."""
    by = {(r["metric"], r["block_days"]): r for r in rows}
    main = by["log_loss", 3]
    same_way = all(np.sign(by["log_loss", b]["difference"]) == np.sign(main["difference"]) for b in (1, 7) if ("log_loss", b) in by)
    return bool(main["upper"] < 0 and by["brier", 3]["upper"] <= 5e-4 and ece_difference <= 2e-3 and equal_budget and main["same_sign"] and same_way)
