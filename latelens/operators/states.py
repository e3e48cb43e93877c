"""States between decisions: sealed predictions, cursors, cohorts and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latelens.errors import IntegrityError
from latelens.functions.hashing import is_hex_id
from latelens.operators import ingest
from latelens.operators.sampling import ranked
from latelens.sources.scratch import stored


def prediction_violations(predictions: DataFrame, hex_ids: bool = False) -> DataFrame:
    """One row of counts over a sealed ledger: probabilities that are null, not finite or outside [0, 1], null days,
    null or ill-formed ids, and rows beyond the first of an id."""
    p, i = F.col("probability"), F.col("click_id")
    rules = {
        "bad_probability": F.coalesce(F.isnan(p) | ~p.between(0, 1), F.lit(True)),
        "bad_day": F.col("click_day").isNull(),
        "bad_id": i.isNull() | (~is_hex_id(i) if hex_ids else F.lit(False)),
    }
    # summed by id first, so that no task holds a set of ids
    g = predictions.groupBy("click_id").agg(F.count("*").alias("n"), *[F.count_if(r).alias(k) for k, r in rules.items()])
    repeated = F.sum(F.when(i.isNotNull(), F.col("n") - 1).otherwise(0))
    return g.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in rules], F.coalesce(repeated, F.lit(0)).alias("repeated"))


def missing_parts(ledger: DataFrame, part: str = "part") -> DataFrame:
    """Numbers from 0 to the last part's that no row has."""
    last = ledger.agg(F.max(part)).first()[0]
    every = ledger.sparkSession.range(0, -1 if last is None else int(last) + 1).select(F.col("id").cast("int").alias(part))
    return every.join(ledger.select(part).distinct(), part, "left_anti")


def sealed_with_truth(predictions: DataFrame, truth: DataFrame, boundary: int) -> DataFrame:
    """Predictions joined with their truth by click_id.

    Raises UNKNOWN_CLICKS where a prediction has none, REPEATED_TRUTH where it has several and IMMATURE_TRUTH
    where an outcome isn't available by the boundary. Only after the ledger is sealed should this be called."""
    t = truth.select("click_id", "final_label", "click_time", "available_at", F.lit(True).alias("__known"))
    j = stored(predictions.join(t, "click_id", "left"))
    got = j.agg(F.count("*").alias("n"), F.count_if(F.col("__known").isNull()).alias("unknown"), F.count_if(F.col("available_at") > boundary).alias("late")).first()
    if got.unknown:
        raise IntegrityError("UNKNOWN_CLICKS", "predictions without truth", n=got.unknown)
    if got.n != predictions.count():
        raise IntegrityError("REPEATED_TRUTH", "clicks with several outcomes", n=got.n)
    if got.late:
        raise IntegrityError("IMMATURE_TRUTH", "outcomes behind the boundary", n=got.late)
    return j.drop("__known")


def compact_probabilities(predictions: DataFrame, order: list[str]) -> DataFrame:
    """(position, probability): the probabilities alone, by their dense place in order."""
    return ranked(predictions, order).select(F.col("rank").alias("position"), "probability")


def gathered(features: DataFrame, references: DataFrame, key: str = "click_id") -> DataFrame:
    """Features of references(position, key), one row a position; raises where a reference has none."""
    j = references.join(features.withColumn("__known", F.lit(True)), key, "left")
    if j.where("__known is null").limit(1).count():
        raise IntegrityError("UNKNOWN_REFERENCE", "references without features")
    return j.drop("__known")


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(column, code): the distinct values that aren't null with dense codes from 0 in their order."""
    return ranked(df.select(column).where(F.col(column).isNotNull()).distinct(), [column]).withColumnRenamed("rank", "code")


def coded(df: DataFrame, codes: DataFrame, column: str, name: str = "code") -> DataFrame:
    """df with each value's code, null for null and for values that the dictionary hasn't."""
    return df.join(codes.select(column, F.col("code").alias(name)), column, "left")


class TruthCursor:
    """Truth in order of its availability, taken in steps; what was taken is a prefix and never comes again."""

    def __init__(self, truth: DataFrame, now: int | None = None, revealed: int = 0):
        self.truth, self.now, self.revealed = truth, now, revealed

    def advance(self, now: int) -> DataFrame:
        """Rows that become available after the last step and by now."""
        if self.now is not None and now < self.now:
            raise IntegrityError("CURSOR_BACKWARDS", f"{now} is before {self.now}")
        d = self.truth.where(F.col("available_at") <= now)
        d = d if self.now is None else d.where(F.col("available_at") > self.now)
        self.now, self.revealed = now, self.revealed + d.count()
        return d

    def state(self) -> dict:
        return {"now": self.now, "revealed": self.revealed}

    @classmethod
    def resumed(cls, truth: DataFrame, state: dict) -> TruthCursor:
        """A cursor from its state; raises where truth no longer has the prefix that was taken."""
        n = 0 if state["now"] is None else truth.where(F.col("available_at") <= state["now"]).count()
        if n != state["revealed"]:
            raise IntegrityError("CURSOR_MISMATCH", "truth changed behind the cursor", expected=state["revealed"], got=n)
        return cls(truth, state["now"], state["revealed"])


def monitoring_labels(truth: DataFrame, members: DataFrame, now: int) -> DataFrame:
    """(click_id, final_label) of members whose outcome is known by now.

    Raises MALFORMED_TRUTH for labels other than 0 and 1 and for clicks with several outcomes."""
    known = truth.where(F.col("available_at") <= now)
    g = known.groupBy("click_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(~F.col("final_label").isin(0, 1), F.lit(True))).alias("bad"), F.max("final_label").alias("final_label"))
    g = stored(g)
    if g.where("n > 1 or bad > 0").limit(1).count():
        raise IntegrityError("MALFORMED_TRUTH", "repeated or invalid outcomes")
    return g.select("click_id", "final_label").join(members.select("click_id").distinct(), "click_id", "left_semi")


def monitoring_cohort(members: DataFrame, labels: DataFrame, decision_day: int, lag_days: int = 31, cohort_days: int = 7) -> DataFrame:
    """Members of the cohort that a decision sees, with their labels.

    Raises TOO_EARLY before one full maturity and IMMATURE_COHORT where a member's label isn't known."""
    if decision_day < lag_days:
        raise IntegrityError("TOO_EARLY", f"day {decision_day} has no mature cohort")
    last = decision_day - lag_days
    c = members.where(F.col("click_day").between(last - cohort_days + 1, last)).join(labels, "click_id", "left")
    if c.where("final_label is null").limit(1).count():
        raise IntegrityError("IMMATURE_COHORT", f"unlabelled members on day {decision_day}")
    return c


def check_consecutive(days: list[int], first: int) -> None:
    """Raises unless the decision days so far run from first without a gap."""
    if days != list(range(first, first + len(days))):
        raise IntegrityError("DECISION_GAP", f"{days[:5]} should run from {first}")


def replay_differences(got: DataFrame, expected: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """(keys, difference): rows that are missing, not expected or carry other values than a replay gives.

    Doubles may differ by tolerance; a row that stands twice in the log is told as repeated."""
    g = got.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.first(v).alias(f"__g_{v}") for v in values])
    e = expected.select(*keys, *[F.col(v).alias(f"__e_{v}") for v in values], F.lit(True).alias("__e"))
    types = dict(expected.dtypes)

    def same(v):
        a, b = F.col(f"__g_{v}"), F.col(f"__e_{v}")
        near = F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)) if types[v] in ("double", "float") else F.lit(False)
        return a.eqNullSafe(b) | near

    differs = F.lit(False)
    for v in values:
        differs = differs | ~same(v)
    j = g.join(e, keys, "full_outer")
    what = F.when(F.col("__n").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("__n") > 1, "repeated").when(differs, "changed")
    return j.select(*keys, what.alias("difference")).where("difference is not null")


def record_masks(records: DataFrame, kinds: list[str]) -> DataFrame:
    """(click_id, n, mask): a bit for each kind of record a click has; kinds that aren't named have none."""
    bit = F.lit(0)
    for i, k in enumerate(kinds):
        bit = F.when(F.col("kind") == k, 1 << i).otherwise(bit)
    return records.groupBy("click_id").agg(F.count("*").alias("n"), F.bit_or(bit).cast("int").alias("mask"))


def repeated_records(masks: DataFrame) -> DataFrame:
    """Clicks with more records than kinds."""
    return masks.where(F.col("n") != F.bit_count("mask"))


def days_out_of_order(df: DataFrame, time: str = "click_time", day: str = "click_day") -> DataFrame:
    """Days that begin before an earlier day has ended, from one row per day."""
    ends = df.groupBy(day).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    # one row a day
    before = F.max("last").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1))
    return ends.withColumn("before", before).where(F.col("first") < F.col("before"))


def sorted_unless_monotonic(df: DataFrame, order: str, value: str) -> tuple[DataFrame, bool]:
    """df, sorted by value and order only where value falls somewhere in order; and whether it was sorted."""
    if not ingest.monotonic_violations(df, order, value).first()["violations"]:
        return df, False
    return df.orderBy(F.col(value).cast("double"), order), True
