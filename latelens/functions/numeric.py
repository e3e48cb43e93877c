"""Column functions of the scoring and loss formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBABILITY_EPS = 1e-12
LOGIT_EPS = 1e-6
MAX_RATE = 100.0


def sigmoid(z: Column) -> Column:
    """Logistic function without overflow on either side."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def log_sigmoid(z: Column) -> Column:
    return -softplus(-z)


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def clipped(p: Column, eps: float = PROBABILITY_EPS) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def log_loss_term(y: Column, p: Column, eps: float = PROBABILITY_EPS) -> Column:
    q = clipped(p, eps)
    return -(y * F.log(q) + (1 - y) * F.log1p(-q))


def bce_with_logits(y: Column, z: Column) -> Column:
    return softplus(z) - y * z


def dfm_loss(z: Column, rate: Column, y: Column, days: Column) -> Column:
    """Delayed-feedback loss: the delay's density for positives, survival for the others."""
    lam = F.least(F.greatest(softplus(rate) + LOGIT_EPS, F.lit(LOGIT_EPS)), F.lit(MAX_RATE))
    positive = softplus(-z) - F.log(lam) + lam * days
    censored = -log_add_exp(log_sigmoid(-z), log_sigmoid(z) - lam * days)
    return F.when(y > 0, positive).otherwise(censored)


def fnw_weight(z: Column, y: Column) -> Column:
    p = F.least(F.greatest(sigmoid(z), F.lit(LOGIT_EPS)), F.lit(1 - LOGIT_EPS))
    return y * (1 + p) + (1 - y) * (1 - p * p)


def esdfm_weight(y: Column, tn: Column, dp: Column) -> Column:
    """tn and dp are logits of a true negative and of a delayed positive."""
    later = 1 + sigmoid(dp)
    return F.least(F.greatest(F.when(y > 0, later).otherwise(later * sigmoid(tn)), F.lit(1e-4)), F.lit(2.0))


def log1p_or_null(v: Column) -> Column:
    return F.when(v >= 0, F.log1p(v))


def standardised(v: Column, lower: Column, upper: Column, mean: Column, scale: Column) -> Column:
    """Clipped, centred and scaled log1p; the sentinel -1 gives 0."""
    return F.when(v == -1, F.lit(0.0)).otherwise((F.least(F.greatest(F.log1p(v), lower), upper) - mean) / scale)


def probability_bin(p: Column, bins: int = 10) -> Column:
    return F.least(F.floor(p * bins).cast("int"), F.lit(bins - 1))


def frequency_band(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 9, "3-9").otherwise("10+")


def delay_band(days: Column) -> Column:
    return F.when(days < 1, "[0,1)").when(days < 3, "[1,3)").when(days < 7, "[3,7)").when(days < 14, "[7,14)").otherwise("[14,30]")


def day_block(day: Column, first: int = 65, block: int = 5, last: int = 89) -> Column:
    start = F.lit(first) + F.floor((day - first) / block).cast("int") * block
    return F.concat(start.cast("string"), F.lit("-"), F.least(start + block - 1, F.lit(last)).cast("string"))


def tick_of(t: Column, tick: int, origin: int = 0) -> Column:
    """The first boundary at or after t."""
    return F.ceil((t - origin) / tick)


def snapshot_boundary(fraction: Column, credits: Column) -> Column:
    return F.ceil(fraction * credits)
