from __future__ import annotations

import math

import pytest
import xxhash
from pyspark.sql import functions as F

from latelens.functions import hashing, numeric


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "a:1", "ünï", "x" * 70])
@pytest.mark.parametrize("seed", [0, 42, 20260813, 2**64 - 1])
def test_seeded_hash_equals_the_package(spark, text, seed):
    got = one(spark, hashing.xxh64(F.lit(text), seed))
    assert got % 2**64 == xxhash.xxh64_intdigest(text.encode(), seed)


def test_unsigned_remainder(spark):
    for n in (10, 4096, 7):
        got = one(spark, hashing.unsigned_mod(hashing.xxh64(F.lit("q"), 5), n))
        assert got == xxhash.xxh64_intdigest(b"q", 5) % n


def test_md5_number(spark):
    assert one(spark, hashing.md5_number(F.lit("a:1"))) == 2666605358


def test_losses_at_known_points(spark):
    l2 = math.log(2)
    rate = F.lit(math.log(math.expm1(2.0)))
    lam = 2 + 1e-6
    d = lambda y: one(spark, numeric.dfm_loss(F.lit(0.0), rate, F.lit(y), F.lit(0.5)))
    assert d(1) == pytest.approx(l2 - math.log(lam) + 0.5 * lam)
    assert d(0) == pytest.approx(-math.log(0.5 + 0.5 * math.exp(-0.5 * lam)))
    w = lambda y: one(spark, numeric.fnw_weight(F.lit(0.0), F.lit(y)))
    assert (w(1), w(0)) == (1.5, 0.75)
    e = lambda y: one(spark, numeric.esdfm_weight(F.lit(y), F.lit(math.log(1 / 3)), F.lit(0.0)))
    assert (e(1), e(0)) == (pytest.approx(1.5), pytest.approx(0.375))


def test_extreme_logits(spark):
    assert one(spark, numeric.sigmoid(F.lit(-800.0))) == 0
    assert one(spark, numeric.softplus(F.lit(800.0))) == 800


def test_bands(spark):
    d = spark.createDataFrame([(0,), (1,), (2,), (3,), (9,), (10,)], "n int")
    assert [r[0] for r in d.select(numeric.frequency_band(F.col("n"))).collect()] == ["0", "1-2", "1-2", "3-9", "3-9", "10+"]
    d = spark.createDataFrame([(65,), (69,), (70,), (89,)], "d int")
    assert [r[0] for r in d.select(numeric.day_block(F.col("d"))).collect()] == ["65-69", "65-69", "70-74", "85-89"]
