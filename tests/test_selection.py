"""Order statistics by radix selection against Python's sorting."""

import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veil.operators import selection


def _numbers(seed):
    rng = random.Random(seed)
    special = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1e308, -1e308,
               math.inf, -math.inf, math.nextafter(1, 2), math.nextafter(1, 0), 1 / 3, 2.0**52, 2.0**53 + 2, 8.0, 7.999999999999999]
    return special + [rng.uniform(-1, 1) * 10 ** rng.randint(-320, 308) for _ in range(2000)] + [
        math.ldexp(1 + rng.randint(-1, 1) * 2**-52, rng.randint(-1022, 1022)) for _ in range(500)]


def test_keys_and_digits_keep_the_order(spark):
    values = sorted(_numbers(1))
    keys = [selection.key_of(x) for x in values]
    assert keys == sorted(keys) and selection.width(1.0, 1.0) == 0 and selection.width(1.0, 2.0) == 53
    for lo, hi, even in ((-1e308, 1e307, True), (1.0, 2.0, True), (5e-324, 1e-300, True), (-math.inf, math.inf, False)):
        df = spark.createDataFrame([(x,) for x in values if lo <= x <= hi], "x double").coalesce(1)
        digits = [r.d for r in df.select(selection.digit_of(
            F.col("x"), F.lit(lo), F.lit(hi), F.lit(even), 4096).alias("d")).collect()]
        assert digits == sorted(digits) and (len(set(digits)) > 1 or len(digits) < 3)


@pytest.mark.parametrize("bits", [12, 3])
def test_medians_of_all_columns_at_once(spark, monkeypatch, bits):
    monkeypatch.setattr(selection, "BITS", bits)
    rng = random.Random(bits)
    columns = [[7.5], [1.0, 2.0], [3.0] * 99 + [1.0], [rng.gauss(0, 1e-9) for _ in range(501)],
               [float(rng.randrange(50)) for _ in range(1000)], [10.0 ** k for k in range(-300, 300)],
               [-1e308, 1e307], [-math.inf, 3.0, 4.0, 5.0, math.inf], [x for x in _numbers(2) if math.isfinite(x)], [1.0] * 10 + [math.nextafter(1, 2)] * 10,
               [float(rng.choice((1, 1, 1, 2**40))) for _ in range(400)]]
    df = spark.createDataFrame([(o, x, n) for o, c in enumerate(columns) for x, n in Counter(c).items()], "o int, x double, c long")
    sizes = {o: (len(c), min(c), max(c)) for o, c in enumerate(columns)}
    got = selection.medians(df, sizes)
    assert got == {o: pytest.approx(statistics.median(c), rel=1e-15) for o, c in enumerate(columns)}


def test_any_rank(spark):
    values = [random.Random(3).uniform(-5, 5) for _ in range(700)]
    df = spark.createDataFrame([(0, x, 1) for x in values], "o int, x double, c long")
    order = sorted(values)
    for a, b in ((0, 699), (1, 2), (350, 350)):
        got = selection.select_ranks(df, {0: (a, b)}, {0: (order[0], order[-1])})
        assert got == {(0, a): order[a], (0, b): order[b]}


def test_a_long_column_and_no_column(spark):
    df = spark.range(100000).select(F.lit(0).alias("o"), F.col("id").cast("double").alias("x"), F.lit(1).alias("c"))
    assert selection.medians(df, {0: (100000, 0.0, 99999.0)}) == {0: 49999.5}
    assert selection.medians(df.where("false"), {}) == {}
