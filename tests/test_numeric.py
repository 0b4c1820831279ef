import math

import pytest
from pyspark.sql import functions as F

from plinth.functions import numeric


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


def test_price_per_unit(spark):
    rows = spark.createDataFrame([(50.0, 1000.0), (1.0, 0.0), (None, 5.0)], "price double, total_sqft double")
    assert [r[0] for r in rows.select(numeric.price_per_unit(rows)).collect()] == [5000.0, None, None]
    with pytest.raises(ValueError):
        numeric.price_per_unit(rows, "price", "absent")


def test_target_round_trip(spark):
    x = F.col("x")
    there = numeric.transform_target(x)
    rows = frame(spark, [0.0, 10.0, 250.5, -3.0, None]).select(there.alias("t"), numeric.inverse_target(there).alias("b"))
    got = [tuple(r) for r in rows.collect()]
    assert got[2][0] == pytest.approx(math.log1p(250.5))
    assert [b for _, b in got[:4]] == pytest.approx([0.0, 10.0, 250.5, 0.0])
    assert got[4] == (None, None)


def test_inverse_target_is_never_negative(spark):
    rows = frame(spark, [-5.0, -0.1]).select(
        numeric.inverse_target(F.col("x")).alias("a"), numeric.inverse_target(F.col("x"), "identity").alias("b")
    )
    assert [tuple(r) for r in rows.collect()] == [(0.0, 0.0), (0.0, 0.0)]


@pytest.mark.parametrize("function", [numeric.transform_target, numeric.inverse_target])
def test_unknown_strategy(spark, function):
    with pytest.raises(ValueError):
        function(F.col("x"), "sqrt")


def moments(spark, values):
    x = F.col("x")
    return tuple(frame(spark, values).agg(numeric.sample_skewness(x), numeric.sample_kurtosis(x)).first())


def test_sample_moments_equal_pandas(spark):
    import pandas as pd

    values = [1.0, 2.0, 2.5, 9.0, 4.0, 7.5]
    series = pd.Series(values)
    assert moments(spark, values) == pytest.approx((series.skew(), series.kurtosis()))


def test_sample_moments_of_constant_and_short_columns(spark):
    assert moments(spark, [3.0] * 5) == (0.0, 0.0)
    assert moments(spark, [1.0, 2.0]) == (None, None)


def test_to_number_takes_text_and_nan(spark):
    rows = spark.createDataFrame([("12", float("nan")), ("x", 1.0)], "s string, d double")
    got = rows.select(numeric.to_number(rows, "s").alias("s"), numeric.to_number(rows, "d").alias("d")).collect()
    assert [tuple(r) for r in got] == [(12.0, None), (None, 1.0)]


def test_round_half_even(spark):
    rows = frame(spark, [0.125, 0.375, 2.5]).select(numeric.round_half_even(F.col("x")))
    assert [r[0] for r in rows.collect()] == [0.12, 0.38, 2.5]
