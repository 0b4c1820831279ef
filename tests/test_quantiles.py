import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.operators.attach import attach
from plinth.operators import quantiles as module
from plinth.operators.quantiles import quantiles
from plinth.staging import stage

PROBS = [0.1, 0.25, 0.5, 0.9]


def skewed(n=60_000, seed=3):
    """One key holds a third of the rows, a long tail of keys the rest; values repeat and have gaps."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 400, n))
    value = np.where(rng.random(n) < 0.3, 7.0, np.round(rng.lognormal(3, 1.5, n), 2))
    value[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"k": key, "v": value, "w": rng.normal(size=n)})


def check(result, pdf, columns, by=None):
    got = {(*([r[by]] if by else []), r.column_name): (r.n, r.q) for r in result.collect()}
    groups = pdf.groupby(by) if by else [(None, pdf)]
    expected = 0
    for name, group in groups:
        for column in columns:
            present = group[column].dropna()
            if len(present):
                n, q = got[(*([name] if by else []), column)]
                assert n == len(present)
                assert q == pytest.approx(np.quantile(present, PROBS), rel=1e-12, abs=1e-12)
                expected += 1
    assert expected == len(got)


@pytest.mark.parametrize("sizing", [{}, {"accuracy": 100}, {"accuracy": 100, "sort_rows": 40}, {"sort_rows": 7}])
def test_global_quantiles(spark, sizing):
    pdf = skewed()
    check(quantiles(spark.createDataFrame(pdf), ["v", "w"], PROBS, **sizing), pdf, ["v", "w"])


@pytest.mark.parametrize(
    "sizing",
    [{}, {"accuracy": 100}, {"accuracy": 100, "broadcast_bytes": 0, "sort_rows": 300}, {"accuracy": 100, "sort_rows": 30}],
)
def test_grouped_quantiles_with_a_hot_key(spark, sizing):
    pdf = skewed()
    check(quantiles(spark.createDataFrame(pdf), ["v", "w"], PROBS, by=["k"], **sizing), pdf, ["v", "w"], "k")


@pytest.mark.parametrize("sizing", [{}, {"accuracy": 100}, {"accuracy": 100, "sort_rows": 40}, {"sort_rows": 7}])
def test_wide_quantiles(spark, sizing):
    pdf = skewed()
    pdf["few"], pdf["none"] = np.where(pdf.w > 1.5, np.nan, np.round(pdf.w)), np.nan
    names = ["v", "few", "none", "w"]
    check(quantiles(spark.createDataFrame(pdf), names, PROBS, wide=True, **sizing), pdf, names)
    assert quantiles(spark.createDataFrame(pdf).limit(0), names, PROBS, wide=True).isEmpty()
    for more in ({"by": ["k"]}, {"carry": ["w"]}):
        with pytest.raises(ValueError):
            quantiles(spark.createDataFrame(pdf), ["v"], PROBS, wide=True, **more)


@pytest.mark.parametrize("values", [[5.0], [1.0, 1.0], [0.0, -0.0, np.inf, -np.inf], [2.0] * 500 + [3.0] * 700 + [4.0]])
def test_wide_quantiles_count_as_long_ones(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    for accuracy in (100, 10_000):
        wide, long = (quantiles(df, ["v"], PROBS, accuracy=accuracy, wide=w).collect() for w in (True, False))
        assert str(wide) == str(long)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6) | st.sampled_from([0.0, 1.0]), min_size=1, max_size=60))
def test_any_small_sample(spark, values):
    pdf = pd.DataFrame({"v": values})
    check(quantiles(spark.createDataFrame(pdf), ["v"], PROBS), pdf, ["v"])


def test_null_groups_are_left_out_and_extras_ride_along(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 9.0), ("b", None)], "k string, v double")
    for few in (1, 100):
        got = quantiles(rows, ["v"], [0.5], by=["k"], extra={"top": F.max("value")}, sort_rows=few).collect()
        assert [(r.k, r.n, r.q, r.top) for r in got] == [("a", 2, [2.0], 3.0)]


def test_one_column_needs_no_join(spark):
    rows = spark.createDataFrame(skewed())
    got = quantiles(rows, ["v"], PROBS, extra={"top": F.max("value")})
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.first().top == skewed().v.max()
    assert quantiles(rows.filter("false"), ["v"], PROBS).count() == 0


def test_brackets_that_miss_are_widened(spark, monkeypatch):
    """A sketch that is wrong altogether costs another round, not the result."""
    pdf = skewed(4000)

    def nowhere(n_probs, accuracy):
        return F.array(*[F.lit(float(v)) for _ in range(n_probs) for v in (-5.0, -4.0)])

    monkeypatch.setattr(module, "_bracket_ends", nowhere)
    rows = spark.createDataFrame(pdf)
    check(quantiles(rows, ["v", "w"], PROBS, sort_rows=100), pdf, ["v", "w"])
    check(quantiles(rows, ["v"], PROBS, by=["k"], sort_rows=100), pdf, ["v"], "k")


def test_no_task_sorts_more_than_it_may(spark, monkeypatch):
    """One group of 40,000 distinct values: what is left to sort is bounded, and is counted here."""
    seen, refined = [], module._refined

    def watched(counted, keys, probs, sort_rows):
        out = refined(counted, keys, probs, sort_rows)
        seen.append((counted.count(), out.groupBy(*keys).count().agg(F.max("count")).first()[0]))
        return out

    monkeypatch.setattr(module, "_refined", watched)
    rows = spark.range(40_000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 40_009).cast("double").alias("v"))
    got = quantiles(rows, ["v"], [0.5], by=["k"], accuracy=10, sort_rows=500).first()
    values = np.sort(np.arange(40_000) * 7919 % 40_009)
    assert got.q == [np.quantile(values, 0.5)]
    assert seen[0][0] > 5000 and seen[0][1] <= 500


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_attach_inner_and_left(spark, limit):
    pdf = pd.DataFrame({"k": ["hot"] * 900 + [f"c{i}" for i in range(50)] * 2 + [None] * 7, "i": range(1007)})
    rows = spark.createDataFrame(pdf)
    sizes = rows.dropna(subset=["k"]).filter("k != 'c7'").groupBy("k").agg(F.count("i").alias("n"))
    sizes = stage(sizes.withColumn("label", F.upper("k")), "sizes")
    inner = attach(rows, sizes, ["k"], "n", broadcast_bytes=limit)
    assert inner.count() == 998 and inner.columns == ["k", "i", "label"]
    left = attach(rows, sizes, ["k"], "n", how="left", broadcast_bytes=limit)
    assert left.count() == 1007 and left.select("i").distinct().count() == 1007
    assert left.filter("label IS NULL").count() == 9


def test_cold_keys_get_as_many_tasks_as_their_rows_ask_for(spark):
    rows = spark.range(8000).select((F.col("id") % 2000).alias("k"), "id")
    sizes = stage(rows.groupBy("k").agg(F.count("id").alias("rows"), F.min("id").alias("first")), "sizes")
    joined = attach(rows, sizes, ["k"], "rows", broadcast_bytes=0, cold_rows=200)
    found = joined.groupBy(F.spark_partition_id().alias("task")).agg(
        F.count("id").alias("n"), F.count_if(F.col("first") == F.col("k")).alias("right")
    ).collect()
    assert sum(r.n for r in found) == sum(r.right for r in found) == 8000
    assert len(found) > 30 and max(r.n for r in found) < 600
