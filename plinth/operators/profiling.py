"""Statistical profile of a table: moments, quantiles, categories, correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.numeric import sample_kurtosis, sample_skewness, to_number
from plinth.operators.attach import attach
from plinth.operators.quantiles import quantiles
from plinth.schemas import TARGET, numeric_columns, require_columns, string_columns
from plinth.staging import stage

QUARTILES = [0.25, 0.5, 0.75]


def _quartile(i: int) -> Column:
    return F.get("q", F.lit(i))


def _moments() -> dict[str, Column]:
    return {
        "mean": F.avg("value"), "std": F.stddev_samp("value"), "min": F.min("value"), "max": F.max("value"),
        "skewness": sample_skewness(F.col("value")),
    }


def dataset_overview(df: DataFrame) -> dict:
    """Row count and column lists; the only job is the count."""
    return {
        "total_rows": df.count(),
        "total_columns": len(df.columns),
        "columns": list(df.columns),
        "numerical_columns": numeric_columns(df),
        "categorical_columns": string_columns(df),
    }


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """A few rows for display."""
    return df.limit(n)


def target_statistics(df: DataFrame, target: str = TARGET, **sizing) -> DataFrame:
    """One row: centre, spread, shape of the target, and the skewness of log1p of its positive values."""
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    positive_log = F.when(F.col("value") > 0, F.log1p("value"))
    extra = _moments() | {
        "kurtosis": sample_kurtosis(F.col("value")), "log_skewness": sample_skewness(positive_log)
    }
    stats = quantiles(df, [target], QUARTILES, extra=extra, **sizing)
    return stats.select(
        F.col("column_name").alias("target_name"), F.col("n").alias("count"), "mean",
        _quartile(1).alias("median"), "std", "min", _quartile(0).alias("q25"), _quartile(2).alias("q75"),
        "max", (_quartile(2) - _quartile(0)).alias("iqr"), "skewness", "kurtosis", "log_skewness",
    )


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, **sizing) -> DataFrame:
    """One row per numeric column: count, mean, median, std, min, quartiles, max, skewness."""
    columns = numeric_columns(df) if columns is None else list(columns)
    stats = quantiles(df, columns, QUARTILES, extra=_moments(), **sizing)
    return stats.select(
        "column_name", F.col("n").alias("count"), "mean", _quartile(1).alias("median"), "std", "min",
        _quartile(0).alias("q25"), _quartile(2).alias("q75"), "max", "skewness",
    )


def category_table(df: DataFrame, columns: Sequence[str] | None = None, target: str = TARGET, **sizing) -> DataFrame:
    """``column_name, category, frequency`` and target statistics of every non-null category of every column."""
    columns = string_columns(df) if columns is None else list(columns)
    has_target = target in df.columns
    cells = F.array(*[F.struct(F.lit(c).alias("of_column"), F.col(c).alias("category")) for c in columns])
    values = [to_number(df, target).alias("target_value")] if has_target else []
    long = df.select(*values, F.inline(cells)).filter("category IS NOT NULL")
    keys = ["of_column", "category"]
    table = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("frequency"))
    if has_target:
        prices = quantiles(
            long, ["target_value"], [0.5], by=keys,
            extra={"mean_target": F.avg("value"), "std_target": F.stddev_samp("value")}, **sizing,
        ).select(*keys, F.col("n").alias("count_target"), "mean_target", _quartile(0).alias("median_target"), "std_target")
        table = table.join(prices, keys, "left")
    return table.withColumnRenamed("of_column", "column_name")


def category_summary(
    df: DataFrame, columns: Sequence[str] | None = None, target: str = TARGET, top: int = 10, **sizing
) -> DataFrame:
    """Per string column: distinct values, top categories by frequency and by median target.

    ``ranking`` is ``frequency`` or ``target``; ``unique_count`` repeats on each row of a column.
    """
    table = stage(category_table(df, columns, target, **sizing), "categories")
    distinct = table.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))
    rankings = [("frequency", F.col("frequency"))]
    if "median_target" in table.columns:
        rankings.append(("target", F.col("median_target")))
    parts = []
    for name, measure in rankings:
        order = Window.partitionBy("column_name").orderBy(measure.desc(), F.col("category").asc())
        ranked = table.filter(measure.isNotNull()).withColumn("position", F.row_number().over(order))
        parts.append(ranked.filter(F.col("position") <= top).withColumn("ranking", F.lit(name)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    # One row per string column of the schema.
    return result.join(F.broadcast(distinct), "column_name")


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson"
) -> DataFrame:
    """``(col_a, col_b, corr)`` over all ordered pairs, each on its pair-complete rows.

    The diagonal is 1; a column that is constant on the pair's rows gives NULL. Each task adds up
    masked products of its batches, so the plan is the same for any number of columns.
    """
    columns = numeric_columns(df) if columns is None else [c for c in columns if c in df.columns]
    if method == "spearman":
        return _spearman(df, columns)
    if method != "pearson":
        raise ValueError(f"unknown correlation method: {method}")
    spark, k = df.sparkSession, len(columns)
    if not columns:
        return spark.createDataFrame([], "col_a string, col_b string, corr double")
    rows = df.select(*[to_number(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    # Some value near the middle of each column, to keep the sums small.
    middle = rows.agg(*[F.percentile_approx(c, 0.5, 100).alias(c) for c in rows.columns]).first()
    origin = np.array([m or 0.0 for m in middle])
    sums = ["n", "sum_a", "sum_b", "sum_aa", "sum_bb", "sum_ab"]

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, first, square, cross = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = batch.to_numpy(float) - origin
            present = ~np.isnan(x)
            x, mask = np.where(present, x, 0.0), present.astype(float)
            n, first, square, cross = n + mask.T @ mask, first + x.T @ mask, square + (x * x).T @ mask, cross + x.T @ x
        a, b = np.triu_indices(k)
        parts = [n[a, b], first[a, b], first[b, a], square[a, b], square[b, a], cross[a, b]]
        yield pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32), **dict(zip(sums, parts))})

    schema = "a int, b int, " + ", ".join(f"{name} double" for name in sums)
    pairs = spark.createDataFrame([(a, b, *[0.0] * len(sums)) for a in range(k) for b in range(a, k)], schema)
    total = rows.mapInPandas(add_up, schema).unionAll(pairs).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in sums])

    def mean(name: str) -> Column:
        return F.try_divide(F.col(name), F.col("n"))

    def spread(of: str) -> Column:
        variance = mean(f"sum_{of}{of}") - mean(f"sum_{of}") * mean(f"sum_{of}")
        # What is left of a constant after rounding is no variance.
        return F.when(variance > 1e-14 * mean(f"sum_{of}{of}"), F.sqrt(variance))

    corr = (mean("sum_ab") - mean("sum_a") * mean("sum_b")) / (spread("a") * spread("b"))
    corr = F.when(F.col("a") != F.col("b"), corr).when(corr.isNotNull(), 1.0)
    names = F.array(*[F.lit(c) for c in columns])
    one, other = F.get(names, F.col("a")), F.get(names, F.col("b"))
    there = F.struct(one.alias("col_a"), other.alias("col_b"), corr.alias("corr"))
    back = F.struct(other.alias("col_a"), one.alias("col_b"), corr.alias("corr"))
    return total.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(there)).otherwise(F.array(there, back))))


def _spearman(df: DataFrame, columns: Sequence[str], buckets: int = 256) -> DataFrame:
    """Pearson correlation of average ranks, taken per pair of columns over its complete rows.

    All pairs are one long frame and go through the same few jobs, however many there are. Equal pairs of values
    travel once with their number. A rank is a running sum within a bucket of values plus the lower buckets;
    buckets are cut at the quantiles of a column, so no task ranks a whole column.
    """
    spark, k = df.sparkSession, len(columns)
    itself = spark.createDataFrame([(c, c, 1.0) for c in columns], "col_a string, col_b string, corr double")
    if k < 2:
        return itself
    rows = df.select(F.array(*[to_number(df, c) for c in columns]).alias("x"))
    probabilities = [i / buckets for i in range(1, buckets)]
    found = rows.agg(*[
        F.percentile_approx(F.get("x", F.lit(i)), probabilities, 10 * buckets).alias(f"c{i}") for i in range(k)
    ]).first()
    # A row per column of the schema, of at most ``buckets`` numbers.
    steps = spark.createDataFrame(
        [(i, sorted(set(found[f"c{i}"] or []))) for i in range(k)], "of int, steps array<double>"
    )
    pairs = rows.select("x", F.explode(F.sequence(F.lit(0), F.lit(k - 2))).alias("a"))
    pairs = pairs.select("x", "a", F.explode(F.sequence(F.col("a") + 1, F.lit(k - 1))).alias("b"))
    pairs = pairs.select("a", "b", F.get("x", F.col("a")).alias("u"), F.get("x", F.col("b")).alias("v"))
    pairs = pairs.where("u IS NOT NULL AND v IS NOT NULL").groupBy("a", "b", "u", "v").agg(F.count(F.lit(1)).alias("copies"))
    pairs = stage(pairs, "value-pairs")

    sides = F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(value).alias("value"), F.col(of).alias("of"))
        for side, value, of in ((0, "u", "a"), (1, "v", "b"))
    ])
    values = pairs.select("a", "b", "copies", F.inline(sides)).groupBy("a", "b", "side", "of", "value").agg(
        F.sum("copies").alias("weight"), F.count("copies").alias("rows")
    )
    values = values.join(F.broadcast(steps), "of").select(
        "a", "b", "side", "value", "weight", "rows", F.size(F.filter("steps", lambda s: s < F.col("value"))).alias("bucket")
    )
    values = stage(values, "pair-values")
    of_side = ["a", "b", "side"]
    sizes = values.groupBy(*of_side, "bucket").agg(F.sum("weight").alias("size"), F.count("value").alias("held"))
    upto = Window.partitionBy(*of_side).orderBy("bucket")  # at most ``buckets`` rows
    sizes = sizes.withColumn("below", F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sizes = stage(sizes, "bucket-sizes")
    within = Window.partitionBy(*of_side, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = attach(values, sizes.drop("size"), [*of_side, "bucket"], "held").withColumn("upto", F.sum("weight").over(within))
    rank = F.col("below") + F.col("upto") - (F.col("weight") - 1) / 2.0
    ranked = stage(ranked.select(*of_side, "value", rank.alias("rank"), "rows"), "ranks")
    for side, value, name in ((0, "u", "rank_u"), (1, "v", "rank_v")):
        of_value = ranked.where(F.col("side") == side).select(
            "a", "b", F.col("value").alias(value), F.col("rank").alias(name), "rows"
        )
        pairs = attach(pairs, of_value, ["a", "b", value], "rows")
    totals = sizes.where("side = 0").groupBy("a", "b").agg(F.sum("size").alias("n"))  # a row per pair of columns
    w, middle = F.col("copies"), (F.col("n") + 1) / 2
    ru, rv = F.col("rank_u") - middle, F.col("rank_v") - middle
    spread = F.sqrt(F.sum(w * ru * ru)) * F.sqrt(F.sum(w * rv * rv))
    corr = pairs.join(F.broadcast(totals), ["a", "b"]).groupBy("a", "b").agg(F.try_divide(F.sum(w * ru * rv), spread).alias("corr"))
    names = F.array(*[F.lit(c) for c in columns])
    every = spark.createDataFrame([(a, b) for a, b in combinations(range(k), 2)], "a int, b int")
    both = every.join(corr, ["a", "b"], "left").select(
        F.get(names, F.col("a")).alias("one"), F.get(names, F.col("b")).alias("other"), "corr"
    )
    ways = F.array(*[F.struct(F.col(p).alias("col_a"), F.col(q).alias("col_b")) for p, q in (("one", "other"), ("other", "one"))])
    return itself.unionByName(both.select(F.inline(ways), "corr"))
