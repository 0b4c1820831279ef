"""Market analytics: group price rankings, locality lists, market snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.numeric import price_per_unit
from plinth.operators.attach import attach
from plinth.operators.quantiles import quantiles
from plinth.schemas import TARGET
from plinth.staging import stage

UNIT_PRICE = "price_per_sqft"


def with_unit_price(df: DataFrame, price: str = TARGET, size: str = "total_sqft") -> DataFrame:
    if UNIT_PRICE in df.columns or size not in df.columns:
        return df
    return df.withColumn(UNIT_PRICE, price_per_unit(df, price, size))


def _median_of(stats: DataFrame, by: Sequence[str], column: str, names: dict[str, str]) -> DataFrame:
    picked = {"median": F.get("q", F.lit(0)), "count": F.col("n"), "mean": F.col("mean")}
    return stats.filter(F.col("column_name") == column).select(
        *by, *[picked[kind].alias(name) for kind, name in names.items()]
    )


def group_statistics(
    df: DataFrame, by: str = "location", price: str = TARGET, unit_price: str = UNIT_PRICE, **sizing
) -> DataFrame:
    """Per group: count, median and mean price, median and mean unit price. NULL groups are left out."""
    stats = quantiles(df, [price, unit_price], [0.5], by=[by], extra={"mean": F.avg("value")}, **sizing)
    pick = F.get("q", F.lit(0))

    def of(column: str, value: Column) -> Column:
        return F.max(F.when(F.col("column_name") == column, value))

    return stats.groupBy(by).agg(
        F.coalesce(of(price, F.col("n")), F.lit(0).cast("long")).alias("listing_count"),
        of(price, pick).alias("median_price"),
        of(price, F.col("mean")).alias("mean_price"),
        of(unit_price, pick).alias("median_price_per_sqft"),
        of(unit_price, F.col("mean")).alias("mean_price_per_sqft"),
    )


def with_support(stats: DataFrame, min_listings: int = 15, count: str = "listing_count") -> DataFrame:
    return stats.filter(F.col(count) >= min_listings)


def top_groups(stats: DataFrame, measure: str, by: str, n: int = 15, ascending: bool = False) -> DataFrame:
    """The ``n`` groups with the highest (or lowest) measure; ties go by group key."""
    order = F.col(measure).asc_nulls_last() if ascending else F.col(measure).desc_nulls_last()
    return stats.orderBy(order, F.col(by).asc()).limit(n)


def location_statistics(
    df: DataFrame, by: str = "location", min_listings: int = 15, n: int = 15, price: str = TARGET,
    size: str = "total_sqft", **sizing
) -> dict[str, DataFrame]:
    """Group table with enough support, its most expensive and most affordable groups, and the counts.

    Empty when the group or price column is missing.
    """
    if by not in df.columns or price not in df.columns:
        return {}
    stats = stage(group_statistics(with_unit_price(df, price, size), by, price, **sizing), "groups")
    qualified = with_support(stats, min_listings)
    counts = stats.agg(
        F.count(F.lit(1)).alias("total_unique"),
        F.count_if(F.col("listing_count") >= min_listings).alias("qualified_count"),
    )
    return {
        "counts": counts,
        "qualified": qualified,
        "expensive": top_groups(qualified, "median_price_per_sqft", by, n),
        "affordable": top_groups(qualified, "median_price_per_sqft", by, n, ascending=True),
    }


def frequent_groups_only(df: DataFrame, by: str, min_rows: int = 15) -> DataFrame:
    """Rows whose group has at least ``min_rows`` rows, null prices included."""
    sizes = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("group_rows"))
    return attach(df, stage(sizes.filter(F.col("group_rows") >= min_rows), "groups"), [by], "group_rows")


def market_by_group(df: DataFrame, by: str = "location", price: str = TARGET, **sizing) -> DataFrame:
    """Per group: all rows (null prices count), median and mean price."""
    sizes = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("properties"))
    stats = quantiles(df, [price], [0.5], by=[by], extra={"mean": F.avg("value")}, **sizing)
    prices = stats.select(by, F.get("q", F.lit(0)).alias("median_price"), F.col("mean").alias("mean_price"))
    return sizes.join(prices, by, "left")


def market_summary(df: DataFrame, by: str = "location", price: str = TARGET, n: int = 15, **sizing) -> DataFrame:
    """Top groups by median price; no minimum support is asked."""
    return top_groups(market_by_group(df, by, price, **sizing), "median_price", by, n)


def market_snapshot(df: DataFrame, by: str = "location", price: str = TARGET, **sizing) -> DataFrame:
    """``(metric, value)``: records, median and mean price, number of groups."""

    def metrics(one_row: DataFrame, **values: Column) -> DataFrame:
        cells = [F.struct(F.lit(name).alias("metric"), c.cast("double").alias("value")) for name, c in values.items()]
        return one_row.select(F.inline(F.array(*cells)))

    rows = metrics(df.agg(F.count(F.lit(1)).alias("n")), records=F.col("n"))
    groups = metrics(df.select(by).dropna().distinct().agg(F.count(F.lit(1)).alias("n")), localities=F.col("n"))
    prices = quantiles(df, [price], [0.5], extra={"mean": F.avg("value")}, **sizing)
    prices = metrics(prices, median_price=F.get("q", F.lit(0)), mean_price=F.col("mean"))
    return rows.unionByName(prices).unionByName(groups)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values."""
    return df.select(column).dropna().distinct().orderBy(column)


def top_categories(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("frequency"))
    return counts.orderBy(F.col("frequency").desc(), F.col(column).asc()).limit(n)
