"""The small tables behind the charts: histograms, box statistics, binned scatter, bar rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.numeric import to_number
from plinth.operators.attach import attach
from plinth.operators.market import UNIT_PRICE, frequent_groups_only, top_groups, with_unit_price
from plinth.operators.profiling import correlation_matrix
from plinth.operators.quantiles import quantiles
from plinth.schemas import TARGET
from plinth.staging import stage

# What the charts show.
PRICE_BINS = 40
UNIT_PRICE_BINS = 50
UNIT_PRICE_RANGE = (1000, 30000)
SCATTER_MAX_SQFT = 6000
BOX_RANGE = (1, 6)
HEATMAP_COLUMNS = ["total_sqft", "bath", "balcony", "bhk", "price"]
BAR_MIN_ROWS = 15
BAR_GROUPS = 15


def histogram(df: DataFrame, column: str, bins: int, transform=None) -> DataFrame:
    """``bin, bin_start, bin_end, frequency`` of ``bins`` equal bins over the value range; the last bin is closed.

    ``transform`` maps the numeric column first, e.g. ``F.log1p``. Empty bins are present.
    """
    value = to_number(df, column)
    value = value if transform is None else transform(value)
    data = df.select(value.alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")
    # One row; the range travels to the count as literals.
    low, high = data.agg(F.min("value"), F.max("value")).first()
    schema = "bin long, bin_start double, bin_end double, frequency long"
    if low is None:
        return df.sparkSession.createDataFrame([], schema)
    if low == high:
        low, high = low - 0.5, high + 0.5
    place = F.floor((F.col("value") - low) * bins / (high - low))
    counts = data.groupBy(F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("frequency"))
    width = (high - low) / bins
    all_bins = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"), (low + F.col("id") * width).alias("bin_start"),
        (low + (F.col("id") + 1) * width).alias("bin_end"),
    )
    # At most `bins` rows on either side.
    return all_bins.join(F.broadcast(counts), "bin", "left").fillna(0, ["frequency"])


def histogram_median(df: DataFrame, column: str, **sizing) -> DataFrame:
    """One row ``column_name, n, median``: the line drawn into a histogram."""
    return quantiles(df, [column], [0.5], **sizing).select("column_name", "n", F.get("q", F.lit(0)).alias("median"))


def box_stats(df: DataFrame, by: str, value: str = TARGET, factor: float = 1.5, **sizing) -> DataFrame:
    """Per group: count, mean, quartiles and whiskers (extreme values within ``factor`` IQR of the box)."""
    stats = quantiles(df, [value], [0.25, 0.5, 0.75], by=[by], extra={"mean": F.avg("value")}, **sizing)
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(2))
    boxes = stats.select(
        by, F.col("n").alias("count"), "mean", q1.alias("q1"), F.get("q", F.lit(1)).alias("median"), q3.alias("q3"),
        (q1 - factor * (q3 - q1)).alias("low_fence"), (q3 + factor * (q3 - q1)).alias("high_fence"),
    )
    boxes = stage(boxes, "boxes")
    fences = boxes.select(by, "low_fence", "high_fence", F.col("count").alias("group_rows"))
    rows = attach(df.select(by, to_number(df, value).alias("value")), fences, [by], "group_rows")
    inside = F.when(F.col("value").between(F.col("low_fence"), F.col("high_fence")), F.col("value"))
    whiskers = rows.groupBy(by).agg(
        F.min(inside).alias("low_inside"), F.max(inside).alias("high_inside"),
        F.count_if((F.col("value") < F.col("low_fence")) | (F.col("value") > F.col("high_fence"))).alias("outliers"),
    )
    # A whisker never ends inside the box.
    return boxes.join(whiskers, by).select(
        by, "count", "mean", "q1", "median", "q3",
        F.least("q1", F.coalesce("low_inside", "q1")).alias("whisker_low"),
        F.greatest("q3", F.coalesce("high_inside", "q3")).alias("whisker_high"),
        "outliers",
    )


def binned_scatter(df: DataFrame, x: str, y: str, hue: str, x_width: float, y_width: float) -> DataFrame:
    """Point counts on an x-y grid per hue: a scatter plot that stays small however many points there are."""
    grid = [
        F.floor(to_number(df, x) / x_width).alias("x_bin"), F.floor(to_number(df, y) / y_width).alias("y_bin"),
        F.col(hue),
    ]
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*grid).agg(
        F.count(F.lit(1)).alias("points"), F.avg(to_number(df, y)).alias("mean_y")
    )


def bar_ranking(df: DataFrame, by: str, value: str, min_rows: int = BAR_MIN_ROWS, n: int = BAR_GROUPS, **sizing) -> DataFrame:
    """The ``n`` groups with at least ``min_rows`` rows that have the highest median of ``value``."""
    rows = frequent_groups_only(df, by, min_rows)
    stats = quantiles(rows, [value], [0.5], by=[by], **sizing).select(by, F.get("q", F.lit(0)).alias("median_value"))
    return top_groups(stats, "median_value", by, n)


def in_range(column: str, bounds: tuple) -> Column:
    return F.col(column).between(*bounds)


def chart_tables(df: DataFrame) -> dict[str, DataFrame]:
    """All chart tables of a clean listing table that its columns allow. Stage ``df`` first."""
    df = with_unit_price(df)
    has = set(df.columns).issuperset
    tables = {
        "price_histogram": histogram(df, TARGET, PRICE_BINS),
        "price_median": histogram_median(df, TARGET),
        "log_price_histogram": histogram(df, TARGET, PRICE_BINS, F.log1p),
        "correlation_heatmap": correlation_matrix(df, HEATMAP_COLUMNS),
    }
    if has({"total_sqft", "bhk"}):
        small = df.filter(F.col("total_sqft") <= SCATTER_MAX_SQFT)
        tables["area_vs_price"] = binned_scatter(small, "total_sqft", TARGET, "bhk", 100.0, 10.0)
    for column in ("bhk", "bath"):
        if has({column}):
            tables[f"price_by_{column}"] = box_stats(df.filter(in_range(column, BOX_RANGE)), column)
    for column in ("area_type", "availability_status"):
        if has({column}):
            tables[f"price_by_{column}"] = box_stats(df, column)
    if has({UNIT_PRICE}):
        shown = df.filter(in_range(UNIT_PRICE, UNIT_PRICE_RANGE))
        tables["unit_price_histogram"] = histogram(shown, UNIT_PRICE, UNIT_PRICE_BINS)
        tables["unit_price_median"] = histogram_median(shown, UNIT_PRICE)
    if has({"location"}):
        tables["top_price_locations"] = bar_ranking(df, "location", TARGET)
        if has({UNIT_PRICE}):
            tables["top_unit_price_locations"] = bar_ranking(df, "location", UNIT_PRICE)
    return tables
