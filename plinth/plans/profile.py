"""Full exploratory profile of a clean listing table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plinth.operators import charts, market, profiling, quality
from plinth.schemas import TARGET
from plinth.staging import stage


def run_profile(df: DataFrame, min_listings: int = 15) -> dict:
    """Overview, statistics, rankings, outliers and the data behind every chart; the table is staged once."""
    df = stage(df, "profile")
    return {
        "overview": profiling.dataset_overview(df),
        "target_statistics": profiling.target_statistics(df, TARGET),
        "numerical_summaries": profiling.numeric_summary(df),
        "categorical_summaries": profiling.category_summary(df, target=TARGET),
        "correlation_matrix": profiling.correlation_matrix(df),
        "location_insights": market.location_statistics(df, min_listings=min_listings),
        "outlier_analysis": quality.iqr_outliers(df),
        "charts": charts.chart_tables(df),
    }
