"""Load, audit, clean, audit again: the quality report of a raw listing table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.cleaning import clean_listings
from plinth.operators.market import top_categories
from plinth.operators.profiling import target_statistics
from plinth.operators.quality import inspect, validation_report
from plinth.schemas import TARGET
from plinth.sources.tables import write_report, write_table
from plinth.staging import stage

REQUIRED = ("location", "total_sqft", "price")


def quality_report(
    raw: DataFrame, required: Sequence[str] = REQUIRED, clean_path: str | None = None, report_path: str | None = None,
    mode: str = "error",
) -> dict[str, DataFrame]:
    """The clean table and one report frame for everything learned on the way; written where paths are given."""
    raw = stage(raw, "raw")
    clean, cleaning = clean_listings(raw)
    clean = stage(clean, "clean")

    def tagged(report: DataFrame, prefix: str) -> DataFrame:
        return report.withColumn("section", F.concat(F.lit(f"{prefix}."), "section"))

    def as_report(df: DataFrame, section: str, column: str | None = None) -> DataFrame:
        metrics = [c for c in df.columns if c != column and dict(df.dtypes)[c] in ("int", "bigint", "double")]
        cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        name = F.col(column) if column else F.lit(None).cast("string")
        return df.select(
            F.lit(section).alias("section"), name.alias("column_name"), F.inline(F.array(*cells)),
            F.lit(None).cast("string").alias("detail"),
        )

    parts = [
        tagged(inspect(raw), "raw"),
        tagged(validation_report(raw, required), "raw"),
        as_report(cleaning, "cleaning"),
        tagged(inspect(clean), "cleaned"),
        tagged(validation_report(clean, required), "cleaned"),
        as_report(target_statistics(clean, TARGET).select("mean", "median", "std", "min", "max", "skewness"), "target"),
        as_report(top_categories(clean, "location"), "top_locations", "location"),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    report = stage(report, "report")
    if clean_path:
        write_table(clean, clean_path, mode=mode)
    if report_path:
        write_report(report, report_path, mode)
    return {"clean": clean, "cleaning": cleaning, "report": report}
