"""Structure and quality audits. Every audit of a table is one or two wide aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.numeric import missing_as_null, to_number
from plinth.operators.quantiles import quantiles
from plinth.schemas import numeric_columns

CRITICAL = ("price", "location")
REPORT_COLUMNS = "section string, column_name string, metric string, value double, detail string"


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: ``column_name, data_type, row_count, missing_count, missing_pct``."""
    gaps = [
        F.count_if(missing_as_null(F.col(f"`{f.name}`"), f.dataType).isNull()).alias(f.name)
        for f in df.schema.fields
    ]
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *gaps)
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"`{f.name}`").alias("missing_count"),
        )
        for i, f in enumerate(df.schema.fields)
    ])
    long = wide.select(F.col("__rows").alias("row_count"), F.inline(cells))
    return long.select(
        "position", "column_name", "data_type", "row_count", "missing_count",
        _percent(F.col("missing_count"), F.col("row_count")).alias("missing_pct"),
    )


def missing_values(df: DataFrame, critical: Sequence[str] = ()) -> DataFrame:
    """Columns with missing cells, and whether they are critical."""
    return (
        null_counts(df)
        .filter("missing_count > 0")
        .select("column_name", "missing_count", "missing_pct", F.col("column_name").isin(*critical).alias("critical"))
    )


def copies_per_row(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows with their number of copies; NULL equals NULL and NaN equals NaN.

    Equal rows meet in the map-side combine, so one row repeated a billion times is cheap.
    """
    names = [F.col("`" + c.replace("`", "``") + "`") for c in subset or df.columns]
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))


def duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: ``row_count, duplicate_count, duplicate_pct``; a repeat of an earlier row is a duplicate."""
    counted = copies_per_row(df, subset).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_count"),
    )
    return counted.withColumn("duplicate_pct", _percent(F.col("duplicate_count"), F.col("row_count")))


def listing_rules(df: DataFrame) -> dict[str, Column]:
    """Impossible-value rules for the listing columns that ``df`` has."""
    has = set(df.columns).issuperset
    rules = {}
    if has({"price"}):
        rules["non_positive_price_count"] = to_number(df, "price") <= 0
    if has({"bath", "bhk"}):
        rules["excessive_bathrooms_count"] = to_number(df, "bath") > to_number(df, "bhk") + 3
    if has({"total_sqft"}):
        rules["non_positive_sqft_count"] = to_number(df, "total_sqft") <= 0
    if has({"bhk"}):
        rules["non_positive_bhk_count"] = to_number(df, "bhk") <= 0
    return rules


def impossible_values(df: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """``(rule, violations)`` for each violated rule; a comparison with NULL is no violation."""
    rules = listing_rules(df) if rules is None else rules
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, violations long")
    wide = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    cells = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations")) for name in rules
    ])
    return wide.select(F.inline(cells)).filter("violations > 0")


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5, **sizing) -> DataFrame:
    """Quartiles, Tukey fences and the count of values strictly outside them, per numeric column.

    Columns that are absent or hold no number are left out. ``sizing`` goes to ``quantiles``.
    """
    columns = numeric_columns(df) if columns is None else [c for c in columns if c in df.columns]
    if not columns:
        schema = (
            "column_name string, n long, q1 double, q3 double, iqr double, "
            "lower_bound double, upper_bound double, outlier_count long, outlier_pct double"
        )
        return df.sparkSession.createDataFrame([], schema)
    spread = F.col("q3") - F.col("q1")
    fences = quantiles(df, columns, [0.25, 0.75], **sizing).select(
        "column_name", "n", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3")
    )
    fences = fences.select(
        "*", spread.alias("iqr"),
        (F.col("q1") - factor * spread).alias("lower_bound"),
        (F.col("q3") + factor * spread).alias("upper_bound"),
    )
    # One row per column: the fences travel as literals and the count is one codegen pass.
    found = fences.collect()
    fences = df.sparkSession.createDataFrame(found, fences.schema)
    outside = [
        F.count_if((to_number(df, f.column_name) < f.lower_bound) | (to_number(df, f.column_name) > f.upper_bound))
        .alias(f.column_name)
        for f in found
    ]
    if not outside:
        return fences.withColumns({"outlier_count": F.lit(0).cast("long"), "outlier_pct": F.lit(0.0)})
    counted = df.agg(*outside)
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("outlier_count")) for c in counted.columns
    ])
    return fences.join(F.broadcast(counted.select(F.inline(cells))), "column_name").withColumn(
        "outlier_pct", _percent(F.col("outlier_count"), F.col("n"))
    )


def schema_check(df: DataFrame, required: Sequence[str]) -> dict:
    missing = [c for c in required if c not in df.columns]
    return {"valid": not missing, "missing_required_columns": missing, "existing_columns": list(df.columns)}


def _report(df: DataFrame, section: str, column: Column, metrics: Mapping[str, Column]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(name).alias("metric"), c.cast("double").alias("value")) for name, c in metrics.items()
    ])
    return df.select(
        F.lit(section).alias("section"), column.cast("string").alias("column_name"),
        F.inline(cells), F.lit(None).cast("string").alias("detail"),
    )


def inspect(df: DataFrame) -> DataFrame:
    """Shape, types, missing cells and duplicates in report form ``section, column_name, metric, value, detail``."""
    per_column = null_counts(df)
    columns = _report(
        per_column, "inspect", F.col("column_name"),
        {"missing_count": F.col("missing_count"), "missing_pct": F.col("missing_pct")},
    )
    types = df.sparkSession.createDataFrame(
        [("inspect", f.name, "data_type", float(i), f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        REPORT_COLUMNS,
    )
    table = _report(
        duplicates(df), "inspect", F.lit(None),
        {
            "row_count": F.col("row_count"),
            "column_count": F.lit(len(df.columns)),
            "duplicate_count": F.col("duplicate_count"),
        },
    )
    return table.unionByName(types).unionByName(columns)


def validation_report(
    df: DataFrame, required: Sequence[str] = (), critical: Sequence[str] = CRITICAL, factor: float = 1.5
) -> DataFrame:
    """All audits of one table in report form. Valid means: schema complete, no critical cell missing."""
    spark = df.sparkSession
    schema = schema_check(df, required)
    gaps = null_counts(df)
    # One row per column, read by two parts of the report.
    gaps = spark.createDataFrame(gaps.collect(), gaps.schema)
    is_gap = F.col("missing_count") > 0
    summary = gaps.agg(
        F.max("row_count").alias("rows"),
        F.sum("missing_count").alias("cells"),
        F.count_if(is_gap & F.col("column_name").isin(*critical)).alias("critical"),
    )
    parts = [
        _report(summary, "validation", F.lit(None), {
            "is_valid": (F.lit(schema["valid"]) & (F.col("critical") == 0)).cast("int"),
            "total_rows": F.col("rows"),
            "total_columns": F.lit(len(df.columns)),
            "total_missing_cells": F.col("cells"),
        }),
        spark.createDataFrame(
            [("schema", c, "missing_required_column", 1.0, None) for c in schema["missing_required_columns"]],
            REPORT_COLUMNS,
        ),
        _report(gaps.filter(is_gap), "missing", F.col("column_name"), {
            "missing_count": F.col("missing_count"),
            "missing_pct": F.col("missing_pct"),
            "critical": F.col("column_name").isin(*critical).cast("int"),
        }),
        _report(duplicates(df), "duplicates", F.lit(None), {
            "duplicate_count": F.col("duplicate_count"), "duplicate_pct": F.col("duplicate_pct"),
        }),
        _report(impossible_values(df), "impossible", F.col("rule"), {"violations": F.col("violations")}),
        _report(iqr_outliers(df, factor=factor), "outliers", F.col("column_name"), {
            name: F.col(name)
            for name in ("q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_count", "outlier_pct")
        }),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
