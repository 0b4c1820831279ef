"""Cleaning of raw listings: dedup, parse, fold, impute, filter, with a report of what was removed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import text
from plinth.functions.numeric import missing_as_null
from plinth.operators.attach import attach
from plinth.operators.quality import copies_per_row
from plinth.operators.quantiles import quantiles
from plinth.schemas import CLEAN_LISTING, DEFAULT_AREA_TYPE, OTHER, READY, require_columns
from plinth.staging import stage

KEPT, NULL_ESSENTIAL, ANOMALY = "kept", "null_essential", "anomaly"


def fold_rare(df: DataFrame, column: str, min_count: int = 10, other: str = OTHER) -> DataFrame:
    """Replace categories with fewer than ``min_count`` rows by ``other``. Stage ``df`` first if expensive."""
    frequent = category_counts(df, column).filter(F.col("category_rows") >= min_count)
    return apply_fold(df, stage(frequent, "frequent"), column, other)


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("category_rows"))


def apply_fold(df: DataFrame, frequent: DataFrame, column: str, other: str = OTHER) -> DataFrame:
    """Keep the categories listed in ``frequent (column, category_rows)``, fold all others."""
    marked = attach(df, frequent.withColumn("is_frequent", F.lit(True)), [column], "category_rows", how="left")
    folded = F.when(F.col("is_frequent"), F.col(column)).otherwise(F.lit(other))
    return marked.withColumn(column, folded).select(*df.columns)


def group_medians(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """``(by, rows, <column>_median …)``: exact medians per group, one row per group with any value."""
    long = quantiles(df, columns, [0.5], by=[by])
    medians = [
        F.max(F.when(F.col("column_name") == c, F.get("q", F.lit(0)))).alias(f"{c}_median") for c in columns
    ]
    return long.groupBy(by).agg(F.max("n").alias("group_rows"), *medians)


def impute_group_median(
    df: DataFrame, by: str, fallbacks: Mapping[str, Column], votes: DataFrame | None = None
) -> DataFrame:
    """Fill NULLs with the median of the row's group, else the fallback; truncate to int.

    The medians come from ``votes`` (default: ``df`` itself).
    """
    medians = stage(group_medians(df if votes is None else votes, list(fallbacks), by), "medians")
    filled = attach(df, medians, [by], "group_rows", how="left")
    for column, fallback in fallbacks.items():
        value = F.coalesce(F.col(column).cast("double"), F.col(f"{column}_median"), fallback.cast("double"))
        filled = filled.withColumn(column, value.cast("int"))
    return filled.select(*df.columns)


def domain_mask() -> Column:
    """Rows a clean listing table may hold; unknown counts as no."""
    bhk, sqft = F.col("bhk"), F.col("total_sqft")
    roomy = F.when(bhk == 0, sqft > 0).otherwise(F.try_divide(sqft, bhk) >= 200)
    mask = roomy & (sqft <= 25000) & (F.col("bath") <= bhk + 2) & (F.col("price") > 0) & (bhk <= 12)
    return F.coalesce(mask, F.lit(False))


def parse_listings(df: DataFrame) -> DataFrame:
    """Typed, normalised columns from the raw text; defaults stand in for absent columns."""
    has = set(df.columns).__contains__
    if has("size"):
        bhk = text.parse_count(F.col("size"))
    else:
        bhk = F.col("bhk").try_cast("int") if has("bhk") else F.lit(2)
    out = {
        "bhk": bhk,
        "total_sqft": text.parse_area(F.col("total_sqft").cast("string")),
        "availability_status": text.clean_status(F.col("availability")) if has("availability") else F.lit(READY),
        "location": text.normalize_location(F.col("location")) if has("location") else F.lit(OTHER),
        "area_type": text.default_area_type(F.col("area_type")) if has("area_type") else F.lit(DEFAULT_AREA_TYPE),
    }
    out |= {c: missing_as_null(F.col(c), df.schema[c].dataType).cast("double") for c in ("bath", "balcony", "price")}
    return df.withColumns(out)


def judge_listings(
    df: DataFrame, min_location_frequency: int = 10, remove_duplicates: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """Parsed, folded and imputed rows, each with its verdict and its number of raw copies.

    Stages the parsed rows once, then needs two small aggregates (location counts, bhk
    medians) whose results are attached to the rows. ``keep`` names extra columns to carry.
    """
    require_columns(df, "total_sqft", "bath", "balcony", "price")
    rows = copies_per_row(df) if remove_duplicates else df.withColumn("copies", F.lit(1).cast("long"))
    final = CLEAN_LISTING.names
    parsed = stage(parse_listings(rows).select(*keep, *final, "copies"), "parsed")
    folded = fold_rare(parsed, "location", min_location_frequency)
    essential = F.col("bhk").isNotNull() & F.col("total_sqft").isNotNull() & F.col("price").isNotNull()
    # Rows lacking an essential field do not vote on the medians.
    votes = parsed.filter(essential).select("bhk", "bath", "balcony")
    filled = impute_group_median(folded, "bhk", {"bath": F.col("bhk"), "balcony": F.lit(1)}, votes)
    verdict = F.when(~essential, NULL_ESSENTIAL).when(~domain_mask(), ANOMALY).otherwise(KEPT)
    return filled.select(*keep, *final, "copies", verdict.alias("verdict"))


def clean_rows(judged: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return judged.filter(F.col("verdict") == KEPT).select(*keep, *CLEAN_LISTING.names)


def clean_report(judged: DataFrame) -> DataFrame:
    """One row: what came in, what each step removed, what is left."""
    counts = judged.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("initial_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count_if(F.col("verdict") == NULL_ESSENTIAL).alias("dropped_null_essentials"),
        F.count_if(F.col("verdict") == ANOMALY).alias("domain_anomalies_filtered"),
        F.count_if(F.col("verdict") == KEPT).alias("final_cleaned_rows"),
    )
    retention = F.try_divide(F.col("final_cleaned_rows") * 100.0, F.col("initial_rows"))
    return counts.withColumns({
        "final_columns": F.array(*[F.lit(c) for c in CLEAN_LISTING.names]),
        "data_retention_rate_pct": retention,
    })


def clean_listings(
    df: DataFrame, min_location_frequency: int = 10, remove_duplicates: bool = True, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Clean listing table and its one-row cleaning report; both read the same staged rows."""
    judged = judge_listings(df, min_location_frequency, remove_duplicates, keep)
    return clean_rows(judged, keep), clean_report(judged)
