"""Schemas and column groups of the listing data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RAW_LISTING = T.StructType([
    T.StructField("area_type", T.StringType()),
    T.StructField("availability", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("society", T.StringType()),
    T.StructField("total_sqft", T.StringType()),
    T.StructField("bath", T.DoubleType()),
    T.StructField("balcony", T.DoubleType()),
    T.StructField("price", T.DoubleType()),
])

CLEAN_LISTING = T.StructType([
    T.StructField("location", T.StringType()),
    T.StructField("total_sqft", T.DoubleType()),
    T.StructField("bath", T.IntegerType()),
    T.StructField("balcony", T.IntegerType()),
    T.StructField("bhk", T.IntegerType()),
    T.StructField("area_type", T.StringType()),
    T.StructField("availability_status", T.StringType()),
    T.StructField("price", T.DoubleType()),
])

# Names the model pipeline and its reports are keyed by.
RAW_NUMERIC = ["total_sqft", "bath", "balcony", "bhk"]
ENGINEERED = ["total_rooms", "sqft_per_bhk", "bath_per_bhk", "sqft_per_room", "bhk_bath_diff"]
CATEGORICAL = ["location", "area_type", "availability_status"]
TARGET = "price"
OTHER = "Other"
READY = "Ready To Move"
UNDER_CONSTRUCTION = "Under Construction"
DEFAULT_AREA_TYPE = "Super built-up Area"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
