"""Numeric column expressions: coercion, unit price, target transform, sample moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.functions.text import decimal_or_null
from plinth.schemas import require_columns

# Fixed value: one lakh in rupees.
LAKH = 100000.0


def missing_as_null(c: Column, data_type: T.DataType) -> Column:
    """NaN counts as missing, and Spark would otherwise sort it above every number."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.nanvl(c, F.lit(None).cast(data_type))
    return c


def to_number(df: DataFrame, name: str) -> Column:
    """Column as a double; text that is not a number becomes NULL."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.StringType):
        return decimal_or_null(F.col(name))
    return missing_as_null(F.col(name), data_type).cast("double")


def price_per_unit(df: DataFrame, price: str = "price", size: str = "total_sqft", scale: float = LAKH) -> Column:
    """Price per unit of size, for market analytics only: it leaks the target into a model."""
    require_columns(df, price, size)
    return F.try_divide(F.col(price).cast("double") * scale, F.col(size).cast("double"))


def transform_target(c: Column, strategy: str = "log1p") -> Column:
    if strategy == "log1p":
        return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))
    if strategy == "identity":
        return c
    raise ValueError(f"unknown target transformation strategy: {strategy}")


def inverse_target(c: Column, strategy: str = "log1p") -> Column:
    if strategy == "log1p":
        return F.when(c.isNotNull(), F.greatest(F.expm1(c), F.lit(0.0)))
    if strategy == "identity":
        return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    raise ValueError(f"unknown target transformation strategy: {strategy}")


def round_half_even(c: Column, digits: int = 2) -> Column:
    power = float(10**digits)
    return F.rint(c * power) / power


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness (G1); 0 for a constant column, NULL below three values."""
    n = F.count(c).cast("double")
    adjusted = F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n >= 3, F.coalesce(adjusted, F.lit(0.0)))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis (G2); 0 for a constant column, NULL below four values."""
    n = F.count(c).cast("double")
    spread = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    adjusted = (n - 1) / spread * ((n + 1) * F.kurtosis(c) + 6.0)
    return F.when(n >= 4, F.coalesce(adjusted, F.lit(0.0)))
