import pytest
from pyspark.sql import functions as F

from plinth.operators import quality

SCHEMA = "location string, total_sqft double, price double, bhk int, bath int, balcony double"


@pytest.fixture(scope="module")
def tidy(spark):
    rows = [("A", 1000.0, 50.0, 2, 2, 1.0), ("B", 1200.0, 60.0, 2, 2, 1.0), ("C", 1500.0, 80.0, 3, 3, 2.0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [
        (None, 1000.0, 50.0, 2, 8, float("nan")), ("B", -10.0, 60.0, 2, 2, 1.0), ("C", 0.0, 0.0, -1, 1, None),
        ("C", 900.0, 45.0, 2, 2, 1.0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_schema_check(tidy):
    assert quality.schema_check(tidy, ["price"])["valid"]
    result = quality.schema_check(tidy, ["price", "society"])
    assert not result["valid"] and result["missing_required_columns"] == ["society"]


def test_missing_values_count_nan_and_null(dirty):
    rows = {r.column_name: r for r in quality.missing_values(dirty, ["price", "location"]).collect()}
    assert set(rows) == {"location", "balcony"}
    assert rows["balcony"].missing_count == 2 and rows["balcony"].missing_pct == 50.0 and not rows["balcony"].critical
    assert rows["location"].critical


def test_missing_values_of_empty_table(spark):
    assert quality.missing_values(spark.createDataFrame([], SCHEMA)).count() == 0


def test_duplicates(spark, tidy):
    assert quality.duplicates(tidy).first().duplicate_count == 0
    doubled = quality.duplicates(tidy.union(tidy.limit(1))).first()
    assert (doubled.duplicate_count, doubled.duplicate_pct) == (1, 25.0)
    odd = spark.createDataFrame([(None, float("nan")), (None, float("nan")), (1, 0.0)], "a int, b double")
    assert quality.duplicates(odd).first().duplicate_count == 1
    assert quality.duplicates(odd, ["a"]).first().duplicate_count == 1


def test_impossible_values(spark, tidy, dirty):
    assert quality.impossible_values(tidy).count() == 0
    assert {r.rule: r.violations for r in quality.impossible_values(dirty).collect()} == {
        "non_positive_price_count": 1, "excessive_bathrooms_count": 1, "non_positive_sqft_count": 2,
        "non_positive_bhk_count": 1,
    }
    text = spark.createDataFrame([("-3",), ("many",), (None,)], "price string")
    assert quality.impossible_values(text).first().violations == 1
    assert quality.impossible_values(spark.createDataFrame([(1,)], "z int")).count() == 0


def test_iqr_outliers(spark):
    df = spark.createDataFrame([(x, "t", None) for x in (10.0, 12.0, 11.0, 13.0, 12.5, 11.8, 500.0)], "price double, s string, e double")
    for sizing in ({}, {"sort_rows": 3}):
        rows = quality.iqr_outliers(df, **sizing).collect()
        assert [(r.column_name, r.outlier_count) for r in rows] == [("price", 1)]
    assert quality.iqr_outliers(df, ["absent", "price"]).count() == 1
    assert quality.iqr_outliers(df, ["e"]).count() == 0


def test_validation_report(tidy, dirty):
    def metric(df, required=("location", "price")):
        rows = quality.validation_report(df, required).collect()
        return {(r.section, r.column_name, r.metric): r.value for r in rows}

    good, bad = metric(tidy), metric(dirty)
    assert good["validation", None, "is_valid"] == 1.0 and bad["validation", None, "is_valid"] == 0.0
    assert bad["validation", None, "total_missing_cells"] == 3.0
    assert bad["impossible", "non_positive_sqft_count", "violations"] == 2.0
    lacking = metric(tidy, ("society",))
    assert lacking["schema", "society", "missing_required_column"] == 1.0
    assert lacking["validation", None, "is_valid"] == 0.0


def test_custom_rule_with_null_is_no_violation(spark):
    df = spark.createDataFrame([(None,), (5,)], "x int")
    assert quality.impossible_values(df, {"big": F.col("x") > 1}).first().violations == 1


def test_duplicates_of_a_column_name_with_a_dot(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], ["a.b", "c"])
    assert tuple(quality.duplicates(df).first())[:2] == (3, 1)
