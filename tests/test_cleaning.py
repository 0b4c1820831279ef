import pytest
from pyspark.sql import functions as F

from plinth.operators import cleaning
from plinth.schemas import CLEAN_LISTING


def test_clean_listings_end_to_end(raw_listings):
    clean, report = cleaning.clean_listings(raw_listings, min_location_frequency=2)
    assert [(f.name, f.dataType) for f in clean.schema.fields] == [(f.name, f.dataType) for f in CLEAN_LISTING.fields]
    row = report.first()
    assert (row.initial_rows, row.duplicates_removed, row.dropped_null_essentials) == (5, 1, 1)
    assert (row.domain_anomalies_filtered, row.final_cleaned_rows, row.data_retention_rate_pct) == (0, 3, 60.0)
    rows = {r.bhk: r for r in clean.collect()}
    assert rows[3].total_sqft == 1258.5 and rows[3].balcony == 1
    assert rows[2].location == rows[3].location == "Whitefield" and rows[4].location == "Other"
    assert rows[4].availability_status == "Ready To Move" and rows[2].availability_status == "Under Construction"


def test_duplicates_can_be_kept(raw_listings):
    clean, report = cleaning.clean_listings(raw_listings, 2, remove_duplicates=False)
    assert report.first().duplicates_removed == 0 and clean.count() == 4


def test_absent_columns_get_defaults(spark):
    df = spark.createDataFrame([("1000", 2.0, 1.0, 50.0)], "total_sqft string, bath double, balcony double, price double")
    row = cleaning.clean_listings(df, 1)[0].first()
    assert (row.bhk, row.location, row.area_type, row.availability_status) == (
        2, "Other", "Super built-up Area", "Ready To Move",
    )
    with pytest.raises(ValueError, match="price"):
        cleaning.clean_listings(df.drop("price"))


def test_impute_truncates_group_median_and_falls_back(spark):
    rows = [(2, 2.0, 1.0), (2, 3.0, None), (2, None, 2.0), (5, None, None)]
    df = spark.createDataFrame(rows, "bhk int, bath double, balcony double")
    filled = cleaning.impute_group_median(df, "bhk", {"bath": F.col("bhk"), "balcony": F.lit(1)})
    assert sorted(tuple(r) for r in filled.collect()) == [(2, 2, 1), (2, 2, 2), (2, 3, 1), (5, 5, 1)]


def test_domain_rules(spark):
    rows = [
        (2, 1000.0, 2, 50.0, True), (2, 399.0, 2, 50.0, False), (0, 10.0, 2, 50.0, True), (0, 0.0, 1, 50.0, False),
        (2, 25001.0, 2, 50.0, False), (2, 1000.0, 5, 50.0, False), (2, 1000.0, 4, 0.0, False),
        (13, 9000.0, 4, 90.0, False), (2, 1000.0, None, 50.0, False),
    ]
    df = spark.createDataFrame(rows, "bhk int, total_sqft double, bath int, price double, ok boolean")
    assert df.filter(cleaning.domain_mask() != F.col("ok")).count() == 0


def test_fold_rare_keeps_the_threshold(spark):
    df = spark.createDataFrame([("A",)] * 3 + [("B",)] * 2 + [(None,)], "location string")
    folded = cleaning.fold_rare(df, "location", 3).groupBy("location").count().collect()
    assert {r.location: r["count"] for r in folded} == {"A": 3, "Other": 3}


def test_input_is_left_alone(raw_listings):
    before = raw_listings.collect()
    cleaning.clean_listings(raw_listings)
    assert raw_listings.collect() == before
