import re

import pytest
from pyspark.sql import functions as F

from plinth.functions import text


def apply(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_parse_count(spark):
    values = ["2 BHK", "4 Bedroom", "1 RK", " 12 bhk 3", "studio", "", None]
    assert apply(spark, text.parse_count, values) == [2, 4, 1, 12, None, None, None]


def test_parse_area_plain_and_range(spark):
    values = ["1200", " 1200.5 ", "1_000", "1e3", "1000 - 1200", "2100 - 2850", "1-2-3", "nan", "inf", "-5", None]
    expected = [1200.0, 1200.5, 1000.0, 1000.0, 1100.0, 2475.0, 1.0, None, None, -5.0, None]
    assert apply(spark, text.parse_area, values) == expected


def test_parse_area_units(spark):
    values = ["100Sq. Meter", "100Sq.Meter", "100Sq. Yards", "2Acres", "3Guntha", "4Perch", "5 ACRE perch", "6Cents"]
    expected = [1076.39, 1076.39, 900.0, 87120.0, 3267.0, 1089.0, 217800.0, 6.0]
    assert apply(spark, text.parse_area, values) == pytest.approx(expected)


def test_parse_area_without_usable_number(spark):
    assert apply(spark, text.parse_area, ["call owner", "Sq. Meter", "Sq. Meter 100", "1.2.3 Acres", ""]) == [None] * 5


def test_decimal_or_null_rejects_java_suffixes(spark):
    values = ["1200d", "1200f", "0x10", "1__0", " 7 ", "+.5e-1", "5."]
    assert apply(spark, text.decimal_or_null, values) == [None, None, None, None, 7.0, 0.05, 5.0]


def test_clean_status(spark):
    values = [" ready TO move ", "Ready To Move", None, "19-Dec", "Immediate Possession"]
    ready, building = "Ready To Move", "Under Construction"
    assert apply(spark, text.clean_status, values) == [ready, ready, ready, building, building]


def test_normalize_text_is_python_title_case(spark):
    values = [
        "1st jp-nagar o'neil", "  ELECTRONIC  city Phase II ", " x y\t z", "a1b2 c_d", "éCOLE d'été", "", "  ",
        "(sector 2) hsr", "a\x1cb",
    ]
    expected = [re.sub(r"\s+", " ", v.strip()).title() for v in values]
    assert apply(spark, text.normalize_text, values) == expected


def test_location_and_area_type_defaults(spark):
    assert apply(spark, text.normalize_location, [None, " whitefield "]) == ["Other", "Whitefield"]
    assert apply(spark, text.default_area_type, [None, " Plot  Area "]) == ["Super built-up Area", "Plot  Area"]


def test_feature_labels(spark):
    values = [
        "num__total_sqft", "num__bhk_bath_diff", "cat__location_Jp Nagar", "cat__area_type_Plot Area",
        "cat__availability_status_Ready To Move", "num__lake_view",
    ]
    expected = [
        "Property size", "BHK/bathroom difference", "Locality: Jp Nagar", "Area type: Plot Area",
        "Availability: Ready To Move", "Lake View",
    ]
    assert apply(spark, text.feature_label, values) == expected
