import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plinth.operators import charts, market, profiling

ROWS = [
    ("Whitefield", "Plot Area", 1000.0, 2, 2, 1, 50.0), ("Whitefield", "Plot Area", 1200.0, 2, 2, 1, 60.0),
    ("Hebbal", "Carpet Area", 1500.0, 3, 3, 2, 90.0), ("Hebbal", "Carpet Area", 1600.0, 3, 3, 2, 100.0),
    ("Yelahanka", None, 900.0, 1, 1, 0, 40.0), (None, "Plot Area", 2200.0, 4, 4, 3, 220.0),
]
SCHEMA = "location string, area_type string, total_sqft double, bhk int, bath int, balcony int, price double"


@pytest.fixture(scope="module")
def clean(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def pdf():
    return pd.DataFrame(ROWS, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def test_overview(clean):
    overview = profiling.dataset_overview(clean)
    assert overview["total_rows"] == 6 and overview["categorical_columns"] == ["location", "area_type"]
    assert overview["numerical_columns"] == ["total_sqft", "bhk", "bath", "balcony", "price"]


@pytest.mark.parametrize("sizing", [{}, {"sort_rows": 3}])
def test_target_statistics(clean, pdf, sizing):
    row = profiling.target_statistics(clean, "price", **sizing).first()
    price = pdf["price"]
    assert (row["count"], row.min, row.max) == (6, 40.0, 220.0)
    assert (row.mean, row.median, row.std) == pytest.approx((price.mean(), price.median(), price.std()))
    assert (row.q25, row.q75) == pytest.approx((price.quantile(0.25), price.quantile(0.75)))
    assert (row.skewness, row.kurtosis, row.log_skewness) == pytest.approx(
        (price.skew(), price.kurtosis(), np.log1p(price).skew())
    )
    with pytest.raises(ValueError):
        profiling.target_statistics(clean, "absent")


def test_numeric_summary(clean):
    rows = {r.column_name: r for r in profiling.numeric_summary(clean).collect()}
    assert set(rows) == {"total_sqft", "bhk", "bath", "balcony", "price"}
    assert rows["total_sqft"].mean == 1400.0 and rows["balcony"].median == 1.5


def test_category_summary(clean):
    rows = profiling.category_summary(clean, top=2).collect()
    top = [(r.category, r.frequency) for r in rows if r.column_name == "location" and r.ranking == "frequency"]
    assert top == [("Hebbal", 2), ("Whitefield", 2)]
    dear = [(r.category, r.median_target) for r in rows if r.column_name == "location" and r.ranking == "target"]
    assert dear == [("Hebbal", 95.0), ("Whitefield", 55.0)]
    assert {r.unique_count for r in rows if r.column_name == "location"} == {3}
    assert {r.ranking for r in profiling.category_summary(clean.drop("price")).collect()} == {"frequency"}


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_equals_pandas(spark, method):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 300).astype(float), "b": rng.normal(size=300), "c": rng.normal(size=300)})
    pdf["b"] += pdf["a"]
    pdf.loc[::7, "b"] = np.nan
    got = {(r.col_a, r.col_b): r["corr"] for r in profiling.correlation_matrix(spark.createDataFrame(pdf), method=method).collect()}
    expected = pdf.corr(method="pearson") if method == "pearson" else None
    for a in pdf:
        for b in pdf:
            if expected is not None:
                want = expected.loc[a, b]
            else:
                pair = pdf[[a, b]].dropna() if a != b else pdf[[a]].dropna()
                ranks = pair.rank()
                want = np.corrcoef(ranks[a], ranks[b])[0, 1]
            assert got[a, b] == pytest.approx(want)
    with pytest.raises(ValueError):
        profiling.correlation_matrix(spark.createDataFrame(pdf), method="other")


def test_correlation_of_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.1), (2.0, 0.1), (3.0, 0.1)], "a double, b double")
    got = {(r.col_a, r.col_b): r["corr"] for r in profiling.correlation_matrix(df).collect()}
    assert got["a", "b"] is None and got["b", "b"] is None and got["a", "a"] == 1.0


def test_location_statistics(clean):
    result = market.location_statistics(clean, min_listings=2)
    assert tuple(result["counts"].first()) == (3, 2)
    assert [r.location for r in result["expensive"].collect()] == ["Hebbal", "Whitefield"]
    assert [r.location for r in result["affordable"].collect()] == ["Whitefield", "Hebbal"]
    row = result["affordable"].first()
    assert (row.listing_count, row.median_price, row.median_price_per_sqft) == (2, 55.0, 5000.0)
    assert market.location_statistics(clean.drop("price")) == {}


def test_market_counts_rows_without_price(spark, clean):
    df = clean.union(spark.createDataFrame([("Whitefield", None, 1.0, 1, 1, 1, None), ("Empty", None, 1.0, 1, 1, 1, None)], SCHEMA))
    rows = {r.location: r for r in market.market_by_group(df).collect()}
    assert rows["Whitefield"].properties == 3 and rows["Whitefield"].median_price == 55.0
    assert rows["Empty"].properties == 1 and rows["Empty"].median_price is None
    assert market.market_summary(df).first().location == "Hebbal"
    snapshot = {r.metric: r.value for r in market.market_snapshot(df).collect()}
    assert snapshot == {"records": 8.0, "median_price": 75.0, "mean_price": pytest.approx(560 / 6), "localities": 4.0}


def test_distinct_and_top(clean):
    assert [r.location for r in market.distinct_values(clean, "location").collect()] == ["Hebbal", "Whitefield", "Yelahanka"]
    assert [tuple(r) for r in market.top_categories(clean, "location", 1).collect()] == [("Hebbal", 2)]
    assert market.frequent_groups_only(clean, "location", 2).count() == 4


def test_histogram_has_every_bin_and_row(spark):
    values = [0.0, 0.5, 1.0, 9.99, 10.0, None, float("nan")]
    rows = charts.histogram(spark.createDataFrame([(v,) for v in values], "x double"), "x", 10).orderBy("bin").collect()
    assert [r.frequency for r in rows] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 2]
    one = charts.histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x", 4).collect()
    assert sum(r.frequency for r in one) == 4
    assert charts.histogram(spark.createDataFrame([(None,)], "x double"), "x", 4).count() == 0


@pytest.mark.parametrize("sizing", [{}, {"sort_rows": 3}])
def test_box_stats(spark, sizing):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0, 100.0)] + [("b", 5.0)], "g string, price double")
    rows = {r.g: r for r in charts.box_stats(df, "g", **sizing).collect()}
    a = rows["a"]
    assert (a.q1, a.median, a.q3, a.whisker_low, a.whisker_high, a.outliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)
    assert (rows["b"].whisker_low, rows["b"].whisker_high) == (5.0, 5.0)


def test_binned_scatter_keeps_all_points(clean):
    rows = charts.binned_scatter(clean, "total_sqft", "price", "bhk", 1000.0, 50.0)
    assert rows.agg(F.sum("points")).first()[0] == 6


def test_chart_tables(clean):
    tables = charts.chart_tables(clean)
    assert set(tables) == {
        "price_histogram", "log_price_histogram", "correlation_heatmap", "area_vs_price", "price_by_bhk",
        "price_by_bath", "price_by_area_type", "unit_price_histogram", "top_price_locations", "top_unit_price_locations",
        "price_median", "unit_price_median",
    }
    assert tables["price_median"].first().n == clean.count()
    assert all(t.columns for t in tables.values())


def test_spearman_of_many_columns_takes_the_same_jobs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({f"c{i}": np.round(rng.normal(size=300) * (i + 1) + rng.normal(size=300), i % 3) for i in range(7)})
    pdf.loc[rng.random(300) < 0.2, "c1"] = np.nan
    pdf.loc[:99, "c4"] = 7.0  # a third of a column is one value
    pdf["flat"] = 3.0
    staged = []
    real = profiling.stage
    monkeypatch.setattr(profiling, "stage", lambda df, label: staged.append(label) or real(df, label))
    seen = []
    for columns in (["c0", "c1"], list(pdf)):
        staged.clear()
        got = profiling.correlation_matrix(spark.createDataFrame(pdf[columns]), columns, "spearman").collect()
        seen.append(list(staged))
        want = pdf[columns].corr(method="spearman")
        found = {(r.col_a, r.col_b): r["corr"] for r in got}
        assert len(found) == len(columns) ** 2
        for (a, b), value in found.items():
            expected = want.loc[a, b]
            assert value is None if a != b and np.isnan(expected) else value == pytest.approx(1.0 if a == b else expected)
    assert seen[0] == seen[1]
