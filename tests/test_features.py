import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from plinth.operators import features

SCHEMA = "location string, total_sqft double, bath double, balcony double, bhk double, area_type string, availability_status string"


def listings(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(location="Hebbal", sqft=1200.0, bath=2.0, balcony=1.0, bhk=2.0, area="Plot  Area", status="Ready To Move"):
    return (location, sqft, bath, balcony, bhk, area, status)


@pytest.fixture(scope="module")
def train(spark):
    rows = [row("hebbal ", 1000.0 + 50 * i, 1.0 + i % 3, None if i % 5 == 0 else 1.0, 1.0 + i % 4) for i in range(12)]
    rows += [row("Rareville", area="Carpet Area"), row(None, area=None)]
    return listings(spark, rows)


@pytest.fixture(scope="module")
def fitted(train):
    return features.build_feature_pipeline().fit(train)


def vectors(model, df):
    out = model.transform(df).select(vector_to_array("features").alias("v"))
    return np.array([r.v for r in out.collect()])


def test_engineered_values(spark):
    r = features.ListingFeatures().transform(listings(spark, [row()])).first()
    assert (r.total_rooms, r.sqft_per_bhk, r.bath_per_bhk, r.sqft_per_room, r.bhk_bath_diff) == (4.0, 600.0, 1.0, 300.0, 0.0)
    assert r.area_type == "Plot Area"


def test_engineered_values_without_rooms_or_input(spark):
    zero = features.ListingFeatures().transform(listings(spark, [row(bath=0.0, bhk=0.0), row(sqft=None, bath=None, bhk=None)]))
    a, b = zero.collect()
    assert all(math.isfinite(a[c]) for c in features.ENGINEERED)
    assert (b.total_rooms, b.sqft_per_bhk, b.total_sqft) == (4.0, 500.0, None)
    bare = features.ListingFeatures().transform(spark.createDataFrame([(1,)], "i int")).first()
    assert bare.sqft_per_room == 250.0
    assert features.ListingFeatures.feature_names(["a"])[:2] == ["a", "total_rooms"]


@pytest.mark.parametrize("name", [*features.LEAKAGE_COLUMNS, "PRICE"])
def test_leakage_is_refused(spark, train, name):
    leaky = train.withColumn(name, F.lit(1.0))
    with pytest.raises(ValueError, match="CRITICAL DATA LEAKAGE DETECTED"):
        features.CategoryFolder().fit(leaky)
    with pytest.raises(ValueError, match="CRITICAL DATA LEAKAGE DETECTED"):
        features.ListingFeatures().transform(leaky)
    with pytest.raises(ValueError, match="CRITICAL DATA LEAKAGE DETECTED"):
        features.build_feature_pipeline(numeric=["total_sqft", name])


def test_only_spark_frames(train):
    import pandas as pd

    with pytest.raises(TypeError):
        features.ListingFeatures()._transform(pd.DataFrame())
    with pytest.raises(TypeError):
        features.CategoryFolder()._fit(None)


def test_fold_is_learned_on_training_rows_only(spark, train):
    model = features.CategoryFolder().fit(train)
    new = listings(spark, [row("HEBBAL"), row("Rareville"), row("Nowhere"), row(None)])
    assert [r.location for r in model.transform(new).collect()] == ["Hebbal", "Other", "Other", "Other"]


def test_median_imputer_interpolates(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, None)], "a double, b double")
    model = features.MedianImputer(inputCols=["a", "b"]).fit(df)
    assert [tuple(r) for r in model.transform(df).collect()] == [(1.0, 0.0), (2.0, 0.0), (1.5, 0.0)]


@pytest.mark.parametrize(
    "kind, expected",
    [("robust", (1.0 - 3.0) / 3.5), ("standard", (1.0 - 4.0) / np.std([1, 2, 4, 9])), ("none", 1.0)],
)
def test_scalers(spark, kind, expected):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (9.0, 5.0)], "a double, c double")
    model = features.NumericScaler(inputCols=["a", "c"], kind=kind).fit(df)
    first = model.transform(df.limit(1).withColumn("c", F.lit(7.0))).first()
    assert first["num__a"] == pytest.approx(expected)
    assert first["num__c"] == (7.0 if kind == "none" else 2.0)
    with pytest.raises(ValueError):
        features.NumericScaler(inputCols=["a"], kind="odd").fit(df)


def test_pipeline_names_and_unseen_categories(spark, train, fitted):
    names = features.feature_names(fitted)
    assert names[:2] == ["num__total_sqft", "num__bath"] and len(names) == len(set(names))
    assert {n for n in names if n.startswith("cat__location_")} == {"cat__location_Hebbal", "cat__location_Other"}
    assert "cat__area_type_Other" in names
    seen = vectors(fitted, train)
    unseen = vectors(fitted, listings(spark, [row("Mars", area="Sky Area", status="Never")]))
    assert seen.shape[1] == unseen.shape[1] == len(names)
    assert np.isfinite(seen).all() and np.isfinite(unseen).all()
    hot = dict(zip(names, unseen[0]))
    assert hot["cat__location_Other"] == 1.0
    assert sum(v for n, v in hot.items() if n.startswith(("cat__area", "cat__avail"))) == 0.0


def test_pipeline_survives_saving(train, fitted, tmp_path):
    fitted.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert features.feature_names(again) == features.feature_names(fitted)
    assert np.array_equal(vectors(again, train), vectors(fitted, train))


def test_test_rows_do_not_change_the_fit(spark, train, fitted):
    again = features.build_feature_pipeline().fit(train.union(train.limit(0)))
    assert np.array_equal(vectors(again, train), vectors(fitted, train))
    other = features.build_feature_pipeline().fit(train.union(listings(spark, [row(sqft=99999.0)] * 6)))
    assert not np.array_equal(vectors(other, train), vectors(fitted, train))


def test_the_fit_makes_its_rows_once(spark, train):
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    counting = train.withColumn("bath", F.udf(counted, "double")("bath"))
    model = features.build_feature_pipeline().fit(counting)
    assert made.value == train.count()
    assert np.array_equal(vectors(model, train), vectors(features.build_feature_pipeline().fit(train), train))


def test_fold_counts_rows_of_all_spellings(spark):
    rows = [row("old  town ")] * 4 + [row("OLD TOWN")] * 3 + [row("Old Town")] * 3 + [row("new town")] * 9 + [row(None)] * 12
    model = features.CategoryFolder().fit(listings(spark, rows))
    assert [tuple(r) for r in model.tables["location"].collect()] == [("Old Town", 10)]


def test_model_ready_bundle(spark):
    rows = [(i, *row(sqft=900.0 + i % 5, bhk=1.0 + i % 3), 40.0 + i % 5) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, " + SCHEMA + ", price double")
    bundle = features.model_ready(df, ["id"])
    assert (bundle["train_samples"], bundle["test_samples"]) == (80, 20)
    assert bundle["train"].first().features.size == bundle["num_features_out"]
    assert bundle["test"].filter("abs(expm1(label) - actual) > 1e-9").count() == 0
    with pytest.raises(ValueError, match="target column"):
        features.model_ready(df.drop("price"), ["id"])


def test_finite_check_reads_stored_values_only(spark, monkeypatch):
    wide = 1 << 22

    def vectors(*values):
        return spark.createDataFrame([(Vectors.sparse(wide, [1, wide - 1], [v, 1.0]),) for v in values], ["features"])

    dense = []
    plain = features.vector_to_array
    monkeypatch.setattr(features, "vector_to_array", lambda column: dense.append(column) or plain(column))
    features.check_finite(vectors(1.0, -2.0, 0.0))
    features.check_finite(vectors(1.0).limit(0))
    assert not dense
    features.check_finite(spark.createDataFrame([(Vectors.dense(1.5e308, 1.0),)] * 2, ["features"]))
    for bad in (float("nan"), float("inf"), float("-inf")):
        with pytest.raises(ValueError, match="NaN or infinite"):
            features.check_finite(spark.createDataFrame([(Vectors.dense(1.0, 2.0),), (Vectors.sparse(2, [1], [bad]),)], ["features"]))
