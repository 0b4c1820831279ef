import json

import pytest
from pyspark.sql import functions as F

from plinth.operators import features, models, scoring
from plinth.plans.profile import run_profile
from plinth.plans.quality_report import quality_report
from plinth.plans.training import train_final
from plinth.sources.artifact import ValuationModel
from plinth.sources.tables import report_dict
from plinth.streaming import scoring as stream

SMALL = {
    "RandomForest": {"numTrees": 2, "maxDepth": 3}, "GradientBoosting": {"maxIter": 1},
    "XGBoost": {"maxIter": 2, "maxDepth": 3}, "LightGBM": {"maxIter": 1, "maxDepth": 2},
}


@pytest.fixture(scope="module")
def listings(spark):
    base = spark.range(200).select(
        F.col("id").cast("string").alias("request_id"), F.lit("hebbal ").alias("location"),
        (600 + (F.col("id") * 37) % 1500).cast("double").alias("total_sqft"),
        (1 + F.col("id") % 3).cast("double").alias("bath"), F.lit(1.0).alias("balcony"),
        (1 + F.col("id") % 4).cast("double").alias("bhk"), F.lit("Plot Area").alias("area_type"),
        F.lit("Ready To Move").alias("availability_status"),
    )
    return base.withColumn("price", F.col("total_sqft") / 20)


@pytest.fixture(scope="module")
def artifact(listings):
    rows = features.separate_target(listings)
    pipeline = features.build_feature_pipeline().fit(rows)
    return ValuationModel(pipeline, models.fit(models.ridge, features.vectorize(pipeline, rows)), interval_q90=5.0)


def test_score_keeps_the_input_and_marks_bad_rows(listings, artifact):
    requests = listings.drop("price").withColumn("total_sqft", F.when(F.col("request_id") == "3", -1.0).otherwise(F.col("total_sqft")))
    scored = scoring.score(requests, artifact)
    assert scored.columns[: len(requests.columns)] == requests.columns and scored.count() == 200
    bad = scored.filter("NOT valid").collect()
    assert [(r.request_id, r.errors, r.predicted_price) for r in bad] == [("3", ["total_sqft must be greater than 0"], None)]
    good = scored.filter("valid").first()
    assert good.location == "hebbal " and good.interval_low <= good.predicted_price <= good.interval_high
    assert good.predicted_crore == pytest.approx(good.predicted_price / 100)
    assert good.interval_high - good.predicted_price == pytest.approx(5.0)
    accepted, rejected = scoring.accepted_and_rejected(requests)
    assert (accepted.count(), rejected.count()) == (199, 1)


def test_band_is_cut_at_zero(spark):
    row = scoring.with_band(spark.createDataFrame([(3.0,)], "p double"), F.col("p"), 10.0).first()
    assert (row.interval_low, row.interval_high) == (0.0, 13.0)


def test_missing_columns_are_errors(spark):
    errors = scoring.validate_inputs(spark.createDataFrame([("x",)], "location string")).first()
    assert not errors.valid and len(errors.errors) == 6


def test_artifact_round_trip(spark, listings, artifact, tmp_path):
    artifact.metadata = {"best_model": "Ridge"}
    artifact.save(spark, str(tmp_path / "a"))
    again = ValuationModel.load(spark, str(tmp_path / "a"))
    assert again.metadata == artifact.metadata and again.interval_q90 == 5.0
    before, after = (scoring.score(listings.drop("price"), a).select("request_id", "predicted_price") for a in (artifact, again))
    assert before.exceptAll(after).isEmpty()
    with pytest.raises(FileNotFoundError):
        ValuationModel.load(spark, str(tmp_path / "none"))


def test_stream_scores_like_the_batch(spark, listings, artifact, tmp_path):
    requests = listings.drop("price")
    requests.repartition(3).write.json(str(tmp_path / "in"))
    query = stream.run_scoring(
        stream.score_stream(stream.request_stream(spark, str(tmp_path / "in")), artifact),
        str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True,
    )
    query.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).select("request_id", "predicted_price")
    batch = scoring.rounded(scoring.score(requests, artifact)).select("request_id", "predicted_price")
    assert streamed.count() == 200 and streamed.exceptAll(batch).isEmpty()


def test_quality_report(raw_listings, tmp_path):
    result = quality_report(raw_listings, clean_path=str(tmp_path / "clean"), report_path=str(tmp_path / "report"))
    nested = report_dict(result["report"])
    assert nested["raw.inspect"]["row_count"] == 5 and nested["cleaning"]["duplicates_removed"] == 1
    assert nested["cleaned.validation"]["is_valid"] == 1.0 and nested["target"]["max"] == 150.0
    assert nested["top_locations"]["Other"]["frequency"] == 3
    lines = [json.loads(x) for f in (tmp_path / "report").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == result["report"].count()


def test_profile(listings):
    profile = run_profile(listings.withColumnRenamed("request_id", "code"))
    assert profile["overview"]["total_rows"] == 200
    assert profile["target_statistics"].first()["count"] == 200
    assert profile["outlier_analysis"].count() == 5
    assert profile["location_insights"]["counts"].first().qualified_count == 1


def test_train_final(spark, listings, tmp_path):
    out = str(tmp_path / "model")
    registry = models.model_registry(overrides=SMALL)
    candidates = [{"maxIter": 1, "maxDepth": 2}, {"maxIter": 2, "maxDepth": 3}]
    trained = train_final(listings, ["request_id"], out, registry, candidates, n_splits=2)
    about = trained.metadata
    assert (about["train_rows"], about["test_rows"], about["localities"]) == (160, 40, 1)
    assert about["best_params"] in candidates and len(about["benchmark"]) == 5
    assert about["oof_absolute_error_q90_lakhs"] == trained.interval_q90 > 0
    assert spark.read.parquet(f"{out}/test_predictions").count() == 40
    assert spark.read.parquet(f"{out}/split/train").count() == 160
    loaded = ValuationModel.load(spark, f"{out}/artifact")
    assert loaded.metadata["best_model"] == "XGBoost"
    assert scoring.score(listings.drop("price").limit(3), loaded).filter("predicted_price > 0").count() == 3
