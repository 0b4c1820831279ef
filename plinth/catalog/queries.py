"""Every operator as a query over the given tables; doubles are rounded for comparison only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.catalog.views import (
    LISTING_KEYS,
    dirty_listings,
    keyed_listings,
    parsed_listings,
    sales,
    table,
)
from plinth.functions import numeric, text
from plinth.operators import (
    attribution,
    charts,
    cleaning,
    evaluation,
    features,
    market,
    models,
    profiling,
    quality,
    scoring,
    split,
)
from plinth.operators.trees import TreeModel
from plinth.plans.profile import run_profile
from plinth.plans.quality_report import quality_report
from plinth.plans.training import train_final
from plinth.schemas import RAW_LISTING
from plinth.sources.artifact import ValuationModel
from plinth.sources.tables import load_csv, write_table
from plinth.staging import scratch_path, stage

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    _REGISTRY[f.__name__] = f
    return f


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def neat(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double so that engines can be compared.

    The nudge sends exact ties the same way everywhere; ``+ 0.0`` removes negative zero.
    """
    nudge = 10.0 ** -(digits + 3)
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(c) + nudge, digits) + F.lit(0.0) for c in doubles})


def tally(df: DataFrame, *columns: Column) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


# --- text and parsing -----------------------------------------------------------------


@query
def parse_size(spark, d):
    return tally(dirty_listings(spark, d), F.col("size"), text.parse_count(F.col("size")).alias("bhk"))


@query
def parse_area(spark, d):
    area = text.parse_area(F.col("total_sqft")).alias("sqft")
    return neat(tally(dirty_listings(spark, d), F.col("total_sqft"), area))


@query
def clean_status(spark, d):
    status = text.clean_status(F.col("availability")).alias("status")
    return tally(dirty_listings(spark, d), F.col("availability"), status)


@query
def normalize_location(spark, d):
    name = text.normalize_location(F.col("location")).alias("name")
    return tally(dirty_listings(spark, d), F.col("location"), name)


@query
def normalize_area_type(spark, d):
    raw = F.col("area_type")
    return tally(
        dirty_listings(spark, d), raw, text.default_area_type(raw).alias("defaulted"),
        text.normalize_text(raw).alias("normalized"),
    )


@query
def feature_labels(spark, d):
    dirty = dirty_listings(spark, d)
    slots = dirty.select(F.explode(F.array(
        F.concat(F.lit("cat__location_"), text.normalize_location(F.col("location"))),
        F.concat(F.lit("cat__area_type_"), text.normalize_text(F.col("area_type"))),
        F.concat(F.lit("cat__availability_status_"), text.clean_status(F.col("availability"))),
        F.lit("num__sqft_per_bhk"), F.lit("num__garden_size"),
    )).alias("slot")).dropna()
    return tally(slots, F.col("slot"), text.feature_label(F.col("slot")).alias("label"))


# --- sources --------------------------------------------------------------------------


@query
def csv_round_trip(spark, d):
    path = scratch_path(spark, "csv")
    write_table(dirty_listings(spark, d), path, "csv")
    return neat(load_csv(spark, path, required=["location", "total_sqft", "price"], schema=RAW_LISTING))


# --- quality --------------------------------------------------------------------------


@query
def missing_values(spark, d):
    return neat(quality.missing_values(dirty_listings(spark, d), ["price", "location"]))


@query
def duplicate_rows(spark, d):
    return neat(quality.duplicates(dirty_listings(spark, d)))


@query
def duplicate_keys(spark, d):
    return neat(quality.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query
def domain_rules(spark, d):
    return quality.impossible_values(parsed_listings(spark, d))


@query
def custom_rules(spark, d):
    accounts = table(spark, d, "customer")
    return quality.impossible_values(accounts, {
        "overdrawn": F.col("c_acctbal") < 0,
        "unnamed": F.col("c_name").isNull(),
        "rich_builder": (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000),
    })


@query
def inspect_table(spark, d):
    return neat(quality.inspect(dirty_listings(spark, d)))


@query
def validation_report(spark, d):
    rows = stage(parsed_listings(spark, d).drop(*LISTING_KEYS), "parsed")
    return neat(quality.validation_report(rows, ["location", "total_sqft", "price"]))


@query
def iqr_outliers(spark, d):
    lines = table(spark, d, "lineitem")
    return neat(quality.iqr_outliers(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query
def iqr_outliers_bracketed(spark, d):
    """The large-input plan of the quantiles, forced."""
    lines = table(spark, d, "lineitem")
    return neat(quality.iqr_outliers(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], sort_rows=100, accuracy=100))


# --- cleaning -------------------------------------------------------------------------


@query
def clean_listings(spark, d):
    return neat(cleaning.clean_listings(dirty_listings(spark, d))[0])


@query
def clean_report(spark, d):
    report = cleaning.clean_listings(dirty_listings(spark, d))[1]
    return neat(report.withColumn("final_columns", F.array_join("final_columns", ",")))


@query
def clean_report_keep_duplicates(spark, d):
    report = cleaning.clean_listings(dirty_listings(spark, d), min_location_frequency=5, remove_duplicates=False)[1]
    return neat(report.drop("final_columns"))


@query
def fold_rare_categories(spark, d):
    rows = stage(dirty_listings(spark, d).select(text.normalize_location(F.col("location")).alias("location")), "names")
    return tally(cleaning.fold_rare(rows, "location", 15), F.col("location"))


@query
def impute_group_median(spark, d):
    rows = stage(parsed_listings(spark, d), "parsed")
    filled = cleaning.impute_group_median(rows, "bhk", {"bath": F.col("bhk"), "balcony": F.lit(1)})
    return tally(filled, F.col("bhk"), F.col("bath"), F.col("balcony"))


# --- profile --------------------------------------------------------------------------


@query
def dataset_overview(spark, d):
    facts = profiling.dataset_overview(dirty_listings(spark, d))
    rows = [(name, ",".join(v) if isinstance(v, list) else str(v)) for name, v in facts.items()]
    return spark.createDataFrame(rows, "fact string, value string")


@query
def target_stats(spark, d):
    return neat(profiling.target_statistics(table(spark, d, "orders"), "o_totalprice"), 3)


@query
def target_stats_skewed(spark, d):
    return neat(profiling.target_statistics(table(spark, d, "events"), "value"))


@query
def numeric_summary(spark, d):
    return neat(profiling.numeric_summary(table(spark, d, "part"), ["p_size", "p_retailprice"]))


@query
def numeric_summary_bracketed(spark, d):
    lines = table(spark, d, "lineitem")
    return neat(profiling.numeric_summary(lines, ["l_quantity", "l_extendedprice", "l_discount"], sort_rows=100, accuracy=100), 3)


@query
def categorical_summary(spark, d):
    return neat(profiling.category_summary(table(spark, d, "part"), ["p_brand", "p_type", "p_name"], "p_retailprice"))


@query
def correlation(spark, d):
    lines = table(spark, d, "lineitem")
    return neat(profiling.correlation_matrix(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey"]))


@query
def correlation_with_gaps(spark, d):
    return neat(profiling.correlation_matrix(parsed_listings(spark, d), charts.HEATMAP_COLUMNS))


@query
def correlation_spearman(spark, d):
    return neat(profiling.correlation_matrix(table(spark, d, "part"), ["p_size", "p_retailprice"], "spearman"))


# --- market ---------------------------------------------------------------------------


@query
def unit_price(spark, d):
    lines = table(spark, d, "lineitem")
    price = numeric.price_per_unit(lines, "l_extendedprice", "l_quantity", 1.0)
    return neat(lines.groupBy("l_returnflag").agg(F.sum(price).alias("total"), F.max(price).alias("highest")), 3)


def _market(spark, d):
    """Joined once, read by every part of a market query."""
    return stage(sales(spark, d), "sales")


def _type_market(spark, d, **sizing):
    return market.location_statistics(_market(spark, d), "p_type", 15, **sizing)


@query
def location_stats_top(spark, d):
    return neat(_type_market(spark, d)["expensive"], 2)


@query
def location_stats_bottom(spark, d):
    return neat(_type_market(spark, d)["affordable"], 2)


@query
def brand_stats_top(spark, d):
    """More groups than the ranking shows."""
    return neat(market.location_statistics(_market(spark, d), "p_brand", 15)["expensive"], 2)


@query
def brand_stats_bottom(spark, d):
    return neat(market.location_statistics(_market(spark, d), "p_brand", 15)["affordable"], 2)


@query
def location_stats_counts(spark, d):
    return market.location_statistics(_market(spark, d), "l_partkey", 25)["counts"]


@query
def location_stats_bracketed(spark, d):
    """Many groups, with both large-input plans forced: bracketed quantiles, hot and cold keys apart."""
    rows = _market(spark, d)
    return neat(market.location_statistics(rows, "l_partkey", 25, sort_rows=10, broadcast_bytes=0)["qualified"], 2)


@query
def market_summary(spark, d):
    return neat(market.market_summary(_market(spark, d), "n_name"), 3)


@query
def market_snapshot(spark, d):
    return neat(market.market_snapshot(_market(spark, d), "n_name"), 3)


@query
def distinct_values(spark, d):
    return market.distinct_values(sales(spark, d), "p_type")


@query
def top_categories(spark, d):
    return market.top_categories(table(spark, d, "part"), "p_type")


@query
def frequent_groups_only(spark, d):
    rows = market.frequent_groups_only(table(spark, d, "lineitem"), "l_partkey", 35)
    return neat(rows.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")))


# --- charts ---------------------------------------------------------------------------


@query
def histogram(spark, d):
    return neat(charts.histogram(table(spark, d, "orders"), "o_totalprice", charts.PRICE_BINS))


@query
def histogram_log(spark, d):
    return neat(charts.histogram(table(spark, d, "orders"), "o_totalprice", charts.PRICE_BINS, F.log1p))


@query
def histogram_in_range(spark, d):
    rows = market.with_unit_price(sales(spark, d)).filter(charts.in_range("price_per_sqft", (120000000, 180000000)))
    return neat(charts.histogram(rows, "price_per_sqft", charts.UNIT_PRICE_BINS), 2)


@query
def histogram_median(spark, d):
    return neat(charts.histogram_median(table(spark, d, "orders"), "o_totalprice"))


@query
def histogram_median_in_range(spark, d):
    rows = market.with_unit_price(sales(spark, d)).filter(charts.in_range("price_per_sqft", (120000000, 180000000)))
    return neat(charts.histogram_median(rows, "price_per_sqft", sort_rows=100, accuracy=100), 2)


@query
def box_stats(spark, d):
    return neat(charts.box_stats(table(spark, d, "events"), "event_type", "value"))


@query
def box_stats_bracketed(spark, d):
    lines = table(spark, d, "lineitem")
    return neat(charts.box_stats(lines, "l_returnflag", "l_extendedprice", sort_rows=100, accuracy=100), 3)


@query
def binned_scatter(spark, d):
    lines = table(spark, d, "lineitem").filter("l_quantity <= 40")
    return neat(charts.binned_scatter(lines, "l_quantity", "l_extendedprice", "l_returnflag", 5.0, 10000.0))


@query
def bar_ranking(spark, d):
    return neat(charts.bar_ranking(_market(spark, d), "l_partkey", "price", 25))


@query
def unit_price_ranking(spark, d):
    return neat(charts.bar_ranking(market.with_unit_price(_market(spark, d)), "l_partkey", market.UNIT_PRICE, 25), 2)


# --- features -------------------------------------------------------------------------


def _inputs(spark, d):
    return parsed_listings(spark, d).drop("price")


@query
def engineer_features(spark, d):
    rows = features.ListingFeatures().transform(_inputs(spark, d))
    names = ["area_type", "availability_status", *features.ENGINEERED]
    return neat(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")))


@query
def rare_fold_fit_apply(spark, d):
    places = _inputs(spark, d).select(*LISTING_KEYS, "location")
    train, test = split.train_test_split(stage(places, "inputs"), LISTING_KEYS)
    folded = features.CategoryFolder(minCount=12).fit(train).transform(test)
    return tally(folded, F.col("location"))


@query
def median_impute(spark, d):
    rows = stage(_inputs(spark, d), "parsed")
    columns = ["total_sqft", "bath", "balcony", "bhk"]
    filled = features.MedianImputer(inputCols=columns).fit(rows).transform(rows)
    return neat(filled.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.sum, F.min, F.count)]), 2)


def _scaled(spark, d, kind):
    lines = table(spark, d, "lineitem")
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    scaled = features.NumericScaler(inputCols=columns, kind=kind).fit(lines).transform(lines)
    return neat(scaled.groupBy("l_returnflag", "l_linestatus").agg(
        *[f(f"num__{c}").alias(f"{f.__name__}_{c}") for c in columns for f in (F.avg, F.min, F.max)]
    ))


@query
def robust_scale(spark, d):
    return _scaled(spark, d, "robust")


@query
def standard_scale(spark, d):
    return _scaled(spark, d, "standard")


@query
def one_hot_active(spark, d):
    """Fit on the training side, count the active slots of the test side."""
    train, test = split.train_test_split(stage(_inputs(spark, d), "inputs"), LISTING_KEYS)
    model = features.build_feature_pipeline().fit(stage(train, "train"))
    names = features.feature_names(model)
    # Counts of non-zeros stay sparse; the result is one number per slot of the model.
    active = model.transform(test).agg(Summarizer.numNonZeros(F.col("features")).alias("hits")).first().hits
    hot = [(n, int(hits)) for n, hits in zip(names, active) if n.startswith("cat__") and hits]
    return spark.createDataFrame(hot, "raw_feature string, n long")


@query
def separate_target(spark, d):
    return neat(features.separate_target(parsed_listings(spark, d)).select(*LISTING_KEYS, "label", "actual"))


@query
def model_ready(spark, d):
    """Rows of both sides of the vectorised split; the plan itself refuses non-finite vectors."""
    ready = features.model_ready(stage(parsed_listings(spark, d), "parsed"), LISTING_KEYS)
    sides = [ready[side].select(F.lit(side).alias("side"), "actual") for side in ("train", "test")]
    return neat(sides[0].unionAll(sides[1]).groupBy("side").agg(F.count("actual").alias("n"), F.max("actual").alias("dearest")))


@query
def target_round_trip(spark, d):
    orders = table(spark, d, "orders")
    log = numeric.transform_target(F.col("o_totalprice") - 50000)
    back = numeric.inverse_target(log - 1.0)
    same = numeric.inverse_target(numeric.transform_target(F.col("o_totalprice") - 50000, "identity"), "identity")
    return neat(orders.select("o_orderkey", log.alias("log_target"), back.alias("restored"), same.alias("clipped")), 3)


@query
def split_assign(spark, d):
    return split.split_assign(table(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "split")


@query
def split_assign_multi_key(spark, d):
    lines = split.split_assign(table(spark, d, "lineitem"), LISTING_KEYS, 0.1, 7)
    return lines.select(*LISTING_KEYS, "split")


@query
def kfold_assign(spark, d):
    return split.kfold_assign(table(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "fold")


# --- models, metrics ------------------------------------------------------------------


def _guesses(spark, d):
    """Order totals with a deterministic made-up prediction."""
    off = (F.col("o_orderkey") % 61 - 25) / 100.0
    return table(spark, d, "orders").select(
        "o_orderpriority", F.col("o_totalprice").alias("actual"), (F.col("o_totalprice") * (1 + off)).alias("predicted")
    )


@query
def regression_metrics(spark, d):
    return neat(evaluation.regression_metrics(_guesses(spark, d)), 3)


@query
def regression_metrics_by_group(spark, d):
    return neat(evaluation.regression_metrics(_guesses(spark, d), by=["o_orderpriority"]), 3)


@query
def regression_metrics_bracketed(spark, d):
    return neat(evaluation.regression_metrics(_guesses(spark, d), by=["o_orderpriority"], sort_rows=100, accuracy=100), 3)


@query
def residual_band(spark, d):
    band = evaluation.residual_band(_guesses(spark, d))
    return neat(spark.createDataFrame([(0.9, band)], "q double, band double"), 3)


@query
def ridge_fit(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("x2"),
        (F.col("l_extendedprice") / 1000).alias("label"),
    )
    vectors = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(lines)
    model = models.fit(models.ridge, vectors, alpha=5000.0)
    w1, w2 = (float(w) for w in model.coefficients)
    return neat(spark.createDataFrame([(w1, w2, float(model.intercept))], "w1 double, w2 double, intercept double"))


def _training_rows(spark, d):
    clean = cleaning.clean_listings(keyed_listings(spark, d), keep=LISTING_KEYS)[0]
    return stage(clean, "clean")


def _split_rows(spark, d):
    rows = features.separate_target(_training_rows(spark, d))
    return tuple(stage(side, "side") for side in split.train_test_split(rows, LISTING_KEYS))


@query
def benchmark(spark, d):
    train, test = _split_rows(spark, d)
    return evaluation.benchmark_models(train, test, models.model_registry())


@query
def tune(spark, d):
    train, _ = _split_rows(spark, d)
    return evaluation.tune(train, LISTING_KEYS)[1]


@query
def oof_band(spark, d):
    train, _ = _split_rows(spark, d)
    best, _ = evaluation.tune(train, LISTING_KEYS)
    oof = evaluation.out_of_fold(train, LISTING_KEYS, models.model_registry()["XGBoost"], best)
    band = evaluation.residual_band(oof)
    return oof.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.avg((F.abs(F.col("actual") - F.col("predicted")) <= band).cast("double")).alias("inside")
    )


@query
def score_listings(spark, d):
    train, test = _split_rows(spark, d)
    pipeline = features.build_feature_pipeline().fit(train)
    booster = models.model_registry()["XGBoost"]
    model = models.fit(booster, stage(features.vectorize(pipeline, train), "vectors"))
    band = evaluation.residual_band(evaluation.out_of_fold(train, LISTING_KEYS, booster))
    artifact = ValuationModel(pipeline, model, interval_q90=band)
    path = scratch_path(spark, "artifact")
    artifact.save(spark, path)
    return scoring.score(test.drop("label", "actual"), ValuationModel.load(spark, path))


@query
def tree_explain(spark, d):
    train, test = _split_rows(spark, d)
    pipeline = features.build_feature_pipeline().fit(train)
    booster = models.model_registry()["XGBoost"]
    model = models.fit(booster, stage(features.vectorize(pipeline, train), "vectors"))
    vectors = features.vectorize(pipeline, test, LISTING_KEYS)
    names, categories = features.indexed_names(pipeline)
    parts = attribution.tree_attributions(vectors, LISTING_KEYS, model, names, categories=categories)
    return attribution.explain(parts, LISTING_KEYS)


@query
def train_valuation(spark, d):
    """The whole training plan; returns the saved test predictions."""
    out = scratch_path(spark, "training")
    train_final(_training_rows(spark, d), LISTING_KEYS, out)
    return spark.read.parquet(f"{out}/test_predictions")


# --- scoring and attribution ----------------------------------------------------------


@query
def validate_inputs(spark, d):
    rows = parsed_listings(spark, d).withColumn("bhk", F.col("bhk") - 1)
    checked = scoring.validate_inputs(rows)
    return tally(checked, F.array_join("errors", "; ").alias("problems"), F.col("valid"))


@query
def score_band(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("price"))
    banded = scoring.with_band(orders, F.col("price"), 64.264)
    return neat(banded.drop("price", "interval_label"), 8)


# Fixed weights, so that the attributions have a closed form.
_NAMES = ["num__total_sqft", "num__bath", "cat__area_type_Plot Area"]
_WEIGHTS = [0.01, -0.5, 2.0]
_MEANS = [25.0, 0.05, 0.5]


def _line_values():
    flag = (F.col("l_returnflag") == "R").cast("double")
    return F.array("l_quantity", "l_discount", flag)


def _linear(spark, d):
    return attribution.linear_attributions(
        table(spark, d, "lineitem"), LISTING_KEYS, _line_values(), _NAMES, _WEIGHTS, _MEANS
    )


@query
def linear_attribution(spark, d):
    cells = _linear(spark, d).select(*LISTING_KEYS, F.inline("attributions"))
    return neat(cells, 6)


@query
def explain_topn(spark, d):
    return neat(attribution.explain(_linear(spark, d), LISTING_KEYS, 2), 6)


@query
def global_importance(spark, d):
    return neat(attribution.global_importance(_linear(spark, d)), 6)


def _stump_trees():
    """Two fixed trees: quantity then discount, and a single split on the return flag."""
    deep = {
        0: {"left": 1, "right": 2, "slot": 0, "threshold": 25.0, "rows": 100, "value": 0.0},
        1: {"left": None, "rows": 60, "value": 1.0},
        2: {"left": 3, "right": 4, "slot": 1, "threshold": 0.05, "rows": 40, "value": 0.0},
        3: {"left": None, "rows": 10, "value": 2.0},
        4: {"left": None, "rows": 30, "value": 5.0},
    }
    flat = {
        0: {"left": 1, "right": 2, "slot": 2, "threshold": 0.5, "rows": 4, "value": 0.0},
        1: {"left": None, "rows": 3, "value": -1.0},
        2: {"left": None, "rows": 1, "value": 3.0},
    }
    return TreeModel.from_nodes([(deep, 1.0), (flat, 0.5)])


def _trees(spark, d):
    return attribution.tree_attributions(
        table(spark, d, "lineitem"), LISTING_KEYS, _stump_trees(), _NAMES, _line_values()
    )


@query
def tree_attribution(spark, d):
    return neat(_trees(spark, d).select(*LISTING_KEYS, F.inline("attributions")), 6)


@query
def tree_importance(spark, d):
    return neat(attribution.global_importance(_trees(spark, d)), 6)


# --- whole plans ----------------------------------------------------------------------


@query
def full_quality_report(spark, d):
    return quality_report(dirty_listings(spark, d))["report"]


@query
def full_profile(spark, d):
    clean = cleaning.clean_listings(dirty_listings(spark, d))[0]
    profile = run_profile(clean)
    return neat(profile["charts"]["price_by_area_type"])


