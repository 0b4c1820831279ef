from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from plinth.operators import attribution, features, models
from plinth.operators.attribution import TreePaths
from plinth.operators.trees import TreeModel

NAMES = ["num__total_sqft", "num__bath", "cat__area_type_Plot Area"]


def random_tree(rng, depth, slots):
    """Node dict of a full random tree; features may repeat on a path."""
    nodes, todo, number = {}, [(0, depth, 1000)], 1
    while todo:
        here, left_depth, rows = todo.pop()
        if left_depth == 0 or rows < 4:
            nodes[here] = {"left": None, "rows": rows, "value": float(rng.normal())}
            continue
        share = int(rows * rng.uniform(0.2, 0.8))
        nodes[here] = {
            "left": number, "right": number + 1, "slot": int(rng.integers(slots)), "threshold": float(rng.normal()),
            "rows": rows, "value": 0.0,
        }
        todo += [(number, left_depth - 1, share), (number + 1, left_depth - 1, rows - share)]
        number += 2
    return nodes


def expectation(nodes, x, known, here=0):
    node = nodes[here]
    if node["left"] is None:
        return node["value"]
    if node["slot"] in known:
        return expectation(nodes, x, known, node["left"] if goes_left(node, x) else node["right"])
    sides = (node["left"], node["right"])
    return sum(nodes[s]["rows"] / node["rows"] * expectation(nodes, x, known, s) for s in sides)


def brute_force(trees, x):
    k = len(x)
    out = np.zeros(k)
    for i in range(k):
        others = [j for j in range(k) if j != i]
        for size in range(k):
            weight = factorial(size) * factorial(k - 1 - size) / factorial(k)
            for known in combinations(others, size):
                for nodes in trees:
                    out[i] += weight * (expectation(nodes, x, {*known, i}) - expectation(nodes, x, set(known)))
    return out


def goes_left(node, x):
    value = x[node["slot"]]
    return value == node["category"] if "category" in node else value <= node["threshold"]


@pytest.mark.parametrize("max_bytes", [1 << 20, 1])
@pytest.mark.parametrize("batch", [25, 400])
def test_equals_brute_force_shapley(max_bytes, batch):
    rng = np.random.default_rng(5)
    trees = [random_tree(rng, 4, 4) for _ in range(3)]
    x = rng.normal(size=(25, 4))
    x[:, 3] = rng.integers(5, size=25)
    for nodes in trees:  # the last slot is nominal, with 5 categories
        for node in nodes.values():
            if node.get("slot") == 3:
                node["category"] = int(rng.integers(5))
    model = TreeModel.from_nodes([(nodes, 1.0) for nodes in trees], base=0.25)
    blocks = attribution.tree_blocks(model, max_bytes)
    assert len(blocks) == (1 if max_bytes > 1 else 3)
    slots = attribution.used_slots(model)
    place = {s: i for i, s in enumerate(slots)}
    many = np.tile(x, (batch // 25, 1))  # more rows than patterns, and fewer
    got = np.zeros(many.shape)
    for first, last in blocks:
        part = model.part(first, last)
        paths = [TreePaths(part, int(root), place) for root in part.roots]
        got[:, slots] += attribution.contributions(paths, many[:, slots])
    want = np.array([brute_force(trees, row) for row in x])
    assert got == pytest.approx(np.tile(want, (batch // 25, 1)), abs=1e-10)
    base = attribution.expected_value(model)
    assert base == pytest.approx(0.25 + sum(expectation(t, x[0], set()) for t in trees))
    assert base + got.sum(axis=1) == pytest.approx(model.predict(many))


@pytest.mark.parametrize("learner, settings", [
    (models.xgboost_like, {"rounds": 30, "max_depth": 7, "step": 0.2}), (models.lightgbm_like, {"rounds": 10, "min_rows": 3}),
    (models.random_forest, {"trees": 4}), (models.gradient_boosting, {"rounds": 5}),
])
@pytest.mark.parametrize("max_bytes", [64 << 20, 20_000])
def test_base_plus_contributions_is_the_prediction(spark, learner, settings, max_bytes):
    df = spark.range(400).select(
        "id", (F.col("id") * 7 % 101).cast("double").alias("a"), (F.col("id") * 13 % 37).cast("double").alias("b"),
        (F.col("id") % 2).cast("double").alias("c"), (F.col("id") * 31 % 53).cast("double").alias("d"),
    ).withColumn("label", F.sin("a") * F.col("b") + F.col("c") * 9 - F.col("d"))
    df = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df)
    model = models.fit(learner, df, seed=1, **settings)
    scored = model.transform(df).select("id", "features", "prediction")
    names = ["num__a", "num__b", "cat__c", "num__d"]
    parts = attribution.tree_attributions(scored, ["id", "prediction"], model, names, max_bytes=max_bytes)
    total = F.aggregate("attributions", F.lit(attribution.expected_value(model)), lambda s, a: s + a.contribution)
    assert parts.count() == 400
    assert parts.filter(F.abs(total - F.col("prediction")) > 1e-6).count() == 0


def test_nominal_slots_report_the_category_of_the_row(spark):
    places = F.concat(F.lit("P"), (F.col("id") % 7).cast("string"))
    df = spark.range(600).select(
        "id", (F.col("id") * 7 % 101 + 500).cast("double").alias("total_sqft"), places.alias("location"),
        F.lit(1.0).alias("bath"), F.lit(1.0).alias("balcony"), (F.col("id") % 3 + 1).cast("double").alias("bhk"),
        F.lit("Plot Area").alias("area_type"), F.lit("Ready").alias("availability_status"),
    ).withColumn("label", F.col("total_sqft") / 100 + F.substring("location", 2, 1).cast("int") % 4)
    pipeline = features.build_feature_pipeline().fit(df)
    train = features.vectorize(pipeline, df, ["id", "label"])
    model = models.fit(models.xgboost_like, train, maxIter=8, maxDepth=4, stepSize=0.3)
    assert model.input_column == "indexed" and model.nominal.any()
    names, categories = features.indexed_names(pipeline)
    parts = attribution.tree_attributions(model.transform(train), ["id", "prediction"], model, names, categories=categories)
    total = F.aggregate("attributions", F.lit(attribution.expected_value(model)), lambda s, a: s + a.contribution)
    assert parts.filter(F.abs(total - F.col("prediction")) > 1e-6).count() == 0
    cells = parts.select("id", F.inline("attributions")).filter("raw_feature LIKE 'cat__location%'").join(df, "id")
    wrong = (F.col("raw_feature") != F.concat(F.lit("cat__location_"), "location")) | (F.col("feature_value") != 1)
    assert cells.count() == 600 and cells.filter(wrong).isEmpty()
    importance = {r.raw_feature: r.mean_abs_shap for r in attribution.global_importance(parts).collect()}
    mean = cells.filter("location = 'P1'").agg(F.sum(F.abs("contribution"))).first()[0] / 600
    assert importance["cat__location_P1"] == pytest.approx(mean)
    new = train.select("id", "indexed").withColumn("prediction", F.lit(0.0)).limit(0).unionByName(
        model.transform(features.vectorize(pipeline, df.withColumn("location", F.lit("elsewhere")), ["id"])).select("id", "indexed", "prediction")
    )
    unknown = attribution.tree_attributions(new, ["id"], model, names, categories=categories).select(F.inline("attributions"))
    assert unknown.filter("raw_feature = 'cat__location_unknown' AND feature_value = 0").count() == 600


def test_explain_reports_active_slots_best_first(spark):
    df = spark.createDataFrame([(1, 10.0, 0.0, 0.0), (2, 25.0, 4.0, 1.0)], "id int, a double, b double, c double")
    parts = attribution.linear_attributions(df, ["id"], F.array("a", "b", "c"), NAMES, [0.1, -1.0, 2.0], [25.0, 0.0, 0.5])
    rows = [tuple(r)[:6] for r in attribution.explain(parts, ["id"], 8).orderBy("id", "rank").collect()]
    assert rows == [
        (1, 1, "Property size", "num__total_sqft", -1.5, "decreases"),
        (2, 1, "Bathrooms", "num__bath", -4.0, "decreases"),
        (2, 2, "Area type: Plot Area", "cat__area_type_Plot Area", 1.0, "increases"),
    ]
    assert attribution.explain(parts, ["id"], 1).count() == 2


def test_global_importance(spark):
    df = spark.createDataFrame([(1, 10.0, 2.0, 0.0), (2, 40.0, 4.0, 1.0)], "id int, a double, b double, c double")
    parts = attribution.linear_attributions(df, ["id"], F.array("a", "b", "c"), NAMES, [0.1, -1.0, 2.0], [25.0, 0.0, 0.5])
    rows = attribution.global_importance(parts, 2).collect()
    assert [(r.raw_feature, r.mean_abs_shap) for r in rows] == [("num__bath", 3.0), ("num__total_sqft", 1.5)]


def test_a_tree_makes_its_tables_once_a_batch(monkeypatch):
    rng = np.random.default_rng(4)
    nodes = {0: {"left": 1, "right": 2, "slot": 0, "threshold": 0.5, "rows": 10.0, "value": 0.0},
             1: {"rows": 4.0, "value": 1.0}, 2: {"left": 3, "right": 4, "slot": 1, "category": 2.0, "rows": 6.0, "value": 0.0},
             3: {"rows": 1.0, "value": -2.0}, 4: {"rows": 5.0, "value": 3.0}}
    model = TreeModel.from_nodes([(nodes, 1.0)])
    paths = [TreePaths(model, 0, {0: 0, 1: 1})]
    x = np.c_[rng.random(5000), rng.integers(0, 4, 5000)]
    one_by_one = np.concatenate([attribution.contributions(paths, x[i : i + 50]) for i in range(0, 5000, 50)])
    calls, table = [], attribution.leaf_shapley
    monkeypatch.setattr(attribution, "leaf_shapley", lambda *args: calls.append(1) or table(*args))
    whole = attribution.contributions(paths, x)
    assert np.array_equal(whole, one_by_one) and len(calls) == len(paths[0].groups)
    assert whole.sum(axis=1) + attribution.expected_value(model) == pytest.approx(model.predict(x))
