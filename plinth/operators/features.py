"""Leakage-guarded feature pipeline: custom stages with the exact statistics, standard encoders.

Every ``fit`` sees the training rows only. Numeric slots of the vector are named
``num__<column>``, one-hot slots ``cat__<column>_<category>``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from math import isfinite

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.numeric import missing_as_null, round_half_even, to_number, transform_target
from plinth.functions.text import normalize_text
from plinth.operators.attach import attach
from plinth.operators.cleaning import apply_fold, category_counts
from plinth.operators.quantiles import quantiles
from plinth.operators.split import train_test_split
from plinth.schemas import CATEGORICAL, ENGINEERED, OTHER, RAW_NUMERIC
from plinth.staging import stage

# Columns that carry the target and must never become model input.
LEAKAGE_COLUMNS = [
    "price",
    "price_lakhs",
    "price_per_sqft",
    "target",
    "target_encoded_price",
    "target_price",
]
# Stand-ins used only inside the engineered features.
FEATURE_DEFAULTS = {"total_sqft": 1000.0, "bhk": 2.0, "bath": 2.0}
RARE_BELOW = 10
LABEL, ACTUAL = "label", "actual"
# Two forms of the same features: one-hot slots for linear models, category numbers for trees.
FEATURES, INDEXED = "features", "indexed"


def check_no_leakage(names: Iterable[str], blocked: Iterable[str] = LEAKAGE_COLUMNS) -> None:
    """Raise if a column derived from the target is among the model inputs."""
    blocked = {b.lower() for b in blocked}
    found = [n for n in names if n.lower() in blocked]
    if found:
        raise ValueError(
            f"CRITICAL DATA LEAKAGE DETECTED: {found} come from the target and cannot be model inputs."
        )


def _require_frame(df) -> None:
    if not isinstance(df, DataFrame):
        raise TypeError(f"expected a Spark DataFrame, got {type(df).__name__}")


class _Columns(Params):
    """Shared ``inputCols`` with one output column per input, named by a prefix."""

    inputCols = Param(Params._dummy(), "inputCols", "columns to work on", TypeConverters.toListString)
    prefix = Param(Params._dummy(), "prefix", "prefix of the output columns", TypeConverters.toString)

    def _outputs(self) -> dict[str, str]:
        return {c: self.getOrDefault("prefix") + c for c in self.getOrDefault("inputCols")}


class CategoryFolder(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Learn the frequent categories of one column; everything else later becomes ``Other``."""

    minCount = Param(Params._dummy(), "minCount", "rows a category needs", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=("location",), minCount=RARE_BELOW, prefix=""):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCols=["location"], minCount=RARE_BELOW, prefix="")

    def _fit(self, df: DataFrame) -> CategoryFolderModel:
        _require_frame(df)
        check_no_leakage(df.columns)
        model = CategoryFolderModel()
        self._copyValues(model)
        for column in self.getOrDefault("inputCols"):
            if column in df.columns:
                # Each spelling is normalised once, not once a row.
                spellings = category_counts(df.select(column), column).withColumn(column, normalize_text(F.col(column)))
                counts = spellings.dropna().groupBy(column).agg(F.sum("category_rows").alias("category_rows"))
                counts = counts.filter(F.col("category_rows") >= self.getOrDefault("minCount"))
                model.tables[column] = stage(counts, "categories")
        return model


class CategoryFolderModel(Model, _Columns, MLWritable, MLReadable):
    """Holds one ``(category, category_rows)`` table per column."""

    minCount = CategoryFolder.minCount

    def __init__(self):
        super().__init__()
        self._setDefault(inputCols=["location"], prefix="", minCount=RARE_BELOW)
        self.tables: dict[str, DataFrame] = {}

    def _transform(self, df: DataFrame) -> DataFrame:
        _require_frame(df)
        check_no_leakage(df.columns)
        for column, table in self.tables.items():
            if column in df.columns:
                df = apply_fold(df.withColumn(column, normalize_text(F.col(column))), table, column)
        return df

    def write(self) -> MLWriter:
        return _FolderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FolderReader(cls)


class _FolderWriter(MLWriter):
    def __init__(self, model: CategoryFolderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(
            self.model, path, self.sparkSession, extraMetadata={"tables": sorted(self.model.tables)}
        )
        for column, table in self.model.tables.items():
            table.write.parquet(f"{path}/tables/{column}")


class _FolderReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> CategoryFolderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        for column in metadata["tables"]:
            model.tables[column] = self.sparkSession.read.parquet(f"{path}/tables/{column}")
        return model


class ListingFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Normalise the plain text categories and add the engineered numeric features."""

    def _transform(self, df: DataFrame) -> DataFrame:
        _require_frame(df)
        check_no_leakage(df.columns)
        texts = {c: normalize_text(F.col(c)) for c in ("area_type", "availability_status") if c in df.columns}
        base = {
            c: F.coalesce(to_number(df, c), F.lit(default)) if c in df.columns else F.lit(default)
            for c, default in FEATURE_DEFAULTS.items()
        }
        sqft, bhk, bath = base["total_sqft"], base["bhk"], base["bath"]
        rooms = bhk + bath
        some_bhk = F.greatest(bhk, F.lit(1.0))
        return df.withColumns(texts | {
            "total_rooms": rooms,
            "sqft_per_bhk": round_half_even(sqft / some_bhk),
            "bath_per_bhk": round_half_even(bath / some_bhk),
            "sqft_per_room": round_half_even(sqft / F.greatest(rooms, F.lit(1.0))),
            "bhk_bath_diff": round_half_even(bath - bhk),
        })

    @staticmethod
    def feature_names(inputs: Sequence[str] = ()) -> list[str]:
        return [*inputs, *ENGINEERED]


class ConstantImputer(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Missing text becomes a category of its own."""

    fill = Param(Params._dummy(), "fill", "replacement of NULL", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=(), fill=OTHER, prefix=""):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCols=[], fill=OTHER, prefix="")

    def _transform(self, df: DataFrame) -> DataFrame:
        fill = F.lit(self.getOrDefault("fill"))
        return df.withColumns({new: F.coalesce(F.col(c), fill) for c, new in self._outputs().items()})


class _Fitted(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """A model that is a few numbers per column, kept as JSON."""

    stats = Param(Params._dummy(), "stats", "fitted numbers per column, JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(inputCols=[], prefix="", stats="{}")

    def fitted(self) -> dict:
        return json.loads(self.getOrDefault("stats"))


class MedianImputer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Exact training median per column; a column without any training value is filled with 0."""

    @keyword_only
    def __init__(self, *, inputCols=(), prefix=""):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCols=[], prefix="")

    def _fit(self, df: DataFrame) -> MedianImputerModel:
        columns = self.getOrDefault("inputCols")
        check_no_leakage(columns)
        medians = {r.column_name: r.q[0] for r in quantiles(df, columns, [0.5], wide=True).collect()}
        model = self._copyValues(MedianImputerModel())
        return model._set(stats=json.dumps({c: medians.get(c, 0.0) for c in columns}))


class MedianImputerModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        outputs = self._outputs()
        return df.withColumns({
            outputs[c]: F.coalesce(to_number(df, c), F.lit(median)) for c, median in self.fitted().items()
        })


class NumericScaler(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """``robust``: (x - median) / IQR; ``standard``: (x - mean) / population std; ``none``: unchanged.

    A constant column is only centred.
    """

    kind = Param(Params._dummy(), "kind", "robust, standard or none", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=(), kind="robust", prefix="num__"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCols=[], kind="robust", prefix="num__")

    def _fit(self, df: DataFrame) -> NumericScalerModel:
        columns = self.getOrDefault("inputCols")
        check_no_leakage(columns)
        kind = self.getOrDefault("kind")
        tiny = 10 * 2.0**-52
        stats = {}
        if kind == "robust":
            for r in quantiles(df, columns, [0.25, 0.5, 0.75], wide=True).collect():
                spread = r.q[2] - r.q[0]
                stats[r.column_name] = [r.q[1], spread if spread > tiny else 1.0]
        elif kind == "standard":
            moments = df.agg(*[f(to_number(df, c)).alias(f"{f.__name__} {c}") for c in columns for f in (F.avg, F.stddev_pop)]).first()
            for i, c in enumerate(columns):
                mean, std = moments[2 * i], moments[2 * i + 1]
                if mean is not None:
                    stats[c] = [mean, std if std > tiny * max(abs(mean), 1.0) else 1.0]
        elif kind != "none":
            raise ValueError(f"unknown scaler: {kind}")
        model = self._copyValues(NumericScalerModel())
        return model._set(stats=json.dumps({c: stats.get(c, [0.0, 1.0]) for c in columns}))


class NumericScalerModel(_Fitted):
    kind = NumericScaler.kind

    def _transform(self, df: DataFrame) -> DataFrame:
        outputs = self._outputs()
        return df.withColumns({
            outputs[c]: (to_number(df, c) - F.lit(centre)) / F.lit(scale)
            for c, (centre, scale) in self.fitted().items()
        })


class FeaturePipeline(Pipeline):
    """A pipeline whose later fits read the folded and engineered rows staged, instead of making them again for every scan."""

    def _fit(self, df: DataFrame) -> PipelineModel:
        _require_frame(df)
        stages, fitted = self.getStages(), []
        for i, step in enumerate(stages):
            if isinstance(step, StringIndexer):
                # Labels in the order of the alphabet depend on the categories alone, not on their rows.
                model = step.fit(df.select(*step.getInputCols()).distinct())
            else:
                model = step.fit(df) if isinstance(step, Estimator) else step
            fitted.append(model)
            df = model.transform(df)
            if isinstance(step, ListingFeatures):
                read = dict.fromkeys(c for later in stages[i + 1 :] for c in later.getOrDefault("inputCols"))
                df = stage(df.select(*[c for c in read if c in df.columns]), "engineered")
        return PipelineModel(fitted)


def build_feature_pipeline(
    scaler: str = "robust",
    numeric: Sequence[str] = (*RAW_NUMERIC, *ENGINEERED),
    categorical: Sequence[str] = CATEGORICAL,
    fold: Sequence[str] = ("location",),
) -> Pipeline:
    """Raw listing features to two vectors; a vector that is not selected is not computed.

    ``features`` is sparse with one slot per category, an unseen one gives all zeros. ``indexed``
    has one nominal slot per column, its value the number of the category (unseen: the number
    of known ones), so a tree meets a dozen slots instead of thousands.
    """
    check_no_leakage([*numeric, *categorical])
    filled = [f"imputed {c}" for c in categorical]
    index = [f"index {c}" for c in categorical]
    hot = [f"hot {c}" for c in categorical]
    return FeaturePipeline(stages=[
        CategoryFolder(inputCols=list(fold)),
        ListingFeatures(),
        MedianImputer(inputCols=list(numeric)),
        NumericScaler(inputCols=list(numeric), kind=scaler),
        ConstantImputer(inputCols=list(categorical), prefix="imputed "),
        StringIndexer(inputCols=filled, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=index, outputCols=hot),
        VectorAssembler(inputCols=[*[f"num__{c}" for c in numeric], *hot], outputCol=FEATURES),
        VectorAssembler(inputCols=[*[f"num__{c}" for c in numeric], *index], outputCol=INDEXED),
    ])


def feature_names(model: PipelineModel) -> list[str]:
    """Slot names of the ``features`` vector, in order."""
    scaler = next(s for s in model.stages if isinstance(s, NumericScalerModel))
    indexer = next(s for s in model.stages if hasattr(s, "labelsArray"))
    names = [f"num__{c}" for c in scaler.getOrDefault("inputCols")]
    for column, labels in zip(indexer.getInputCols(), indexer.labelsArray):
        names += [f"cat__{column.removeprefix('imputed ')}_{label}" for label in labels]
    return names


def indexed_names(model: PipelineModel) -> tuple[list[str], dict[int, list[str]]]:
    """Slot names of the ``indexed`` vector, and the category names of its nominal slots."""
    scaler = next(s for s in model.stages if isinstance(s, NumericScalerModel))
    indexer = next(s for s in model.stages if hasattr(s, "labelsArray"))
    names = [f"num__{c}" for c in scaler.getOrDefault("inputCols")]
    columns = [f"cat__{c.removeprefix('imputed ')}" for c in indexer.getInputCols()]
    return names + columns, {len(names) + i: list(labels) for i, labels in enumerate(indexer.labelsArray)}


def vectorize(model: PipelineModel, df: DataFrame, carry: Sequence[str] = (LABEL, ACTUAL)) -> DataFrame:
    """``features`` and ``indexed`` plus the ``carry`` columns that ``df`` has."""
    return model.transform(df).select(*[c for c in carry if c in df.columns], FEATURES, INDEXED)


def target_column(df: DataFrame) -> str:
    for name in ("price", "price_lakhs"):
        if name in df.columns:
            return name
    raise ValueError("target column ('price' or 'price_lakhs') is missing")


def separate_target(df: DataFrame, target: str | None = None, strategy: str = "log1p") -> DataFrame:
    """Replace the target column by ``label`` (what models fit) and ``actual`` (what metrics compare)."""
    target = target or target_column(df)
    actual = F.col(target).cast("double")
    return df.withColumns({LABEL: transform_target(actual, strategy), ACTUAL: actual}).drop(target)


def check_finite(df: DataFrame, column: str = FEATURES) -> None:
    """Raise if a feature vector holds NaN or an infinity.

    The sum of the magnitudes in a slot is finite only if every one is, and takes the stored values of a sparse vector
    alone. Vectors are spread out to all their slots only if a sum is not: finite values can add up to infinity.
    """
    df = df.filter(F.col(column).isNotNull())
    if df.isEmpty():
        return
    sums = df.agg(Summarizer.normL1(F.col(column)).alias("sums")).first().sums
    if all(map(isfinite, sums.toArray())):
        return
    bad = F.exists(vector_to_array(column), lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    if not df.filter(bad).isEmpty():
        raise ValueError("feature vectors contain NaN or infinite values")


def model_ready(
    df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int = 42, strategy: str = "log1p",
    scaler: str = "robust", target: str | None = None,
) -> dict:
    """Split, guard, transform the target, fit the features on the training side, vectorise both sides.

    Nothing is written but staged tables in the scratch area.
    """
    rows = separate_target(df, target, strategy)
    check_no_leakage(rows.columns)
    train, test = (stage(side, "split") for side in train_test_split(rows, keys, test_size, seed))
    pipeline = build_feature_pipeline(scaler).fit(train)
    ready = {}
    for name, side in (("train", train), ("test", test)):
        vectors = stage(vectorize(pipeline, side, (*keys, LABEL, ACTUAL)), "vectors")
        check_finite(vectors)
        ready[name] = vectors
    return ready | {
        "train_raw": train, "test_raw": test, "feature_pipeline": pipeline, "target_transform": strategy,
        "train_samples": train.count(), "test_samples": test.count(),
        "num_features_out": len(feature_names(pipeline)),
    }
