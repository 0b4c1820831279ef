"""Continuous scoring: the request service of the batch engine, as a stream of request rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plinth.operators.scoring import rounded, score
from plinth.schemas import CATEGORICAL, RAW_NUMERIC
from plinth.sources.artifact import ValuationModel

REQUEST = T.StructType(
    [T.StructField("request_id", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in RAW_NUMERIC]
    + [T.StructField(c, T.StringType()) for c in CATEGORICAL]
)


def request_stream(spark: SparkSession, path: str, schema: T.StructType = REQUEST) -> DataFrame:
    """JSON request rows as they arrive in a folder."""
    return spark.readStream.schema(schema).json(path)


def score_stream(requests: DataFrame, artifact: ValuationModel) -> DataFrame:
    """Validity, price and band of each request; stateless, so no watermark is needed."""
    return rounded(score(requests, artifact))


def run_scoring(scored: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write scored requests exactly once; ``available_now`` works off what is there and stops."""
    trigger = {"availableNow": True} if available_now else {"processingTime": "5 seconds"}
    writer = scored.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start(out)
