"""Join a per-key aggregate back to the rows it was computed from.

The row side may be huge and one key may hold a third of it, so no single plan is
right for every size:

* an aggregate of few bytes (its rows counted, their width from the schema and the texts in it): broadcast it, rows never move;
* beyond: the keys above a thousandth of all rows are at most a thousand, so they
  are always broadcast; only the remaining, provably small keys are shuffled, to as many tasks as their rows ask for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Aggregates up to this size are broadcast.
BROADCAST_BYTES = 32 << 20
# A key is hot when it holds more than 1/HOT_SHARE of all rows; at most HOT_SHARE keys can.
HOT_SHARE = 1000
# Rows of cold keys a task gets, whatever the session's number of shuffle partitions.
COLD_ROWS = 500_000


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes a row takes in a broadcast table."""
    total = F.lit(64)
    for field in df.schema:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(kind, T.ArrayType):
            total = total + F.coalesce(F.octet_length(F.to_json(F.array(column))), F.lit(0))
        elif isinstance(kind, (T.StructType, T.MapType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            total = total + 16
    return total.cast("bigint")


def attach(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    weight: str,
    how: str = "inner",
    broadcast_bytes: int = BROADCAST_BYTES,
    cold_rows: int = COLD_ROWS,
) -> DataFrame:
    """Join ``per_key`` (one row per key, ``weight`` = rows of that key) onto ``rows``.

    ``per_key`` should be staged: it is counted here and read again by the join.
    The weight column is not part of the result.
    """
    keys = list(keys)
    size = per_key.agg(
        F.coalesce(F.sum(_row_bytes(per_key)), F.lit(0)).alias("bytes"), F.sum(weight).alias("total")
    ).first()
    if size.bytes <= broadcast_bytes:
        return rows.join(F.broadcast(per_key.drop(weight)), keys, how)
    is_hot = F.col(weight) > size.total / HOT_SHARE
    hot = per_key.filter(is_hot).drop(weight)
    cold = per_key.filter(~is_hot).drop(weight)
    unkeyed = F.lit(False)
    for key in keys:
        unkeyed = unkeyed | F.col(key).isNull()
    # Adaptive coalescing packs 64 MB of compressed rows into a task; a given number of partitions stays.
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-int(size.total) // cold_rows))
    remaining = rows.filter(~unkeyed).join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    shuffled = remaining.repartition(tasks, *keys).join(cold.repartition(tasks, *keys), keys, how)
    joined = rows.join(F.broadcast(hot), keys, "inner").unionByName(shuffled)
    if how == "left":
        # NULL keys match nothing and would all meet in one shuffle partition.
        joined = joined.unionByName(rows.filter(unkeyed), allowMissingColumns=True)
    return joined
