"""Input frames of the registered queries: the plain tables and a dirty listing view on them.

The given tables hold no dirty text, so one view derives it from lineitem. Its SQL text
uses integer arithmetic and concatenation only and runs unchanged on other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.cleaning import parse_listings
from plinth.schemas import CLEAN_LISTING

LISTING_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

_ROWS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_partkey % 20 = 0 THEN NULL
       WHEN l_partkey % 4 = 0 THEN 'Super built-up  Area'
       WHEN l_partkey % 4 = 1 THEN 'Plot  Area'
       WHEN l_partkey % 4 = 2 THEN 'Built-up  Area'
       ELSE 'Carpet  Area' END AS area_type,
  CASE WHEN l_orderkey % 97 = 0 THEN NULL
       WHEN l_linestatus = 'F' THEN 'Ready To Move' ELSE '19-Dec' END AS availability,
  CASE WHEN l_orderkey % 1001 = 0 THEN NULL
       ELSE ' ' || n_name || '  block-' || CAST(l_partkey % 211 AS VARCHAR(20)) || ' ' END AS location,
  CASE WHEN l_orderkey % 500 = 0 THEN NULL
       WHEN l_suppkey % 3 = 0 THEN CAST(nb AS VARCHAR(20)) || ' Bedroom'
       ELSE CAST(nb AS VARCHAR(20)) || ' BHK' END AS size,
  CAST(NULL AS VARCHAR(20)) AS society,
  CASE l_partkey % 12
       WHEN 0 THEN CAST(a AS VARCHAR(20)) || ' - ' || CAST(a + 251 AS VARCHAR(20))
       WHEN 1 THEN CAST(a AS VARCHAR(20)) || 'Sq. Meter'
       WHEN 2 THEN CAST(a AS VARCHAR(20)) || 'Sq. Yards'
       WHEN 3 THEN CAST(1 + a % 3 AS VARCHAR(20)) || 'Acres'
       WHEN 4 THEN CAST(1 + a % 9 AS VARCHAR(20)) || 'Guntha'
       WHEN 5 THEN CAST(1 + a % 20 AS VARCHAR(20)) || 'Perch'
       WHEN 6 THEN 'call owner'
       WHEN 7 THEN CAST(1 + a % 9 AS VARCHAR(20)) || 'Cents'
       ELSE CAST(a AS VARCHAR(20)) END AS total_sqft,
  CASE WHEN l_orderkey % 180 = 0 THEN NULL ELSE CAST(1 + l_suppkey % 7 AS DOUBLE) END AS bath,
  CASE WHEN l_orderkey % 22 = 0 THEN NULL ELSE CAST(l_linenumber % 4 AS DOUBLE) END AS balcony,
  l_extendedprice / 1000.0 AS price
FROM (
  SELECT l.*, n_name, 300 + (l_partkey * 37 + l_orderkey) % 4000 AS a, 1 + CAST(l_quantity AS INT) % 6 AS nb
  FROM {lineitem} l JOIN {supplier} s ON l_suppkey = s_suppkey JOIN {nation} n ON s_nationkey = n_nationkey
) x
"""
_LISTING = "area_type, availability, location, size, society, total_sqft, bath, balcony, price"

# Rows with their unique key, and the raw table with planted exact duplicates.
KEYED_SQL = _ROWS
DIRTY_SQL = f"""
SELECT {_LISTING} FROM ({_ROWS}) y
UNION ALL
SELECT {_LISTING} FROM ({_ROWS}) z WHERE l_partkey % 97 = 0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation")})


def dirty_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, DIRTY_SQL)


def keyed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty rows with the four columns that identify them, no planted duplicates."""
    return _run(spark, sf_dir, KEYED_SQL)


def parsed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed rows, parsed but neither folded nor filtered."""
    return parse_listings(keyed_listings(spark, sf_dir)).select(*LISTING_KEYS, *CLEAN_LISTING.names)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their part and supplier nation, as a market of ``price`` and ``total_sqft``."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    suppliers = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select("s_suppkey", "n_name")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_partkey", "p_brand", "p_type", "n_name", F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("total_sqft"),
    )
