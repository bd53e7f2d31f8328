"""Match-shaped tables derived from the generic star schema, so that every operator runs on the given data.

Each projection is a list of SQL expressions over one input table, valid in Spark and in DuckDB alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SAMPLES = (
    "user_id % 64 AS match_id",
    "event_id AS frame_index",
    "event_id * 5 AS t_ms",
    "event_id * 5 / 1000.0D AS t_sec",
    "CASE WHEN event_type <> 'error' THEN CAST((event_id * 3 + user_id * 7) % 600 + event_id * 7919 % 40 AS DOUBLE) END AS x",
    "CASE WHEN event_type <> 'error' THEN CAST((event_id * 2 + user_id * 5) % 330 + event_id * 6007 % 30 AS DOUBLE) END AS y",
    "CAST(event_id % 97 AS DOUBLE) / 100.0D AS conf",
    "event_type NOT IN ('error', 'signup') AS detected",
    "event_type = 'signup' AS interpolated",
    "CAST((event_id - event_id % 400) / 400 AS BIGINT) AS shot_id",
)
BOXES = (
    "l_orderkey AS frame_index",
    "CAST(l_linenumber AS BIGINT) AS det_id",
    "CAST(l_partkey % 560 AS DOUBLE) AS x1",
    "CAST(l_suppkey * 37 % 300 AS DOUBLE) AS y1",
    "CAST(l_partkey % 560 + 8 + l_suppkey % 30 AS DOUBLE) AS x2",
    "CAST(l_suppkey * 37 % 300 + 20 + l_partkey % 60 AS DOUBLE) AS y2",
    "l_discount * 10 AS conf",
    "CAST(l_linenumber % 4 AS BIGINT) AS class_id",
)
RANGES = (
    "o_custkey AS match_id",
    "o_orderkey AS range_id",
    "CAST(o_orderkey * 7919 % 5400 AS DOUBLE) AS start_sec",
    "CAST(o_orderkey * 7919 % 5400 + o_orderkey * 31 % 400 - 40 AS DOUBLE) AS end_sec",
)
POINTS = ("o_custkey AS match_id", "o_orderkey AS point_id", "CAST(o_orderkey * 104729 % 5600 AS DOUBLE) AS t_sec")
ACTIONS = (
    "user_id AS match_id",
    "event_id AS seq",
    "CASE event_type WHEN 'click' THEN 'Shot Taken' WHEN 'view' THEN 'Key Pass' WHEN 'purchase' THEN 'Goal' WHEN 'signup' THEN 'Interception' ELSE 'Dispossessed' END AS action",
    "event_id * 3 / 10.0D AS seconds",
    "CASE user_id % 3 WHEN 0 THEN 'FW' WHEN 1 THEN 'MF' ELSE 'XX' END AS position",
)


def project(spark: SparkSession, sf_dir: str, table: str, columns: tuple[str, ...]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def duck(table: str, columns: tuple[str, ...]) -> str:
    """The same projection as a DuckDB subquery."""
    return "(SELECT " + ", ".join(c.replace("0D", "0::DOUBLE") for c in columns) + f" FROM {table})"
