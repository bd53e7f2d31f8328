"""Small helpers that the Arrow-backed operators share.

A task sees its partition as a stream of record batches; rows are bounded by
``ROWS_PER_BATCH`` so that a worker never holds more than one batch of texts.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS_PER_BATCH = 512


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session (long texts else make batches of hundreds of MB), and let workers import this package as the driver does."""
    home, path = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [path, home]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def map_batches(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(step, schema)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    """The named columns as Python lists."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
