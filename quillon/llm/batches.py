"""Arrow batches between Spark and Python, kept small whatever the length of the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.session import ship_package

BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches hold at most so many rows and about so many bytes; a single longer text makes its own batch.

    Spark reads these two settings of the session when a plan runs, which is after the operator has returned, so they cannot
    be put back. They are only ever lowered: smaller ones of the caller stay.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def map_batches(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow with the package on the executors and bounded batches."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def kept_names(keep: tuple[str, ...], result: tuple[str, ...]) -> list[str]:
    """Names under which kept columns come out: one that is also a column of the result gets ``input_`` before it."""
    own = {r.lower() for r in result}
    return [f"input_{k}" if k.lower() in own else k for k in keep]
