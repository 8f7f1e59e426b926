"""Arrow schemas of Spark schemas, and the size of Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Batches that go to Python workers hold at most so many rows and so many bytes, as long as the user hasn't set them.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def arrow_schema(schema: StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as rows, so that very long texts don't add up in a worker.

    Plans read these settings when they run, so they stay set; a value that the session already has is left alone. All
    operators use the same values, whichever was called last.
    """
    known = spark.conf.getAll
    for key, value in BATCH.items():
        if key not in known:
            spark.conf.set(key, value)
