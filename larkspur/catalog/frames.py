"""Small tables made here, as relations that need no job to be read."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Goes by way of Arrow, which Spark keeps as a local relation."""
    columns = list(zip(*rows)) if rows else [()] * len(schema.fields)
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), schema)
