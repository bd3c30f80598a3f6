"""Select queries over streams.

There are no streaming operators of their own. A select query lowers to
DataFrame operations, though, so one without an order, limit or distinct_on
also runs over a streaming DataFrame bound by ``Frames``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import Table


def parquet_stream(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """A folder to which Parquet files of a table's columns are added."""
    return spark.readStream.schema(table.struct).parquet(path)
