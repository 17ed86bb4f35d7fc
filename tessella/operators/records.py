"""Open key-value records of the first data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mark_processed(records: DataFrame, data: str = "data") -> DataFrame:
    """Copy every record with ``processed`` set to true."""
    rest = F.map_filter(F.col(data), lambda k, v: k != "processed")
    return records.withColumn(
        data, F.map_concat(rest, F.create_map(F.lit("processed"), F.lit("true")))
    )


def add_metadata(metadata: Column, key: str, value: Column) -> Column:
    rest = F.map_filter(metadata, lambda k, v: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), value))


def get_metadata(metadata: Column, key: str, default: str | None = None) -> Column:
    return F.coalesce(F.try_element_at(metadata, F.lit(key)), F.lit(default))
