"""Intermediate tables of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from auditspark.session import stored

#: files of a table for each core of the cluster
FILES = 4


def compact(df: DataFrame, name: str) -> DataFrame:
    """Write narrow rows that come out of a shuffle, in a few files for each core, and read them back.

    Such tables are small for the number of shuffle partitions that texts need.
    """
    return stored(df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism), name)
