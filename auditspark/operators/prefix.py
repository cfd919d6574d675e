"""Sums over what comes before, in two levels, so that no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sum_before(rows: DataFrame, group: list[str], piece: str, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the earlier rows of the same group.

    Rows of a group lie in pieces that follow each other by ``piece``; within a piece they follow by ``order``. Each piece adds up its own
    rows, and a group looks through one row per piece.
    """
    earlier = Window.partitionBy(*group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, piece).agg(F.sum(value).alias("total"))
    handed = totals.select(*group, piece, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("handed"))
    near = Window.partitionBy(*group, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    looked = rows.withColumn("near", F.coalesce(F.sum(value).over(near), F.lit(0)))
    return looked.join(handed, [*group, piece]).withColumn(name, F.col("near") + F.col("handed")).drop("near", "handed")
