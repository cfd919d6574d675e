"""Bounded samples of labelled documents to fit a classifier on, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Is the row outside of what may be learned from: crc32 of the id as text leaves 2 by 4; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(labelled: DataFrame, per_class: int, total: int) -> DataFrame:
    """At most ``per_class`` rows of each label of ``labelled(doc_id, label)`` and ``total`` rows, the same in each run.

    Rows are taken in the order of a hash of their id, class by class in turn. Up to
    1,000 per class, Spark keeps no more rows of a class than that in any task.
    """
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = labelled.where("doc_id is not null and label is not null").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= per_class).orderBy("rank", "label", "doc_id").limit(total).select("doc_id", "label")


def texts_of(chosen: DataFrame, documents: DataFrame) -> DataFrame:
    """``(label, text)`` of a bounded sample; its size is bounded by ``sample``, so that it is broadcast."""
    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(F.broadcast(chosen.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id").select("label", "text"))


def fresh(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
