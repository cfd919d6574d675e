"""Scan history: append, latest scans, averages, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditspark import dims
from auditspark.functions import text
from auditspark.sources import committed, json_lists

KEPT_SCANS = 100
AVERAGED = ["security_score", "reliability_score", "quality_score", "trust_score"]
HISTORY_SCHEMA = (
    "scan_id string, owner_uid string, source_type string, source_label string, created_at timestamp, "
    "updated_at timestamp, totals struct<total_files_scanned:int,total_lines_analyzed:int,total_issues_found:int,"
    "critical:int,high:int,medium:int,low:int>, scores struct<security_score:int,trust_score:int,"
    "reliability_score:int,quality_score:int,improvement_potential:int>"
)


def parse_history(texts: DataFrame) -> DataFrame:
    """History rows from JSON lists in ``value``; a text that is no list, or is damaged, gives none."""
    item = StructType.fromDDL(HISTORY_SCHEMA).simpleString()
    items = F.when(text.strip(F.col("value")).startswith("["), F.from_json("value", f"array<{item}>"))
    return texts.select(F.explode(items).alias("h")).select("h.*").where(F.col("scan_id").isNotNull())


def read_history_json(spark: SparkSession, path: str) -> DataFrame:
    """History kept as files that each hold one JSON list, of any size: a list is read by many tasks.

    A file that is no whole list gives no rows, and an element that is no history row is left out.
    """
    return json_lists.list_objects(spark, path).select(F.from_json("text", HISTORY_SCHEMA).alias("h")).select("h.*").where(F.col("scan_id").isNotNull())


def history_rows(scans: DataFrame, sources: DataFrame) -> DataFrame:
    """A history row of each finished scan.

    ``scans`` are those of `plans.scan.scan`, and ``sources(scan_id, owner_uid, source_type, source_label, started_at,
    finished_at)`` says where they came from. Scans without a source keep their totals and scores.
    """
    totals = F.struct(
        F.col("files").cast("int").alias("total_files_scanned"), F.col("total_lines").cast("int").alias("total_lines_analyzed"),
        F.col("issues").cast("int").alias("total_issues_found"), *[F.col(s).cast("int").alias(s) for s in dims.SEVERITIES],
    )
    return scans.join(sources, "scan_id", "left").select(
        "scan_id", "owner_uid", "source_type", "source_label",
        F.col("started_at").cast("timestamp").alias("created_at"), F.col("finished_at").cast("timestamp").alias("updated_at"),
        totals.alias("totals"), F.struct(*[F.col(s).cast("int").alias(s) for s in dims.SCORES]).alias("scores"),
    )


def append_history(scans: DataFrame, path: str) -> None:
    """Add scans to a history table; a scan that it holds already is replaced, also when a job runs again."""
    committed.publish(scans.select(*StructType.fromDDL(HISTORY_SCHEMA).names), path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The scans of a history table."""
    return committed.committed(spark, path, HISTORY_SCHEMA)


def kept_scans(history: DataFrame, limit: int = KEPT_SCANS) -> DataFrame:
    """The latest scans over all owners."""
    return history.orderBy(F.col("updated_at").desc(), "scan_id").limit(limit)


def list_history(history: DataFrame, limit: int = 20) -> DataFrame:
    """The newest scans of each owner."""
    order = Window.partitionBy("owner_uid").orderBy(F.col("updated_at").desc(), "scan_id")
    return history.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def owner_analytics(history: DataFrame, owners: DataFrame) -> DataFrame:
    """Number, averages and last time of each owner's scans; owners without scans get zeros."""
    grouped = history.groupBy("owner_uid").agg(
        F.count("*").alias("total_scans"),
        *[text.py_round(F.sum(name) / F.count("*"), 2).alias(f"avg_{name}") for name in AVERAGED],
        F.max("updated_at").alias("last_scan_at"),
    )
    zeros = [F.coalesce("total_scans", F.lit(0)).alias("total_scans")]
    zeros += [F.coalesce(f"avg_{name}", F.lit(0.0)).alias(f"avg_{name}") for name in AVERAGED]
    return owners.select("owner_uid").distinct().join(grouped, "owner_uid", "left").select("owner_uid", *zeros, "last_scan_at")


def compare(history: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score differences, second scan minus first, for each pair whose scans both exist."""
    a = history.select(F.col("scan_id").alias("scan_a"), *[F.col(s).alias(f"a_{s}") for s in dims.SCORES])
    b = history.select(F.col("scan_id").alias("scan_b"), *[F.col(s).alias(f"b_{s}") for s in dims.SCORES])
    both = pairs.join(a, "scan_a").join(b, "scan_b")
    return both.select("scan_a", "scan_b", *[(F.col(f"b_{s}") - F.col(f"a_{s}")).alias(f"diff_{s}") for s in dims.SCORES])
