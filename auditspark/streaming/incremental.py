"""Scan of newly arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditspark import dims
from auditspark.operators import line_rules
from auditspark.plans import scan
from auditspark.session import stored


def scan_new_files(files: DataFrame, findings_path: str, summary_path: str, checkpoint: str, line_rules_only: bool = False) -> StreamingQuery:
    """Findings of each batch of new ``files`` that rest on single files, and their counts per file.

    Both tables are partitioned by batch number and a repeated batch overwrites its own part. A batch reads nothing of
    earlier ones, so its cost does not grow with the history; `current_counts` adds up.
    """

    def take(batch: DataFrame, number: int) -> None:
        part = f"batch_id={number}"
        found = line_rules.line_findings(batch) if line_rules_only else scan.file_findings(stored(scan.file_facts(batch), "arrived"))
        found.write.mode("overwrite").parquet(f"{findings_path}/{part}")
        written = batch.sparkSession.read.schema(found.schema).parquet(f"{findings_path}/{part}")
        counts = [F.count_if(F.col("severity") == name).alias(name) for name in dims.SEVERITIES]
        per_file = written.groupBy("scan_id", "file_path").agg(*counts)
        # files without findings count too: they may replace a version that had some
        arrived = batch.select("scan_id", "file_path").distinct().join(per_file, ["scan_id", "file_path"], "left")
        arrived.na.fill(0, dims.SEVERITIES).write.mode("overwrite").parquet(f"{summary_path}/{part}")

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counts(spark: SparkSession, summary_path: str) -> DataFrame:
    """Findings by severity of each scan, taking the last version of each file."""
    last = spark.read.parquet(summary_path).groupBy("scan_id", "file_path").agg(F.max_by(F.struct(*dims.SEVERITIES), "batch_id").alias("c"))
    return last.groupBy("scan_id").agg(*(F.sum(F.col("c")[name]).alias(name) for name in dims.SEVERITIES))
