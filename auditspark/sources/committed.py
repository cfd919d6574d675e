"""Tables that stay right when jobs are run again: written parts count once they are on a list, and replace earlier rows by scan.

A job writes its rows to a new folder and then adds one row to the commit list, a single file. Rows of a job that was ended before
that are never read, and neither are those of a lost task, whose files Spark's own writer drops. A scan's rows come from the
latest commit that holds it, so that a rerun replaces what it wrote before. Jobs that write to one table follow each other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIST = "part string, seq bigint"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """The commit list; a table that nothing was written to yet has an empty one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LIST)
    return spark.read.schema(LIST).parquet(f"{path}/commits")


def publish(rows: DataFrame, path: str, form: str = "parquet", folders: tuple[str, ...] = (), **options) -> None:
    """Write ``rows`` and put them on the list; in ``folders`` by some columns if wished, with options of the writer."""
    spark, part = rows.sparkSession, f"p{uuid.uuid4().hex}"
    rows.write.format(form).options(**options).partitionBy(*folders).save(f"{path}/data/part={part}")
    last = _commits(spark, path).agg(F.max("seq")).first()[0]
    spark.range(1).select(F.lit(part).alias("part"), F.lit((last or 0) + 1).cast("bigint").alias("seq")).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def committed(spark: SparkSession, path: str, schema: str, form: str = "parquet", key: str = "scan_id") -> DataFrame:
    """The rows of each ``key`` from the latest commit that holds it; ``schema`` names the columns, those of folders last."""
    commits = _commits(spark, path)
    if commits.isEmpty():
        return spark.createDataFrame([], schema)
    data = spark.read.schema(f"{schema}, part string").option("basePath", f"{path}/data").format(form).load(f"{path}/data")
    listed = data.select(key, "part").distinct().join(commits, "part")
    latest = listed.groupBy(key).agg(F.max_by("part", "seq").alias("part"))
    return data.join(latest, (data["part"] == latest["part"]) & data[key].eqNullSafe(latest[key]), "left_semi").drop("part")
