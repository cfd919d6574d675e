"""Numbers of issues."""

import random

import pytest
from pyspark.sql import functions as F

from auditspark.operators import issues


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_offsets_are_sums_of_what_comes_before(spark, partitions):
    draw = random.Random(partitions)
    rows = [(draw.choice(["one", "one", "one", "two", "three"]), draw.randint(0, 2), f"p{n:04d}é", draw.randint(1, 9)) for n in range(900)]
    counts = spark.createDataFrame(rows, "scan_id string, phase int, file_path string, n bigint")
    got = {tuple(r)[:3]: r.offset for r in issues.offsets(counts, "scan_id", ["phase", "file_path"], partitions).select("scan_id", "phase", "file_path", "offset").collect()}
    want, sums = {}, {}
    for scan, phase, path, n in sorted(rows, key=lambda r: (r[0], r[1], r[2].encode())):
        want[scan, phase, path] = sums.get(scan, 0)
        sums[scan] = sums.get(scan, 0) + n
    assert got == want


def test_one_scan_of_many_files_lies_in_no_task_as_a_whole(spark):
    """A scan of 1,000,000 files: each range holds a part of it, and the last offset is the sum of all others."""
    counts = spark.range(1_000_000).select(F.lit("s").alias("scan_id"), F.lit(0).alias("phase"), F.format_string("f%07d", "id").alias("file_path"), (F.col("id") % 3 + 1).alias("n"))
    found = issues.offsets(counts, "scan_id", ["phase", "file_path"], 16)
    assert found.where("file_path = 'f0999999'").first().offset == 1_999_998
    sizes = counts.repartitionByRange(16, "scan_id", "phase", "file_path").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 150_000
    assert found.agg(F.sum("offset")).first()[0] == sum((i // 3) * 6 + (0, 1, 3)[i % 3] for i in range(1_000_000))


def test_empty(spark):
    counts = spark.createDataFrame([], "scan_id string, phase int, file_path string, n bigint")
    assert issues.offsets(counts, "scan_id", ["phase", "file_path"]).count() == 0
