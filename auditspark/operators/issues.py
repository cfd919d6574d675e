"""Issues: union of findings, numbering, schema check, filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark import dims, schema
from auditspark.operators.prefix import sum_before
from auditspark.session import shuffle_partitions, stored

MAX_LISTED = 600


def union_findings(*sources: DataFrame) -> DataFrame:
    """All findings; nothing is merged."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def offsets(counts: DataFrame, group: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """``counts`` with ``offset``: the sum of ``n`` over the earlier rows of the same ``group``.

    Sums in two levels: rows lie in ranges of (group, order), each range adds up its own rows, and a group looks through one row per
    range that it lies in. So no task sorts a whole group. The ranges are drawn once, in a written table.
    """
    ranges = partitions or shuffle_partitions(counts.sparkSession)
    cut = stored(counts.repartitionByRange(ranges, group, *order).withColumn("range", F.spark_partition_id()), "counts")
    return sum_before(cut, [group], "range", order, "n", "offset").drop("range")


def number_issues(findings: DataFrame, partitions: int | None = None) -> DataFrame:
    """Adds ``issue_seq`` (from 1) and ``issue_id`` in report order.

    Rows are numbered within their file, and each file gets an offset from the counts of the files before it, so that neither a
    scan's findings nor its files meet in one task.
    """
    place = ["scan_id", "phase", "file_path"]
    inner = Window.partitionBy(*place).orderBy("stage", "seq1", "seq2", "rule_id", "line")
    counts = findings.groupBy(*place).agg(F.count("*").alias("n"))
    before = offsets(counts, "scan_id", ["phase", "file_path"], partitions).select(*place, "offset")
    numbered = findings.withColumn("n", F.row_number().over(inner)).join(before, place)
    seq = (F.col("n") + F.col("offset")).alias("issue_seq")
    return numbered.select(*schema.FINDING[:11], seq).withColumn("issue_id", issue_id(F.col("scan_id"), F.col("issue_seq")))


def issue_id(scan: Column, seq: Column) -> Column:
    digits = seq.cast("string")
    padded = F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits)
    return F.concat(scan, F.lit("-"), padded)


def classify(facts: DataFrame, extra_rules=()) -> DataFrame:
    """Issues from ``(scan_id, issue_seq, file_path, line, rule_seq)`` and the rule catalogue."""
    catalogue = F.broadcast(dims.rules(facts.sparkSession, extra_rules))
    return facts.join(catalogue, "rule_seq")


def schema_problem(issue: dict[str, Column]) -> Column:
    """Null for an issue that may be stored, else what is wrong with it."""
    required = ["issue_id", "issue_type", "category", "severity", "file_path", "message"]
    out = F.when(reduce(lambda a, b: a | b, [issue[name].isNull() for name in required]), "MISSING_FIELD")
    return (
        out.when(~issue["severity"].isin(dims.SEVERITIES), "BAD_SEVERITY")
        .when(~issue["category"].isin(dims.CATEGORIES), "BAD_CATEGORY")
        .when(~issue["confidence"].between(0.0, 100.0), "BAD_CONFIDENCE")
    )


STORED_TEXTS = ["code_snippet", *dims.GUIDANCE_KEYS, *dims.ALIASES]


def conform(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues that fit the stored schema, refused ones with ``problem``); missing optional fields get defaults."""
    have = set(issues.columns)
    filled = issues
    for name in STORED_TEXTS:
        default = "75%" if name == "confidence_score" else ""
        filled = filled.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default))
    filled = filled.withColumn("line", F.coalesce("line", F.lit(1))).withColumn(
        "confidence", F.coalesce("confidence", F.lit(75.0))
    )
    judged = filled.withColumn("problem", schema_problem({name: F.col(name) for name in filled.columns}))
    kept = ["scan_id", "issue_id", "issue_type", "category", "severity", "file_path", "line", "message", *STORED_TEXTS, "confidence"]
    kept += ["tags"] if "tags" in have else []
    return judged.where(F.col("problem").isNull()).select(*kept), judged.where(F.col("problem").isNotNull())


def filter_issues(issues: DataFrame, severity: str = "all", category: str = "all", path_part: str = "") -> DataFrame:
    out = issues
    if severity != "all":
        out = out.where(F.col("severity") == severity)
    if category != "all":
        out = out.where(F.col("category") == category)
    if path_part:
        out = out.where(F.lower("file_path").contains(path_part.lower()))
    return out


def listed_issues(issues: DataFrame, limit: int = MAX_LISTED) -> DataFrame:
    """The first rows of each scan's issue list."""
    order = Window.partitionBy("scan_id").orderBy("issue_seq")
    return issues.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def visible_to(owner: Column, user: str | None) -> Column:
    """Status and result: rows without owner are visible to everyone."""
    return F.lit(True) if not user else owner.isNull() | (owner == user)


def owned_by(owner: Column, user: str | None) -> Column:
    """History and comparison: own rows only."""
    return F.lit(True) if not user else owner == user
