"""The shape of a finding and the helpers that build one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import dims

# A finding before it is numbered; (phase, file_path, stage, seq1, seq2) is its place in the report.
FINDING = [
    "scan_id", "file_path", "line", "rule_id", "issue_type", "category", "severity", "message",
    "code_snippet", "confidence", "tags", "phase", "stage", "seq1", "seq2",
]

#: an array of findings as they leave a row
FINDINGS = (
    "array<struct<line:int,rule_id:string,issue_type:string,category:string,severity:string,message:string,"
    "code_snippet:string,confidence:double,tags:array<string>,phase:int,stage:int,seq1:bigint,seq2:bigint>>"
)

FILE_PHASE, BLOCK_PHASE, FUNCTION_PHASE, MANIFEST_PHASE, PROJECT_PHASE, CONFIG_PHASE = range(1, 7)
LINE_STAGE, STRUCTURE_STAGE, COMPLEXITY_STAGE, MAINTAINABILITY_STAGE = range(1, 5)


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def finding(
    rule_id: str, *, line=1, message=None, snippet="", phase=FILE_PHASE, stage=0, seq1=0, seq2=0,
    severity=None, confidence=None, extra_tag=None,
) -> Column:
    """A finding struct; everything the rule fixes is a literal in the plan."""
    _, issue_type, category, default_severity, default_confidence, tags = dims.RULES[dims.RULE_SEQ[rule_id]]
    tag_array = F.array(*[F.lit(tag) for tag in tags])
    if extra_tag is not None:
        tag_array = F.concat(tag_array, F.array(_column(extra_tag)))
    return F.struct(
        _column(line).cast("int").alias("line"),
        F.lit(rule_id).alias("rule_id"),
        F.lit(issue_type).alias("issue_type"),
        F.lit(category).alias("category"),
        _column(severity if severity is not None else default_severity).alias("severity"),
        _column(message if message is not None else dims.MESSAGES[rule_id]).alias("message"),
        _column(snippet).alias("code_snippet"),
        _column(confidence if confidence is not None else default_confidence).cast("double").alias("confidence"),
        tag_array.alias("tags"),
        F.lit(phase).alias("phase"),
        F.lit(stage).alias("stage"),
        _column(seq1).cast("bigint").alias("seq1"),
        _column(seq2).cast("bigint").alias("seq2"),
    )


def spread(df: DataFrame, findings: Column) -> DataFrame:
    """One row per finding from an array of findings that may hold nulls."""
    one = df.select("scan_id", "file_path", F.explode(F.array_compact(findings)).alias("f"))
    return one.select("scan_id", "file_path", "f.*").select(*FINDING)
