"""Tables of the printed report and of the overview page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark import dims
from auditspark.functions import text
from auditspark.sources import committed

HEAT_FILES, TOP_FINDINGS, TOP_SUGGESTIONS, PRINTED_ADVICE = 60, 12, 6, 10


def heat_map(file_report: DataFrame, limit: int | None = HEAT_FILES) -> DataFrame:
    """The riskiest files of each scan with their place; without a limit all files, and no place."""
    if limit is None:
        return file_report.select("scan_id", "file_path", "risk_score", "issue_count")
    order = Window.partitionBy("scan_id").orderBy(F.col("risk_score").desc(), "file_path")
    ranked = file_report.select("scan_id", "file_path", "risk_score", "issue_count").withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= limit)


def _severest(issues: DataFrame, limit: int) -> DataFrame:
    rank = text.weight(F.col("severity"), dims.SEVERITY_RANK, 0)
    order = Window.partitionBy("scan_id").orderBy(rank.desc(), "issue_seq")
    return issues.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def top_findings(issues: DataFrame, limit: int = TOP_FINDINGS) -> DataFrame:
    return _severest(issues, limit).select(
        "scan_id", "position", F.initcap("severity").alias("severity_title"),
        F.left("issue_type", F.lit(42)).alias("type_cut"), F.left("file_path", F.lit(44)).alias("path_cut"), "line",
    )


def top_suggestions(issues: DataFrame, limit: int = TOP_SUGGESTIONS) -> DataFrame:
    suggestion = F.replace(text.strip(F.col("suggested_code")), F.lit("\n"), F.lit(" "))
    shown = text.first_text(suggestion, text.strip(F.col("best_practice")))
    return _severest(issues, limit).select(
        "scan_id", "position", F.left("issue_type", F.lit(34)).alias("type_cut"),
        F.left(F.coalesce(shown, F.lit("")), F.lit(120)).alias("suggestion_cut"),
    )


def summary_lines(scans: DataFrame) -> DataFrame:
    """The two summary lines of a scan from its totals and its side scores."""

    def label(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    return scans.select(
        "scan_id",
        label("Files scanned: ", F.col("files"), " | Lines analyzed: ", F.col("total_lines"), " | Issues found: ",
              F.col("issues"), " | AI mode: ", F.col("mode")).alias("totals_line"),
        label("Dependency Risk Score: ", F.col("dependency_risk_score"), "/100 | Test Coverage Score: ",
              F.col("test_coverage_score"), "/100 | Code Maturity Index: ", F.col("code_maturity_index"), "/100").alias("side_line"),
    )


def score_table(scored: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(s).alias("key"), F.col(s).alias("value")) for s in dims.SCORES])
    one = scored.select("scan_id", F.explode(rows).alias("r"))
    return one.select(
        "scan_id", text.humanize(F.col("r.key")).alias("label"), F.concat(F.col("r.value").cast("string"), F.lit("/100")).alias("shown")
    )


def severity_bars(distribution: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(s).alias("key"), F.col(s).alias("count")) for s in dims.SEVERITIES])
    one = distribution.select("scan_id", F.posexplode(rows).alias("position", "r"))
    return one.select("scan_id", "position", F.initcap("r.key").alias("bar"), F.col("r.count").alias("issues"))


def printed_advice(recommendations: DataFrame, limit: int = PRINTED_ADVICE) -> DataFrame:
    numbered = F.concat(F.col("position").cast("string"), F.lit(". "), "advice")
    return recommendations.where(F.col("position") <= limit).select("scan_id", "position", "topic", numbered.alias("shown"))


def detail_view(issues: DataFrame) -> DataFrame:
    """The texts shown for one issue, each with its fallbacks."""
    c = F.col
    note = text.first_text
    before = note(c("before_code"), c("code_snippet"), "// N/A")
    after = note(c("after_code"), c("refactored_code"), "// N/A")
    return issues.select(
        "scan_id", "issue_seq",
        F.concat(F.lit("Severity: "), F.upper("severity"), F.lit(" | Confidence: "), text.confidence_label(c("confidence"))).alias("head"),
        c("risk_explanation").alias("risk"),
        note(c("real_world_attack_scenario"), "No scenario generated.").alias("scenario"),
        note(c("why_this_is_dangerous"), c("why_dangerous")).alias("danger"),
        note(c("secure_fix_explanation"), c("suggested_code")).alias("fix"),
        note(c("best_practice_reference"), c("best_practice")).alias("practice"),
        note(c("performance_impact"), "No material performance impact expected.").alias("performance"),
        note(c("refactored_code"), c("refactored_example"), "# No suggestion generated").alias("refactored"),
        F.concat(F.lit("// Before\n"), before, F.lit("\n\n// After\n"), after).alias("before_after"),
        note(c("improvement_reasoning"), c("secure_fix_explanation"), c("suggested_code")).alias("reasoning"),
        note(c("suggested_code"), c("secure_fix_explanation"), "# No secure fix generated").alias("suggestion"),
        note(c("confidence_score"), text.confidence_label(c("confidence"))).alias("confidence_shown"),
    )


def json_rows(table: DataFrame, part: str, order: Column) -> DataFrame:
    """JSON lines of a result table, one object per row, for `export_json`."""
    body = [name for name in table.columns if name != "scan_id"]
    return table.select("scan_id", F.lit(part).alias("part"), order.cast("bigint").alias("seq"), F.to_json(F.struct("scan_id", *body)).alias("json"))


EXPORTED = "value string, scan_id string"


def export_json(rows: DataFrame, path: str, rows_per_file: int = 200_000) -> None:
    """One folder per scan with JSON lines; a scan that was exported before is replaced.

    A large scan is spread over several files and is never one document in memory.
    """
    # adaptive execution cuts a scan's rows by size, whatever their numbers are
    placed = rows.hint("rebalance", "scan_id", "part").select("scan_id", F.col("json").alias("value"))
    committed.publish(placed, path, "text", ("scan_id",), maxRecordsPerFile=rows_per_file)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """``(value, scan_id)``: the JSON lines of an export."""
    return committed.committed(spark, path, EXPORTED, "text")
