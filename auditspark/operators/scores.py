"""Roll-ups of issues and files, and the scores made from them.

All counters of a scan come from one grouped aggregate over issues and one over files, both with
partial aggregation before the shuffle, so a scan that holds most of the data is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import dims
from auditspark.functions import text


def _severe() -> Column:
    return (F.col("category") == "reliability") & F.lower("severity").isin("high", "critical")


def _named(*signs: str) -> Column:
    test = F.col("rule_id").contains(signs[0])
    for sign in signs[1:]:
        test = test | F.col("rule_id").contains(sign)
    return test


def issue_rollup(issues: DataFrame) -> DataFrame:
    """Every per-scan counter the scores and recommendations need."""
    severity = F.lower("severity")
    exposed = F.col("category").isin("security", "dependency")
    auth = _named("AUTH") | F.lower("issue_type").contains("authentication")
    crafted = F.col("category").isin("quality", "maintainability")
    return issues.groupBy("scan_id").agg(
        F.count("*").alias("issues"),
        *[F.count_if(severity == name).alias(name) for name in dims.SEVERITIES],
        F.sum(F.when(exposed, text.weight(F.col("severity"), dims.SECURITY_WEIGHT, 1)).otherwise(0)).alias("security_weight"),
        F.sum(
            F.when(F.col("category") == "dependency", text.weight(F.col("severity"), dims.DEPENDENCY_WEIGHT, 2)).otherwise(0)
        ).alias("dependency_weight"),
        F.count_if(_named("SECRET")).alias("secret_hits"),
        F.count_if(auth).alias("auth_hits"),
        F.count_if(_named("INPUT_VALIDATION")).alias("input_hits"),
        F.count_if(_severe()).alias("reliability_hits"),
        F.count_if(_named("MISSING_EXCEPTION_HANDLING")).alias("unhandled_hits"),
        F.count_if(_named("EMPTY_EXCEPTION_HANDLER")).alias("swallowed_hits"),
        F.count_if(_named("DUPLICATION")).alias("duplication_hits"),
        F.count_if(_named("LONG_FUNCTION")).alias("long_hits"),
        F.count_if(_named("DEAD_CODE")).alias("dead_hits"),
        F.count_if(_named("COMPLEXITY")).alias("complexity_hits"),
        F.count_if(exposed & _named("SECRET")).alias("rec_secret"),
        F.count_if(exposed & _named("INJECTION")).alias("rec_injection"),
        F.count_if((F.col("category") == "reliability") & _named("MISSING_EXCEPTION_HANDLING")).alias("rec_exceptions"),
        F.count_if(crafted & _named("DUPLICATION")).alias("rec_duplication"),
    )


def severity_distribution(issues: DataFrame) -> DataFrame:
    severity = F.lower("severity")
    return issues.groupBy("scan_id").agg(*[F.count_if(severity == name).alias(name) for name in dims.SEVERITIES])


def file_issue_counts(issues: DataFrame) -> DataFrame:
    severity = F.lower("severity")
    return issues.groupBy("scan_id", "file_path").agg(
        F.count("*").alias("issue_count"),
        *[F.count_if(severity == name).alias(f"{name}_count") for name in dims.SEVERITIES],
        F.count_if(_named("DUPLICATION")).alias("duplication_blocks"),
        F.sum(text.weight(F.col("severity"), dims.RISK_WEIGHT, 1)).alias("risk_weight"),
    )


def file_risk(weight_sum: Column) -> Column:
    return text.py_round(F.least(F.lit(100.0), weight_sum * F.lit(2.4)), 2)


def file_report(metrics: DataFrame, issues: DataFrame) -> DataFrame:
    """Metrics of every file with its issue counts and risk; files without issues get zeros."""
    counts = ["issue_count", *[f"{name}_count" for name in dims.SEVERITIES], "duplication_blocks", "risk_weight"]
    joined = metrics.join(file_issue_counts(issues), ["scan_id", "file_path"], "left")
    filled = joined.select(*metrics.columns, *[F.coalesce(name, F.lit(0)).alias(name) for name in counts])
    return filled.withColumn("risk_score", file_risk(F.col("risk_weight"))).drop("risk_weight")


def file_rollup(metrics: DataFrame) -> DataFrame:
    """Totals of each scan's files; index values are added as whole hundredths, so order does not matter."""
    hundredths = F.bround(F.col("maintainability_index") * 100, 0).cast("bigint")
    return metrics.groupBy("scan_id").agg(
        F.count("*").alias("files"),
        F.sum("lines").alias("total_lines"),
        (F.count_if(F.col("has_logging") > 0) / F.count("*")).alias("logging_ratio"),
        (F.count_if(F.col("null_checks") > 0) / F.count("*")).alias("null_check_ratio"),
        (F.sum("complexity") / F.count("*")).alias("mean_complexity"),
        (F.sum(hundredths) / (F.count("*") * 100)).alias("mean_maintainability"),
    )


def scan_rollup(files: DataFrame, issues: DataFrame) -> DataFrame:
    """File totals with issue counters of the same scan; scans without issues count zero."""
    counters = issue_rollup(issues)
    names = [name for name in counters.columns if name != "scan_id"]
    joined = file_rollup(files).join(counters, "scan_id", "left")
    return joined.select(*[c for c in joined.columns if c not in names], *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def _clamp(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), value)).cast("int")


def security_score(weighted: Column, lines: Column) -> Column:
    density = weighted / F.greatest(lines / F.lit(100.0), F.lit(1.0))
    return F.rint(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(100.0) - density * F.lit(3.3)))).cast("int")


def trust_score() -> Column:
    bonus = F.when((F.col("files") > 0) & (F.col("input_hits") == 0), 4).otherwise(0)
    lost = F.col("secret_hits") * 11 + F.col("auth_hits") * 9 + F.col("input_hits") * 4 + F.col("reliability_hits") * 6
    return _clamp(F.lit(100) - lost + bonus)


def reliability_score() -> Column:
    lost = F.col("unhandled_hits") * 6 + F.col("swallowed_hits") * 5 + F.col("reliability_hits") * 4
    gained = F.floor(F.col("logging_ratio") * 8.0) + F.floor(F.col("null_check_ratio") * 6.0)
    return _clamp(F.lit(100) - lost + gained)


def quality_score() -> Column:
    hits = (
        F.col("duplication_hits") * 4 + F.col("long_hits") * 3 + F.col("dead_hits") * 2 + F.col("complexity_hits") * 4
    )
    mean_cc, mean_index = F.col("mean_complexity"), F.col("mean_maintainability")
    heavy = F.when(mean_cc > 20, 8).when(mean_cc > 12, 4).otherwise(0)
    poor = F.when(mean_index < 45, 10).when(mean_index < 65, 5).otherwise(0)
    return _clamp(F.lit(100) - hits - heavy - poor)


def improvement_potential() -> Column:
    health = (
        F.col("security_score") * F.lit(0.35) + F.col("trust_score") * F.lit(0.2)
        + F.col("reliability_score") * F.lit(0.2) + F.col("quality_score") * F.lit(0.25)
    )
    density = F.col("issues") / F.greatest(F.col("files"), F.lit(1))
    return _clamp(F.rint(F.lit(100.0) - health + F.least(F.lit(18.0), density * F.lit(4.0))))


def dependency_score(weighted: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - weighted).cast("int")


def with_scores(rollup: DataFrame) -> DataFrame:
    """Adds the five scores and the dependency score to `scan_rollup`."""
    return (
        rollup.withColumn("security_score", security_score(F.col("security_weight"), F.col("total_lines")))
        .withColumn("trust_score", trust_score())
        .withColumn("reliability_score", reliability_score())
        .withColumn("quality_score", quality_score())
        .withColumn("improvement_potential", improvement_potential())
        .withColumn("dependency_risk_score", dependency_score(F.col("dependency_weight")))
    )


# score -> name of a diagnostic, the counter behind it, and its decimals (None: a whole number)
DIAGNOSTICS = {
    "trust": [("secret_exposure_hits", "secret_hits", None), ("auth_safety_hits", "auth_hits", None),
              ("input_validation_hits", "input_hits", None), ("error_handling_hits", "reliability_hits", None)],
    "reliability": [("missing_exception_cases", "unhandled_hits", 0), ("swallowed_exception_cases", "swallowed_hits", 0),
                    ("critical_reliability_issues", "reliability_hits", 0), ("logging_ratio", "logging_ratio", 3), ("null_check_ratio", "null_check_ratio", 3)],
    "quality": [("duplication_hits", "duplication_hits", 0), ("long_function_hits", "long_hits", 0), ("dead_code_hits", "dead_hits", 0),
                ("complexity_hits", "complexity_hits", 0), ("avg_complexity", "mean_complexity", 2), ("avg_maintainability", "mean_maintainability", 2)],
}


def diagnostics() -> Column:
    """The counters and rounded means behind three of the scores, one struct each."""

    def shown(counter: str, places: int | None) -> Column:
        return F.col(counter) if places is None else F.col(counter).cast("double") if places == 0 else text.py_round(F.col(counter), places)

    return F.struct(*[F.struct(*[shown(c, p).alias(n) for n, c, p in rows]).alias(score) for score, rows in DIAGNOSTICS.items()])


def score_radar(scored: DataFrame) -> DataFrame:
    """One row per scan and score axis."""
    axes = F.array(*[
        F.struct(F.lit(name.split("_")[0]).alias("axis"), F.col(name).alias("value")) for name in dims.SCORES
    ])
    return scored.select("scan_id", F.explode(axes).alias("a")).select("scan_id", "a.axis", "a.value")


def recommendations(scored: DataFrame) -> DataFrame:
    """Ordered advice per scan from rows that hold scores, counters and the test and maturity scores."""
    conditions = [
        ("secret", F.col("rec_secret") > 0),
        ("injection", F.col("rec_injection") > 0),
        ("exceptions", F.col("rec_exceptions") > 0),
        ("duplication", F.col("rec_duplication") > 0),
        ("quality", F.col("quality_score") < 70),
        ("security", F.col("security_score") < 75),
        ("tests", F.col("test_coverage_score") < 50),
        ("maturity", F.col("code_maturity_index") < 55),
    ]
    topics = F.array_compact(F.array(*[F.when(test, topic) for topic, test in conditions]))
    chosen = F.when(F.size(topics) == 0, F.array(F.lit("none"))).otherwise(topics)
    wording = F.create_map(*[F.lit(part) for item in dims.RECOMMENDATIONS.items() for part in item])
    one = scored.select("scan_id", F.posexplode(chosen).alias("pos", "topic"))
    return one.select("scan_id", (F.col("pos") + 1).alias("position"), "topic", F.element_at(wording, F.col("topic")).alias("advice"))
