"""Checks on a whole project: safeguards, tests, maturity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import dims, schema
from auditspark.functions import text


def _is_backend(path: Column) -> Column:
    return path.endswith(".py") | path.endswith(".js")


def safeguards(facts: DataFrame) -> DataFrame:
    """Counters per scan, and the file on which a missing sign-in check is reported."""
    path = F.col("file_path")
    flags = facts.groupBy("scan_id").agg(
        F.bool_or("has_auth").alias("has_auth"),
        F.min(F.when(_is_backend(path), path)).alias("first_backend"),
        F.count_if("unchecked_input").alias("missing_input_validation_signals"),
        F.count_if("open_cors").alias("insecure_cors"),
        F.count_if("debug_on").alias("debug_enabled"),
    )
    missing = ~F.col("has_auth") & F.col("first_backend").isNotNull()
    return flags.withColumn("auth_layer_missing", missing.cast("int"))


def safeguard_findings(facts: DataFrame) -> DataFrame:
    no_auth = schema.finding("NO_AUTH_LAYER_DETECTED", phase=schema.PROJECT_PHASE)
    per_scan = safeguards(facts).where(F.col("auth_layer_missing") == 1).withColumnRenamed("first_backend", "file_path")
    flags = [
        ("open_cors", "INSECURE_CORS_WILDCARD"),
        ("debug_on", "DEBUG_MODE_ENABLED"),
        ("unchecked_input", "MISSING_INPUT_VALIDATION_ARCH"),
    ]
    per_file = F.array(*[
        F.when(F.col(flag), schema.finding(rule_id, phase=schema.CONFIG_PHASE, seq1=n))
        for n, (flag, rule_id) in enumerate(flags)
    ])
    return schema.spread(per_scan, F.array(no_auth)).unionByName(schema.spread(facts, per_file))


def test_coverage(facts: DataFrame) -> DataFrame:
    """Signs of tests per scan and their score."""
    path = F.lower("file_path")
    slashed = F.concat(F.lit("/"), path, F.lit("/"))
    is_test = path.startswith("tests/") | path.endswith("_test.py") | path.endswith(".spec.js")
    signs = facts.groupBy("scan_id").agg(
        F.bool_or(slashed.contains("/tests/")).alias("has_test_folder"),
        F.bool_or("test_framework").alias("has_pytest_or_unittest"),
        F.count_if(is_test).alias("test_file_count"),
    )
    files = F.col("test_file_count")
    score = (
        F.lit(25) + F.when(F.col("has_test_folder"), 30).otherwise(0)
        + F.when(F.col("has_pytest_or_unittest"), 25).otherwise(0)
        + F.when(files >= 5, 20).when(files >= 2, 10).otherwise(0)
    )
    return signs.withColumn("test_coverage_score", F.least(F.lit(100), score))


def root_measure(path: Column, content: Column) -> Column:
    """What a readme or licence in the project's root folder contributes; null for other files."""
    rank = F.coalesce(*[F.when(path == name, n) for n, name in enumerate(dims.README_NAMES)])
    headings = F.regexp_count(content, F.lit(rf"(?md)^{text.SPACE}*#+{text.SPACE}+"))
    quality = F.least(F.lit(100), F.floor(F.length(text.strip(content)) / 30).cast("int") + headings * 5)
    return F.when(path.isin(dims.README_NAMES + dims.LICENSE_NAMES), F.struct(
        path.isin(dims.LICENSE_NAMES).alias("is_license"), rank.alias("rank"),
        (F.length(content) > 0).alias("filled"), quality.alias("quality"),
    ))


def root_documents(measured: DataFrame) -> DataFrame:
    """Readme and licence per scan from ``(scan_id, root)``, taken before any suffix filter."""
    picked = measured.where(F.col("root").isNotNull()).groupBy("scan_id").agg(
        F.bool_or("root.is_license").alias("has_license"), F.min_by("root", F.col("root.rank")).alias("m"),
    )
    filled = F.col("m.filled") & F.col("m.rank").isNotNull()
    return picked.select(
        "scan_id", "has_license", filled.alias("has_readme"), F.when(filled, F.col("m.quality")).otherwise(0).alias("readme_quality")
    )


def maturity(facts: DataFrame, measured: DataFrame) -> DataFrame:
    """Documentation, licence, structure and logging per scan, and their score."""
    parts = F.split("file_path", "/")
    shape = facts.groupBy("scan_id").agg(
        F.max(F.size(parts)).alias("depth"),
        F.count_distinct(parts[0]).alias("tops"),
        F.bool_or("logging_text").alias("logging_detected"),
    )
    joined = shape.join(root_documents(measured), "scan_id", "left").select(
        "scan_id",
        F.coalesce("has_readme", F.lit(False)).alias("has_readme"),
        F.coalesce("readme_quality", F.lit(0)).alias("readme_quality"),
        F.coalesce("has_license", F.lit(False)).alias("has_license"),
        ((F.col("depth") >= 3) & (F.col("tops") >= 3)).alias("modular_structure"),
        "logging_detected",
    )
    score = (
        F.lit(20) + F.when(F.col("has_readme"), 20).otherwise(0) + F.when(F.col("has_license"), 15).otherwise(0)
        + F.when(F.col("modular_structure"), 20).otherwise(0) + F.when(F.col("logging_detected"), 15).otherwise(0)
        + F.floor(F.least(F.lit(30.0), F.col("readme_quality") * F.lit(0.3))).cast("int")
    )
    return joined.withColumn("code_maturity_index", F.least(F.lit(100), score))
