"""A whole scan: files in, issues, file metrics and scores out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark import dims, schema
from auditspark.operators import (
    dependencies, duplication, enrich, extract, issues, line_rules, metrics, project, reports, scores, structure_rules,
)
from auditspark.session import stored
from auditspark.sources import files as sources


@dataclass(frozen=True)
class Scan:
    """The tables of all scans of one job."""

    issues: DataFrame
    files: DataFrame
    scans: DataFrame
    recommendations: DataFrame
    heat_map: DataFrame
    skipped: DataFrame
    quarantine: DataFrame


def riskiest(files: DataFrame, extra_rules=()) -> DataFrame:
    """Severity counts and security score of each scan from the line rules alone.

    Each text is read once: a row of numbers per file, and one aggregate with partial sums.
    """
    rules = dims.rule_rows(extra_rules)
    seqs = F.transform(line_rules.line_hits(F.col("content"), extra_rules), lambda h: h["rule_seq"])
    each = files.select("scan_id", metrics.text.count_lines(F.col("content")).alias("lines"), seqs.alias("hits"))

    def added(values: list[int]):
        """Sum of a number per rule over the hits of all files."""
        table = F.array(*map(F.lit, values))
        return F.sum(F.aggregate("hits", F.lit(0), lambda total, seq: total + F.get(table, seq)))

    weights = [dims.SECURITY_WEIGHT.get(r[4], 1) if r[3] in ("security", "dependency") else 0 for r in rules]
    counted = each.groupBy("scan_id").agg(
        F.count("*").alias("files"), F.sum("lines").alias("total_lines"), F.sum(F.size("hits")).alias("issues"),
        *[added([int(r[4] == name) for r in rules]).alias(name) for name in dims.SEVERITIES],
        added(weights).alias("security_weight"),
    )
    score = scores.security_score(F.col("security_weight"), F.col("total_lines")).alias("security_score")
    return counted.select("scan_id", "files", "total_lines", "issues", *dims.SEVERITIES, score)


def file_facts(files: DataFrame, extra_rules=()) -> DataFrame:
    """One row per file with all that later steps need of it; each text is read once and left behind."""
    facts = extract.structure(metrics.profile(files, extra_rules, signs=False))
    return facts.withColumn("line_hits", F.concat("line_hits", "extra_hits")).drop("extra_hits") if extra_rules else facts


def file_findings(facts: DataFrame, extra_rules=()) -> DataFrame:
    """Findings that rest on single files: line rules, structure, complexity and manifests.

    All but the manifests' come out of one reading of the facts and one explode.
    """
    own = F.concat(line_rules.hit_array(F.col("line_hits"), extra_rules), structure_rules.structure_array(), metrics.complexity_array())
    manifests = facts.where(F.col("manifest").isNotNull()).select("scan_id", "file_path", F.col("manifest").alias("content"))
    return issues.union_findings(schema.spread(metrics.with_measures(facts), own), dependencies.dependency_findings(manifests))


def function_pairs(blocks: DataFrame, similar_pairs: int | None = None) -> DataFrame:
    """Pairs of similar functions to report: the first ones of each scan, or without a number one for each link between distinct
    bodies and one for each copy."""
    classes = stored(duplication.function_classes(blocks), "classes")
    links = stored(duplication.class_links(classes), "links")
    if similar_pairs is None:
        return duplication.representative_pairs(blocks, classes, links)
    return duplication.reported_pairs(blocks, classes, links, similar_pairs)


def findings(chosen: DataFrame, facts: DataFrame, extra_rules=(), max_blocks=None, similar_pairs=None) -> DataFrame:
    """All findings; only the search for repeated blocks reads the texts again. Nothing has a limit unless it is given."""
    return issues.union_findings(
        file_findings(facts, extra_rules),
        duplication.block_findings(chosen, max_blocks),
        duplication.similarity_findings(function_pairs(extract.blocks_of(facts), similar_pairs)),
        project.safeguard_findings(facts),
    )


def scan(
    files: DataFrame, include_extensions=None, exclude_paths=None, max_files=None, extra_rules=(), max_blocks=None,
    similar_pairs=None, answers=None, sources_of=None,
) -> Scan:
    """Scan every ``scan_id`` of ``files(scan_id, file_path, content)``.

    Nothing is left out unless the caller says so; files that are not selected are rows of ``skipped``, and issues that
    do not fit the schema are rows of ``quarantine`` and count nowhere. ``answers(scan_id, issue_seq, raw)`` of a reviewer
    are applied before anything is counted. ``sources_of(scan_id, owner_uid, source_type, source_label, started_at,
    finished_at)`` adds where a scan came from and how long it took.

    Two tables are written to the shared folder, since several later steps read each of them and the
    Python workers behind the first should run once: file facts and findings. Readme and licence of a
    project count even if their suffix is not selected, so the facts hold them too, unselected.
    """
    marked = sources.mark_source_files(files, include_extensions, exclude_paths, max_files)
    root_names = dims.README_NAMES + dims.LICENSE_NAMES
    every = stored(file_facts(marked.where(F.col("selected") | F.col("file_path").isin(root_names)), extra_rules), "facts")
    facts = every.where("selected")
    found = stored(findings(marked.where("selected"), facts, extra_rules, max_blocks, similar_pairs), "findings")
    listed = enrich.add_guidance(issues.number_issues(found))
    if answers is not None:
        listed = enrich.apply_answers(listed, enrich.parse_answers(answers))
    listed = listed.withColumn("problem", issues.schema_problem({name: F.col(name) for name in listed.columns}))
    refused, listed = listed.where(F.col("problem").isNotNull()), listed.where(F.col("problem").isNull()).drop("problem")
    if answers is not None or extra_rules:
        # what is counted is what is listed: answers change severities, and own rules may not fit the schema
        listed = stored(listed, "issues")
        found = listed
    report = scores.file_report(metrics.file_metrics(facts), found)
    scored = scores.with_scores(scores.scan_rollup(report, found))
    full = scored.join(project.test_coverage(facts), "scan_id").join(project.maturity(facts, every), "scan_id")
    full = full.join(project.safeguards(facts).drop("has_auth", "first_backend"), "scan_id")
    if answers is None:
        full = full.withColumn("mode", F.lit("basic"))
    else:
        answered = answers.groupBy("scan_id").agg(F.count("*").alias("answers"))
        full = full.join(answered, "scan_id", "left").withColumn("mode", F.when(F.col("answers") > 0, "advanced").otherwise("basic_fallback")).drop("answers")
    if sources_of is not None:
        seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / F.lit(1e6)
        full = full.join(sources_of.withColumn("duration_seconds", metrics.text.py_round(seconds, 2)), "scan_id", "left")
    return Scan(listed, report, full, scores.recommendations(full), reports.heat_map(report, None), sources.skipped_files(marked), refused)


def scan_document(scans: DataFrame) -> DataFrame:
    """Nested result per scan, without its issues and files, which stay tables."""
    totals = F.struct(
        F.col("files").alias("total_files_scanned"), F.col("total_lines").alias("total_lines_analyzed"),
        F.col("issues").alias("total_issues_found"), *dims.SEVERITIES,
    )
    return scans.select(
        "scan_id", totals.alias("totals"), F.struct(*dims.SCORES).alias("scores"),
        F.struct(*dims.SEVERITIES).alias("severity_distribution"),
        F.struct(*[F.col(s).alias(s.split("_")[0]) for s in dims.SCORES]).alias("score_radar"),
        F.struct(
            F.col("mode").alias("ai_mode_applied"),
            F.struct("logging_ratio", "null_check_ratio").alias("aggregate_metrics"),
            scores.diagnostics().alias("score_diagnostics"),
            F.struct("missing_input_validation_signals", "auth_layer_missing", "insecure_cors", "debug_enabled").alias("architecture_validator"),
            F.struct("has_test_folder", "has_pytest_or_unittest", "test_file_count", "test_coverage_score").alias("test_coverage"),
            F.struct("has_readme", "readme_quality", "has_license", "modular_structure", "logging_detected", "code_maturity_index").alias("code_maturity"),
            "dependency_risk_score",
        ).alias("metadata"),
    )
