"""Findings in dependency manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import dims, schema
from auditspark.functions import text

# Requirement shape, manifest sections, version marks.
REQUIREMENT = rf"^([A-Za-z0-9_.-]+){text.SPACE}*([<>=!~]+)?{text.SPACE}*([A-Za-z0-9_.-]+)?"
SECTIONS = ["dependencies", "devDependencies", "optionalDependencies"]
OPEN_VERSIONS = ["*", "latest"]
VERSION_PREFIX = r"^[\^~>=< ]+"


def is_manifest(path: Column) -> Column:
    lowered = F.lower(path)
    return lowered.endswith("requirements.txt") | lowered.endswith("package.json")


def requirements(manifest_lines: DataFrame) -> DataFrame:
    """(package, operator, version) of each requirement line of ``(scan_id, [file_path,] line, text)``."""
    line = text.strip(F.col("text"))
    cleaned = manifest_lines.withColumn("text", line).where((line != "") & ~line.startswith("#"))
    parts = cleaned.select(
        *manifest_lines.columns,
        F.lower(F.regexp_extract("text", REQUIREMENT, 1)).alias("package"),
        F.regexp_extract("text", REQUIREMENT, 2).alias("operator"),
        F.regexp_extract("text", REQUIREMENT, 3).alias("version"),
    )
    return parts.where(F.col("package") != "")


def unpinned(reqs: DataFrame) -> DataFrame:
    return reqs.where(F.col("operator") == "")


def outdated(reqs: DataFrame) -> DataFrame:
    """Known packages below their safe version; the risk table has seven rows and is broadcast."""
    risks = F.broadcast(dims.dependency_risks(reqs.sparkSession))
    older = (F.col("version") != "") & text.version_is_lower(F.col("version"), F.col("safe_version"))
    return reqs.join(risks, "package").where(older)


def requirement_findings(files: DataFrame) -> DataFrame:
    chosen = files.where(F.lower("file_path").endswith("requirements.txt"))
    one = chosen.select("scan_id", "file_path", F.posexplode(text.split_lines(F.col("content"))).alias("pos", "text"))
    reqs = requirements(one.select("scan_id", "file_path", (F.col("pos") + 1).alias("line"), "text"))
    common = {"line": F.col("line"), "snippet": F.col("text"), "phase": schema.MANIFEST_PHASE, "seq1": F.col("line")}
    loose = schema.finding(
        "UNPINNED_PY_DEPENDENCY", message=F.concat(F.lit("No version is fixed for '"), "package", F.lit("'.")), seq2=0, **common
    )
    old = schema.finding(
        "OUTDATED_RISKY_DEPENDENCY", severity=F.col("risk_severity"), seq2=1,
        message=F.concat(F.lit("'"), "package", F.lit("' "), "version", F.lit(" is older than "), "safe_version", F.lit(".")),
        **common,
    )
    return schema.spread(unpinned(reqs), F.array(loose)).unionByName(schema.spread(outdated(reqs), F.array(old)))


def package_entries(files: DataFrame) -> DataFrame:
    """``(scan_id, file_path, section, section_seq, entry_seq, name, version)`` of package.json files."""
    fields = ", ".join(f"`{section}` map<string,string>" for section in SECTIONS)
    parsed = files.where(F.lower("file_path").endswith("package.json")).select(
        "scan_id", "file_path", F.from_json("content", fields).alias("p")
    )
    sections = F.array(*[
        F.struct(F.lit(n).alias("section_seq"), F.lit(name).alias("section"), F.map_entries(F.col("p")[name]).alias("entries"))
        for n, name in enumerate(SECTIONS)
    ])
    per_section = parsed.select("scan_id", "file_path", F.explode(sections).alias("s"))
    entries = per_section.select("scan_id", "file_path", "s.section", "s.section_seq", F.posexplode("s.entries").alias("entry_seq", "e"))
    return entries.select(
        "scan_id", "file_path", "section", "section_seq", "entry_seq",
        F.col("e.key").alias("name"), F.coalesce("e.value", F.lit("None")).alias("version"),
    )


def package_risks(entries: DataFrame) -> DataFrame:
    """Entries with an open version or below the safe one; the latter decides the severity."""
    risks = F.broadcast(dims.dependency_risks(entries.sparkSession))
    joined = entries.withColumn("package", F.lower("name")).join(risks, "package", "left")
    bare = F.regexp_replace("version", VERSION_PREFIX, "")
    older = F.col("safe_version").isNotNull() & (bare != "") & text.version_is_lower(bare, F.col("safe_version"))
    is_open = text.strip(F.col("version")).isin(OPEN_VERSIONS)
    severity = F.when(older, F.col("risk_severity")).when(is_open, "medium")
    return joined.withColumn("older", older).withColumn("severity", severity).where(F.col("severity").isNotNull())


def package_findings(files: DataFrame) -> DataFrame:
    risky = package_risks(package_entries(files))
    low = F.concat(F.lit("'"), "name", F.lit("' "), "version", F.lit(" is older than "), "safe_version", F.lit("."))
    loose = F.concat(F.lit("'"), "name", F.lit("' takes any version ('"), "version", F.lit("')."))
    one = schema.finding(
        "JS_DEPENDENCY_RISK", severity=F.col("severity"), message=F.when(F.col("older"), low).otherwise(loose),
        snippet=F.concat(F.lit('"'), "name", F.lit('": "'), "version", F.lit('"')),
        phase=schema.MANIFEST_PHASE, seq1=F.col("section_seq"), seq2=F.col("entry_seq"), extra_tag=F.col("section"),
    )
    return schema.spread(risky, F.array(one))


def dependency_findings(files: DataFrame) -> DataFrame:
    return requirement_findings(files).unionByName(package_findings(files))
