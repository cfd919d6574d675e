"""The registered queries and, where SQL can say the same, the SQL they are checked against."""

from __future__ import annotations

import io
import sys
import uuid
import zipfile

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark import dims, schema
from auditspark.functions import text
from auditspark.operators import (
    dependencies, duplication, enrich, extract, history, issues, line_rules, metrics, project, reports, scores,
    structure_rules as rules,
)
from auditspark.plans import scan as plan
from auditspark.session import shared_folder, stored, uncounted
from auditspark.sources import files as sources
from auditspark.streaming import incremental, reviews, status, throttle
from checks import sqltext as S
from checks.adapters import TEMPLATES, adapt, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
KINDS = len(TEMPLATES)
BROKEN_KINDS = (6, 21)  # templates that are no valid Python
PYTHON_COMPLEXITY = {0: 3, 1: 4, 2: 7, 3: 11, 4: 1, 5: 1, 7: 17, 8: 26, 11: 2, 12: 3, 16: 1, 17: 1}  # counted by hand


# Names that the Python templates use, read off by hand
PYTHON_NAMES = {
    0: "api_key short_token password given eval user hashlib link safe jwt",
    1: "cursor key os command subprocess open path out OSError",
    2: "debug app request item ValueError Exception",
    3: "value other a b x logger OSError print open self",
    4: "used annotations",
    5: "value wanted _private",
    7: "value other",
    8: "value other",
    11: "result item items price discount taxed rate words text first last joined",
    12: "result item items price discount taxed rate table row rows size len",
    16: "schema input",
    17: "password input",
}

# Read off the Python templates by hand:
# (template, function, parameters, nesting, magic numbers, risky calls, has try)
PYTHON_FUNCTIONS = [
    (0, "login", 3, 1, 0, 0, False), (1, "load", 2, 0, 0, 0, False), (1, "start", 1, 0, 0, 1, False),
    (1, "save", 1, 1, 0, 2, False), (1, "save_again", 1, 1, 0, 1, True), (2, "show", 1, 1, 0, 0, True),
    (3, "just_long", 1, 0, 0, 0, False), (3, "just_short", 1, 0, 0, 0, False), (3, "six_parameters", 6, 0, 0, 0, False),
    (3, "five_parameters", 5, 0, 0, 0, False), (3, "deep_five", 1, 5, 0, 0, True), (3, "deep_four", 1, 4, 0, 0, False),
    (3, "four_magic", 1, 0, 4, 0, False), (3, "three_magic", 1, 0, 3, 0, False), (3, "Ab", 1, 0, 0, 0, False),
    (3, "same", 2, 0, 0, 0, False), (5, "_private", 1, 0, 0, 0, False), (5, "wanted", 1, 0, 0, 0, False),
    (7, "steps", 2, 1, 16, 0, False), (8, "steps", 2, 1, 25, 0, False), (11, "total_price", 2, 1, 0, 0, False),
    (11, "unlike", 1, 0, 0, 0, False), (12, "total_cost", 2, 1, 0, 0, False), (12, "other", 1, 1, 0, 0, False),
    (16, "test_one", 0, 0, 0, 0, False),
    *[(5, f"lone_{n:02d}", 1, 0, 0, 0, False) for n in range(1, 23)],
]
# (template, innermost function or "", dotted name)
PYTHON_CALLS = [
    (0, "login", "eval"), (0, "login", "hashlib.md5"), (0, "login", "jwt.decode"), (1, "load", "cursor.execute"),
    (1, "start", "os.system"), (1, "start", "subprocess.run"), (1, "save", "open"), (1, "save", "out.write"),
    (1, "save_again", "open"), (2, "", "app.add"), (2, "show", "item.go"), (2, "show", "item.go"), (2, "show", "item.go"),
    (3, "deep_five", "logger.info"), (3, "deep_five", "print"), (3, "deep_four", "print"), (3, "same", "open"),
    (4, "", "used.call"), (5, "", "wanted"), (11, "unlike", "text.split"), (11, "unlike", "joined.upper"),
    (12, "other", "len"), (16, "test_one", "schema.validate"), (16, "test_one", "input"), (17, "", "input"),
]
# (template, function, magic numbers)
SCRIPT_NUMBERS = [
    (9, "pick", 0), (9, "go", 0), (9, "nextLine", 0), (9, "outer", 4), (9, "guarded", 0), (10, "pickAll", 0),
    (22, "sprawl", 24), (22, "brief", 11),
]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = S.full(sql)
        return fn

    return register


def _issues(spark, sf) -> DataFrame:
    classified = issues.classify(adapt(spark, sf, "issue_facts"))
    return classified.select(
        "scan_id", "issue_seq", "file_path", "line", "rule_id", "issue_type", "category", "severity", "confidence",
        F.concat(F.lit("m"), F.col("issue_seq").cast("string")).alias("message"),
        F.concat(F.lit(" x = "), F.col("line").cast("string")).alias("code_snippet"),
    )


def _measured(spark, sf) -> DataFrame:
    index = metrics.maintainability(F.col("lines"), F.col("complexity"), F.col("comment_lines"))
    return adapt(spark, sf, "file_facts").withColumn("maintainability_index", index)


def _scored(spark, sf) -> DataFrame:
    return scores.with_scores(scores.scan_rollup(_measured(spark, sf), _issues(spark, sf)))


def _side_scores(spark, sf) -> DataFrame:
    return (
        _scored(spark, sf)
        .withColumn("test_coverage_score", (F.col("total_lines") * 7 % 101).cast("int"))
        .withColumn("code_maturity_index", (F.col("total_lines") * 11 % 101).cast("int"))
        .withColumn("mode", F.when(F.col("issues") % 2 == 0, "basic").otherwise("advanced"))
    )


def _file_report(spark, sf) -> DataFrame:
    return scores.file_report(_measured(spark, sf), _issues(spark, sf))


def _enriched(spark, sf) -> DataFrame:
    return enrich.add_guidance(_issues(spark, sf))


def _code(spark, sf) -> DataFrame:
    return adapt(spark, sf, "code_files")


def _named_code(spark, sf) -> DataFrame:
    return _code(spark, sf).withColumn("language", text.language(F.col("file_path")))


def _scripts(spark, sf) -> DataFrame:
    return _named_code(spark, sf).where(F.col("language").isin("javascript", "typescript"))


def _parsed(spark, sf) -> DataFrame:
    return extract.parsed(_code(spark, sf))


SCRIPT_SQL = f"(SELECT * FROM code_files WHERE {S.language('file_path')} IN ('javascript', 'typescript')) c"

# --- sources -------------------------------------------------------------------------------

BAD = "source LIKE '%'"


@query("s1_source_files", f"""
SELECT scan_id, file_path, md5(content) AS digest FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY scan_id ORDER BY file_path) AS n FROM doc_files
  WHERE {S.suffix('file_path')} IN ('.py', '.js', '.ts', '.json') AND NOT contains(lower(file_path), 'fr/')) s
WHERE n <= 20""")
def _(spark, sf):
    chosen = sources.select_source_files(adapt(spark, sf, "doc_files"), ["PY", ".js", " ts", ".json"], ["FR/", " "], 20)
    return chosen.select("scan_id", "file_path", F.md5("content").alias("digest"))


@query("s1_all_source_files", f"""
SELECT scan_id, file_path, md5(content) AS digest FROM doc_files
WHERE {S.suffix('file_path')} IN ('.py', '.js', '.ts', '.json') AND NOT contains(lower(file_path), 'fr/')""")
def _(spark, sf):
    chosen = sources.select_source_files(adapt(spark, sf, "doc_files"), ["PY", ".js", " ts", ".json"], ["FR/", " "])
    return chosen.select("scan_id", "file_path", F.md5("content").alias("digest"))


@query("s1_skipped_files", f"""
SELECT scan_id, file_path, 'NOT_SELECTED' AS reason FROM doc_files
WHERE NOT {S.suffix('file_path')} IN ('.py', '.js', '.ts', '.json') OR contains(lower(file_path), 'fr/')""")
def _(spark, sf):
    return sources.skipped_files(sources.mark_source_files(adapt(spark, sf, "doc_files"), ["PY", ".js", " ts", ".json"], ["FR/", " "]))


@query("s2_read_text", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(spark, sf):
    data = F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("C3")))
    return table(spark, sf, "documents").select("doc_id", F.md5(sources.clean_bytes(data)).alias("digest"))


@query("s3_file_map", "SELECT scan_id, file_path FROM doc_files")
def _(spark, sf):
    # paths as different file systems list them
    head = F.element_at(F.array(*map(F.lit, ["file:/data\\in/", "hdfs://node:8020/data/in/", "s3a://bucket/data/in/", "/data/in/"])), (F.length("file_path") % 4 + 1).cast("int"))
    stored_path = F.concat(head, F.replace("file_path", F.lit("/"), F.lit("\\")))
    return adapt(spark, sf, "doc_files").select("scan_id", sources.relative_path(stored_path, "s3a://bucket/data/in/").alias("file_path"))


def _zipped(batches):
    for batch in batches:
        payloads = []
        for doc, content in zip(batch["doc_id"], batch["text"]):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("src/", "")
                archive.writestr("../out.py" if doc % 11 == 0 else "src/doc.py", content)
            payloads.append(b"damaged" if doc % 7 == 0 else buffer.getvalue())
        yield pd.DataFrame({"path": [f"in/d{d}.zip" for d in batch["doc_id"]], "content": payloads})


@query("s4_archive_members", """
SELECT 'in/d' || doc_id || '.zip' AS path, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN 'src/doc.py' END AS member,
  CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN md5(text) END AS digest,
  CASE WHEN doc_id % 7 = 0 THEN 'NOT_A_ZIP_FILE' WHEN doc_id % 11 = 0 THEN 'UNSAFE_MEMBER_PATH' END AS error FROM documents""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    archives = docs.mapInPandas(_zipped, "path string, content binary").withColumn("length", F.length("content"))
    return sources.archive_members(archives).select("path", "member", F.md5("data").alias("digest"), "error")


@query("s5_archive_verdict", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'NOT_A_ZIP_NAME' WHEN n_chars * 10000 > 26214400 THEN 'TOO_LARGE' END AS verdict
FROM documents""")
def _(spark, sf):
    name = F.concat(F.lit("a"), F.when(F.col("doc_id") % 3 == 0, ".zip.txt").otherwise(".ZIP"))
    return table(spark, sf, "documents").select("doc_id", sources.archive_verdict(name, F.col("n_chars") * 10000, dims.USUAL_ARCHIVE_BYTES).alias("verdict"))


_repo = S.lit(sources.REPOSITORY_PATTERN)


@query("s6_repository_urls", f"""
SELECT page_id, regexp_matches(url, {_repo}) AS valid, regexp_extract(url, {_repo}, 2) AS owner,
  regexp_extract(url, {_repo}, 3) AS repo FROM repo_urls""")
def _(spark, sf):
    parts = sources.repository(F.col("url"))
    return adapt(spark, sf, "repo_urls").select("page_id", *[c.alias(n) for n, c in parts.items()])


@query("s7_clone_failures", """
SELECT page_id, CASE WHEN contains(lower(message), 'authentication') OR contains(lower(message), 'access denied') THEN 'REPO_ACCESS_DENIED'
  WHEN contains(lower(message), 'could not resolve host') OR contains(lower(message), 'failed to connect') THEN 'NETWORK_ERROR'
  WHEN contains(lower(message), 'repository not found') THEN 'REPO_NOT_FOUND' ELSE 'GIT_CLONE_FAILED' END AS code FROM clone_messages""")
def _(spark, sf):
    return adapt(spark, sf, "clone_messages").select("page_id", sources.clone_failure(F.col("message")).alias("code"))


@query("s8_manifest_files", """
SELECT scan_id, file_path, CASE WHEN lower(file_path) LIKE '%requirements.txt' THEN 'requirements' ELSE 'package' END AS manifest_kind
FROM code_files WHERE lower(file_path) LIKE '%requirements.txt' OR lower(file_path) LIKE '%package.json'""")
def _(spark, sf):
    return sources.manifests(_code(spark, sf)).select("scan_id", "file_path", "manifest_kind")


@query("s9_history_json", """
SELECT scan_id, owner_uid, quality_score, security_score FROM scan_history WHERE CAST(scan_id AS BIGINT) % 3 = 0""")
def _(spark, sf):
    item = F.to_json(F.struct("scan_id", "owner_uid", F.struct(*dims.SCORES).alias("scores")))
    number = F.col("scan_id").cast("bigint") % 3
    value = F.when(number == 0, F.concat(F.lit(" ["), item, F.lit("]"))).when(number == 1, item).otherwise(F.concat(F.lit("["), item))
    kept = history.parse_history(adapt(spark, sf, "scan_history").select(value.alias("value")))
    return kept.select("scan_id", "owner_uid", "scores.quality_score", "scores.security_score")


@query("s9_history_file", """
SELECT scan_id, owner_uid, quality_score, security_score, 'a "}{][" \\ b' AS source_label FROM scan_history""")
def _(spark, sf):
    """Files that each hold a JSON list, one for each task that writes; a file is read by byte ranges."""
    label = F.lit('a "}{][" \\ b').alias("source_label")
    rows = adapt(spark, sf, "scan_history").select(F.to_json(F.struct("scan_id", "owner_uid", label, F.struct(*dims.SCORES).alias("scores"))).alias("value"))
    path = f"{shared_folder(spark)}/auditspark-history-{uuid.uuid4().hex}"

    def listed(batches):
        yield pa.RecordBatch.from_pydict({"value": ["[ null"]})
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(", ", batch.column("value").cast(pa.string()), "")], ["value"])
        yield pa.RecordBatch.from_pydict({"value": ["]"]})

    rows.hint("rebalance").mapInArrow(listed, "value string").write.text(path)
    return history.read_history_json(spark, path).select("scan_id", "owner_uid", "scores.quality_score", "scores.security_score", "source_label")


@query("s10_exported_json", """
SELECT scan_id, '{"scan_id":"' || scan_id || '","issue_seq":' || issue_seq || ',"severity":"' || severity || '","file_path":"' || file_path || '"}' AS value
FROM issues WHERE CAST(scan_id AS BIGINT) % 50 < 40""")
def _(spark, sf):
    """Scans 0 to 29 of each fifty exported, then 20 to 39, then an export whose commit is missing, and read back."""
    rows = reports.json_rows(_issues(spark, sf).select("scan_id", "issue_seq", "severity", "file_path"), "issue", F.col("issue_seq"))
    rows = rows.withColumn("group", F.floor((F.col("scan_id").cast("bigint") % 50) / 10)).withColumn("scan_id", F.concat(F.lit("k"), F.col("group").cast("string"))).drop("group")
    path = f"{shared_folder(spark)}/auditspark-export-{uuid.uuid4().hex}"
    for groups in (("k0", "k1", "k2"), ("k2", "k3")):
        reports.export_json(rows.where(F.col("scan_id").isin(*groups)), path)
    rows.limit(5).select(F.col("json").alias("value"), "scan_id").write.partitionBy("scan_id").text(f"{path}/data/part=lost")
    read = reports.read_export(spark, path)
    return read.select(F.get_json_object("value", "$.scan_id").alias("scan_id"), "value")


@query("s11_history_table", "SELECT scan_id, owner_uid, updated_at, security_score FROM scan_history")
def _(spark, sf):
    """History written in two overlapping jobs, the first one twice, and read back."""
    scans = adapt(spark, sf, "scan_history")
    totals = F.struct(*[F.lit(None).cast("int").alias(c) for c in ("total_files_scanned", "total_lines_analyzed", "total_issues_found", *dims.SEVERITIES)])
    rows = scans.withColumn("source_label", F.lit("x")).withColumn("totals", totals).withColumn("scores", F.struct(*dims.SCORES))
    rows = rows.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at")})
    path = f"{shared_folder(spark)}/auditspark-scans-{uuid.uuid4().hex}"
    number = F.col("scan_id").cast("bigint") % 4
    for some in (number < 3, number < 3, number > 1):
        history.append_history(rows.where(some), path)
    return history.read_history(spark, path).select("scan_id", "owner_uid", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "scores.security_score")


@query("s10_export_json", """
SELECT scan_id, 'issue' AS part, CAST(issue_seq AS BIGINT) AS seq, '{"scan_id":"' || scan_id || '","issue_seq":' || issue_seq ||
  ',"severity":"' || severity || '","file_path":"' || file_path || '"}' AS json FROM issues""")
def _(spark, sf):
    rows = _issues(spark, sf).select("scan_id", "issue_seq", "severity", "file_path")
    return reports.json_rows(rows, "issue", F.col("issue_seq"))


@query("s11_kept_scans", "SELECT scan_id, owner_uid, updated_at FROM scan_history ORDER BY updated_at DESC, scan_id LIMIT 100")
def _(spark, sf):
    return history.kept_scans(adapt(spark, sf, "scan_history")).select("scan_id", "owner_uid", "updated_at")


@query("s12_summary_lines", """
SELECT scan_id, 'Files scanned: ' || files || ' | Lines analyzed: ' || total_lines || ' | Issues found: ' || issues || ' | AI mode: ' || mode AS totals_line,
  'Dependency Risk Score: ' || dependency_risk_score || '/100 | Test Coverage Score: ' || test_coverage_score || '/100 | Code Maturity Index: ' ||
  code_maturity_index || '/100' AS side_line FROM side_scores""")
def _(spark, sf):
    return reports.summary_lines(_side_scores(spark, sf))


@query("s12_score_table", " UNION ALL ".join(
    f"SELECT scan_id, '{s.replace('_', ' ').title()}' AS label, {s} || '/100' AS shown FROM scored" for s in dims.SCORES))
def _(spark, sf):
    return reports.score_table(_scored(spark, sf))


@query("s12_severity_bars", " UNION ALL ".join(
    f"SELECT scan_id, {n} AS position, '{s.title()}' AS bar, {s} AS issues FROM issue_rollup" for n, s in enumerate(dims.SEVERITIES)))
def _(spark, sf):
    return reports.severity_bars(scores.severity_distribution(_issues(spark, sf)))


# --- text functions --------------------------------------------------------------------------


@query("p1_language", f"SELECT scan_id, file_path, {S.language('file_path')} AS language FROM code_files")
def _(spark, sf):
    return _named_code(spark, sf).select("scan_id", "file_path", "language")


_cs = f"CASE WHEN {S.language('file_path')} = 'python' THEN starts_with({S.strip('text')}, '#') ELSE regexp_matches({S.strip('text')}, '^(//|/\\*|\\*)') END"


@query("p2_comment_lines", f"""
SELECT f.scan_id, f.file_path, coalesce(n, 0) AS comment_lines FROM code_files f LEFT JOIN (
  SELECT scan_id, file_path, count(*) FILTER (WHERE {_cs}) AS n FROM code_lines GROUP BY ALL) c USING (scan_id, file_path)""")
def _(spark, sf):
    named = _named_code(spark, sf)
    count = text.comment_lines(F.col("language"), text.split_lines(F.col("content")))
    return named.select("scan_id", "file_path", count.cast("bigint").alias("comment_lines"))


@query("p3_count_lines", "SELECT scan_id, file_path, CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INTEGER) AS lines FROM code_files")
def _(spark, sf):
    return _code(spark, sf).select("scan_id", "file_path", text.count_lines(F.col("content")).alias("lines"))


@query("p4_split_lines", "SELECT scan_id, file_path, CAST(line AS INTEGER) AS line, md5(text) AS digest FROM code_lines")
def _(spark, sf):
    return line_rules.lines(_code(spark, sf)).select("scan_id", "file_path", "line", F.md5("text").alias("digest"))


@query("p5_snippets", f"SELECT scan_id, file_path, CAST(line AS INTEGER) AS line, {S.snippet('text')} AS snippet FROM doc_lines")
def _(spark, sf):
    return line_rules.lines(adapt(spark, sf, "doc_files")).select("scan_id", "file_path", "line", text.snippet(F.col("text")).alias("snippet"))


@query("p6_clean_lines", f"SELECT scan_id, file_path, CAST(line AS INTEGER) AS line, {S.clean('text')} AS cleaned FROM code_lines")
def _(spark, sf):
    return line_rules.lines(_code(spark, sf)).select("scan_id", "file_path", "line", text.clean_line(F.col("text")).alias("cleaned"))


@query("p7_issue_filter", """
SELECT scan_id, issue_seq, file_path FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY scan_id ORDER BY issue_seq) AS n FROM issues
WHERE severity = 'high' AND category = 'security' AND contains(lower(file_path), 'm1')) i WHERE n <= 600""")
def _(spark, sf):
    found = issues.filter_issues(_issues(spark, sf), "high", "security", "M1")
    return issues.listed_issues(found).select("scan_id", "issue_seq", "file_path")


@query("p8_owner_scope", """
SELECT scan_id, owner IS NULL OR owner = '7' AS may_see, coalesce(owner = '7', false) AS owns FROM
  (SELECT scan_id, nullif(owner_uid, '3') AS owner FROM scan_history) h""")
def _(spark, sf):
    owner = F.nullif(F.col("owner_uid"), F.lit("3"))
    return adapt(spark, sf, "scan_history").select(
        "scan_id", issues.visible_to(owner, "7").alias("may_see"), F.coalesce(issues.owned_by(owner, "7"), F.lit(False)).alias("owns")
    )


@query("p9_bands", f"""
SELECT scan_id, {S.band('security_score')} AS band, CASE WHEN quality_score >= 80 THEN 'severe' WHEN quality_score >= 60 THEN 'high'
  WHEN quality_score >= 35 THEN 'raised' ELSE 'calm' END AS heat FROM scan_history""")
def _(spark, sf):
    return adapt(spark, sf, "scan_history").select(
        "scan_id", text.score_band(F.col("security_score")).alias("band"), text.risk_band(F.col("quality_score")).alias("heat")
    )


@query("p10_humanize", "SELECT event_id, upper(left(event_type, 1)) || substr(event_type, 2) || ' Seen' AS label FROM events")
def _(spark, sf):
    key = F.concat("event_type", F.lit("_seen"))
    return table(spark, sf, "events").select("event_id", text.humanize(key).alias("label"))


@query("p11_conform", """
SELECT scan_id, 'i' || issue_seq AS issue_id, CASE WHEN issue_seq % 5 = 1 THEN 'BAD_SEVERITY' WHEN issue_seq % 5 = 2 THEN 'BAD_CATEGORY'
  WHEN issue_seq % 5 = 3 THEN 'BAD_CONFIDENCE' END AS problem, CASE WHEN issue_seq % 5 NOT IN (1, 2, 3) THEN 75e0 END AS confidence FROM issues""")
def _(spark, sf):
    seq = F.col("issue_seq") % 5
    raw = _issues(spark, sf).withColumn("issue_id", F.concat(F.lit("i"), F.col("issue_seq").cast("string")))
    raw = raw.withColumn("severity", F.when(seq == 1, "grave").otherwise(F.col("severity")))
    raw = raw.withColumn("category", F.when(seq == 2, "style").otherwise(F.col("category")))
    raw = raw.withColumn("confidence", F.when(seq == 3, 100.5))
    good, bad = issues.conform(raw)
    none = F.lit(None)
    return good.select("scan_id", "issue_id", none.cast("string").alias("problem"), "confidence").unionByName(
        bad.select("scan_id", "issue_id", "problem", none.cast("double").alias("confidence"))
    )


@query("p12_extensions", """
SELECT doc_id, array_to_string(list_sort(list_distinct(['.' || lang, '.' || source, '.py'])), ',') AS extensions FROM documents""")
def _(spark, sf):
    raw = F.array(F.upper("lang"), F.concat(F.lit("."), "source"), F.lit(" py "), F.lit(""), "lang", F.lit(None))
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.normalize_extensions(raw), ",").alias("extensions"))


@query("p13_list_field", """
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' WHEN doc_id % 4 = 2 THEN '[' || lang || '|' || source ELSE lang || '|' || source END AS items
FROM documents""")
def _(spark, sf):
    kind = F.col("doc_id") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit(' ["'), "lang", F.lit('"," '), "source", F.lit('",""]')))
        .when(kind == 1, F.concat("lang", F.lit(" ,, "), "source"))
        .when(kind == 2, F.concat(F.lit("["), "lang", F.lit(", "), "source"))
    )
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.parse_list(raw), "|").alias("items"))


@query("p14_duration", f"""
SELECT event_id, {S.rounded("(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000e0", 2)} AS seconds FROM events""")
def _(spark, sf):
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", text.duration_seconds(start, F.col("ts")).alias("seconds"))


@query("p15_labels", """
SELECT scan_id, file_path, 'Risk ' || CAST(floor(risk_score + 0.5e0) AS BIGINT) || ' | Issues ' || issue_count AS label,
  CAST(floor(risk_score / 3e0 + 0.5e0) AS BIGINT) || '%' AS percent FROM file_report""")
def _(spark, sf):
    risk = F.col("risk_score")
    return _file_report(spark, sf).select(
        "scan_id", "file_path", text.heat_label(risk, F.col("issue_count")).alias("label"),
        text.confidence_label(risk / F.lit(3.0)).alias("percent"),
    )


def _note(*xs):
    return "coalesce(" + ", ".join(f"nullif({x}, '')" if not x.startswith("'") else x for x in xs) + ")"


@query("p16_detail_view", f"""
SELECT scan_id, issue_seq, 'Severity: ' || upper(severity) || ' | Confidence: ' || CAST(floor(confidence + 0.5e0) AS BIGINT) || '%' AS head,
  {_note('risk_explanation')} AS risk, {_note('real_world_attack_scenario', "'No scenario generated.'")} AS scenario,
  {_note('why_this_is_dangerous', 'why_dangerous')} AS danger, {_note('secure_fix_explanation', 'suggested_code')} AS fix,
  {_note('best_practice_reference', 'best_practice')} AS practice,
  {_note('performance_impact', "'No material performance impact expected.'")} AS performance,
  {_note('refactored_code', 'refactored_example', "'# No suggestion generated'")} AS refactored,
  '// Before' || chr(10) || {_note('before_code', 'code_snippet', "'// N/A'")} || chr(10) || chr(10) || '// After' || chr(10) ||
  {_note('after_code', 'refactored_code', "'// N/A'")} AS before_after,
  {_note('improvement_reasoning', 'secure_fix_explanation', 'suggested_code')} AS reasoning,
  {_note('suggested_code', 'secure_fix_explanation', "'# No secure fix generated'")} AS suggestion,
  {_note('confidence_score', "''")} AS confidence_shown
FROM (SELECT * REPLACE (CASE WHEN issue_seq % 2 = 0 THEN '' ELSE real_world_attack_scenario END AS real_world_attack_scenario,
  CASE WHEN issue_seq % 3 = 0 THEN '' ELSE secure_fix_explanation END AS secure_fix_explanation,
  CASE WHEN issue_seq % 2 = 0 THEN '' ELSE before_code END AS before_code) FROM enriched) e""")
def _(spark, sf):
    seq, blank = F.col("issue_seq"), F.lit("")
    thinned = _enriched(spark, sf).withColumns({
        "real_world_attack_scenario": F.when(seq % 2 == 0, blank).otherwise(F.col("real_world_attack_scenario")),
        "secure_fix_explanation": F.when(seq % 3 == 0, blank).otherwise(F.col("secure_fix_explanation")),
        "before_code": F.when(seq % 2 == 0, blank).otherwise(F.col("before_code")),
    })
    return reports.detail_view(thinned).withColumn("risk", F.nullif("risk", blank))


# --- line rules ------------------------------------------------------------------------------


def _line_rule(number: int, rule_id: str) -> None:
    sql = (
        f"SELECT scan_id, file_path, CAST(line AS INTEGER) AS line, {S.snippet('text')} AS code_snippet FROM code_lines "
        f"WHERE {S.hit(dims.LINE_PATTERNS[rule_id], 'text', ignore_case=True)}"
    )

    @query(f"r{number:02d}_{rule_id.lower()}", sql)
    def _(spark, sf):
        return line_rules.rule_hits(line_rules.lines(_code(spark, sf)), rule_id)


for _number, _rule_id in enumerate(dims.LINE_PATTERNS, 1):
    _line_rule(_number, _rule_id)


@query("r13_all_line_rules", " UNION ALL ".join(
    f"SELECT scan_id, file_path, CAST(line AS INTEGER) AS line, '{r}' AS rule_id, '{dims.RULES[dims.RULE_SEQ[r]][3]}' AS severity "
    f"FROM code_lines WHERE {S.hit(p, 'text', True)}" for r, p in dims.LINE_PATTERNS.items()))
def _(spark, sf):
    found = line_rules.line_findings(_code(spark, sf))
    return found.select("scan_id", "file_path", "line", "rule_id", "severity")


# --- Python structure ------------------------------------------------------------------------

PY = f"{S.language('file_path')} = 'python'"
_kind = f"doc_id % {KINDS}"
_doc_of = f"(SELECT doc_id, {_kind} AS kind, c.* FROM documents JOIN code_files c ON regexp_extract(c.file_path, '([0-9]+)[^0-9]*$', 1) = CAST(doc_id AS VARCHAR))"


@query("a1_parsed_files", f"""
SELECT scan_id, file_path, kind NOT IN {BROKEN_KINDS} AS parse_ok FROM {_doc_of} d WHERE {PY}""")
def _(spark, sf):
    return rules.python_file_stats(_parsed(spark, sf)).select("scan_id", "file_path", "parse_ok")


_defs = (
    "(SELECT scan_id, file_path, regexp_extract(text, '^\\s*(async\\s+)?def\\s+(\\w+)', 2) AS name, max(line) AS start_line "
    f"FROM code_lines WHERE {PY} AND regexp_matches(text, '^\\s*(async\\s+)?def\\s+\\w+\\(.*\\):') GROUP BY ALL)"
)


@query("a2_functions", f"SELECT scan_id, file_path, name, CAST(start_line AS INTEGER) AS start_line FROM {_defs} d")
def _(spark, sf):
    return rules.python_functions(_parsed(spark, sf)).select("scan_id", "file_path", "name", "start_line")


_facts = "(VALUES " + S.values(PYTHON_FUNCTIONS) + ") f(kind, name, param_count, max_nesting, magic_numbers, risky_calls, has_try)"


def _expected(columns: str) -> str:
    return f"SELECT d.scan_id, d.file_path, {columns} FROM {_doc_of} d JOIN {_facts} ON d.kind = f.kind"


@query("a3_parameters", _expected("name, param_count"))
def _(spark, sf):
    return rules.python_functions(_parsed(spark, sf)).select("scan_id", "file_path", "name", "param_count")


@query("a4_nesting", _expected("name, max_nesting"))
def _(spark, sf):
    return rules.python_functions(_parsed(spark, sf)).select("scan_id", "file_path", "name", "max_nesting")


@query("a5_magic_numbers", _expected("name, magic_numbers"))
def _(spark, sf):
    return rules.python_functions(_parsed(spark, sf)).select("scan_id", "file_path", "name", "magic_numbers")


@query("a6_calls", f"""
SELECT d.scan_id, d.file_path, nullif(func, '') AS func, dotted, regexp_extract(dotted, '[^.]+$') AS plain
FROM {_doc_of} d JOIN (VALUES {S.values(PYTHON_CALLS)}) c(kind, func, dotted) ON d.kind = c.kind""")
def _(spark, sf):
    return rules.python_calls(_parsed(spark, sf))


@query("a6_call_summary", """
SELECT scan_id, file_path, func, count(*) FILTER (WHERE regexp_matches(dotted, 'open|read|write|requests|urlopen|subprocess')) AS risky_calls,
  bool_or(regexp_matches(dotted, 'logging|logger|print')) AS logs FROM calls GROUP BY ALL""")
def _(spark, sf):
    return rules.call_summary(adapt(spark, sf, "calls"))


@query("a7_try_and_none", _expected("name, risky_calls, has_try, CASE WHEN d.kind = 3 THEN 1 ELSE 0 END AS null_checks"))
def _(spark, sf):
    parsed = stored(_parsed(spark, sf).select("scan_id", "file_path", "language", "py"), "parsed")  # the texts are parsed once
    functions = rules.python_functions(parsed).select("scan_id", "file_path", "name", "risky_calls", "has_try")
    stats = rules.python_file_stats(parsed).select("scan_id", "file_path", "null_checks")
    return functions.join(stats, ["scan_id", "file_path"])


@query("a8_imports", f"""
SELECT scan_id, file_path, name, CAST(max(line) AS INTEGER) AS line FROM (SELECT scan_id, file_path, line,
  coalesce(nullif(regexp_extract(text, ' as (\\w+)$', 1), ''), nullif(regexp_extract(text, '^import (\\w+)', 1), ''),
  regexp_extract(text, '^from \\S+ import (\\w+)$', 1)) AS name
  FROM code_lines WHERE {PY} AND regexp_matches(text, '^(import|from) ')) i WHERE name <> '' GROUP BY ALL""")
def _(spark, sf):
    return rules.python_imports(_parsed(spark, sf)).select("scan_id", "file_path", "name", "line")


_names = ", ".join(f"({kind}, '{name}')" for kind, names in PYTHON_NAMES.items() for name in names.split())


@query("a9_used_names", f"""
SELECT d.scan_id, d.file_path, name FROM {_doc_of} d JOIN (VALUES {_names}) c(kind, name) ON d.kind = c.kind""")
def _(spark, sf):
    return _parsed(spark, sf).select("scan_id", "file_path", F.explode("py.names").alias("name"))


@query("a10_file_stats", f"""
SELECT c.scan_id, c.file_path, coalesce(n, 0) AS function_count FROM code_files c LEFT JOIN
  (SELECT scan_id, file_path, count(*) AS n FROM {_defs} d GROUP BY ALL) f USING (scan_id, file_path) WHERE {PY}""")
def _(spark, sf):
    stats = rules.python_file_stats(_parsed(spark, sf))
    return stats.select("scan_id", "file_path", F.col("function_count").cast("bigint").alias("function_count"))


def _function_table(spark, sf) -> DataFrame:
    order = Window.partitionBy("scan_id", "file_path").orderBy("start_line")
    return adapt(spark, sf, "functions").withColumn("func_seq", F.row_number().over(order)).withColumn("snippet", F.lit("def"))


def _function_rule(key: str, rule_id: str, test: str) -> None:
    severity = dims.RULES[dims.RULE_SEQ[rule_id]][3]

    @query(key, f"SELECT scan_id, file_path, start_line AS line, '{severity}' AS severity FROM functions WHERE {test}")
    def _(spark, sf):
        found = rules.python_function_findings(_function_table(spark, sf))
        return found.where(F.col("rule_id") == rule_id).select("scan_id", "file_path", "line", "severity")


_function_rule("a11_long_function", "LONG_FUNCTION", "end_line - start_line + 1 > 50")
_function_rule("a12_too_many_parameters", "TOO_MANY_PARAMETERS", "param_count > 5")
_function_rule("a13_deep_nesting", "DEEP_NESTING", "max_nesting > 4")
_function_rule("a14_magic_numbers", "MAGIC_NUMBERS", "magic_numbers >= 4")
_function_rule("a15_poor_naming", "POOR_NAMING_CONVENTION", "NOT regexp_matches(name, '^[a-z_][a-z0-9_]{2,}$')")
_function_rule("a16_missing_exception_handling", "MISSING_EXCEPTION_HANDLING", "risky_calls > 0 AND NOT has_try")


def _nested(df: DataFrame, fields, into: str) -> DataFrame:
    """Rows of one file as an array, as the extraction job gives them."""
    return df.groupBy("scan_id", "file_path").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(into))


_unused = "SELECT i.*, ROW_NUMBER() OVER (PARTITION BY scan_id, file_path ORDER BY seq) AS n FROM imports i ANTI JOIN names u USING (scan_id, file_path, name)"


def _unused_imports(spark, sf, limit: int | None) -> DataFrame:
    imports = _nested(adapt(spark, sf, "imports"), ["seq", "name", "line"], "imports")
    used = adapt(spark, sf, "names").groupBy("scan_id", "file_path").agg(F.collect_set("name").alias("names"))
    both = imports.join(used, ["scan_id", "file_path"], "left")
    unused = rules.unused_imports(F.col("imports"), F.coalesce("names", F.array().cast("array<string>")), limit)
    return both.select("scan_id", "file_path", F.explode(unused).alias("i")).select("scan_id", "file_path", "i.name", "i.line")


@query("a17_unused_import", f"SELECT scan_id, file_path, name, line FROM ({_unused}) x WHERE n <= 30")
def _(spark, sf):
    return _unused_imports(spark, sf, rules.USUAL_UNUSED_IMPORTS)


@query("a17_all_unused_imports", f"SELECT scan_id, file_path, name, line FROM ({_unused}) x")
def _(spark, sf):
    return _unused_imports(spark, sf, None)


_dead = """SELECT f.*, ROW_NUMBER() OVER (PARTITION BY scan_id, file_path ORDER BY name) AS n
  FROM (SELECT scan_id, file_path, name, max(start_line) AS start_line FROM functions GROUP BY ALL) f
  ANTI JOIN (SELECT DISTINCT scan_id, file_path, plain AS name FROM calls) c USING (scan_id, file_path, name)
  WHERE NOT starts_with(name, '_')"""


def _dead_functions(spark, sf, limit: int | None) -> DataFrame:
    distinct = adapt(spark, sf, "functions").groupBy("scan_id", "file_path", "name").agg(F.max("start_line").alias("start_line"))
    functions = _nested(distinct, ["name", "start_line"], "functions")
    called = adapt(spark, sf, "calls").groupBy("scan_id", "file_path").agg(F.collect_set("plain").alias("called"))
    both = functions.join(called, ["scan_id", "file_path"], "left")
    dead = rules.dead_functions(F.col("functions"), F.coalesce("called", F.array().cast("array<string>")), limit)
    return both.select("scan_id", "file_path", F.explode(dead).alias("f")).select("scan_id", "file_path", "f.name", "f.start_line")


@query("a18_dead_function", f"SELECT scan_id, file_path, name, start_line FROM ({_dead}) x WHERE n <= 20")
def _(spark, sf):
    return _dead_functions(spark, sf, rules.USUAL_DEAD_FUNCTIONS)


@query("a18_all_dead_functions", f"SELECT scan_id, file_path, name, start_line FROM ({_dead}) x")
def _(spark, sf):
    return _dead_functions(spark, sf, None)


# --- script structure ------------------------------------------------------------------------

_header = "^(function\\s+(\\w+)\\s*\\(([^)]*)\\)|(const|let|var)\\s+(\\w+)\\s*=\\s*\\(([^)]*)\\)\\s*=>\\s*\\{)"
_starts = (
    f"(SELECT scan_id, file_path, line, text, regexp_extract(text, '{_header}', 2) || regexp_extract(text, '{_header}', 5) AS name, "
    f"regexp_extract(text, '{_header}', 3) || regexp_extract(text, '{_header}', 6) AS params FROM code_lines l "
    f"WHERE {S.language('file_path')} IN ('javascript', 'typescript') AND regexp_matches(text, '{_header}'))"
)
_closed = "(SELECT scan_id, file_path, line AS close_line FROM code_lines WHERE text IN ('}', '});'))"


@query("j1_script_functions", f"""
SELECT s.scan_id, s.file_path, name, CAST(line AS INTEGER) AS start_line,
  CAST(CASE WHEN contains(text, '{{') THEN min(close_line) ELSE line END AS INTEGER) AS end_line,
  CAST(len([p for p in string_split(params, ',') if trim(p) <> '']) AS INTEGER) AS param_count
FROM {_starts} s JOIN {_closed} c ON s.scan_id = c.scan_id AND s.file_path = c.file_path AND close_line >= line
GROUP BY s.scan_id, s.file_path, name, line, text, params""")
def _(spark, sf):
    found = rules.js_functions(_parsed(spark, sf))
    return found.select("scan_id", "file_path", "name", "start_line", "end_line", "param_count")


def _content_blocks(spark, sf) -> DataFrame:
    """Each script as one block, so that the block measures can be checked by SQL."""
    return rules.js_measures(_scripts(spark, sf).withColumnRenamed("content", "block"))


@query("j2_brace_depth", f"""
SELECT scan_id, file_path, CAST(max(level - least(0, low)) AS INTEGER) AS max_nesting FROM (
  SELECT scan_id, file_path, level, min(level) OVER (PARTITION BY scan_id, file_path ORDER BY pos) AS low FROM (
    SELECT scan_id, file_path, pos, sum(CASE b WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY scan_id, file_path ORDER BY pos) AS level FROM (
      SELECT scan_id, file_path, unnest(bs) AS b, unnest(range(len(bs))) AS pos FROM (
        SELECT scan_id, file_path, regexp_extract_all(content, '[{{}}]') AS bs FROM {SCRIPT_SQL}) x) y) z) w GROUP BY ALL""")
def _(spark, sf):
    return _content_blocks(spark, sf).select("scan_id", "file_path", "max_nesting")


@query("j3_logging", f"SELECT scan_id, file_path, {S.hit(rules.JS_LOGGING, 'content')} AS has_logging FROM {SCRIPT_SQL}")
def _(spark, sf):
    return _scripts(spark, sf).select("scan_id", "file_path", rules.js_has_logging(F.col("content")).alias("has_logging"))


@query("j4_null_checks", f"SELECT scan_id, file_path, CAST({S.count(rules.JS_NULL_CHECK, 'content')} AS INTEGER) AS null_checks FROM {SCRIPT_SQL}")
def _(spark, sf):
    return _scripts(spark, sf).select("scan_id", "file_path", rules.null_check_count(F.col("content")).alias("null_checks"))


_keywords = f"CAST({S.count(rules.JS_KEYWORDS, 'content')} + 1 AS INTEGER)"


@query("j5_keyword_complexity", f"SELECT scan_id, file_path, {_keywords} AS complexity FROM {SCRIPT_SQL}")
def _(spark, sf):
    return _scripts(spark, sf).select("scan_id", "file_path", rules.keyword_complexity(F.col("content")).alias("complexity"))


_imported = (
    f"(SELECT scan_id, file_path, name, max(line) AS line FROM (SELECT scan_id, file_path, line, unnest(string_split_regex("
    f"regexp_extract(text, '^\\s*import\\s+(.+?)\\s+from\\s+[''\"].+[''\"]', 1), '[{{}},\\s]+')) AS name FROM code_lines l "
    f"WHERE {S.language('file_path')} IN ('javascript', 'typescript')) i WHERE name NOT IN ('', 'as', 'default') GROUP BY ALL)"
)


def _script_imports(spark, sf) -> DataFrame:
    one = _parsed(spark, sf).select("scan_id", "file_path", F.explode("js.imports").alias("i"))
    return one.select("scan_id", "file_path", "i.*")


@query("j6_script_imports", f"SELECT scan_id, file_path, name, CAST(line AS INTEGER) AS line FROM {_imported} i")
def _(spark, sf):
    return _script_imports(spark, sf).select("scan_id", "file_path", "name", "line")


_used = f"list_contains(regexp_extract_all({S.plain('content')}, '\\b([A-Za-z_]\\w+)\\b'), name)"


@query("j7_used_imports", f"SELECT i.scan_id, i.file_path, name, {_used} AS used FROM {_imported} i JOIN code_files c USING (scan_id, file_path)")
def _(spark, sf):
    return _script_imports(spark, sf).select("scan_id", "file_path", "name", "used")


def _js_table_rule(key: str, rule_id: str, test: str) -> None:
    severity = dims.RULES[dims.RULE_SEQ[rule_id]][3]

    @query(key, f"SELECT scan_id, file_path, start_line AS line, '{severity}' AS severity FROM functions WHERE {test}")
    def _(spark, sf):
        found = rules.js_function_findings(_function_table(spark, sf).withColumn("risky", F.col("risky_calls") > 0))
        return found.where(F.col("rule_id") == rule_id).select("scan_id", "file_path", "line", "severity")


_js_table_rule("j8_long_function_js", "LONG_FUNCTION_JS", "end_line - start_line + 1 > 50")
_js_table_rule("j9_too_many_parameters_js", "TOO_MANY_PARAMETERS_JS", "param_count > 5")
_js_table_rule("j10_high_complexity_js", "HIGH_COMPLEXITY_JS", "complexity > 14")
_js_table_rule("j11_deep_nesting_js", "DEEP_NESTING_JS", "max_nesting > 5")
_js_table_rule("j13_poor_naming_js", "POOR_NAMING_JS", "length(name) < 3")


@query("j12_magic_numbers_js", f"""
SELECT d.scan_id, d.file_path, name, magic_numbers FROM {_doc_of} d JOIN (VALUES {S.values(SCRIPT_NUMBERS)}) c(kind, name, magic_numbers) ON d.kind = c.kind""")
def _(spark, sf):
    return rules.js_functions(_parsed(spark, sf)).select("scan_id", "file_path", "name", "magic_numbers")


@query("j14_missing_exception_handling_js", f"SELECT scan_id, file_path, CAST(line AS INTEGER) AS line FROM {_starts} s WHERE name = 'go'")
def _(spark, sf):
    # of all script templates only function `go` makes a risky call and has no try
    found = rules.js_function_findings(rules.js_functions(_parsed(spark, sf)))
    return found.where(F.col("rule_id") == "MISSING_EXCEPTION_HANDLING_JS").select("scan_id", "file_path", "line")


@query("j15_dead_code_js", f"""
SELECT s.scan_id, s.file_path, CAST(s.line AS INTEGER) AS line FROM {_starts} s JOIN code_files c USING (scan_id, file_path)
WHERE len(list_filter(regexp_extract_all({S.plain('content')}, '\\w+'), lambda w: w = name)) <= 1""")
def _(spark, sf):
    return rules.js_dead_findings(rules.js_functions(_parsed(spark, sf))).select("scan_id", "file_path", "line")


@query("j16_unused_import_js", f"""
SELECT i.scan_id, i.file_path, CAST(i.line AS INTEGER) AS line, name FROM {_imported} i JOIN code_files c USING (scan_id, file_path) WHERE NOT {_used}""")
def _(spark, sf):
    found = rules.js_import_findings(_parsed(spark, sf))
    return found.select("scan_id", "file_path", "line", F.regexp_extract("message", "import '(.*)'\\.$", 1).alias("name"))


# --- metrics ---------------------------------------------------------------------------------

_js_cc = f"CAST({S.count(metrics.JS_BRANCHES, 'content')} + 1 AS INTEGER)"
_other_cc = f"CAST({S.count(metrics.OTHER_BRANCHES, 'content')} + 1 AS INTEGER)"
_hand = "CASE kind " + " ".join(f"WHEN {k} THEN {v}" for k, v in PYTHON_COMPLEXITY.items()) + " END"


@query("m1_python_complexity", f"SELECT scan_id, file_path, {_hand} AS complexity FROM {_doc_of} d WHERE {PY}")
def _(spark, sf):
    return rules.python_file_stats(_parsed(spark, sf)).select("scan_id", "file_path", "complexity")


@query("m2_script_complexity", f"SELECT scan_id, file_path, {_js_cc} AS complexity FROM {SCRIPT_SQL}")
def _(spark, sf):
    return _scripts(spark, sf).select("scan_id", "file_path", metrics.js_complexity(F.col("content")).alias("complexity"))


@query("m3_text_complexity", f"""
SELECT scan_id, file_path, CASE WHEN {S.language('file_path')} IN ('javascript', 'typescript') THEN {_js_cc} ELSE {_other_cc} END AS complexity
FROM doc_files""")
def _(spark, sf):
    named = adapt(spark, sf, "doc_files").withColumn("language", text.language(F.col("file_path")))
    return named.select("scan_id", "file_path", metrics.text_complexity(F.col("language"), F.col("content")).alias("complexity"))


@query("m4_maintainability", "SELECT scan_id, file_path, maintainability_index FROM measured")
def _(spark, sf):
    return _measured(spark, sf).select("scan_id", "file_path", "maintainability_index")


def _file_findings(spark, sf) -> DataFrame:
    return metrics.complexity_findings(_measured(spark, sf).withColumn("first_line", F.lit("")))


@query("m5_complex_files", """
SELECT scan_id, file_path, CASE WHEN complexity > 25 THEN 'HIGH_COMPLEXITY_FILE' ELSE 'MODERATE_COMPLEXITY_FILE' END AS rule_id
FROM measured WHERE complexity > 16""")
def _(spark, sf):
    found = _file_findings(spark, sf)
    return found.where(F.col("stage") == schema.COMPLEXITY_STAGE).select("scan_id", "file_path", "rule_id")


@query("m6_low_maintainability", "SELECT scan_id, file_path FROM measured WHERE maintainability_index < 45")
def _(spark, sf):
    found = _file_findings(spark, sf)
    return found.where(F.col("rule_id") == "LOW_MAINTAINABILITY").select("scan_id", "file_path")


_file_cc = (
    f"CASE WHEN {PY} AND kind NOT IN {BROKEN_KINDS} THEN {_hand} "
    f"WHEN {S.language('file_path')} IN ('javascript', 'typescript') THEN {_js_cc} ELSE {_other_cc} END"
)


@query("m7_file_metrics", f"""
SELECT c.scan_id, c.file_path, {S.language('c.file_path')} AS language,
  CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INTEGER) AS lines,
  {_file_cc.replace('file_path', 'c.file_path')} AS complexity FROM code_files c
LEFT JOIN (SELECT doc_id, {_kind} AS kind FROM documents) d ON regexp_extract(c.file_path, '([0-9]+)[^0-9]*$', 1) = CAST(doc_id AS VARCHAR)""")
def _(spark, sf):
    found = metrics.file_metrics(plan.file_facts(_code(spark, sf)))
    return found.select("scan_id", "file_path", "language", "lines", "complexity")


# --- duplication -----------------------------------------------------------------------------

_cleaned = f"[x for x in [{S.clean('t')} for t in {S.split('content')}] if x <> '']"
_marks = (
    "(SELECT scan_id, file_path, CAST(i AS INTEGER) AS idx, sha1(block) AS fp FROM (SELECT scan_id, file_path, i, "
    "array_to_string(ls[i:i + 5], chr(10)) AS block FROM (SELECT scan_id, file_path, ls, unnest(range(1, len(ls) - 4)) AS i FROM "
    f"(SELECT scan_id, file_path, {_cleaned} AS ls FROM %s) a) b) c WHERE length(block) >= 40)"
)
_ranked = (
    "(SELECT *, ROW_NUMBER() OVER (PARTITION BY scan_id, fp ORDER BY file_path, idx) AS n, "
    "min(file_path) OVER (PARTITION BY scan_id, fp) AS f1, max(file_path) OVER (PARTITION BY scan_id, fp) AS f2 FROM " + _marks + " m)"
)
_pairs = (
    "(SELECT scan_id, fp, max(file_path) FILTER (WHERE n = 1) AS file_path, max(idx) FILTER (WHERE n = 1) AS line, "
    "max(file_path) FILTER (WHERE n = 2) AS other_path, max(idx) FILTER (WHERE n = 2) AS other_line FROM "
    + _ranked + " r WHERE f1 <> f2 AND n <= 2 GROUP BY scan_id, fp)"
)


@query("d1_shingles", f"SELECT scan_id, file_path, idx, fp FROM {_marks % 'doc_files'} m")
def _(spark, sf):
    return duplication.shingles(adapt(spark, sf, "doc_files"))


@query("d2_duplicate_blocks", f"SELECT scan_id, fp, file_path, line, other_path, other_line FROM {_pairs % 'code_files'} p")
def _(spark, sf):
    return duplication.duplicate_blocks(_code(spark, sf))


@query("d2_duplicate_prose", f"SELECT scan_id, fp, file_path, line, other_path, other_line FROM {_pairs % 'doc_files'} p")
def _(spark, sf):
    return duplication.duplicate_blocks(adapt(spark, sf, "doc_files"))


def _numbered(code: DataFrame) -> DataFrame:
    """Files with the number ``doc`` of their document; those without one belong to none, and would all meet in one task."""
    return code.withColumn("doc", F.regexp_extract("file_path", "([0-9]+)[^0-9]*$", 1)).where("doc <> ''")


@query("d3_reported_blocks", f"""
SELECT scan_id, file_path, line, other_path, other_line FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY scan_id ORDER BY file_path, line) AS n
  FROM {_pairs % "(SELECT lang AS scan_id, file_path, content FROM code_files JOIN (SELECT doc_id, lang FROM documents) d ON regexp_extract(file_path, '([0-9]+)[^0-9]*$', 1) = CAST(doc_id AS VARCHAR))"} p) q WHERE n <= 25""")
def _(spark, sf):
    # One scan per language, so that the cap is reached.
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), "lang")
    merged = _numbered(_code(spark, sf)).join(docs, "doc")
    blocks = duplication.duplicate_blocks(merged.select(F.col("lang").alias("scan_id"), "file_path", "content"))
    return duplication.reported_blocks(blocks, 25).select("scan_id", "file_path", "line", "other_path", "other_line")


@query("d4_function_blocks")
def _(spark, sf):
    return extract.function_blocks(_code(spark, sf)).select("scan_id", "file_path", "name", "line", "turn", F.md5("body").alias("digest"))


@query("d5_similar_functions")
def _(spark, sf):
    blocks = stored(extract.function_blocks(_code(spark, sf)), "blocks")
    return duplication.similar_functions(blocks)


@query("d5_similarity_totals")
def _(spark, sf):
    blocks = stored(extract.function_blocks(_code(spark, sf)), "blocks")
    classes = stored(duplication.function_classes(blocks), "classes")
    return duplication.similarity_totals(blocks, classes, duplication.class_links(classes))


@query("d6_all_similarity_findings")
def _(spark, sf):
    merged = _code(spark, sf).withColumn("scan_id", F.substring_index("scan_id", "-", 1))
    found = duplication.similarity_findings(plan.function_pairs(stored(extract.function_blocks(merged), "blocks")))
    return found.select("scan_id", "file_path", "line", "message", "confidence")


@query("d6_similarity_findings")
def _(spark, sf):
    merged = _code(spark, sf).withColumn("scan_id", F.substring_index("scan_id", "-", 1))
    blocks = stored(extract.function_blocks(merged), "blocks")
    found = duplication.similarity_findings(duplication.similar_functions(blocks))
    return found.select("scan_id", "file_path", "line", "message", "confidence")


# --- dependencies ----------------------------------------------------------------------------

_st = S.strip("text")
_req = S.lit(dependencies.REQUIREMENT)
_reqs = (
    f"(SELECT scan_id, line, text, lower(regexp_extract({_st}, {_req}, 1)) AS package, regexp_extract({_st}, {_req}, 2) AS operator, "
    f"regexp_extract({_st}, {_req}, 3) AS version FROM manifest_lines WHERE {_st} <> '' AND NOT starts_with({_st}, '#') "
    f"AND regexp_extract({_st}, {_req}, 1) <> '')"
)


@query("k1_requirements", f"SELECT scan_id, line, package, operator, version FROM {_reqs} r")
def _(spark, sf):
    return dependencies.requirements(adapt(spark, sf, "manifest_lines")).select("scan_id", "line", "package", "operator", "version")


@query("k2_unpinned", f"SELECT scan_id, line, package FROM {_reqs} r WHERE operator = ''")
def _(spark, sf):
    return dependencies.unpinned(dependencies.requirements(adapt(spark, sf, "manifest_lines"))).select("scan_id", "line", "package")


@query("k3_version_order", f"SELECT line, {S.version('text')} < {S.version(S.lit('2.31.0'))} AS lower FROM manifest_lines")
def _(spark, sf):
    return adapt(spark, sf, "manifest_lines").select("line", text.version_is_lower(F.col("text"), F.lit("2.31.0")).alias("lower"))


@query("k4_outdated", f"""
SELECT scan_id, line, package, version, safe_version, risk_severity FROM {_reqs} r JOIN risks USING (package)
WHERE version <> '' AND {S.version('version')} < {S.version('safe_version')}""")
def _(spark, sf):
    found = dependencies.outdated(dependencies.requirements(adapt(spark, sf, "manifest_lines")))
    return found.select("scan_id", "line", "package", "version", "safe_version", "risk_severity")


_good = "(SELECT * FROM js_manifests WHERE json_valid(content))"
_entries = "(" + " UNION ALL ".join(
    f"SELECT scan_id, file_path, '{s}' AS section, k AS name, json_extract_string(content, '$.{s}.' || k) AS version FROM "
    f"(SELECT scan_id, file_path, content, unnest(json_keys(content, '$.{s}')) AS k FROM {_good} g "
    f"WHERE json_type(content, '$.{s}') = 'OBJECT') x" for s in dependencies.SECTIONS) + ")"


@query("k5_package_entries", f"SELECT scan_id, file_path, section, name, version FROM {_entries} e")
def _(spark, sf):
    entries = dependencies.package_entries(adapt(spark, sf, "js_manifests"))
    return entries.select("scan_id", "file_path", "section", "name", "version")


_bare = "regexp_replace(version, '^[\\^~>=< ]+', '')"
_older = f"(safe_version IS NOT NULL AND {_bare} <> '' AND {S.version(_bare)} < {S.version('safe_version')})"


@query("k6_package_risks", f"""
SELECT scan_id, file_path, section, name, version, CASE WHEN {_older} THEN risk_severity ELSE 'medium' END AS severity
FROM {_entries} e LEFT JOIN risks r ON lower(name) = package WHERE {_older} OR {S.strip('version')} IN ('*', 'latest')""")
def _(spark, sf):
    risky = dependencies.package_risks(dependencies.package_entries(adapt(spark, sf, "js_manifests")))
    return risky.select("scan_id", "file_path", "section", "name", "version", "severity")


def _on_code(sql: str, table_name: str, code: str) -> str:
    return sql.replace(f"FROM {table_name}", f"FROM ({code}) m")


_code_reqs = _on_code(_reqs, "manifest_lines", "SELECT * FROM code_lines WHERE lower(file_path) LIKE '%requirements.txt'").replace(
    "SELECT scan_id, line", "SELECT scan_id, file_path, line", 1)
_code_entries = _on_code(_entries, "js_manifests", "SELECT * FROM code_files WHERE lower(file_path) LIKE '%package.json'")


@query("k7_dependency_findings", f"""
SELECT scan_id, file_path, CAST(line AS INTEGER) AS line, 'UNPINNED_PY_DEPENDENCY' AS rule_id, 'low' AS severity, {_st} AS code_snippet
FROM {_code_reqs} r WHERE operator = ''
UNION ALL
SELECT scan_id, file_path, CAST(line AS INTEGER), 'OUTDATED_RISKY_DEPENDENCY', risk_severity, {_st} FROM {_code_reqs} r JOIN risks USING (package)
WHERE version <> '' AND {S.version('version')} < {S.version('safe_version')}
UNION ALL
SELECT scan_id, file_path, 1, 'JS_DEPENDENCY_RISK', CASE WHEN {_older} THEN risk_severity ELSE 'medium' END, '"' || name || '": "' || version || '"'
FROM {_code_entries} e LEFT JOIN risks r ON lower(name) = package WHERE {_older} OR {S.strip('version')} IN ('*', 'latest')""")
def _(spark, sf):
    return dependencies.dependency_findings(_code(spark, sf)).select("scan_id", "file_path", "line", "rule_id", "severity", "code_snippet")


# --- project checks --------------------------------------------------------------------------

_low = "lower(content)"
_any = lambda tokens: "(" + " OR ".join(f"contains({_low}, {S.lit(t)})" for t in tokens) + ")"
_cors = f"(contains({_low}, 'cors') AND {_any(dims.CORS_WILDCARDS)})"
_debug = S.hit(dims.DEBUG_PATTERN, _low)
_input = f"(regexp_matches({_low}, {S.lit(dims.INPUT_PATTERN)}) AND NOT regexp_matches({_low}, {S.lit(dims.VALIDATION_PATTERN)}))"
_backend = "(file_path LIKE '%.py' OR file_path LIKE '%.js')"


def _profile(spark, sf) -> DataFrame:
    return metrics.profile(_code(spark, sf))


@query("v1_missing_auth", f"""
SELECT scan_id, min(file_path) FILTER (WHERE {_backend}) AS file_path FROM code_files GROUP BY scan_id
HAVING NOT bool_or({_any(dims.AUTH_TOKENS)}) AND bool_or({_backend})""")
def _(spark, sf):
    return project.safeguard_findings(_profile(spark, sf)).where("rule_id = 'NO_AUTH_LAYER_DETECTED'").select("scan_id", "file_path")


def _safeguard(key: str, rule_id: str, test: str) -> None:
    @query(key, f"SELECT scan_id, file_path FROM code_files WHERE {test}")
    def _(spark, sf):
        return project.safeguard_findings(_profile(spark, sf)).where(F.col("rule_id") == rule_id).select("scan_id", "file_path")


_safeguard("v2_open_cors", "INSECURE_CORS_WILDCARD", _cors)
_safeguard("v3_debug_mode", "DEBUG_MODE_ENABLED", _debug)
_safeguard("v4_unchecked_input", "MISSING_INPUT_VALIDATION_ARCH", _input)


@query("v5_safeguards", f"""
SELECT scan_id, count(*) FILTER (WHERE {_input}) AS missing_input_validation_signals, count(*) FILTER (WHERE {_cors}) AS insecure_cors,
  count(*) FILTER (WHERE {_debug}) AS debug_enabled,
  CAST(NOT bool_or({_any(dims.AUTH_TOKENS)}) AND bool_or({_backend}) AS INTEGER) AS auth_layer_missing FROM code_files GROUP BY scan_id""")
def _(spark, sf):
    return project.safeguards(_profile(spark, sf)).drop("has_auth", "first_backend")


_is_test = "(lower(file_path) LIKE 'tests/%' OR lower(file_path) LIKE '%\\_test.py' ESCAPE '\\' OR lower(file_path) LIKE '%.spec.js')"


@query("v6_test_coverage", f"""
SELECT *, least(100, 25 + CASE WHEN has_test_folder THEN 30 ELSE 0 END + CASE WHEN has_pytest_or_unittest THEN 25 ELSE 0 END +
  CASE WHEN test_file_count >= 5 THEN 20 WHEN test_file_count >= 2 THEN 10 ELSE 0 END) AS test_coverage_score FROM (
SELECT scan_id, bool_or(contains('/' || lower(file_path) || '/', '/tests/')) AS has_test_folder,
  bool_or({_any(['pytest', 'unittest'])}) AS has_pytest_or_unittest, count(*) FILTER (WHERE {_is_test}) AS test_file_count
FROM code_files GROUP BY scan_id) t""")
def _(spark, sf):
    return project.test_coverage(_profile(spark, sf))


_readme_rank = "CASE file_path WHEN 'README.md' THEN 0 WHEN 'readme.md' THEN 1 WHEN 'Readme.md' THEN 2 END"
_heads = "len(regexp_extract_all(content, '(?m)^[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]*#+[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+'))"


@query("v7_maturity", f"""
SELECT *, least(100, 20 + CASE WHEN has_readme THEN 20 ELSE 0 END + CASE WHEN has_license THEN 15 ELSE 0 END +
  CASE WHEN modular_structure THEN 20 ELSE 0 END + CASE WHEN logging_detected THEN 15 ELSE 0 END +
  CAST(floor(least(30e0, readme_quality * 0.3e0)) AS INTEGER)) AS code_maturity_index FROM (
SELECT s.scan_id, coalesce(filled, false) AS has_readme, CAST(CASE WHEN filled THEN quality ELSE 0 END AS INTEGER) AS readme_quality,
  coalesce(has_license, false) AS has_license, depth >= 3 AND tops >= 3 AS modular_structure, logging_detected FROM (
  SELECT scan_id, max(len(string_split(file_path, '/'))) AS depth, count(DISTINCT string_split(file_path, '/')[1]) AS tops,
    bool_or({_any(['logging', 'logger'])}) AS logging_detected FROM code_files GROUP BY scan_id) s LEFT JOIN (
  SELECT scan_id, bool_or(file_path IN ('LICENSE', 'LICENSE.md', 'COPYING')) AS has_license,
    arg_min(length(content) > 0, {_readme_rank}) AS filled,
    arg_min(least(100, length({S.strip('content')}) // 30 + {_heads} * 5), {_readme_rank}) AS quality
  FROM code_files WHERE file_path IN ('README.md', 'readme.md', 'Readme.md', 'LICENSE', 'LICENSE.md', 'COPYING') GROUP BY scan_id) r USING (scan_id)) t""")
def _(spark, sf):
    return project.maturity(_profile(spark, sf), _profile(spark, sf))


# --- roll-ups and scores ---------------------------------------------------------------------


@query("g1_severity_distribution", f"SELECT scan_id, {', '.join(dims.SEVERITIES)} FROM issue_rollup")
def _(spark, sf):
    return scores.severity_distribution(_issues(spark, sf))


COUNTS = ["issue_count", "critical_count", "high_count", "medium_count", "low_count", "duplication_blocks"]


@query("g2_file_issue_counts", f"SELECT scan_id, file_path, {', '.join(COUNTS)} FROM file_report")
def _(spark, sf):
    return _file_report(spark, sf).select("scan_id", "file_path", *COUNTS)


@query("g3_file_risk", "SELECT scan_id, file_path, risk_score FROM file_report")
def _(spark, sf):
    return _file_report(spark, sf).select("scan_id", "file_path", "risk_score")


TOTALS = ["files", "total_lines", "issues", *dims.SEVERITIES]


@query("g4_totals", f"SELECT scan_id, {', '.join(TOTALS)} FROM rollup")
def _(spark, sf):
    return scores.scan_rollup(_measured(spark, sf), _issues(spark, sf)).select("scan_id", *TOTALS)


@query("g5_ratios", "SELECT scan_id, logging_ratio, null_check_ratio FROM file_rollup")
def _(spark, sf):
    return scores.file_rollup(_measured(spark, sf)).select("scan_id", "logging_ratio", "null_check_ratio")


def _score(key: str, columns: list[str]) -> None:
    @query(key, f"SELECT scan_id, {', '.join(columns)} FROM scored")
    def _(spark, sf):
        return _scored(spark, sf).select("scan_id", *columns)


_score("g6_security_score", ["security_score"])
_score("g7_trust_score", ["trust_score", "secret_hits", "auth_hits", "input_hits", "reliability_hits"])
_score("g8_reliability_score", ["reliability_score", "unhandled_hits", "swallowed_hits", "logging_ratio", "null_check_ratio"])
_score("g9_quality_score", ["quality_score", "duplication_hits", "long_hits", "dead_hits", "complexity_hits", "mean_complexity", "mean_maintainability"])
_score("g10_improvement_potential", ["improvement_potential"])
_score("g11_all_scores", dims.SCORES)
_score("g12_dependency_score", ["dependency_risk_score"])


@query("g11_score_diagnostics", """
SELECT scan_id, CAST(secret_hits AS BIGINT) AS secret_exposure_hits, CAST(auth_hits AS BIGINT) AS auth_safety_hits,
  CAST(input_hits AS BIGINT) AS input_validation_hits, CAST(reliability_hits AS BIGINT) AS error_handling_hits,
  CAST(unhandled_hits AS DOUBLE) AS missing_exception_cases, CAST(swallowed_hits AS DOUBLE) AS swallowed_exception_cases,
  CAST(reliability_hits AS DOUBLE) AS critical_reliability_issues, CAST(format('{:.3f}', logging_ratio) AS DOUBLE) AS logging_ratio,
  CAST(format('{:.3f}', null_check_ratio) AS DOUBLE) AS null_check_ratio, CAST(duplication_hits AS DOUBLE) AS duplication_hits,
  CAST(long_hits AS DOUBLE) AS long_function_hits, CAST(dead_hits AS DOUBLE) AS dead_code_hits, CAST(complexity_hits AS DOUBLE) AS complexity_hits,
  CAST(format('{:.2f}', mean_complexity) AS DOUBLE) AS avg_complexity, CAST(format('{:.2f}', mean_maintainability) AS DOUBLE) AS avg_maintainability FROM scored""")
def _(spark, sf):
    told = _scored(spark, sf).select("scan_id", scores.diagnostics().alias("d"))
    return told.select("scan_id", "d.trust.*", "d.reliability.*", "d.quality.*")


@query("s11_history_rows", f"""
SELECT scan_id, 'u' || CAST(files % 5 AS VARCHAR) AS owner_uid, 'upload' AS source_type, CAST(issues AS INTEGER) AS total_issues_found,
  {', '.join(f'CAST({s} AS INTEGER) AS {s}' for s in dims.SCORES)} FROM scored""")
def _(spark, sf):
    scored = _scored(spark, sf)
    came_from = scored.select(
        "scan_id", F.concat(F.lit("u"), (F.col("files") % 5).cast("string")).alias("owner_uid"), F.lit("upload").alias("source_type"),
        F.lit("a.zip").alias("source_label"), F.timestamp_seconds(F.lit(0)).alias("started_at"), F.timestamp_seconds(F.lit(5)).alias("finished_at"))
    rows = history.history_rows(scored, came_from)
    return rows.select("scan_id", "owner_uid", "source_type", "totals.total_issues_found", "scores.*")


@query("g13_score_radar", " UNION ALL ".join(f"SELECT scan_id, '{s.split('_')[0]}' AS axis, {s} AS value FROM scored" for s in dims.SCORES))
def _(spark, sf):
    return scores.score_radar(_scored(spark, sf))


_topics = (
    "list_filter([CASE WHEN rec_secret > 0 THEN 'secret' END, CASE WHEN rec_injection > 0 THEN 'injection' END, "
    "CASE WHEN rec_exceptions > 0 THEN 'exceptions' END, CASE WHEN rec_duplication > 0 THEN 'duplication' END, "
    "CASE WHEN quality_score < 70 THEN 'quality' END, CASE WHEN security_score < 75 THEN 'security' END, "
    "CASE WHEN test_coverage_score < 50 THEN 'tests' END, CASE WHEN code_maturity_index < 55 THEN 'maturity' END], lambda t: t IS NOT NULL)"
)
_advice = (
    "(SELECT scan_id, unnest(ts) AS topic, CAST(unnest(range(1, len(ts) + 1)) AS INTEGER) AS position FROM "
    f"(SELECT scan_id, CASE WHEN len({_topics}) = 0 THEN ['none'] ELSE {_topics} END AS ts FROM side_scores) t)"
)
_wording = "CASE topic " + " ".join(f"WHEN '{k}' THEN {S.lit(v)}" for k, v in dims.RECOMMENDATIONS.items()) + " END"


@query("g14_recommendations", f"SELECT scan_id, position, topic, {_wording} AS advice FROM {_advice} a")
def _(spark, sf):
    return scores.recommendations(_side_scores(spark, sf))


@query("s12_printed_advice", f"SELECT scan_id, position, topic, position || '. ' || {_wording} AS shown FROM {_advice} a WHERE position <= 10")
def _(spark, sf):
    return reports.printed_advice(scores.recommendations(_side_scores(spark, sf)))


@query("g15_owner_analytics", f"""
SELECT CAST(c_custkey AS VARCHAR) AS owner_uid, coalesce(n, 0) AS total_scans, coalesce({S.rounded('s / n', 2)}, 0e0) AS avg_security_score,
  coalesce({S.rounded('r / n', 2)}, 0e0) AS avg_reliability_score, coalesce({S.rounded('q / n', 2)}, 0e0) AS avg_quality_score,
  coalesce({S.rounded('t / n', 2)}, 0e0) AS avg_trust_score, last_scan_at
FROM customer LEFT JOIN (SELECT owner_uid, count(*) AS n, CAST(sum(security_score) AS DOUBLE) AS s, CAST(sum(reliability_score) AS DOUBLE) AS r,
  CAST(sum(quality_score) AS DOUBLE) AS q, CAST(sum(trust_score) AS DOUBLE) AS t, max(updated_at) AS last_scan_at FROM scan_history GROUP BY owner_uid) h
ON owner_uid = CAST(c_custkey AS VARCHAR)""")
def _(spark, sf):
    owners = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("owner_uid"))
    return history.owner_analytics(adapt(spark, sf, "scan_history"), owners)


# --- windows, joins, sets --------------------------------------------------------------------


@query("w1_issue_numbers", """
SELECT scan_id, file_path, rule_id, line, scan_id || '-' || lpad(CAST(n AS VARCHAR), CAST(greatest(5, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS issue_id FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY scan_id ORDER BY CASE WHEN category = 'dependency' THEN 4 ELSE 1 END, file_path, rule_seq, line, issue_seq) AS n
  FROM issue_facts JOIN rules USING (rule_seq)) x""")
def _(spark, sf):
    facts = issues.classify(adapt(spark, sf, "issue_facts")).withColumns({
        "code_snippet": F.lit(""), "phase": F.when(F.col("category") == "dependency", schema.MANIFEST_PHASE).otherwise(schema.FILE_PHASE),
        "stage": F.lit(1), "seq1": F.col("rule_seq").cast("bigint"), "seq2": F.col("line") * 1_000_000 + F.col("issue_seq"),
    })
    return issues.number_issues(facts).select("scan_id", "file_path", "rule_id", "line", "issue_id")


@query("w2_heat_map", """
SELECT scan_id, file_path, risk_score, issue_count, CAST(n AS INTEGER) AS position FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY scan_id ORDER BY risk_score DESC, file_path) AS n FROM file_report) r WHERE n <= 60""")
def _(spark, sf):
    return reports.heat_map(_file_report(spark, sf))


@query("w2_all_files", "SELECT scan_id, file_path, risk_score, issue_count FROM file_report")
def _(spark, sf):
    return reports.heat_map(_file_report(spark, sf), None)


_severest = f"(SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY scan_id ORDER BY {S.weight('rank')} DESC, issue_seq) AS INTEGER) AS position FROM %s)"


@query("w3_top_findings", f"""
SELECT scan_id, position, upper(left(severity, 1)) || substr(severity, 2) AS severity_title, left(issue_type, 42) AS type_cut,
  left(file_path, 44) AS path_cut, line FROM {_severest % 'issues'} i WHERE position <= 12""")
def _(spark, sf):
    return reports.top_findings(_issues(spark, sf))


@query("w4_top_suggestions", f"""
SELECT scan_id, position, left(issue_type, 34) AS type_cut, left(replace({S.strip('suggested_code')}, chr(10), ' '), 120) AS suggestion_cut
FROM {_severest % 'enriched'} i WHERE position <= 6""")
def _(spark, sf):
    return reports.top_suggestions(_enriched(spark, sf))


@query("w5_review_batch", f"SELECT scan_id, issue_seq, position AS batch_rank FROM {_severest % 'issues'} i WHERE position <= 3")
def _(spark, sf):
    return enrich.review_batch(_issues(spark, sf), 3).select("scan_id", "issue_seq", "batch_rank")


@query("w6_list_history", """
SELECT scan_id, owner_uid, CAST(n AS INTEGER) AS position FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY owner_uid ORDER BY updated_at DESC, scan_id) AS n
FROM scan_history) h WHERE n <= 5""")
def _(spark, sf):
    return history.list_history(adapt(spark, sf, "scan_history"), 5).select("scan_id", "owner_uid", "position")


_texts = ", ".join([*dims.GUIDANCE_KEYS, *dims.ALIASES])


@query("x1_guidance", f"SELECT scan_id, issue_seq, rule_id, {_texts} FROM enriched")
def _(spark, sf):
    return _enriched(spark, sf).select("scan_id", "issue_seq", "rule_id", *dims.GUIDANCE_KEYS, *dims.ALIASES)


@query("x2_prompts", f"""
SELECT scan_id, issue_seq, 'Review this finding of a code scan and answer with one JSON object only.' || chr(10) || chr(10) || 'Issue Type: ' || issue_type ||
  chr(10) || 'Severity: ' || severity || chr(10) || 'File: ' || file_path || ':' || line || chr(10) || 'Message: ' || message || chr(10) ||
  'Code Snippet:' || chr(10) || left(code_snippet, 1600) || chr(10) || chr(10) || 'Keys: {", ".join(dims.ANSWER_KEYS)}' AS prompt FROM issues""")
def _(spark, sf):
    c = F.col
    built = enrich.prompt(c("issue_type"), c("severity"), c("file_path"), c("line"), c("message"), c("code_snippet"))
    return _issues(spark, sf).select("scan_id", "issue_seq", built.alias("prompt"))


@query("x3_answers", "SELECT * FROM every_answer")
def _(spark, sf):
    return enrich.parse_answers(adapt(spark, sf, "llm_answers")).drop("raw")


_changed = ["severity", "risk_explanation", "secure_fix_explanation", "refactored_code"]


@query("x4_applied_answers", f"""
SELECT scan_id, issue_seq, {', '.join(f"coalesce(nullif(a_{k}, ''), {k}) AS {k}" for k in _changed)},
  coalesce(nullif(a_refactored_code, ''), refactored_code) AS after_code,
  coalesce(nullif(a_secure_fix_explanation, ''), secure_fix_explanation) AS suggested_code
FROM enriched LEFT JOIN answers USING (scan_id, issue_seq)""")
def _(spark, sf):
    answers = enrich.parse_answers(adapt(spark, sf, "llm_responses"))
    applied = enrich.apply_answers(_enriched(spark, sf), answers)
    return applied.select("scan_id", "issue_seq", *_changed, "after_code", "suggested_code")


@query("x5_review_diagnostics", f"""
SELECT scan_id, count(r.raw) AS processed, CASE WHEN count(r.raw) > 0 THEN 'advanced' ELSE 'basic_fallback' END AS mode
FROM {_severest % 'issues'} i LEFT JOIN llm_responses r USING (scan_id, issue_seq) WHERE position <= 3 GROUP BY scan_id""")
def _(spark, sf):
    return enrich.review_diagnostics(enrich.review_batch(_issues(spark, sf), 3), adapt(spark, sf, "llm_responses"))


@query("x6_compare", "SELECT a.scan_id AS scan_a, b.scan_id AS scan_b, "
       + ", ".join(f"b.{s} - a.{s} AS diff_{s}" for s in dims.SCORES)
       + " FROM scan_history a JOIN scan_history b ON CAST(b.scan_id AS BIGINT) = CAST(a.scan_id AS BIGINT) + 1")
def _(spark, sf):
    scans = adapt(spark, sf, "scan_history")
    after = (F.col("scan_id").cast("bigint") + 1).cast("string")
    return history.compare(scans, scans.select(F.col("scan_id").alias("scan_a"), after.alias("scan_b")))


_gate = "last_value(CASE WHEN op <> 'progress' THEN op END IGNORE NULLS) OVER (PARTITION BY scan_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_fold = f"""(SELECT scan_id, max(seq) FILTER (WHERE op = 'create') AS c,
  arg_max(CASE op WHEN 'create' THEN 'queued' WHEN 'progress' THEN 'running' ELSE op END, seq) AS status,
  CAST(arg_max(CASE op WHEN 'create' THEN 0 WHEN 'completed' THEN 100 ELSE greatest(0, least(100, progress)) END, seq)
    FILTER (WHERE op IN ('create', 'completed', 'progress')) AS INTEGER) AS progress,
  arg_max(ts, seq) AS updated_at, max(seq) FILTER (WHERE op = 'failed') AS f, arg_max(left(error, 1200), seq) FILTER (WHERE op = 'failed') AS e
FROM (SELECT *, {_gate} AS gate FROM scan_status_events) g WHERE op <> 'progress' OR gate IS NULL OR gate NOT IN ('completed', 'failed') GROUP BY scan_id)"""


@query("t2_status_fold", f"SELECT scan_id, status, progress, updated_at, CASE WHEN f > c THEN e END AS error FROM {_fold} s WHERE c IS NOT NULL")
def _(spark, sf):
    return status.status_fold(adapt(spark, sf, "scan_status_events"))


@query("x7_status_lookup", f"""
SELECT o.scan_id, owner_uid, status FROM (SELECT DISTINCT user_id * 10 + event_id % 10 AS scan_id, CAST(user_id % 3 AS VARCHAR) AS owner_uid FROM events) o
JOIN {_fold} s ON o.scan_id = s.scan_id WHERE c IS NOT NULL AND owner_uid = '1'""")
def _(spark, sf):
    events = table(spark, sf, "events")
    scan_id = F.col("user_id") * 10 + F.col("event_id") % 10
    owners = events.select(scan_id.alias("scan_id"), (F.col("user_id") % 3).cast("string").alias("owner_uid")).distinct()
    known = status.status_fold(adapt(spark, sf, "scan_status_events")).join(owners, "scan_id")
    return status.status_of(known, "1").select("scan_id", "owner_uid", "status")


@query("t1_throttle", """
, ordered AS (SELECT *, epoch_us(ts) AS t, ROW_NUMBER() OVER (PARTITION BY user_key ORDER BY ts, event_id) AS n FROM scan_requests),
run AS (
  SELECT user_key, event_id, t, n, [t] AS accepted, true AS allowed, 0 AS retry FROM ordered WHERE n = 1
  UNION ALL
  SELECT user_key, event_id, t, n, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END, len(live) < 2,
    CASE WHEN len(live) < 2 THEN 0 ELSE CAST(floor(greatest(1e0, (86400000000 - (t - live[1])) / 1000000e0)) AS INTEGER) END
  FROM (SELECT o.user_key, o.event_id, o.t, o.n, list_filter(r.accepted, lambda a: a >= o.t - 86400000000) AS live
        FROM run r JOIN ordered o ON o.user_key = r.user_key AND o.n = r.n + 1) s)
SELECT user_key, event_id, t, allowed, CAST(retry AS INTEGER) AS retry_after_sec FROM run""")
def _(spark, sf):
    return throttle.throttle(adapt(spark, sf, "scan_requests"), 2, 86400)


ORACLE["t1_throttle"] = ORACLE["t1_throttle"].replace(") , ordered AS", "), ordered AS")


# --- streams over the given tables -------------------------------------------------------------


def _stream(spark, sf, name: str) -> DataFrame:
    """The rows of one given table as a stream, be it one file or a folder of files.

    A pattern that only the table matches: a stream takes no path of a single file.
    """
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """What an append stream has written once all present input is taken in."""
    spark, path = stream.sparkSession, _folder(stream.sparkSession, name)
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-log")
    with uncounted(spark):
        running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


ORACLE["t1_throttle_stream"] = ORACLE["t1_throttle"]


@query("t1_throttle_stream")
def _(spark, sf):
    requests = _stream(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("user_key"), "ts")
    closed = throttle.with_closing_tick(requests, _folder(spark, "tick"))
    return _drained(throttle.throttle_stream(closed, 2, 86400, "0 seconds"), "throttle")


@query("t2_status_stream", f"""
SELECT CAST(scan_id AS VARCHAR) AS scan_id, status, progress, CASE WHEN f > c THEN e END AS error FROM
  (SELECT * FROM {_fold} s WHERE c IS NOT NULL) k""")
def _(spark, sf):
    events = _stream(spark, sf, "events")
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "view", "running")
    op = op.when(F.col("event_type") == "click", "progress").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    log = events.select(
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("scan_id"), F.col("event_id").alias("seq"), op.alias("op"),
        (F.floor("value").cast("int") * 3 - 20).alias("progress"), F.col("props").alias("error"), "ts",
    )
    path = _folder(spark, "status")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    stream = status.status_stream(log).writeStream.outputMode("update").foreachBatch(keep)
    stream.option("checkpointLocation", path + "-log").trigger(availableNow=True).start().awaitTermination()
    latest = spark.read.parquet(path).groupBy("scan_id").agg(F.max_by(F.struct("status", "progress", "error"), "last_seq").alias("s"))
    return latest.select("scan_id", "s.*")


@query("x4_late_answers", """
SELECT CAST(o_orderkey % 100 AS VARCHAR) AS scan_id, o_orderkey AS issue_seq, 'open' AS severity, 'sent ' || epoch_us(l_shipdate) AS after_code
FROM orders JOIN (SELECT DISTINCT l_orderkey, l_shipdate FROM lineitem) l ON l_orderkey = o_orderkey
  AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 90 DAY""")
def _(spark, sf):
    """Orders as issues and shipments as answers; issues that stay open come out behind the watermark only, and are left aside."""
    orders, lines = _stream(spark, sf, "orders"), _stream(spark, sf, "lineitem")
    scan = lambda key: (F.col(key) % 100).cast("string").alias("scan_id")
    texts = [F.lit("open").alias(key) for key in dims.ANSWER_KEYS]
    sent_at, answered_at = F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp")
    issues = orders.select(scan("o_orderkey"), F.col("o_orderkey").alias("issue_seq"), sent_at.alias("sent_at"), F.lit("").alias("code_snippet"), *texts)
    answer = F.to_json(F.struct(F.concat(F.lit("sent "), F.unix_micros(answered_at)).alias("refactored_code")))
    responses = lines.select(scan("l_orderkey"), F.col("l_orderkey").alias("issue_seq"), answered_at.alias("answered_at"), answer.alias("raw"))
    done = _drained(reviews.reviewed(issues, responses, "90 days"), "reviews")
    return done.where("answered").select("scan_id", "issue_seq", "severity", "after_code")


@query("t3_new_files", " UNION ALL ".join(
    f"SELECT scan_id, file_path, CAST(line AS INTEGER) AS line, '{r}' AS rule_id FROM doc_stream_lines WHERE {S.hit(p, 'text', True)}"
    for r, p in dims.LINE_PATTERNS.items()))
def _(spark, sf):
    docs = _stream(spark, sf, "documents")
    arriving = docs.select(
        F.col("source").alias("scan_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"),
        F.concat(F.lit("# TODO "), F.col("text")).alias("content"),
    )
    path = _folder(spark, "arriving")
    incremental.scan_new_files(arriving, f"{path}/findings", f"{path}/counts", f"{path}/log").awaitTermination()
    found = spark.read.parquet(f"{path}/findings").where(F.col("rule_id").isin(*dims.LINE_PATTERNS))
    return found.select("scan_id", "file_path", "line", "rule_id")


@query("t3_counts_of_new_files", "SELECT scan_id, " + ", ".join(
    f"CAST(sum(CASE WHEN severity = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {s}" for s in dims.SEVERITIES) + " FROM (" + " UNION ALL ".join(
    f"SELECT scan_id, '{dims.RULES[dims.RULE_SEQ[r]][3]}' AS severity FROM doc_stream_lines WHERE {S.hit(p, 'text', True)}"
    for r, p in dims.LINE_PATTERNS.items()) + ") h GROUP BY scan_id")
def _(spark, sf):
    docs = _stream(spark, sf, "documents")
    arriving = docs.select(
        F.col("source").alias("scan_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"),
        F.concat(F.lit("# TODO "), F.col("text")).alias("content"),
    )
    path = _folder(spark, "arriving")
    incremental.scan_new_files(arriving, f"{path}/findings", f"{path}/counts", f"{path}/log", line_rules_only=True).awaitTermination()
    return incremental.current_counts(spark, f"{path}/counts").select("scan_id", *dims.SEVERITIES)


# --- whole scans -----------------------------------------------------------------------------

_all_hits = " UNION ALL ".join(
    f"SELECT scan_id, '{dims.RULES[dims.RULE_SEQ[r]][2]}' AS category, '{dims.RULES[dims.RULE_SEQ[r]][3]}' AS severity FROM code_lines WHERE {S.hit(p, 'text', True)}"
    for r, p in dims.LINE_PATTERNS.items()
)
_sec = f"CASE WHEN category IN ('security', 'dependency') THEN {S.weight('security')} ELSE 0 END"


@query("g0_riskiest_scans", f"""
SELECT scan_id, files, total_lines, coalesce(issues, 0) AS issues, {', '.join(f'coalesce({s}, 0) AS {s}' for s in dims.SEVERITIES)},
  CAST(round_even(least(100e0, greatest(0e0, 100e0 - coalesce(w, 0) / greatest(total_lines / 100e0, 1e0) * 3.3e0)), 0) AS INTEGER) AS security_score
FROM (SELECT scan_id, count(*) AS files, CAST(sum(length(content) - length(replace(content, chr(10), '')) + 1) AS BIGINT) AS total_lines
  FROM code_files GROUP BY scan_id) f
LEFT JOIN (SELECT scan_id, count(*) AS issues, CAST(sum({_sec}) AS BIGINT) AS w, {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in dims.SEVERITIES)}
  FROM ({_all_hits}) h GROUP BY scan_id) i USING (scan_id)""")
def riskiest_scans(spark, sf):
    return plan.riskiest(_code(spark, sf))


@query("u1_all_findings")
def _(spark, sf):
    code = _code(spark, sf)
    found = plan.findings(code, stored(plan.file_facts(code), "facts"))
    return found.groupBy("rule_id", "category", "severity").agg(F.count("*").alias("findings"), F.count_distinct("file_path").alias("files"))


@query("u2_scan_documents")
def _(spark, sf):
    done = plan.scan(_code(spark, sf), include_extensions=[*dims.DEFAULT_EXTENSIONS, ".txt"])
    return plan.scan_document(done.scans).select("scan_id", F.to_json(F.struct("totals", "scores", "severity_distribution", "score_radar", "metadata")).alias("document"))
