"""Sources, whole scans and properties that hold for any input."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from auditspark import dims
from auditspark.functions import text
from auditspark.operators import history, issues, line_rules, metrics, project, reports, scores
from auditspark.plans import scan as plan
from auditspark.sources import files as sources, json_lists

TREE = {
    "app/main.py": "import os\nimport jwt\napi_key = 'abcdef1'\n\ndef run(command):\n    os.system(command)\n    return open(command)\n",
    "app/other.py": "debug = True\ncors(allow_origins=['*'])\nvalue = input('x')\n",
    "web/a.js": "import x from 'x'\nfunction go(a) {\n  return fetch(a)\n}\n",
    "requirements.txt": "flask==1.0\nnumpy\n",
    "package.json": '{"dependencies": {"lodash": "1.0", "b": "*"}}',
    "tests/test_a.py": "import pytest\n",
    "README.md": "# Title\n" + "word " * 100,
    "LICENSE": "free",
    "image.png": "eval(",
}


def zipped(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return bytearray(buffer.getvalue())


def test_archives(spark):
    rows = [
        ("in/good.ZIP", 10, zipped({"src/": "", "src\\a.py": "eval(x)", "big.py": "x" * 3000, "a/../b.py": "y"})),
        ("in/bad.zip", 10, bytearray(b"nope")),
        ("in/escape.zip", 10, zipped({"../x.py": "y"})),
        ("in/sibling.zip", 10, zipped({"a/../../good2/x.py": "y"})),
        ("in/huge.zip", 10, zipped({"a.py": "x" * 2500, "b.py": "x" * 2600})),
        ("in/name.tar", 10, bytearray(b"x")),
        ("in/long.zip", 26 * 1024 * 1024, bytearray(b"x")),
    ]
    df = spark.createDataFrame(rows, "path string, length bigint, content binary")
    members = sources.archive_members(df, max_total=5000, max_member=2000, max_archive=25 * 1024 * 1024).cache()
    got = {(r.path, r.member, r.error) for r in members.collect()}
    assert got == {
        ("in/good.ZIP", "src/a.py", None), ("in/good.ZIP", "a/../b.py", None), ("in/bad.zip", None, "NOT_A_ZIP_FILE"),
        ("in/escape.zip", None, "UNSAFE_MEMBER_PATH"), ("in/sibling.zip", None, "UNSAFE_MEMBER_PATH"),
        ("in/huge.zip", None, "EXTRACTED_SIZE_TOO_LARGE"), ("in/good.ZIP", "big.py", "MEMBER_TOO_LARGE"), ("in/name.tar", None, "NOT_A_ZIP_NAME"), ("in/long.zip", None, "TOO_LARGE"),
    }
    assert ("good", "src/a.py", "eval(x)") in {tuple(r) for r in sources.archive_files(members).collect()}


def test_read_files(spark, tmp_path):
    for path, content in TREE.items():
        target = tmp_path / "s1" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content)
    got = {(r.scan_id, r.file_path): r.content for r in sources.read_files(spark, str(tmp_path)).collect()}
    assert got == {("s1", path): content for path, content in TREE.items()}


def test_read_files_of_another_file_system_opens_selected_files_only(spark, tmp_path):
    for path in ("s1/a.py", "s1/vendor/b.py", "s1/image.png", "s 2/c.JS"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes("aé".encode() * 10)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.box.link./in", f"file://{tmp_path}")
    found = sources.read_files(spark, "viewfs://box/in", [".py", "js"], ["vendor/"], max_bytes=5)
    assert {(r.scan_id, r.file_path, r.content, r.truncated) for r in found.collect()} == {("s1", "a.py", "aéa", True), ("s 2", "c.JS", "aéa", True)}
    whole = sources.read_files(spark, "viewfs://box/in").collect()
    assert {r.scan_id for r in whole} == {"s1", "s 2"} and all(r.content == "aé" * 10 for r in whole)
    opened = found._jdf.queryExecution().executedPlan().toString()
    assert found.inputFiles() and "file_path" in opened
    archives = spark.read.format("binaryFile").load(str(tmp_path / "s1"))
    plan = sources.archive_members(archives, max_archive=7)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,7)" in plan


def test_a_scan_without_limits_keeps_every_file(spark, files):
    kept = sources.mark_source_files(files({"big": {f"f{n:04d}.py": "x" for n in range(3000)} | {"x.bin": "x"}}))
    assert kept.where("selected").count() == 3000 and "Window" not in kept._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in sources.skipped_files(kept).collect()] == [("big", "x.bin", "NOT_SELECTED")]
    capped = sources.mark_source_files(kept.drop("selected"), max_files=2500)
    assert "WindowGroupLimit" in capped._jdf.queryExecution().executedPlan().toString() and capped.where("selected").count() == 2500


def test_cap_keeps_the_first_paths_of_each_scan(spark, files):
    trees = {"big": {f"f{n:04d}.py": "x" for n in range(500)}, "small": {"a.py": "x", "b.txt": "x", "VENDOR/c.py": "x"}}
    kept = sources.select_source_files(files(trees).repartition(7), exclude_paths=["vendor/"], max_files=120)
    got = {(r.scan_id, r.file_path) for r in kept.collect()}
    assert got == {("big", f"f{n:04d}.py") for n in range(120)} | {("small", "a.py")}


def test_history_files(spark, tmp_path):
    item = {"scan_id": "a", "owner_uid": "u", "updated_at": "2024-01-02T03:04:05+00:00", "scores": {"security_score": 7}}
    (tmp_path / "good.json").write_text(json.dumps([item, {**item, "scan_id": "b"}], indent=2))
    (tmp_path / "broken.json").write_text("[{")
    (tmp_path / "object.json").write_text(json.dumps(item))
    got = history.read_history_json(spark, str(tmp_path)).collect()
    assert {(r.scan_id, r.scores.security_score) for r in got} == {("a", 7), ("b", 7)}
    path = str(tmp_path / "table")
    assert history.read_history(spark, path).count() == 0
    for n in range(2):  # a job that runs again
        history.append_history(spark.createDataFrame(got, history.HISTORY_SCHEMA), path)
    later = spark.createDataFrame(got, history.HISTORY_SCHEMA).where("scan_id = 'a'").withColumn("source_label", F.lit("later"))
    history.append_history(later, path)
    later.withColumn("scan_id", F.lit("lost")).write.parquet(f"{path}/data/part=plost")  # a job that ended before its commit
    assert sorted((r.scan_id, r.source_label) for r in history.read_history(spark, path).collect()) == [("a", "later"), ("b", None)]


def test_lists_are_read_by_byte_ranges(spark, tmp_path):
    """One list over many ranges gives what a whole read gives, whatever its strings hold."""
    draw = random.Random(8)
    texts = ['"}', "{[", "\\", '\\"', "]}", "é\n", "", '","{']
    items = [{"scan_id": str(n), "source_label": "".join(draw.choices(texts, k=4)), "scores": {"security_score": n}, "more": [{"x": [{}]}, [1, "}"]]} for n in range(4000)]
    mixed = [draw.choice([[item], [None, item], ["{", item], [1.5, item]]) for item in items]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(" \n" + json.dumps([x for some in mixed for x in some], ensure_ascii=False, indent=draw.choice([None, 1])))
    (tmp_path / "in" / "cut.json").write_text(json.dumps(items)[:-1])
    (tmp_path / "in" / "open.json").write_text(json.dumps(items)[:-9])
    (tmp_path / "in" / "empty.json").write_text("[]\n")
    (tmp_path / "in" / "nothing.json").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "in" / "a.json")).rdd.getNumPartitions() > 10
        found = json_lists.list_objects(spark, str(tmp_path / "in")).orderBy("item").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [json.loads(r.text) for r in found] == items


@pytest.fixture(scope="module")
def done(spark):
    rows = [("s1", p, c) for p, c in TREE.items()] + [("s2", p, c) for p, c in TREE.items() if "main" not in p]
    frame = spark.createDataFrame(rows, "scan_id string, file_path string, content string")
    return plan.scan(frame, include_extensions=[*dims.DEFAULT_EXTENSIONS, "txt"])


def test_whole_scan(done):
    rows = done.issues.where("scan_id = 's1'").orderBy("issue_seq").collect()
    assert [r.issue_id for r in rows] == [f"s1-{n:05d}" for n in range(1, len(rows) + 1)]
    got = [(r.file_path, r.rule_id) for r in rows]
    assert got == [
        ("app/main.py", "HARDCODED_SECRET"), ("app/main.py", "COMMAND_INJECTION"),
        ("app/main.py", "MISSING_EXCEPTION_HANDLING"), ("app/main.py", "UNUSED_IMPORT"), ("app/main.py", "DEAD_CODE_FUNCTION"),
        ("app/other.py", "MISSING_INPUT_VALIDATION_HINT"),
        ("tests/test_a.py", "UNUSED_IMPORT"),
        ("web/a.js", "POOR_NAMING_JS"), ("web/a.js", "MISSING_EXCEPTION_HANDLING_JS"), ("web/a.js", "DEAD_CODE_JS"), ("web/a.js", "UNUSED_IMPORT_JS"),
        ("package.json", "JS_DEPENDENCY_RISK"), ("package.json", "JS_DEPENDENCY_RISK"),
        ("requirements.txt", "OUTDATED_RISKY_DEPENDENCY"), ("requirements.txt", "UNPINNED_PY_DEPENDENCY"),
        ("app/other.py", "INSECURE_CORS_WILDCARD"), ("app/other.py", "DEBUG_MODE_ENABLED"), ("app/other.py", "MISSING_INPUT_VALIDATION_ARCH"),
    ]
    assert rows[0].before_code == "api_key = 'abcdef1'" and rows[4].best_practice == "CWE-561"


def test_scan_summary(done):
    first, second = done.scans.orderBy("scan_id").collect()
    assert (first.files, first.issues, first.auth_layer_missing, second.auth_layer_missing) == (6, 18, 0, 1)
    assert (first.has_readme, first.has_license, first.test_coverage_score) == (True, True, 80)
    assert first.dependency_risk_score == 100 - 10 - 5 - 5 - 2
    documents = plan.scan_document(done.scans).count()
    assert documents == 2 and done.heat_map.count() == 11 and done.recommendations.count() > 0


def test_export(done, spark, tmp_path):
    rows = reports.json_rows(done.scans.select("scan_id", "files"), "scan", F.lit(0)).unionByName(
        reports.json_rows(done.issues.select("scan_id", "issue_id", "issue_seq"), "issue", F.col("issue_seq")))
    reports.export_json(rows, str(tmp_path / "out"))
    reports.export_json(rows.where("scan_id = 's1'"), str(tmp_path / "out"))
    every = reports.read_export(spark, str(tmp_path / "out")).collect()
    back = [r for r in every if r.scan_id == "s1"]
    assert len(every) == rows.count() and len(back) == 19 and all(json.loads(r.value)["scan_id"] == "s1" for r in back)


def test_conform_splits_good_and_bad(done):
    good, bad = issues.conform(done.issues.withColumn("severity", F.when(F.col("issue_seq") == 1, "odd").otherwise(F.col("severity"))))
    assert bad.count() == 2 and good.count() == done.issues.count() - 2
    assert "rule_id" not in good.columns


def test_extra_rules(files):
    extra = [("NO_PRINT", "Print", "quality", "low", 50.0, ["style"], r"\bprint\s*\(", "A print call.")]
    found = line_rules.line_findings(files({"s": {"a.py": "print (1)\nblueprint(2)"}}), extra).collect()
    assert [(r.rule_id, r.line, r.message) for r in found] == [("NO_PRINT", 1, "A print call.")]


def test_order_and_partitions_do_not_matter(files):
    def run(frame):
        facts = plan.file_facts(frame)
        found = line_rules.line_findings(frame)
        report = scores.file_report(metrics.file_metrics(facts), found)
        rows = scores.with_scores(scores.scan_rollup(report, found)).join(project.test_coverage(facts), "scan_id")
        return {tuple(r) for r in rows.collect()}

    both = files({"a": TREE, "b": {p: c + "\neval(x)\n" for p, c in TREE.items()}})
    assert run(both.repartition(1)) == run(both.orderBy(F.rand(3)).repartition(13))
    parts = run(both.where("scan_id = 'a'")) | run(both.where("scan_id = 'b'"))
    assert run(both) == parts


def test_first_readme_counts(files):
    trees = {"a": {"readme.md": "# t", "README.md": ""}, "b": {"Readme.md": " # t\n## u\n" + "x" * 300, "docs/README.md": "no"}, "c": {"COPYING": ""}}
    measured = files(trees).withColumn("root", project.root_measure(F.col("file_path"), F.col("content")))
    got = {r.scan_id: (r.has_readme, r.readme_quality, r.has_license) for r in project.root_documents(measured).collect()}
    assert got == {"a": (False, 0, False), "b": (True, 20, False), "c": (False, 0, True)}


def test_one_scan_with_most_of_the_issues(spark):
    """Numbering does not depend on how the rows of a large scan are spread."""
    rows = [("hot" if n % 3 else f"s{n}", f"f{n % 40:02d}", n, 1 + n % 5, n % 7, n) for n in range(6000)]
    base = spark.createDataFrame(rows, "scan_id string, file_path string, line int, phase int, stage int, seq1 bigint")
    found = base.select("*", *[F.lit("x").alias(c) for c in ("rule_id", "issue_type", "category", "severity", "message", "code_snippet")],
                        F.lit(1.0).alias("confidence"), F.array(F.lit("t")).alias("tags"), F.lit(0).alias("seq2"))
    hot = issues.number_issues(found.repartition(16)).where("scan_id = 'hot'").orderBy("issue_seq").collect()
    want = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[3], r[1], r[4], r[5]))
    assert [r.line for r in hot] == [r[2] for r in want]
    assert [r.issue_seq for r in hot] == list(range(1, len(want) + 1))


def test_answers_change_what_is_counted_and_misfits_go_to_quarantine(spark, files):
    tree = {"s": {"a.py": "x = eval(y)\n", "b.py": "# TODO\n"}, "t": {"a.py": "x = eval(y)\n"}}
    plain = plan.scan(files(tree))
    seq = {r.scan_id: r.issue_seq for r in plain.issues.where("rule_id = 'EVAL_USAGE'").collect()}
    before = {r.scan_id: r.asDict() for r in plain.scans.collect()}
    rows = [("s", seq["s"], json.dumps({"severity": "low", "risk_explanation": "checked"})), ("t", seq["t"], json.dumps({"severity": "dire"}))]
    answers = spark.createDataFrame(rows, "scan_id string, issue_seq int, raw string")
    came_from = spark.createDataFrame([("s", "u1", "upload", "s.zip", 0.0, 2.504)], "scan_id string, owner_uid string, source_type string, source_label string, started_at double, finished_at double")
    came_from = came_from.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "finished_at")})
    done = plan.scan(files(tree), answers=answers, sources_of=came_from)
    after = {r.scan_id: r.asDict() for r in done.scans.collect()}
    assert after["s"]["high"] == before["s"]["high"] - 1 and after["s"]["low"] == before["s"]["low"] + 1
    assert after["s"]["issues"] == before["s"]["issues"] and after["s"]["security_score"] > before["s"]["security_score"]
    assert after["t"]["issues"] == before["t"]["issues"] - 1 and {r.problem for r in done.quarantine.collect()} == {"BAD_SEVERITY"}
    assert after["s"]["mode"] == "advanced" and before["s"]["mode"] == "basic" and after["s"]["duration_seconds"] == 2.5
    assert plain.quarantine.count() == 0
    row = history.history_rows(done.scans.select(*plain.scans.columns), came_from).where("scan_id = 's'").first()
    assert (row.owner_uid, row.totals.total_issues_found, row.scores.security_score) == ("u1", after["s"]["issues"], after["s"]["security_score"])
    told = json.loads(plan.scan_document(done.scans).where("scan_id = 's'").select(F.to_json("metadata").alias("m")).first().m)
    assert told["score_diagnostics"]["trust"]["secret_exposure_hits"] == 0 and told["ai_mode_applied"] == "advanced"


def test_an_exported_scan_is_spread_whatever_its_numbers_are(spark, tmp_path):
    table = spark.range(4000).select(F.lit("s1").alias("scan_id"), "id")
    reports.export_json(reports.json_rows(table, "issue", F.lit(0)), str(tmp_path / "out"), rows_per_file=500)
    read = reports.read_export(spark, str(tmp_path / "out"))
    sizes = [len(file.read_text().splitlines()) for file in (tmp_path / "out/data").rglob("part-*")]
    assert read.count() == read.distinct().count() == sum(sizes) == 4000 and max(sizes) <= 500


def test_suffixes_asked_for_are_put_in_order_once_and_not_for_each_row(spark, files):
    asked = [" .PY", "js", "", " Txt\x1f", ".py", "..x", ".", "İ", None]
    column = spark.range(1).select(text.normalize_extensions(F.array(*[F.lit(a).cast("string") for a in asked])).alias("e")).first().e
    assert text.normalized_extensions(asked) == column
    marked = sources.mark_source_files(files({"s": {"a.py": "x", "b.JS": "x", "c.txt": "x", "d.x": "x", "e": "x"}}), asked)
    assert {r.file_path: r.selected for r in marked.collect()} == {"a.py": True, "b.JS": True, "c.txt": True, "d.x": False, "e": False}
    assert "lambda" not in marked._jdf.queryExecution().optimizedPlan().toString()
