"""Rules over functions, imports and calls of one file.

Everything a rule needs is in the row of its file or function, so no rule here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import schema
from auditspark.functions import text

# Thresholds, name shapes and keyword patterns.
SNAKE_CASE = r"^[a-z_][a-z0-9_]{2,}$"
MAX_LENGTH, MAX_PARAMS, MAX_NESTING, MIN_MAGIC = 50, 5, 4, 4
MAX_JS_COMPLEXITY, MAX_JS_NESTING, MIN_JS_NAME = 14, 5, 3
USUAL_UNUSED_IMPORTS, USUAL_DEAD_FUNCTIONS = 30, 20
JS_LOGGING = r"\b(console\.(log|error|warn)|logger\.)"
JS_NULL_CHECK = r"(\?\.|!=\s*null|!==\s*null|typeof\s+\w+\s*!==?\s*['\"]undefined['\"])"
JS_KEYWORDS = r"\b(if|for|while|switch|case|catch)\b|\?\s*"
JS_RISKY = r"\b(fetch|axios|fs\.readFile|fs\.writeFile|JSON\.parse)\b"
JS_TRY = r"\btry\s*\{"
JS_NUMBER = r"(?<![\w.])(-?\d+(?:\.\d+)?)(?![\w.])"
PLAIN_NUMBERS = ["0", "1", "-1"]
RISKY_CALL = "open|read|write|requests|urlopen|subprocess"
LOGGING_CALL = "logging|logger|print"


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def length(first: Column, last: Column) -> Column:
    return F.greatest(F.lit(1), last - first + 1)


# --- Python -----------------------------------------------------------------------------


def python_functions(facts: DataFrame) -> DataFrame:
    """One row per function of the parsed Python files."""
    one = facts.select("scan_id", "file_path", F.posexplode("py.functions").alias("func_seq", "f"))
    return one.select("scan_id", "file_path", "func_seq", "f.*")


def python_imports(facts: DataFrame) -> DataFrame:
    one = facts.select("scan_id", "file_path", F.explode("py.imports").alias("i"))
    return one.select("scan_id", "file_path", "i.*")


def python_calls(facts: DataFrame) -> DataFrame:
    one = facts.select("scan_id", "file_path", F.explode("py.calls").alias("c"))
    return one.select("scan_id", "file_path", "c.*")


def python_file_stats(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("language") == "python").select(
        "scan_id",
        "file_path",
        F.col("py").isNotNull().alias("parse_ok"),
        F.coalesce(F.size("py.functions"), F.lit(0)).alias("function_count"),
        F.coalesce("py.null_checks", F.lit(0)).alias("null_checks"),
        F.coalesce("py.has_logging", F.lit(False)).alias("has_logging"),
        F.col("py.complexity").alias("complexity"),
    )


def call_summary(calls: DataFrame) -> DataFrame:
    """Risky and logging calls per function."""
    return calls.groupBy("scan_id", "file_path", "func").agg(
        F.count_if(F.col("dotted").rlike(RISKY_CALL)).alias("risky_calls"),
        F.max(F.col("dotted").rlike(LOGGING_CALL)).alias("logs"),
    )


def _python_function_tests(col=F.col) -> list[tuple[str, Column, Column]]:
    name = col("name")
    size = length(col("start_line"), col("end_line"))
    return [
        ("LONG_FUNCTION", size > MAX_LENGTH, _say("Function '", name, "' is ", size, " lines long (limit 50).")),
        ("TOO_MANY_PARAMETERS", col("param_count") > MAX_PARAMS,
         _say("Function '", name, "' takes ", col("param_count"), " parameters.")),
        ("DEEP_NESTING", col("max_nesting") > MAX_NESTING,
         _say("Function '", name, "' nests ", col("max_nesting"), " levels deep.")),
        ("MAGIC_NUMBERS", col("magic_numbers") >= MIN_MAGIC,
         _say("Function '", name, "' holds ", col("magic_numbers"), " bare numbers.")),
        ("POOR_NAMING_CONVENTION", ~name.rlike(SNAKE_CASE), _say("Function name '", name, "' is no snake_case name.")),
        ("MISSING_EXCEPTION_HANDLING", (col("risky_calls") > 0) & ~col("has_try"),
         _say("Function '", name, "' makes risky calls without try.")),
    ]


def _findings_of(tests, col, place) -> Column:
    """The findings of one function; null where a test fails."""
    return F.array(*[
        F.when(test, schema.finding(
            rule_id, line=col("start_line"), message=message, snippet=col("snippet"), stage=schema.STRUCTURE_STAGE, seq1=place, seq2=n,
        ))
        for n, (rule_id, test, message) in enumerate(tests)
    ])


def python_function_findings(functions: DataFrame) -> DataFrame:
    """Long, wide, deep, numeric, badly named or careless functions."""
    return schema.spread(functions, _findings_of(_python_function_tests(), F.col, F.col("func_seq")))


# Places of the per-file findings after all per-function ones.
IMPORT_PLACE, DEAD_PLACE = 1_000_000_000, 2_000_000_000


def _first(found: Column, limit: int | None) -> Column:
    return found if limit is None else F.slice(found, 1, limit)


def unused_imports(imports: Column, names: Column, limit: int | None = None) -> Column:
    """Imported names nobody uses, in import order; the first ``limit``, if given."""
    return _first(F.filter(imports, lambda i: ~F.array_contains(names, i["name"])), limit)


def dead_functions(functions: Column, called: Column, limit: int | None = None) -> Column:
    """Functions nobody calls in the file, by name; the first ``limit``, if given."""
    lonely = F.filter(functions, lambda f: ~F.array_contains(called, f["name"]) & ~f["name"].startswith("_"))
    by_name = F.array_sort(lonely, lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return _first(by_name, limit)


def _python_file_array(max_imports: int | None = None, max_dead: int | None = None) -> Column:
    unused = F.transform(
        unused_imports(F.col("py.imports"), F.col("py.names"), max_imports),
        lambda i: schema.finding(
            "UNUSED_IMPORT", line=i["line"], message=_say("Nothing uses the import '", i["name"], "'."),
            snippet=i["snippet"], stage=schema.STRUCTURE_STAGE, seq1=IMPORT_PLACE, seq2=i["seq"],
        ),
    )
    dead = F.transform(
        dead_functions(F.col("py.functions"), F.transform("py.calls", lambda c: c["plain"]), max_dead),
        lambda f, n: schema.finding(
            "DEAD_CODE_FUNCTION", line=f["start_line"],
            message=_say("Nothing in this file calls function '", f["name"], "'."),
            snippet=f["snippet"], stage=schema.STRUCTURE_STAGE, seq1=DEAD_PLACE, seq2=n,
        ),
    )
    return F.concat(unused, dead)


def python_file_findings(facts: DataFrame, max_imports: int | None = None, max_dead: int | None = None) -> DataFrame:
    return schema.spread(facts.where(F.col("py").isNotNull()), _python_file_array(max_imports, max_dead))


# --- JavaScript and TypeScript -----------------------------------------------------------


def js_functions(facts: DataFrame) -> DataFrame:
    """One row per script function, with the measures of its block."""
    one = facts.select("scan_id", "file_path", F.posexplode("js.functions").alias("func_seq", "f"))
    return js_measures(one.select("scan_id", "file_path", "func_seq", "f.*")).drop("block")


def brace_depth(block: Column) -> Column:
    """Deepest open-brace level; a surplus closing brace does not go below zero."""
    braces = F.regexp_extract_all(block, F.lit("[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))

    def step(state, brace):
        depth = F.when(brace == "{", state["depth"] + 1).otherwise(F.greatest(state["depth"] - 1, F.lit(0)))
        return F.struct(depth.alias("depth"), F.greatest(state["deepest"], depth).alias("deepest"))

    return F.aggregate(braces, start, step, lambda state: state["deepest"])


def magic_number_count(block: Column) -> Column:
    numbers = F.regexp_extract_all(block, F.lit(text.java(JS_NUMBER)), F.lit(1))
    return F.size(F.filter(numbers, lambda n: ~n.isin(PLAIN_NUMBERS)))


def keyword_complexity(content: Column) -> Column:
    return F.regexp_count(content, F.lit(text.java(JS_KEYWORDS, whole_words=True))) + 1


def null_check_count(content: Column) -> Column:
    return F.regexp_count(content, F.lit(text.java(JS_NULL_CHECK)))


def js_has_logging(content: Column) -> Column:
    return content.rlike(text.java(JS_LOGGING, whole_words=True))


def _measures(block: Column) -> list[Column]:
    return [
        keyword_complexity(block).alias("complexity"),
        brace_depth(block).alias("max_nesting"),
        magic_number_count(block).alias("magic_numbers"),
        block.rlike(text.java(JS_RISKY, whole_words=True)).alias("risky"),
        block.rlike(text.java(JS_TRY, whole_words=True)).alias("has_try"),
    ]


def js_measures(functions: DataFrame) -> DataFrame:
    return functions.select("*", *_measures(F.col("block")))


def _js_function_tests(col=F.col) -> list[tuple[str, Column, Column]]:
    name = col("name")
    size = col("end_line") - col("start_line") + 1
    return [
        ("LONG_FUNCTION_JS", size > MAX_LENGTH, _say("Function '", name, "' is ", size, " lines long (limit 50).")),
        ("TOO_MANY_PARAMETERS_JS", col("param_count") > MAX_PARAMS,
         _say("Function '", name, "' takes ", col("param_count"), " parameters.")),
        ("HIGH_COMPLEXITY_JS", col("complexity") > MAX_JS_COMPLEXITY,
         _say("Function '", name, "' has complexity ", col("complexity"), ".")),
        ("DEEP_NESTING_JS", col("max_nesting") > MAX_JS_NESTING,
         _say("Function '", name, "' nests ", col("max_nesting"), " levels deep.")),
        ("MAGIC_NUMBERS_JS", col("magic_numbers") >= MIN_MAGIC,
         _say("Function '", name, "' holds ", col("magic_numbers"), " bare numbers.")),
        ("POOR_NAMING_JS", F.length(name) < MIN_JS_NAME, _say("Function name '", name, "' says too little.")),
        ("MISSING_EXCEPTION_HANDLING_JS", col("risky") & ~col("has_try"),
         _say("Function '", name, "' makes risky calls without try.")),
    ]


def js_function_findings(functions: DataFrame) -> DataFrame:
    return schema.spread(functions, _findings_of(_js_function_tests(), F.col, F.col("func_seq")))


def _js_dead(col, place) -> Column:
    return F.when(col("uses") <= 1, schema.finding(
        "DEAD_CODE_JS", line=col("start_line"), message=_say("Function '", col("name"), "' is not used in this file."),
        snippet=col("snippet"), stage=schema.STRUCTURE_STAGE, seq1=IMPORT_PLACE, seq2=place,
    ))


def js_dead_findings(functions: DataFrame) -> DataFrame:
    return schema.spread(functions, F.array(_js_dead(F.col, F.col("func_seq"))))


def unused_js_imports(imports: Column, limit: int | None = None) -> Column:
    return _first(F.filter(imports, lambda i: ~i["used"]), limit)


def _js_import_array(limit: int | None = None) -> Column:
    return F.transform(
        unused_js_imports(F.col("js.imports"), limit),
        lambda i: schema.finding(
            "UNUSED_IMPORT_JS", line=i["line"], message=_say("Nothing uses the import '", i["name"], "'."),
            snippet=i["snippet"], stage=schema.STRUCTURE_STAGE, seq1=DEAD_PLACE, seq2=i["seq"],
        ),
    )


def js_import_findings(facts: DataFrame, limit: int | None = None) -> DataFrame:
    return schema.spread(facts.where(F.col("js").isNotNull()), _js_import_array(limit))


def structure_array() -> Column:
    """All findings that come from the structure of a file, as one array of its row of facts."""
    of_functions = F.flatten(F.transform("py.functions", lambda f, n: _findings_of(_python_function_tests(lambda c: f[c]), lambda c: f[c], n)))
    python = F.concat(of_functions, _python_file_array())
    # measured first, so that a measure is worked out once however many tests use it
    kept = ["name", "start_line", "end_line", "uses", "param_count", "snippet"]
    measured = F.transform("js.functions", lambda f: F.struct(*[f[c].alias(c) for c in kept], *_measures(f["block"])))

    def of_script(f, n):
        def col(c):
            return f[c]

        return F.concat(_findings_of(_js_function_tests(col), col, n), F.array(_js_dead(col, n)))

    scripts = text.let(measured, lambda functions: F.flatten(F.transform(functions, of_script)))
    script = F.concat(scripts, _js_import_array())
    return F.concat(*[F.coalesce(part, F.array().cast(schema.FINDINGS)) for part in (python, script)])


def structure_findings(facts: DataFrame) -> DataFrame:
    """All findings that come from the structure of single files."""
    return schema.spread(facts, structure_array())
