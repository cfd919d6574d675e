"""Complexity, maintainability and the record kept per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import dims, schema
from auditspark.functions import text
from auditspark.operators import dependencies, line_rules, project

# Keyword patterns and limits.
JS_BRANCHES = r"\b(if|for|while|catch|case|\?\s*|&&|\|\|)\b"
OTHER_BRANCHES = r"\b(if|for|while|switch|catch)\b"
HIGH_COMPLEXITY, ELEVATED_COMPLEXITY, LOW_INDEX = 25, 16, 45


# JS_BRANCHES with each boundary as one look outwards: before a word none, around a sign one letter.
JS_BRANCHES_JAVA = (
    rf"{text.words('if', 'for', 'while', 'catch', 'case')}"
    rf"|(?<={text.WORD})(?:\?{text.SPACE}*|&&|\|\|)(?={text.WORD})"
)
OTHER_BRANCHES_JAVA = text.words("if", "for", "while", "switch", "catch")


def js_complexity(content: Column) -> Column:
    return F.regexp_count(content, F.lit(JS_BRANCHES_JAVA)) + 1


def keyword_complexity(content: Column) -> Column:
    return F.regexp_count(content, F.lit(OTHER_BRANCHES_JAVA)) + 1


def text_complexity(lang: Column, content: Column) -> Column:
    """Complexity as far as the text alone tells; a parsed Python file has a better number."""
    is_script = lang.isin("javascript", "typescript")
    return F.when(is_script, js_complexity(content)).otherwise(keyword_complexity(content))


def maintainability(lines: Column, complexity: Column, comments: Column) -> Column:
    loc = F.greatest(lines, F.lit(1)).cast("double")
    branches = F.greatest(complexity.cast("double"), F.lit(1.0))
    ratio = F.least(comments / loc, F.lit(1.0))
    raw = (
        F.lit(171.0) - F.lit(5.2) * F.ln(F.greatest(loc * branches, F.lit(1.0)))
        - F.lit(0.23) * branches - F.lit(16.2) * F.ln(loc)
    )
    value = (raw + F.lit(50.0) * F.sin(F.sqrt(F.lit(2.4) * ratio))) * F.lit(100.0) / F.lit(171.0)
    return text.py_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)), 2)


def text_signs(content: Column) -> dict[str, Column]:
    """Signs of a whole text by column functions."""
    lowered = F.lower(content)

    def any_of(tokens):
        test = lowered.contains(tokens[0])
        for token in tokens[1:]:
            test = test | lowered.contains(token)
        return test

    return {
        "has_auth": any_of(dims.AUTH_TOKENS),
        "open_cors": lowered.contains("cors") & any_of(dims.CORS_WILDCARDS),
        "debug_on": lowered.contains("debug") & lowered.rlike(text.java(dims.DEBUG_PATTERN, whole_words=True)),
        "unchecked_input": any_of(dims.INPUT_SIGNS) & ~any_of(dims.VALIDATION_SIGNS),
        "test_framework": any_of(dims.TEST_SIGNS),
        "logging_text": any_of(dims.LOGGING_SIGNS),
    }


def profile(files: DataFrame, extra_rules=(), signs: bool = True) -> DataFrame:
    """What the JVM reads off a file's text in one pass; the content stays for the parser, which also goes through lines and words.

    ``extra_hits`` are the hits of ``extra_rules``. Without ``signs`` the signs of the text are left to the parser's pass too.
    """
    content = F.col("content")
    base = files.withColumn("language", text.language(F.col("file_path")))
    extra = [line_rules.line_hits(content, extra_rules, own_only=True).alias("extra_hits")] if extra_rules else []
    return base.select(
        *files.columns, "language",
        *[test.alias(name) for name, test in (text_signs(content) if signs else {}).items()],
        *extra,
        F.when(dependencies.is_manifest(F.col("file_path")), content).alias("manifest"),
        project.root_measure(F.col("file_path"), content).alias("root"),
    )


def _measures() -> dict[str, Column]:
    complexity = F.coalesce(F.col("py.complexity"), F.col("text_complexity"))
    checks = F.coalesce(F.col("py.null_checks"), F.col("js_null_checks"))
    return {
        "complexity": complexity.cast("int"),
        "maintainability_index": maintainability(F.col("lines"), complexity, F.col("comment_lines")),
        "has_logging": F.coalesce(F.col("py.has_logging"), F.col("js_logging")).cast("int"),
        "null_checks": checks.cast("int"),
    }


def file_metrics(facts: DataFrame) -> DataFrame:
    """Measures of each file from its profile and structure facts."""
    columns = ["scan_id", "file_path", "language", "lines", "comment_lines", "first_line"]
    return facts.select(*columns, *[value.alias(name) for name, value in _measures().items()])


def with_measures(facts: DataFrame) -> DataFrame:
    """The facts with the measures beside them."""
    return facts.withColumns(_measures())


def complexity_array() -> Column:
    """Findings of a row of `file_metrics`: a complex file, and one that is hard to maintain."""
    cc, index = F.col("complexity"), F.col("maintainability_index")
    place = {"snippet": F.col("first_line"), "stage": schema.COMPLEXITY_STAGE}
    heavy = F.when(cc > HIGH_COMPLEXITY, schema.finding(
        "HIGH_COMPLEXITY_FILE", message=F.concat(F.lit("File complexity is high ("), cc.cast("string"), F.lit(").")), **place,
    )).when(cc > ELEVATED_COMPLEXITY, schema.finding(
        "MODERATE_COMPLEXITY_FILE", message=F.concat(F.lit("File complexity is raised ("), cc.cast("string"), F.lit(").")), **place,
    ))
    low = F.when(index < LOW_INDEX, schema.finding(
        "LOW_MAINTAINABILITY", message=F.concat(F.lit("Maintainability index is low ("), index.cast("string"), F.lit(").")),
        snippet=F.col("first_line"), stage=schema.MAINTAINABILITY_STAGE,
    ))
    return F.array(heavy, low)


def complexity_findings(metrics: DataFrame) -> DataFrame:
    """Complex files, and files that are hard to maintain."""
    return schema.spread(metrics, complexity_array())
