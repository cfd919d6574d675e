"""Guidance texts, and the batch before and after an outside reviewer of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark import dims
from auditspark.functions import text

PROMPT_SNIPPET_CHARS = 1600
DEFAULT_BATCH = 20


def _with_aliases(issues: DataFrame) -> DataFrame:
    return issues.withColumns({alias: F.col(source) for alias, source in dims.ALIASES.items()})


def add_guidance(issues: DataFrame) -> DataFrame:
    """Eight guidance texts and their aliases; the guidance table has five rows and is broadcast."""
    joined = issues.join(F.broadcast(dims.guidance(issues.sparkSession)), "rule_id", "left")
    dead = (F.col("rule_id") == "DEAD_CODE_FUNCTION") | F.col("issue_type").contains("Dead Code")
    texts = {
        key: F.when(dead, dead_text).otherwise(F.coalesce(F.col(f"g_{key}"), F.lit(default)))
        for key, dead_text, default in zip(dims.GUIDANCE_KEYS, dims.DEAD_CODE_GUIDANCE, dims.DEFAULT_GUIDANCE)
    }
    return _with_aliases(joined.withColumns(texts).drop(*[f"g_{key}" for key in dims.GUIDANCE_KEYS]))


def review_batch(issues: DataFrame, size: int = DEFAULT_BATCH) -> DataFrame:
    """The issues of each scan to be reviewed: the most severe, in issue order."""
    rank = text.weight(F.col("severity"), dims.SEVERITY_RANK, 1)
    order = Window.partitionBy("scan_id").orderBy(rank.desc(), "issue_seq")
    return issues.withColumn("batch_rank", F.row_number().over(order)).where(F.col("batch_rank") <= max(1, size))


def prompt(issue_type: Column, severity: Column, path: Column, line: Column, message: Column, snippet: Column) -> Column:
    return F.concat(
        F.lit("Review this finding of a code scan and answer with one JSON object only.\n\nIssue Type: "), issue_type,
        F.lit("\nSeverity: "), severity, F.lit("\nFile: "), path, F.lit(":"), line.cast("string"),
        F.lit("\nMessage: "), message, F.lit("\nCode Snippet:\n"), F.left(snippet, F.lit(PROMPT_SNIPPET_CHARS)),
        F.lit("\n\nKeys: " + ", ".join(dims.ANSWER_KEYS)),
    )


def parse_answers(responses: DataFrame) -> DataFrame:
    """Adds the trimmed answer texts ``a_<key>``; an answer that is no JSON object gives empty texts.

    A JSON null is the text ``None`` and truth values are ``True`` and ``False``; lists and objects stay JSON.
    """
    fields = ", ".join(f"{key} string" for key in dims.ANSWER_KEYS)
    is_object = text.strip(F.col("raw")).startswith("{")
    parsed = responses.withColumn("parsed", F.when(is_object, F.from_json("raw", fields)))
    parsed = parsed.withColumn("kinds", F.when(F.col("parsed").isNotNull(), F.try_parse_json("raw")))

    def shown(key: str) -> Column:
        value = F.coalesce(F.col("parsed")[key], F.lit(""))
        kind = F.schema_of_variant(F.try_variant_get("kinds", f"$.{key}", "variant"))
        return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(value)).otherwise(value)

    answers = {f"a_{key}": text.strip(shown(key)) for key in dims.ANSWER_KEYS}
    return parsed.withColumns(answers).drop("parsed", "kinds")


def apply_answers(issues: DataFrame, answers: DataFrame) -> DataFrame:
    """Non-empty answer texts replace those of the issue; aliases follow."""
    return take_answers(issues.join(answers.select("scan_id", "issue_seq", *[f"a_{k}" for k in dims.ANSWER_KEYS]), ["scan_id", "issue_seq"], "left"))


def take_answers(joined: DataFrame) -> DataFrame:
    """The same for issues that already stand beside their answers."""
    taken = {key: F.coalesce(F.nullif(F.col(f"a_{key}"), F.lit("")), F.col(key)) for key in dims.ANSWER_KEYS}
    return _with_aliases(joined.withColumns(taken).drop(*[f"a_{key}" for key in dims.ANSWER_KEYS]))


def review_diagnostics(batch: DataFrame, responses: DataFrame) -> DataFrame:
    """Per scan how many answers came back, and the mode that follows."""
    came = responses.select("scan_id", "issue_seq", F.lit(1).alias("came"))
    counted = batch.join(came, ["scan_id", "issue_seq"], "left").groupBy("scan_id").agg(F.count("came").alias("processed"))
    return counted.withColumn("mode", F.when(F.col("processed") > 0, "advanced").otherwise("basic_fallback"))
