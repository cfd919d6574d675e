"""Rules that look at one line at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import dims, schema
from auditspark.functions import text


def lines(files: DataFrame) -> DataFrame:
    """``lines(scan_id, file_path, line, text)`` with line numbers from 1."""
    exploded = files.select("scan_id", "file_path", F.posexplode(text.split_lines(F.col("content"))).alias("pos", "text"))
    return exploded.select("scan_id", "file_path", (F.col("pos") + 1).alias("line"), "text")


def matches(rule_id: str, line_text: Column, lowered: Column | None = None) -> Column:
    """Whether a line matches a rule; plain text searches come first, since few lines pass them."""
    lowered = text.folded(line_text) if lowered is None else lowered
    return text.holds(lowered, dims.LINE_TRIGGERS[rule_id]) & line_text.rlike(text.java(dims.LINE_PATTERNS[rule_id], ignore_case=True, whole_words=True))


def rule_hits(line_table: DataFrame, rule_id: str) -> DataFrame:
    """Lines one rule matches, with the snippet it reports."""
    hit = line_table.where(matches(rule_id, F.col("text")))
    return hit.select("scan_id", "file_path", "line", text.snippet(F.col("text")).alias("code_snippet"))


def line_hits(content: Column, extra_rules=(), own_only: bool = False) -> Column:
    """(rule_seq, line, code_snippet) of every hit in a text, worked out inside its row.

    ``extra_rules`` are tuples (rule_id, issue_type, category, severity, confidence, tags, pattern, message); ``own_only`` leaves it at these.
    All patterns are literals, so they are compiled once, and only hits become rows later.
    """
    first_extra = len(dims.RULES)

    def of_line(line: Column, n: Column) -> Column:
        def tests(lowered: Column) -> Column:
            judged = [] if own_only else [(dims.RULE_SEQ[rule_id], matches(rule_id, line, lowered)) for rule_id in dims.LINE_PATTERNS]
            judged += [
                (first_extra + i, line.rlike(text.java(rule[6], ignore_case=True))) for i, rule in enumerate(extra_rules)
            ]
            hits = [
                F.when(test, F.struct(F.lit(seq).alias("rule_seq"), (n + 1).alias("line"), text.snippet(line).alias("code_snippet")))
                for seq, test in judged
            ]
            return F.array_compact(F.array(*hits))

        return text.let(text.folded(line), tests)

    def of_lines(every: Column) -> Column:
        return F.flatten(F.transform(every, of_line))

    return text.let(text.split_lines(content), of_lines)


def hit_findings(hits: DataFrame, extra_rules=()) -> DataFrame:
    """Findings from ``(scan_id, file_path, h)`` with one hit ``h`` per row; the catalogue is broadcast."""
    catalogue = F.broadcast(dims.rules(hits.sparkSession, extra_rules))
    rows = hits.select("scan_id", "file_path", "h.rule_seq", "h.line", "h.code_snippet")
    return rows.join(catalogue, "rule_seq").select(
        *schema.FINDING[:11],
        F.lit(schema.FILE_PHASE).alias("phase"),
        F.lit(schema.LINE_STAGE).alias("stage"),
        F.col("rule_seq").cast("bigint").alias("seq1"),
        F.col("line").cast("bigint").alias("seq2"),
    )


def line_findings(files: DataFrame, extra_rules=()) -> DataFrame:
    """Findings of all line rules in ``files(scan_id, file_path, content)``."""
    hits = files.select("scan_id", "file_path", F.explode(line_hits(F.col("content"), extra_rules)).alias("h"))
    return hit_findings(hits, extra_rules)


def hit_array(hits: Column, extra_rules=()) -> Column:
    """The findings of a file's ``line_hits``; what a rule fixes is looked up in a literal of the plan."""
    rules = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(schema.FINDING[3:7], row[1:5])], F.lit(row[7]).alias("message"),
                 F.lit(float(row[5])).alias("confidence"), F.array(*map(F.lit, row[6])).cast("array<string>").alias("tags"))
        for row in dims.rule_rows(extra_rules)
    ])

    def one(h: Column) -> Column:
        rule = F.get(rules, h["rule_seq"])
        return F.struct(
            h["line"].cast("int").alias("line"), *[rule[n].alias(n) for n in (*schema.FINDING[3:7], "message")],
            h["code_snippet"].alias("code_snippet"), rule["confidence"].alias("confidence"), rule["tags"].alias("tags"),
            F.lit(schema.FILE_PHASE).alias("phase"), F.lit(schema.LINE_STAGE).alias("stage"),
            h["rule_seq"].cast("bigint").alias("seq1"), h["line"].cast("bigint").alias("seq2"),
        )

    return F.transform(hits, one)
