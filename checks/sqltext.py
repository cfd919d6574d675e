"""Pieces of the check SQL that DuckDB runs next to each Spark query."""

from __future__ import annotations

import re

from auditspark import dims
from auditspark.functions.text import LINE_BREAK, SPACE
from checks import adapters

WEIGHTS = {
    "risk": (dims.RISK_WEIGHT, 1), "security": (dims.SECURITY_WEIGHT, 1), "dependency": (dims.DEPENDENCY_WEIGHT, 2),
    "rank": (dims.SEVERITY_RANK, 1),
}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(rf'\A{SPACE}+|{SPACE}+\z')}, '', 'g')"


def plain(x: str) -> str:
    """Foreign letters, digits and spaces folded to ASCII ones, so that RE2's \\b, \\w and \\s agree with Python's."""
    folded = f"regexp_replace({x}, '[^\\x00-\\x7F\\P{{L}}]', 'z', 'g')"
    folded = f"regexp_replace({folded}, '[^\\x00-\\x7F\\P{{N}}]', '9', 'g')"
    return f"regexp_replace({folded}, '[\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]', ' ', 'g')"


def hit(pattern: str, x: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({plain(x)}, {lit(('(?i)' if ignore_case else '') + pattern)})"


def count(pattern: str, x: str) -> str:
    return f"len(regexp_extract_all({plain(x)}, {lit(pattern)}))"


def rounded(x: str, places: int) -> str:
    """Rounded like Python: the exact binary value, half to even."""
    return f"CAST(printf('%.{places}f', {x}) AS DOUBLE)"


def split(x: str) -> str:
    parts = f"string_split_regex({x}, {lit(LINE_BREAK)})"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)"


def snippet(x: str) -> str:
    return f"left({strip(x)}, 260)"


def clean(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '(?s)#.*', ''), '(?s)//.*', '')"
    return strip(f"regexp_replace({bare}, {lit(SPACE + '+')}, ' ', 'g')")


def suffix(x: str) -> str:
    return f"regexp_extract(lower({x}), '[^/](\\.[^./]+)$', 1)"


def language(x: str) -> str:
    s = suffix(x)
    return (
        f"(CASE WHEN {s} = '.py' THEN 'python' WHEN {s} IN ('.js', '.jsx') THEN 'javascript' "
        f"WHEN {s} IN ('.ts', '.tsx') THEN 'typescript' WHEN {s} = '.java' THEN 'java' ELSE 'other' END)"
    )


def weight(kind: str, x: str = "severity") -> str:
    table, default = WEIGHTS[kind]
    return f"(CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END)"


def version(x: str) -> str:
    runs = f"regexp_extract_all(coalesce({x}, ''), '[0-9]+')"
    nums = f"[coalesce(TRY_CAST(r AS BIGINT), 9223372036854775807) for r in {runs}[1:4]]"
    return f"list_concat({nums}, [0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT])[1:4]"


def band(value: str) -> str:
    return f"CASE WHEN {value} >= 85 THEN 'good' WHEN {value} >= 65 THEN 'mid' ELSE 'bad' END"


def maintainability(lines: str, complexity: str, comments: str) -> str:
    loc = f"greatest({lines}, 1)::DOUBLE"
    cc = f"greatest({complexity}::DOUBLE, 1e0)"
    raw = f"(171e0 - 5.2e0 * ln(greatest({loc} * {cc}, 1e0)) - 0.23e0 * {cc} - 16.2e0 * ln({loc}))"
    value = f"({raw} + 50e0 * sin(sqrt(2.4e0 * least({comments} / {loc}, 1e0)))) * 100e0 / 171e0"
    return rounded(f"greatest(0e0, least(100e0, {value}))", 2)


def clamp(x: str) -> str:
    return f"CAST(greatest(0, least(100, {x})) AS INTEGER)"


def values(rows) -> str:
    def cell(v):
        if isinstance(v, bool):
            return str(v).lower()
        return lit(v) if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def _named(*signs: str) -> str:
    return "(" + " OR ".join(f"contains(rule_id, '{s}')" for s in signs) + ")"


def _sum(x: str) -> str:
    return f"CAST(sum({x}) AS BIGINT)"


def _n(test: str) -> str:
    return f"count(*) FILTER (WHERE {test})"


_exposed = "category IN ('security', 'dependency')"
_severe = "category = 'reliability' AND severity IN ('high', 'critical')"
_dead = lit(dims.DEAD_CODE_GUIDANCE[0])


def _answers(table: str) -> str:
    """Trimmed answer texts; a JSON null and truth values are written as Python writes them."""
    good = "CASE WHEN json_valid(raw) THEN raw END"
    columns = []
    for key in dims.ANSWER_KEYS:
        path = lit(f"$.{key}")
        value = (f"CASE json_type({good}, {path}) WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN "
                 f"CASE json_extract_string({good}, {path}) WHEN 'true' THEN 'True' ELSE 'False' END "
                 f"ELSE coalesce(json_extract_string({good}, {path}), '') END")
        columns.append(f"CASE WHEN json_valid(raw) AND json_type({good}) = 'OBJECT' THEN {strip(value)} ELSE '' END AS a_{key}")
    return f"SELECT scan_id, issue_seq, {', '.join(columns)} FROM {table}"


FRAGMENTS = {
    **{name: adapters.oracle_text(name) for name in adapters.ADAPTERS},
    "rules": "SELECT * FROM (VALUES "
    + values([(n, r[0], r[1], r[2], r[3], r[4]) for n, r in enumerate(dims.RULES)])
    + ") t(rule_seq, rule_id, issue_type, category, severity, confidence)",
    "risks": "SELECT * FROM (VALUES "
    + values([(k, v[0], v[1]) for k, v in dims.DEPENDENCY_RISKS.items()]) + ") t(package, safe_version, risk_severity)",
    "guidance": "SELECT * FROM (VALUES " + values([(k, *v) for k, v in dims.GUIDANCE.items()])
    + ") t(rule_id, " + ", ".join(f"g_{k}" for k in dims.GUIDANCE_KEYS) + ")",
    "issues": "SELECT scan_id, issue_seq, file_path, line, rule_id, issue_type, category, severity, confidence, "
    "'m' || issue_seq AS message, ' x = ' || line AS code_snippet FROM issue_facts JOIN rules USING (rule_seq)",
    "code_lines": "SELECT scan_id, file_path, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS line "
    f"FROM (SELECT scan_id, file_path, {split('content')} AS l FROM code_files) s",
    "doc_stream_lines": "SELECT scan_id, file_path, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS line FROM (SELECT source AS scan_id, "
    f"'d' || doc_id || '.py' AS file_path, {split("'# TODO ' || text")} AS l FROM documents) s",
    "doc_lines": "SELECT scan_id, file_path, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS line "
    f"FROM (SELECT scan_id, file_path, {split('content')} AS l FROM doc_files) s",
    "measured": f"SELECT *, {maintainability('lines', 'complexity', 'comment_lines')} AS maintainability_index FROM file_facts",
    "issue_rollup": "SELECT scan_id, count(*) AS issues, "
    + ", ".join(f"{_n(f'severity = {lit(s)}')} AS {s}" for s in dims.SEVERITIES)
    + f", {_sum(f'CASE WHEN {_exposed} THEN ' + weight('security') + ' ELSE 0 END')} AS security_weight, "
    + _sum("CASE WHEN category = 'dependency' THEN " + weight("dependency") + " ELSE 0 END") + " AS dependency_weight, "
    + f"{_n(_named('SECRET'))} AS secret_hits, "
    + _n("contains(rule_id, 'AUTH') OR contains(lower(issue_type), 'authentication')") + " AS auth_hits, "
    + f"{_n(_named('INPUT_VALIDATION'))} AS input_hits, {_n(_severe)} AS reliability_hits, "
    + f"{_n(_named('MISSING_EXCEPTION_HANDLING'))} AS unhandled_hits, {_n(_named('EMPTY_EXCEPTION_HANDLER'))} AS swallowed_hits, "
    + f"{_n(_named('DUPLICATION'))} AS duplication_hits, {_n(_named('LONG_FUNCTION'))} AS long_hits, "
    + f"{_n(_named('DEAD_CODE'))} AS dead_hits, {_n(_named('COMPLEXITY'))} AS complexity_hits, "
    + f"{_n(_exposed + ' AND ' + _named('SECRET'))} AS rec_secret, {_n(_exposed + ' AND ' + _named('INJECTION'))} AS rec_injection, "
    + _n("category = 'reliability' AND " + _named("MISSING_EXCEPTION_HANDLING")) + " AS rec_exceptions, "
    + _n("category IN ('quality', 'maintainability') AND " + _named("DUPLICATION")) + " AS rec_duplication "
    + "FROM issues GROUP BY scan_id",
    "file_rollup": "SELECT scan_id, count(*) AS files, CAST(sum(lines) AS BIGINT) AS total_lines, "
    "count(*) FILTER (WHERE has_logging > 0) / count(*) AS logging_ratio, "
    "count(*) FILTER (WHERE null_checks > 0) / count(*) AS null_check_ratio, "
    "CAST(sum(complexity) AS DOUBLE) / count(*) AS mean_complexity, "
    "CAST(sum(CAST(round_even(maintainability_index * 100, 0) AS BIGINT)) AS DOUBLE) / (count(*) * 100) AS mean_maintainability "
    "FROM measured GROUP BY scan_id",
    "rollup": "SELECT f.*, "
    + ", ".join(
        f"coalesce({n}, 0) AS {n}" for n in [
            "issues", *dims.SEVERITIES, "security_weight", "dependency_weight", "secret_hits", "auth_hits", "input_hits",
            "reliability_hits", "unhandled_hits", "swallowed_hits", "duplication_hits", "long_hits", "dead_hits",
            "complexity_hits", "rec_secret", "rec_injection", "rec_exceptions", "rec_duplication",
        ]
    ) + " FROM file_rollup f LEFT JOIN issue_rollup i USING (scan_id)",
    "four_scores": "SELECT *, "
    "CAST(round_even(least(100e0, greatest(0e0, 100e0 - security_weight / greatest(total_lines / 100e0, 1e0) * 3.3e0)), 0) AS INTEGER) AS security_score, "
    + clamp("100 - (secret_hits * 11 + auth_hits * 9 + input_hits * 4 + reliability_hits * 6) + CASE WHEN input_hits = 0 THEN 4 ELSE 0 END")
    + " AS trust_score, "
    + clamp(
        "100 - (unhandled_hits * 6 + swallowed_hits * 5 + reliability_hits * 4) "
        "+ CAST(floor(logging_ratio * 8e0) AS BIGINT) + CAST(floor(null_check_ratio * 6e0) AS BIGINT)"
    ) + " AS reliability_score, "
    + clamp(
        "100 - (duplication_hits * 4 + long_hits * 3 + dead_hits * 2 + complexity_hits * 4) "
        "- CASE WHEN mean_complexity > 20 THEN 8 WHEN mean_complexity > 12 THEN 4 ELSE 0 END "
        "- CASE WHEN mean_maintainability < 45 THEN 10 WHEN mean_maintainability < 65 THEN 5 ELSE 0 END"
    ) + " AS quality_score FROM rollup",
    "scored": "SELECT *, CAST(greatest(0, least(100, round_even(100e0 - (security_score * 0.35e0 + trust_score * 0.2e0 "
    "+ reliability_score * 0.2e0 + quality_score * 0.25e0) + least(18e0, issues / greatest(files, 1) * 4e0), 0))) AS INTEGER) "
    "AS improvement_potential, CAST(greatest(0, 100 - dependency_weight) AS INTEGER) AS dependency_risk_score FROM four_scores",
    "file_report": "SELECT m.scan_id, m.file_path, coalesce(issue_count, 0) AS issue_count, coalesce(critical_count, 0) AS critical_count, "
    "coalesce(high_count, 0) AS high_count, coalesce(medium_count, 0) AS medium_count, coalesce(low_count, 0) AS low_count, "
    "coalesce(duplication_blocks, 0) AS duplication_blocks, " + rounded("least(100e0, coalesce(w, 0) * 2.4e0)", 2) + " AS risk_score "
    "FROM file_facts m LEFT JOIN (SELECT scan_id, file_path, count(*) AS issue_count, "
    + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}_count" for s in dims.SEVERITIES)
    + ", count(*) FILTER (WHERE contains(rule_id, 'DUPLICATION')) AS duplication_blocks, "
    + f"sum({weight('risk')}) AS w FROM issues GROUP BY scan_id, file_path) i USING (scan_id, file_path)",
    "side_scores": "SELECT *, CAST((total_lines * 7) % 101 AS INTEGER) AS test_coverage_score, "
    "CAST((total_lines * 11) % 101 AS INTEGER) AS code_maturity_index, "
    "CASE WHEN issues % 2 = 0 THEN 'basic' ELSE 'advanced' END AS mode FROM scored",
    "enriched": "SELECT *, "
    + ", ".join(f"{source} AS {alias}" for alias, source in dims.ALIASES.items())
    + " FROM (SELECT i.*, "
    + ", ".join(
        f"CASE WHEN rule_id = 'DEAD_CODE_FUNCTION' OR contains(issue_type, 'Dead Code') THEN {lit(dead)} "
        f"ELSE coalesce(g_{key}, {lit(default)}) END AS {key}"
        for key, dead, default in zip(dims.GUIDANCE_KEYS, dims.DEAD_CODE_GUIDANCE, dims.DEFAULT_GUIDANCE)
    ) + " FROM issues i LEFT JOIN guidance g USING (rule_id)) e",
    "answers": _answers("llm_responses"),
    "every_answer": _answers("llm_answers"),
}


def full(body: str) -> str:
    """A complete statement: the fragments the body needs, in order, as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in FRAGMENTS:
            if re.search(rf"\b{name}\b", text) and name not in order:
                if FRAGMENTS[name] is not text:
                    need(FRAGMENTS[name])
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({FRAGMENTS[name]})" for name in order) + " " + body
