"""Column functions over text, versions, dates and labels."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and word characters as Python sees them; valid in Java and in RE2.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = r"[\p{L}\p{N}_]"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
OTHER_BREAKS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
SNIPPET_CHARS = 260


def java(pattern: str, ignore_case: bool = False, whole_words: bool = False) -> str:
    r"""A Python pattern as a Java one: ``\s``, ``\w``, ``\d`` and ``\b`` follow Unicode as in Python.

    ``whole_words`` says that every ``\b`` has a word character on its inner side, so one look to
    the outer side is enough.
    """
    edge = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
    out = pattern.replace(r"\s", SPACE).replace(r"\w", WORD).replace(r"\d", r"\p{Nd}")
    if whole_words:
        out = re.sub(r"\\b(?=[(A-Za-z])", lambda _: f"(?<!{WORD})", out).replace(r"\b", f"(?!{WORD})")
    return ("(?iu)" if ignore_case else "") + out.replace(r"\b", edge)


def words(*choices: str) -> str:
    """A Java pattern of whole words; no word may end in another one.

    First letters are tested at once, and the sides of a word when it is found: a look back from every letter of a text is dear.
    """
    either, first = "|".join(choices), "".join(sorted({word[0] for word in choices}))
    return f"(?=[{first}])(?:{either})(?!{WORD})(?<!{WORD}(?:{either}))"


def folded(text: Column) -> Column:
    """Lower case, with the two letters that match an ASCII one when case is ignored replaced by it."""
    return F.replace(F.replace(F.lower(text), F.lit("\u017f"), F.lit("s")), F.lit("\u0131"), F.lit("i"))


def holds(lowered: Column, groups: list[list[str]]) -> Column:
    """True if the text holds one of each group."""
    tests = [reduce(or_, [lowered.contains(sign) for sign in group]) for group in groups]
    return reduce(and_, tests)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once per row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def py_round(value: Column, places: int) -> Column:
    """Rounds the exact binary value half to even, as Python does."""
    shape = "0" if places == 0 else "0." + "0" * places
    return F.call_function("format_number", value, F.lit(shape)).cast("double")


def strip(text: Column) -> Column:
    """Without white space at both ends; only the ends of the text are looked at."""
    return F.btrim(text, F.lit(SPACES))


def split_lines(content: Column) -> Column:
    """Lines of a text; a line break at the very end opens no new line.

    Nearly all texts break lines with a line feed alone and are split on that; others are brought to
    that form first.
    """
    unusual = reduce(or_, [content.contains(mark) for mark in OTHER_BREAKS])
    unified = F.when(unusual, F.regexp_replace(content, LINE_BREAK, "\n")).otherwise(content)

    def split(text: Column) -> Column:
        body = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))

    return let(unified, split)


def snippet(line: Column) -> Column:
    return F.left(strip(line), F.lit(SNIPPET_CHARS))


def line_at(lines: Column, number: Column | int) -> Column:
    """The snippet of line ``number`` (from 1), or an empty text."""
    number = F.lit(number) if isinstance(number, int) else number
    return F.coalesce(snippet(F.get(lines, number - 1)), F.lit(""))


def clean_line(line: Column) -> Column:
    """A line without trailing comment and with single spaces."""
    bare = F.substring_index(F.substring_index(line, "#", 1), "//", 1)
    return F.trim(F.regexp_replace(bare, f"{SPACE}+", " "))


def suffix(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"[^/](\.[^./]+)$", 1)


def language(path: Column) -> Column:
    ext = suffix(path)
    return (
        F.when(ext == ".py", "python")
        .when(ext.isin(".js", ".jsx"), "javascript")
        .when(ext.isin(".ts", ".tsx"), "typescript")
        .when(ext == ".java", "java")
        .otherwise("other")
    )


def is_comment(lang: Column, line: Column) -> Column:
    """Does a line begin with a comment mark? Plain tests come first; the pattern is for lines that are indented."""

    def begins(marks: list[str], pattern: str) -> Column:
        at_once = reduce(or_, [line.startswith(mark) for mark in marks])
        return at_once | (reduce(or_, [line.contains(mark) for mark in marks]) & line.rlike(pattern))

    return F.when(lang == "python", begins(["#"], rf"\A{SPACE}*#")).otherwise(begins(["//", "/*", "*"], rf"\A{SPACE}*(?://|/\*|\*)"))


def comment_lines(lang: Column, lines: Column) -> Column:
    return F.size(F.filter(lines, lambda line: is_comment(lang, line)))


def count_lines(content: Column) -> Column:
    return (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("int")


def humanize(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def normalize_extensions(items: Column) -> Column:
    kept = F.filter(items, lambda item: item.isNotNull() & (item != ""))
    bare = F.transform(kept, lambda item: strip(F.lower(item)))
    dotted = F.transform(bare, lambda item: F.when(item.startswith("."), item).otherwise(F.concat(F.lit("."), item)))
    return F.array_sort(F.array_distinct(dotted))


def normalized_extensions(items) -> list[str]:
    """`normalize_extensions` of a list that the caller holds; the same for every row, so it is worked out once."""
    bare = [item.lower().strip() for item in items if item]
    return sorted({item if item.startswith(".") else f".{item}" for item in bare})


def parse_list(value: Column) -> Column:
    """A form field holding a JSON list or comma-separated items."""
    text = strip(F.coalesce(value, F.lit("")))
    as_json = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    items = F.coalesce(as_json, F.split(text, ",", -1))
    return F.filter(F.transform(items, strip), lambda item: item.isNotNull() & (item != ""))


def duration_seconds(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return py_round(micros / F.lit(1e6), 2)


def score_band(value: Column) -> Column:
    return F.when(value >= 85, "good").when(value >= 65, "mid").otherwise("bad")


def risk_band(value: Column) -> Column:
    return F.when(value >= 80, "severe").when(value >= 60, "high").when(value >= 35, "raised").otherwise("calm")


def half_up(value: Column) -> Column:
    return F.floor(F.coalesce(value, F.lit(0.0)) + F.lit(0.5)).cast("bigint")


def heat_label(risk: Column, issues: Column) -> Column:
    return F.concat(
        F.lit("Risk "), half_up(risk).cast("string"), F.lit(" | Issues "), F.coalesce(issues, F.lit(0)).cast("string")
    )


def confidence_label(confidence: Column) -> Column:
    return F.concat(half_up(confidence).cast("string"), F.lit("%"))


def first_text(*choices: Column | str) -> Column:
    """The first non-empty text."""
    picked = [F.nullif(c, F.lit("")) if isinstance(c, Column) else F.lit(c) for c in choices]
    return F.coalesce(*picked)


def version_parts(version: Column) -> Column:
    """The first four numbers of a version, padded with zeros; arrays compare in order."""
    runs = F.slice(F.regexp_extract_all(F.coalesce(version, F.lit("")), F.lit("[0-9]+"), F.lit(0)), 1, 4)
    top = F.lit(9223372036854775807)
    numbers = F.transform(runs, lambda run: F.coalesce(run.try_cast("bigint"), top))
    return F.slice(F.concat(numbers, F.array(*[F.lit(0).cast("bigint")] * 4)), 1, 4)


def version_is_lower(version: Column, safe: Column) -> Column:
    return version_parts(version) < version_parts(safe)


def weight(severity: Column, table: dict[str, int], default: int) -> Column:
    out = None
    for name, value in table.items():
        test = F.lower(severity) == name
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)
