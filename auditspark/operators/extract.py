"""Structure facts of source files.

The Python workers that read texts sit here: a syntax tree for Python files, two skip-ahead passes
over lines (script functions and function blocks) whose next start depends on the last end, and what
is told line by line (hits of the line rules, comments, words of branches), since column functions
over the lines of a row are interpreted element by element. One file is one row in and one row out,
so nothing larger than a file is ever held.
"""

from __future__ import annotations

import ast
import gc
import re
import sys
import warnings
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from auditspark import dims
from auditspark.functions import text
from auditspark.operators import structure_rules

# The helpers below travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---------------------------------------------------------------------------------------
# Node groups, call signs, function headers, comment marks.
# ---------------------------------------------------------------------------------------
NESTING_NODES = frozenset((ast.If, ast.For, ast.While, ast.Try, ast.With, ast.Match))
BRANCH_NODES = frozenset((
    ast.If, ast.For, ast.While, ast.Try, ast.ExceptHandler, ast.With, ast.BoolOp, ast.IfExp, ast.Match,
))
FUNCTION_NODES = frozenset((ast.FunctionDef, ast.AsyncFunctionDef))
# fields that never hold a node with facts: names, marks, operators
LEAF_FIELDS = frozenset((
    "ctx", "op", "ops", "id", "attr", "arg", "kind", "type_comment", "level", "module", "conversion", "simple", "is_async",
))
LOGGING_SIGNS = ("logging", "logger", "print")
RISKY_SIGNS = ("open", "read", "write", "requests", "urlopen", "subprocess")
PLAIN_NUMBERS = {0, 1, -1}
SCRIPT_FUNCTION = re.compile(
    r"^\s*(?:function\s+([A-Za-z_]\w*)\s*\(([^)]*)\)|(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*\(([^)]*)\)\s*=>\s*\{)"
)
DEF_HEADER = re.compile(r"^\s*def\s+([A-Za-z_]\w*)\s*\(")
SCRIPT_HEADER = re.compile(r"^\s*(?:function\s+([A-Za-z_]\w*)\s*\(|(?:const|let|var)\s+([A-Za-z_]\w*)\s*=)")
SCRIPT_IMPORT = re.compile(r"^\s*import\s+(.+?)\s+from\s+['\"].+['\"]", re.MULTILINE)
IMPORT_GLUE = re.compile(r"[{},\s]+")
IMPORT_FILLERS = ("", "as", "default")
WORD_RUN = re.compile(r"\w+")
IDENTIFIER = re.compile(r"[A-Za-z_]\w+")
BLOCK_MIN_LINES = 6
SNIPPET_CHARS = text.SNIPPET_CHARS

# the line rules as (rule_seq, groups of signs, pattern), as `line_rules.matches` has them, with marks that a pattern asks for as well;
# groups of single marks come first, since these are found at once and few lines of prose hold one
RULE_MARKS = {"SQL_INJECTION_STRING_BUILD": [["+", "%", "'", '"']], "COMMAND_INJECTION": [["("]]}
LINE_RULES = [
    (dims.RULE_SEQ[rule_id], sorted(map(tuple, RULE_MARKS.get(rule_id, []) + dims.LINE_TRIGGERS[rule_id]), key=lambda group: max(map(len, group))),
     re.compile(pattern, re.IGNORECASE))
    for rule_id, pattern in dims.LINE_PATTERNS.items()
]
# the patterns of `metrics.text_complexity`, which look to the sides of a word or sign where one stands, and of the script facts of `structure_rules`
SCRIPT_BRANCHES, OTHER_BRANCHES = (
    [re.compile(rf"{word}(?<!\w{word})\b") for word in words]
    for words in (("if", "for", "while", "catch", "case"), ("if", "for", "while", "switch", "catch"))
)
BRANCH_SIGN = re.compile(r"(?:\?(?<=\w\?)\s*|&&(?<=\w&&)|\|\|(?<=\w\|\|))\b")
JS_LOGGING, JS_LOGGING_SIGNS = re.compile(structure_rules.JS_LOGGING), ("console.", "logger.")
JS_NULL_CHECK = re.compile(structure_rules.JS_NULL_CHECK)
DEBUG = re.compile(dims.DEBUG_PATTERN)


def _by_root(signs, *roots) -> list[tuple[str, list[str]]]:
    """(root, signs that hold it): a text without a root is searched once for all its signs."""
    return [(root, [sign for sign in signs if root in sign]) for root in roots]


AUTH, TEST, LOGGING = (
    _by_root(dims.AUTH_TOKENS, "auth", "jwt", "verify_id_token"), _by_root(dims.TEST_SIGNS, "test"), _by_root(dims.LOGGING_SIGNS, "logg"),
)
INPUT, VALIDATION = _by_root(dims.INPUT_SIGNS, "request.", "input("), _by_root(dims.VALIDATION_SIGNS, *dims.VALIDATION_SIGNS)
CORS = _by_root(dims.CORS_WILDCARDS, "allow_origins=")
HEADER_WORDS, SCRIPT_WORDS = ("def", "function", "const", "let", "var"), ("function", "const", "let", "var")
COMMENT_MARKS, PYTHON_COMMENT_MARKS = ("//", "/*", "*"), ("#",)

TEXT_TYPE = (
    "struct<lines:int,comment_lines:int,first_line:string,text_complexity:int,js_logging:boolean,js_null_checks:int,has_auth:boolean,"
    "open_cors:boolean,debug_on:boolean,unchecked_input:boolean,test_framework:boolean,logging_text:boolean,"
    "line_hits:array<struct<rule_seq:int,line:int,code_snippet:string>>>"
)
FUNCTION_TYPE = (
    "array<struct<name:string,start_line:int,end_line:int,param_count:int,max_nesting:int,"
    "magic_numbers:int,risky_calls:int,has_try:boolean,snippet:string>>"
)
PYTHON_TYPE = (
    f"struct<functions:{FUNCTION_TYPE},imports:array<struct<name:string,line:int,seq:int,snippet:string>>,names:array<string>,"
    "calls:array<struct<func:string,dotted:string,plain:string>>,null_checks:int,has_logging:boolean,complexity:int>"
)
BODY_TYPE = "array<struct<name:string,line:int,body:string,turn:int,chars:int>>"
SCRIPT_TYPE = (
    "struct<functions:array<struct<name:string,start_line:int,end_line:int,param_count:int,uses:int,"
    "block:string,snippet:string>>,imports:array<struct<name:string,line:int,seq:int,used:boolean,snippet:string>>>"
)


def _line(lines, number: int) -> str:
    return lines[number - 1].strip()[:SNIPPET_CHARS] if 0 < number <= len(lines) else ""


def _dotted(node) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def _child_fields(kind) -> tuple[str, ...]:
    return tuple(name for name in kind._fields if name not in LEAF_FIELDS) if kind is not ast.Constant else ()


def _is_kind(value) -> bool:
    """Is it a class of nodes? Old names for kinds of constants are not, as no tree has any."""
    return isinstance(value, type) and issubclass(value, ast.AST) and (value is ast.Constant or not issubclass(value, ast.Constant))


#: the fields of each kind of node that may hold nodes with facts, last one first
CHILD_FIELDS = {kind: _child_fields(kind)[::-1] for kind in list(vars(ast).values()) if _is_kind(kind)}


def _push_children(node, kind, todo) -> None:
    """Puts what the fields of a node hold on ``todo``, the first one on top; not all of it are nodes."""
    for name in CHILD_FIELDS[kind]:
        held = getattr(node, name, None)
        if held.__class__ is list:
            todo.extend(held[::-1])
        elif held is not None:
            todo.append(held)


def _tests_none(test) -> bool:
    todo = [test]
    while todo:
        node = todo.pop()
        kind = node.__class__
        if kind is ast.Constant:
            if node.value is None:
                return True
        elif kind in CHILD_FIELDS:
            _push_children(node, kind, todo)
    return False


class _Scope:
    """A function while its nodes are walked: nesting and numbers of its own, without those of functions inside it."""

    __slots__ = ("fact", "outer", "level", "deepest", "numbers")

    def __init__(self, fact, outer, level):
        self.fact, self.outer, self.level, self.deepest, self.numbers = fact, outer, level, level, 0


def _function_fact(node) -> dict:
    args = node.args
    return {
        "name": node.name, "start_line": node.lineno, "end_line": node.end_lineno,
        "param_count": len(args.args) + len(args.kwonlyargs) + len(args.posonlyargs),
        "max_nesting": 0, "magic_numbers": 0, "risky_calls": 0, "has_try": False,
    }


def _own_imports(node) -> list[str]:
    if isinstance(node, ast.Import):
        return [(alias.asname or alias.name.split(".")[0]) for alias in node.names]
    return [(alias.asname or alias.name) for alias in node.names if (alias.asname or alias.name) != "*"]


def python_facts(source: str) -> dict | None:
    """Facts of one Python file, or None if it does not parse.

    Functions are keyed by name: a later one of the same name takes over values and keeps the place.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
        functions, imports, names, calls, scopes = {}, {}, {}, [], []
        null_checks, complexity = 0, 1
        # nodes in source order; ``end`` stands behind the last node inside of one, and nesting counts from the file on
        end = object()
        todo, scope, level, ends = [tree], None, 0, []
        while todo:
            node = todo.pop()
            if node is end:
                scope, level = ends.pop()
                continue
            kind = node.__class__
            if kind is ast.Constant:
                value = node.value
                if scope is not None and isinstance(value, (int, float)) and value not in PLAIN_NUMBERS:
                    scope.numbers += 1
                continue
            if kind not in CHILD_FIELDS:
                continue
            if kind is ast.Name:
                names[node.id] = True
                continue
            if kind in BRANCH_NODES:
                complexity += 1
            if kind in FUNCTION_NODES:
                ends.append((scope, level))
                todo.append(end)
                functions[node.name] = fact = _function_fact(node)
                scope = _Scope(fact, scope, level)
                scopes.append(scope)
            elif kind in NESTING_NODES:
                ends.append((scope, level))
                todo.append(end)
                level += 1
                if scope is not None and level > scope.deepest:
                    scope.deepest = level
                if kind is ast.Try:
                    if scope is not None:
                        functions[scope.fact["name"]]["has_try"] = True
                elif kind is ast.If:
                    null_checks += _tests_none(node.test)
            elif kind is ast.Import or kind is ast.ImportFrom:
                imports.update((name, node.lineno) for name in _own_imports(node))
            elif kind is ast.Call and (dotted := _dotted(node.func)):
                owner = None if scope is None else scope.fact["name"]
                calls.append({"func": owner, "dotted": dotted, "plain": dotted.rpartition(".")[2]})
                if owner is not None:
                    functions[owner]["risky_calls"] += any(sign in dotted for sign in RISKY_SIGNS)
            _push_children(node, kind, todo)
        for inner in reversed(scopes):
            inner.fact["max_nesting"], inner.fact["magic_numbers"] = inner.deepest - inner.level, inner.numbers
            if inner.outer is not None:
                inner.outer.deepest = max(inner.outer.deepest, inner.deepest)
                inner.outer.numbers += inner.numbers
    except Exception:  # noqa: BLE001 - whatever the parser raises, the file counts as unparsable
        return None
    lines = source.splitlines()
    return {
        "functions": [{**fact, "snippet": _line(lines, fact["start_line"])} for fact in functions.values()],
        "imports": [
            {"name": name, "line": line, "seq": seq, "snippet": _line(lines, line)}
            for seq, (name, line) in enumerate(imports.items())
        ],
        "names": list(names), "calls": calls, "null_checks": null_checks, "complexity": complexity,
        "has_logging": any(sign in call["dotted"] for call in calls for sign in LOGGING_SIGNS),
    }


def _brace_end(lines, start) -> int:
    balances = accumulate(line.count("{") - line.count("}") for line in lines[start:])
    return next((start + n for n, open_braces in enumerate(balances, 1) if open_braces <= 0), len(lines))


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _indent_end(lines, start) -> int:
    level = _indent(lines[start])
    later = range(start + 1, len(lines))
    return next((n for n in later if lines[n].strip() and _indent(lines[n]) <= level), len(lines))


def _spans(lines, shapes, words):
    """(start, stop, match) of blocks that do not overlap; the search goes on after each block. A block begins with one of ``words``."""
    at = 0
    while at < len(lines):
        if not lines[at].lstrip().startswith(words):
            at += 1
            continue
        found = ((pattern.match(lines[at]), end_of) for pattern, end_of in shapes)
        match, end_of = next((pair for pair in found if pair[0]), (None, None))
        if match is None:
            at += 1
        else:
            stop = end_of(lines, at)
            yield at, stop, match
            at = stop


def _script_imports(source: str, lines, words) -> list[dict]:
    where = {}
    for match in SCRIPT_IMPORT.finditer(source):
        line = source.count("\n", 0, match.start()) + 1
        where.update((token, line) for token in IMPORT_GLUE.split(match.group(1)) if token not in IMPORT_FILLERS)
    return [
        {
            "name": name, "line": line, "seq": seq, "snippet": _line(lines, line),
            "used": name in words and IDENTIFIER.fullmatch(name) is not None,
        }
        for seq, (name, line) in enumerate(where.items())
    ]


def script_facts(source: str) -> dict:
    """Functions that start a line and imports of a JavaScript or TypeScript file."""
    lines, words = source.splitlines(), Counter(WORD_RUN.findall(source))
    functions = []
    for start, stop, match in _spans(lines, [(SCRIPT_FUNCTION, _brace_end)], SCRIPT_WORDS):
        name, params = match.group(1) or match.group(3), match.group(2) or match.group(4) or ""
        functions.append({
            "name": name, "start_line": start + 1, "end_line": stop, "uses": words[name],
            "param_count": sum(1 for item in params.split(",") if item.strip()),
            "block": "\n".join(lines[start:stop]), "snippet": _line(lines, start + 1),
        })
    return {"functions": functions, "imports": _script_imports(source, lines, words)}


def _clean(line: str) -> str:
    return " ".join(line.partition("#")[0].partition("//")[0].split())


def function_bodies(source: str) -> list[dict]:
    """Cleaned bodies of functions in any language, at least six lines long."""
    lines, out = source.splitlines(), []
    for start, stop, match in _spans(lines, [(DEF_HEADER, _indent_end), (SCRIPT_HEADER, _brace_end)], HEADER_WORDS):
        body = [cleaned for cleaned in map(_clean, lines[start:stop]) if cleaned]
        if len(body) >= BLOCK_MIN_LINES:
            name = next(group for group in match.groups() if group)
            out.append({"name": name, "line": start + 1, "body": "\n".join(body)})
    return out


def numbered_bodies(source: str) -> list[dict]:
    """`function_bodies` with ``turn``: first or second of its name in the file.

    A third function of the same name in a file is never compared with anything and is left out.
    """
    turns, out = Counter(), []
    for block in function_bodies(source):
        turns[block["name"]] += 1
        if turns[block["name"]] <= 2:
            out.append({**block, "turn": turns[block["name"]], "chars": len(block["body"])})
    return out


def _folded(source: str) -> str:
    """`text.folded` of a text."""
    return source.lower().replace("\u017f", "s").replace("\u0131", "i")


def _any_of(lowered: str, by_root) -> bool:
    return any(root in lowered and any(sign in lowered for sign in signs) for root, signs in by_root)


def text_signs(source: str) -> dict:
    """`metrics.text_signs` of a text."""
    lowered = source.lower()
    return {
        "has_auth": _any_of(lowered, AUTH),
        "open_cors": "cors" in lowered and _any_of(lowered, CORS),
        "debug_on": "debug" in lowered and DEBUG.search(lowered) is not None,
        "unchecked_input": _any_of(lowered, INPUT) and not _any_of(lowered, VALIDATION),
        "test_framework": _any_of(lowered, TEST),
        "logging_text": _any_of(lowered, LOGGING),
    }


def _lines_with(folded: str, sign: str, starts) -> list[int]:
    """Numbers from 0 of the lines that hold a sign; the search goes on behind each of them."""
    found, at = [], folded.find(sign)
    while at >= 0:
        n = bisect_right(starts, at) - 1
        found.append(n)
        at = folded.find(sign, starts[n + 1])
    return found


def _hold(text: str, groups) -> bool:
    """Does a text hold one sign of each group?"""
    return all(any(sign in text for sign in group) for group in groups)


def line_hits(source: str, lines) -> list[dict]:
    """Hits of the line rules, as `line_rules.line_hits` has them.

    The lines that hold a sign of a rule's first group are searched as one text for the others, and one by one only if that holds them.
    """
    folded = _folded(source)
    split = folded.splitlines(keepends=True)
    starts, near, hits = [0, *accumulate(map(len, split))], {}, []
    for seq, (first, *others), pattern in LINE_RULES:
        if first not in near:
            numbers = {n for sign in first for n in _lines_with(folded, sign, starts)}
            near[first] = numbers, "".join([split[n] for n in numbers])
        numbers, joined = near[first]
        if numbers and _hold(joined, others):
            hits += [(n + 1, seq) for n in numbers if _hold(split[n], others) and pattern.search(lines[n])]
    return [{"rule_seq": seq, "line": line, "code_snippet": _line(lines, line)} for line, seq in sorted(hits)]


def text_complexity(source: str, script: bool) -> int:
    """`metrics.text_complexity` of a text: words of branches, and in scripts signs between two words."""
    branches = [*SCRIPT_BRANCHES, BRANCH_SIGN] if script else OTHER_BRANCHES
    return 1 + sum(len(branch.findall(source)) for branch in branches)


def text_facts(lang: str, source: str, parsed: bool) -> dict:
    """What is told from the lines and words of a text; a file that was parsed has a better complexity than its words tell."""
    lines, script = source.splitlines(), lang in ("javascript", "typescript")
    marks = PYTHON_COMMENT_MARKS if lang == "python" else COMMENT_MARKS
    return {
        "lines": source.count("\n") + 1, "comment_lines": sum(line.lstrip().startswith(marks) for line in lines),
        "first_line": _line(lines, 1),
        "text_complexity": None if parsed else text_complexity(source, script),
        "js_logging": script and any(sign in source for sign in JS_LOGGING_SIGNS) and JS_LOGGING.search(source) is not None,
        "js_null_checks": len(JS_NULL_CHECK.findall(source)) if script else 0,
        **text_signs(source), "line_hits": line_hits(source, lines),
    }


def _parts(makers: dict) -> dict:
    """column -> (Arrow type, function of language and content)"""
    return {name: (to_arrow_type(_parse_datatype_string(ddl)), make) for name, (ddl, make) in makers.items()}


PYTHON_PART = {"py": (PYTHON_TYPE, lambda lang, source: python_facts(source) if lang == "python" else None)}
SCRIPT_PART = {
    "js": (SCRIPT_TYPE, lambda lang, source: script_facts(source) if lang in ("javascript", "typescript") else None)
}
BODY_PART = {"blocks": (BODY_TYPE, lambda lang, source: numbered_bodies(source))}


def _extract(files: DataFrame, makers: dict, of_text: dict | None = None) -> DataFrame:
    """Adds fact columns to files and drops the content; ``of_text`` names a column for `text_facts`, if they are asked for.

    Other columns pass through as Arrow columns, so facts worked out in the JVM need no join back.
    """
    kept = [f for f in files.schema.fields if f.name != "content"]
    names = [f.name for f in kept]
    passed = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    parts = _parts(makers)
    text_parts = {name: to_arrow_type(_parse_datatype_string(ddl)) for name, ddl in (of_text or {}).items()}

    def run(batches):
        # syntax trees hold no cycles, and looking for some while one grows costs as much as making it: done once per batch
        gc.disable()
        try:
            for batch in batches:
                pairs = list(zip(batch.column("language").to_pylist(), batch.column("content").to_pylist()))
                found = {name: [make(*pair) for pair in pairs] for name, (_, make) in parts.items()}
                made = [pa.array(found[name], type=kind) for name, (kind, _) in parts.items()]
                for kind in text_parts.values():
                    made.append(pa.array([text_facts(*pair, py is not None) for pair, py in zip(pairs, found["py"])], type=kind))
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, names=names + list(parts) + list(text_parts))
                gc.collect()
        finally:
            gc.enable()

    ddl = [f"{name} {ddl}" for name, ddl in [*((name, ddl) for name, (ddl, _) in makers.items()), *(of_text or {}).items()]]
    return files.mapInArrow(run, ", ".join(passed + ddl))


def structure(files: DataFrame) -> DataFrame:
    """All facts of files that have a ``language``: one pass of Python workers over the texts."""
    read = _extract(files, {**PYTHON_PART, **SCRIPT_PART, **BODY_PART}, {"of_text": TEXT_TYPE})
    return read.select(*[c for c in read.columns if c != "of_text"], "of_text.*")


def parsed(files: DataFrame) -> DataFrame:
    """``py`` and ``js`` facts of bare ``files(scan_id, file_path, content)``."""
    named = files.withColumn("language", text.language(F.col("file_path")))
    code = named.where(F.col("language").isin("python", "javascript", "typescript"))
    return _extract(code.select("scan_id", "file_path", "language", "content"), {**PYTHON_PART, **SCRIPT_PART})


def blocks_of(facts: DataFrame) -> DataFrame:
    """``(scan_id, file_path, name, line, body, turn, chars)``: one row per function body."""
    return facts.select("scan_id", "file_path", F.explode("blocks").alias("b")).select("scan_id", "file_path", "b.*")


def function_blocks(files: DataFrame) -> DataFrame:
    """Function bodies of bare files in any language."""
    named = files.withColumn("language", text.language(F.col("file_path")))
    return blocks_of(_extract(named.select("scan_id", "file_path", "language", "content"), BODY_PART))
