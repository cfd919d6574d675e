"""Logical inputs made from the given tables; one SQL text serves Spark and the SQL check.

``$name`` stands for a table. In code templates a pilcrow is a line break, a backquote a single
quote and ``@@`` the document number. Every document becomes one source file: its whole text is
kept as comment (or data) and a template chosen by the document number follows.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from auditspark.session import widen

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _branches(count: int, word: str = "if") -> str:
    return "".join(f"    {word} value > {n}:¶        value = value - other¶" for n in range(2, count + 2))


AUTH = (
    'api_key = "abcdef1"¶short_token = "abc"¶def login(user, password, given):¶    if password == given:¶'
    "        return eval(user)¶    if user == `root`:¶        return hashlib.md5(user)¶"
    '    link = "http://a.b/x"¶    safe = "https://a.b/x"¶    return jwt.decode(link)¶'
)
DB = (
    'def load(cursor, key):¶    return cursor.execute("select * from t where a=" + key + " from dual")¶'
    "def start(command):¶    os.system(command)¶    subprocess.run(command)¶"
    'def save(path):¶    with open(path, "w") as out:¶        out.write(path)¶'
    'def save_again(path):¶    try:¶        open(path, "w")¶    except OSError:¶        raise¶'
)
VIEWS = (
    "import cors¶debug = True¶app.add(allow_origins=[`*`])¶def show(request):¶    item = request.args¶"
    "    try:¶        item.go()¶    except:¶        item = None¶    try: item.go()¶    except ValueError: pass¶"
    "    try:¶        item.go()¶    except Exception:¶        pass¶    # TODO tidy¶    return item¶"
)
BIG = (
    "def just_long(value):¶" + "    value = value + other¶" * 50 + "def just_short(value):¶"
    + "    value = value + other¶" * 49
    + "def six_parameters(a, b, c, *, d, e, f):¶    return a¶def five_parameters(self, b, c, d, e):¶    return b¶"
    + "def deep_five(value):¶    if value:¶        for x in value:¶            while x:¶                try:¶"
    + "                    with x:¶                        logger.info(x)¶                except OSError:¶"
    + "                    print(x)¶"
    + "def deep_four(value):¶    if value is None:¶        for x in value:¶            while x:¶"
    + "                with x:¶                    print(x)¶"
    + "def four_magic(value):¶    return value + 2 + 3.5 + 7 - 9 + 1 + 0¶"
    + "def three_magic(value):¶    return value + 2 + 3.5 + -7 + True¶"
    + "def Ab(value):¶    return value¶class One:¶    def same(self):¶        return open(self)¶"
    + "class Two:¶    def same(self, other):¶        return other¶"
)
IMPORTS = (
    "from __future__ import annotations¶import os.path as pathlike¶import os.path¶import used¶from pkg import *¶"
    + "".join(f"import mod{n:02d}¶" for n in range(32)) + "used.call(annotations)¶"
)
DEAD = (
    "".join(f"def lone_{n:02d}(value):¶    return value¶" for n in range(22, 0, -1))
    + "def _private(value):¶    return value¶def wanted(value):¶    return value¶wanted(_private)¶"
)
BROKEN = "def half(:¶    if x for y while z¶    switch catch if¶"
ONE = (
    "def total_price(items, rate):¶    result = 0¶    for item in items:¶        price = item.price * item.count¶"
    "        discount = price * item.discount¶        taxed = (price - discount) * rate¶"
    "        result = result + taxed¶    return result¶"
    "def unlike(text):¶    words = text.split()¶    first = words[0]¶    last = words[-1]¶    joined = first + last¶"
    "    return joined.upper()¶"
)
TWO = (
    "def total_cost(items, rate):¶    result = 0¶    for item in items:¶        price = item.price * item.count¶"
    "        discount = price * item.discount¶        taxed = (price - discount) * rate¶"
    "        result = result + taxed¶    return result¶"
    "def other(rows):¶    table = {}¶    for row in rows:¶        table[row.key] = row¶    size = len(table)¶"
    "    return size, table¶"
)
SHARED_JS = (
    "  const left = list.filter((entry) => entry.weight > limit);¶  const right = list.filter((entry) => entry.open);¶"
    "  left.sort((a, b) => a.rank - b.rank);¶  right.sort((a, b) => a.rank - b.rank);¶"
    "  const merged = left.concat(right);¶  merged.forEach((entry) => entry.touch(clock));¶"
    "  return merged.map((entry) => entry.name);¶"
)
UI = (
    "import React, { useState as state, x } from `react`;¶import $ from `jq`;¶"
    "function pick(list, limit, clock, d, e, f) {¶" + SHARED_JS + "}¶"
    "const go = (a, b) => {¶  const answer = a ? b : c;¶  const other = a?b:c;¶  fetch(answer);¶}¶"
    "function nextLine(a)¶{¶  return a;¶}¶"
    "function outer(a) {¶  if (a) {¶    while (a) {¶      for (;;) {¶        if (a) {¶          switch (a) {¶"
    "          }¶        }¶      }¶    }¶  }¶  function inner(b) {¶    return b;¶  }¶  return inner(7 + 42 + 3.5 + 100 - 1);¶}¶"
    "export function hidden(a) {¶  try {¶    JSON.parse(a);¶  } catch (e) {¶    console.error(e?.text);¶  }¶}¶"
    "const guarded = (a) => {¶  try {¶    return JSON.parse(a);¶  } catch (e) {¶    return a !== null && a != null;¶  }¶}¶"
)
UTIL = (
    "import * as X from `x`;¶import def, { one as two } from `./lib`;¶export const limitless = 1;¶"
    "const pickAll = (list, limit, clock) => {¶" + SHARED_JS + "}¶pickAll(two, typeof def !== `undefined`);¶"
)
LONG_JS = (
    "function sprawl(a) {¶" + "".join(f"  if (a > {n}) {{ a = a - {n}; }}¶" for n in range(14))
    + "  a = a + 1;¶" * 36 + "}¶"
    + "var brief = (a) => {¶" + "".join(f"  if (a > {n}) {{ a = a - 1; }}¶" for n in range(13)) + "}¶sprawl(brief);¶"
)
UNICODE = (
    "étoken = `abcdef1`¶token = `abcdef1`¶secret: `abcédef` password = `short`¶"
    "passwd = `longer-one`\u000c¶  # TODO é¶¶"
)
REQUIREMENTS = (
    "flask==1.1¶Django >= 3.2¶requests==2.31.0¶pyyaml~=5¶numpy¶¶-r base.txt¶flask[async]==1.0¶requests 2.3¶==1.0¶lodash<4¶"
)

# (path, comment mark or kind of text, code)
TEMPLATES = [
    ("app/auth_@@.py", "# ", AUTH),
    ("app/db_@@.py", "# ", DB),
    ("app/views_@@.py", "# ", VIEWS),
    ("app/big_@@.py", "# ", BIG),
    ("app/imports_@@.py", "# ", IMPORTS),
    ("app/dead_@@.py", "# ", DEAD),
    ("app/broken_@@.py", "# ", BROKEN),
    ("app/complex17_@@.py", "# ", "def steps(value, other):¶" + _branches(16)),
    ("app/complex26_@@.py", "", "def steps(value, other):¶" + _branches(25)),
    ("web/ui_@@.js", "// ", UI),
    ("web/util_@@.ts", "// ", UTIL),
    ("lib/a/one_@@.py", "# ", ONE),
    ("lib/b/two_@@.py", "# ", TWO),
    ("requirements.txt", "# ", REQUIREMENTS),
    ("package.json", "json", '"dependencies":{"lodash":"^4.17.20","Axios":"1.6.0","left":"*","flask":"latest"},'
        '"devDependencies":{"minimist":" *","b":">=1","django":"~3.2"},"optionalDependencies":["x"]}'),
    ("web/package.json", "json", '"dependencies":{"lodash":"1"},'),
    ("tests/test_@@.py", "# ", "import pytest¶def test_one():¶    assert schema.validate(input(`x`))¶"),
    ("src/b@@_test.py", "# ", "import unittest¶password = input(`Name: `)¶"),
    ("web/x@@.spec.js", "// ", "describe(`x`, () => {¶  logger.info(1);¶});¶"),
    ("README.md", "", "¶# Title¶¶ ## Part¶#none¶"),
    ("LICENSE", "", ""),
    ("app/unicode_@@.py", "# ", UNICODE),
    ("web/long_@@.jsx", "// ", LONG_JS),
]


def _quoted(text: str) -> str:
    assert "'" not in text and "\\" not in text, text
    return f"'{text}'"


def _file_sql(kind: int, path: str, mark: str, code: str) -> tuple[str, str]:
    expand = f"replace(replace({_quoted(code)}, '¶', chr(10)), '`', chr(39))"
    if mark == "json":
        body = (
            "'{\"name\":\"p\",\"about\":\"' || replace(replace(text, '\"', ' '), chr(10), ' ') || '\",' || " + expand
        )
    elif mark:
        body = f"'{mark}' || replace(text, chr(10), chr(10) || '{mark}') || chr(10) || {expand}"
    else:
        lead = "'# ' || replace(text, chr(10), ' ') || chr(10) || " if path.endswith(".py") else "text || "
        body = lead + expand
    full = f"WHEN {kind} THEN replace({_quoted(path)}, '@@', CAST(doc_id AS STRING))"
    return full, f"WHEN {kind} THEN {body}"


def _code_files() -> str:
    cases = [_file_sql(kind, *template) for kind, template in enumerate(TEMPLATES)]
    n = len(TEMPLATES)
    paths, bodies = " ".join(c[0] for c in cases), " ".join(c[1] for c in cases)
    return (
        "SELECT source || '-' || CAST(CAST(FLOOR(doc_id / 400) AS INT) AS STRING) AS scan_id, "
        f"CASE doc_id % {n} {paths} END AS file_path, CASE doc_id % {n} {bodies} END AS content FROM $documents"
    )


ISSUE_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
NUMBERED = f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey {ISSUE_ORDER}) AS issue_seq FROM $lineitem)"
FILE_OF_LINE = "'src/m' || CAST(l_linenumber % 3 AS STRING) || '.py'"

ADAPTERS = {
    "doc_files": """
SELECT source AS scan_id,
       lang || '/doc_' || CAST(doc_id AS STRING) || CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.js'
         WHEN 2 THEN '.ts' WHEN 3 THEN '.java' WHEN 4 THEN '.json' ELSE '.txt' END AS file_path,
       text AS content
FROM $documents""",
    "code_files": _code_files(),
    "issue_facts": f"""
SELECT CAST(l_orderkey AS STRING) AS scan_id, CAST(issue_seq AS INT) AS issue_seq, {FILE_OF_LINE} AS file_path,
       CAST(l_linenumber AS INT) AS line, CAST((l_partkey + l_linenumber) % 41 AS INT) AS rule_seq
FROM {NUMBERED} n""",
    "file_facts": f"""
SELECT CAST(l_orderkey AS STRING) AS scan_id, {FILE_OF_LINE} AS file_path,
       CAST(SUM(CAST(l_quantity AS INT)) * 5 + 1 AS INT) AS lines,
       CAST(MAX(l_partkey) % 40 AS INT) + 1 AS complexity,
       CAST(MIN(l_suppkey) % 7 AS INT) AS comment_lines,
       CAST(MAX(l_suppkey) % 2 AS INT) AS has_logging,
       CAST(MAX(l_partkey) % 3 AS INT) AS null_checks
FROM $lineitem
GROUP BY l_orderkey, l_linenumber % 3""",
    "functions": f"""
SELECT CAST(l_orderkey AS STRING) AS scan_id, {FILE_OF_LINE} AS file_path,
       CASE l_suppkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'ab' WHEN 2 THEN '_' ELSE 'fn_' END
         || CAST(l_partkey % 50 AS STRING) AS name,
       CAST(issue_seq * 60 AS INT) AS start_line, CAST(issue_seq * 60 + l_quantity * 2 AS INT) AS end_line,
       CAST(l_suppkey % 9 AS INT) AS param_count, CAST(l_partkey % 7 AS INT) AS max_nesting,
       CAST(l_partkey % 6 AS INT) AS magic_numbers, CAST(l_suppkey % 3 AS INT) AS risky_calls,
       l_partkey % 2 = 0 AS has_try, CAST(l_quantity AS INT) AS complexity
FROM {NUMBERED} n""",
    "imports": f"""
SELECT CAST(l_orderkey AS STRING) AS scan_id, {FILE_OF_LINE} AS file_path,
       'n' || CAST(l_partkey % 40 AS STRING) AS name, CAST(l_linenumber AS INT) AS line,
       CAST(issue_seq AS INT) AS seq
FROM {NUMBERED} n""",
    "names": f"""
SELECT DISTINCT CAST(l_orderkey AS STRING) AS scan_id, {FILE_OF_LINE} AS file_path,
       'n' || CAST(l_suppkey % 40 AS STRING) AS name
FROM $lineitem""",
    "calls": f"""
SELECT CAST(l_orderkey AS STRING) AS scan_id, {FILE_OF_LINE} AS file_path,
       'fn_' || CAST(l_partkey % 50 AS STRING) AS func,
       CASE l_suppkey % 6 WHEN 0 THEN 'thread.start' WHEN 1 THEN 'logging.info' WHEN 2 THEN 'fn_7'
         WHEN 3 THEN 'requests.get' WHEN 4 THEN 'self.fn_8' ELSE 'x.urlopen' END AS dotted,
       CASE l_suppkey % 6 WHEN 0 THEN 'start' WHEN 1 THEN 'info' WHEN 2 THEN 'fn_7'
         WHEN 3 THEN 'get' WHEN 4 THEN 'fn_8' ELSE 'urlopen' END AS plain
FROM $lineitem""",
    "manifest_lines": """
SELECT CAST(p_partkey % 20 AS STRING) AS scan_id, CAST(p_partkey AS INT) AS line,
       CASE p_partkey % 9
         WHEN 0 THEN 'flask==' || CAST(p_size % 4 AS STRING) || '.' || CAST(p_partkey % 10 AS STRING)
         WHEN 1 THEN 'Django >= 3.' || CAST(p_size % 5 AS STRING)
         WHEN 2 THEN 'requests==2.' || CAST(p_partkey % 40 AS STRING) || '.0'
         WHEN 3 THEN 'pyyaml~=' || CAST(p_size % 8 AS STRING)
         WHEN 4 THEN 'numpy'
         WHEN 5 THEN '# comment'
         WHEN 6 THEN '-r base.txt'
         WHEN 7 THEN 'flask[async]==1.0'
         ELSE 'requests 2.' || CAST(p_size AS STRING) END AS text
FROM $part""",
    "js_manifests": """
SELECT CAST(p_partkey % 20 AS STRING) AS scan_id, 'm' || CAST(p_partkey AS STRING) || '/package.json' AS file_path,
       CASE p_partkey % 5
         WHEN 0 THEN '{"dependencies":{"lodash":"^4.17.' || CAST(p_size AS STRING) || '","x":"*"}}'
         WHEN 1 THEN '{"devDependencies":{"Minimist":"~1.2.' || CAST(p_size % 12 AS STRING) || '","axios":"latest"},"dependencies":[1]}'
         WHEN 2 THEN '{"optionalDependencies":{"flask":">=' || CAST(p_size % 4 AS STRING) || '","django":"*"}}'
         WHEN 3 THEN '{broken'
         ELSE '["a"]' END AS content
FROM $part""",
    "scan_history": """
SELECT CAST(o_orderkey AS STRING) AS scan_id, CAST(o_custkey AS STRING) AS owner_uid,
       CASE o_orderkey % 2 WHEN 0 THEN 'upload' ELSE 'github' END AS source_type,
       o_orderdate AS created_at, o_orderdate AS updated_at,
       CAST((o_orderkey * 37) % 101 AS INT) AS security_score,
       CAST((o_orderkey * 53) % 101 AS INT) AS trust_score,
       CAST((o_orderkey * 71) % 101 AS INT) AS reliability_score,
       CAST((o_orderkey * 89) % 101 AS INT) AS quality_score,
       CAST((o_orderkey * 97) % 101 AS INT) AS improvement_potential
FROM $orders""",
    "scan_requests": "SELECT event_id, CAST(user_id AS STRING) AS user_key, ts FROM $events",
    "scan_status_events": """
SELECT user_id * 10 + event_id % 10 AS scan_id, event_id AS seq, ts,
       CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'running' WHEN 'click' THEN 'progress'
         WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS op,
       CAST(FLOOR(value) AS INT) * 3 - 20 AS progress, props AS error
FROM $events""",
    "repo_urls": """
SELECT page_id,
       CASE page_id % 6
         WHEN 0 THEN url
         WHEN 1 THEN 'https://github.com/org' || CAST(page_id % 7 AS STRING) || '/repo-' || CAST(page_id AS STRING)
         WHEN 2 THEN 'git@github.com:team/app_' || CAST(page_id AS STRING) || '.git'
         WHEN 3 THEN 'https://github.com/only-owner'
         WHEN 4 THEN 'https://github.com/a/b.git/'
         ELSE 'http://github.com/a/b' END AS url
FROM $pages""",
    "clone_messages": """
SELECT page_id,
       CASE page_id % 6
         WHEN 0 THEN 'fatal: Authentication failed, repository not found '
         WHEN 1 THEN 'Access Denied for '
         WHEN 2 THEN 'Could not resolve host of '
         WHEN 3 THEN 'Failed to connect to '
         WHEN 4 THEN 'ERROR: Repository not found: '
         ELSE 'exit code 128 at ' END || url AS message
FROM $pages""",
    "llm_answers": f"""
SELECT CAST(l_orderkey AS STRING) AS scan_id, CAST(issue_seq AS INT) AS issue_seq,
       CASE l_partkey % 6
         WHEN 0 THEN '{{"severity":"high","risk_explanation":" r' || CAST(l_partkey AS STRING) || ' ","refactored_code":"x = 1"}}'
         WHEN 1 THEN '{{"severity":"","secure_fix_explanation":"fix"}}'
         WHEN 2 THEN '{{broken'
         WHEN 3 THEN '{{"severity":null,"risk_explanation":true,"confidence_score":90,"refactored_code":"null"}}'
         WHEN 4 THEN '{{"risk_explanation":"true","secure_fix_explanation":null,"performance_impact":false}}'
         ELSE '["a"]' END AS raw
FROM {NUMBERED} n""",
    "llm_responses": f"""
SELECT scan_id, issue_seq, raw FROM (
SELECT CAST(l_orderkey AS STRING) AS scan_id, CAST(issue_seq AS INT) AS issue_seq, l_partkey,
       CASE l_partkey % 4
         WHEN 0 THEN '{{"severity":"high","risk_explanation":" r' || CAST(l_partkey AS STRING) || ' ","refactored_code":"x = 1"}}'
         WHEN 1 THEN '{{"severity":"","secure_fix_explanation":"fix"}}'
         WHEN 2 THEN '{{broken'
         ELSE '["a"]' END AS raw
FROM {NUMBERED} n) a
WHERE l_partkey % 5 <> 0""",
}


def oracle_text(name: str) -> str:
    return re.sub(r"\$(\w+)", r"\1", ADAPTERS[name]).replace("AS STRING", "AS VARCHAR")


@lru_cache(maxsize=None)
def _view_prefix(sf_dir: str) -> str:
    return "t_" + re.sub(r"\W", "_", sf_dir.strip("/")) + "_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The logical input ``name`` as a DataFrame."""
    text, prefix = ADAPTERS[name], _view_prefix(sf_dir)
    for used in set(re.findall(r"\$(\w+)", text)):
        rows = table(spark, sf_dir, used)
        rows = widen(rows, "doc_id") if used == "documents" else rows
        rows.createOrReplaceTempView(prefix + used)
        text = re.sub(rf"\${used}\b", prefix + used, text)
    return spark.sql(text)
