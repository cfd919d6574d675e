import ast
import re
from collections import Counter

from auditspark.functions import text
from auditspark.functions.text import is_comment
from auditspark.operators import extract, line_rules, metrics, structure_rules as rules
from auditspark.plans import scan as plan
from pyspark.sql import functions as F

SOURCE = '''import os.path as p, sys
from a import b, c as d
from z import *
import sys

async def outer(a, /, b, *args, c=2, **more):
    """text"""
    with a:
        for x in b:
            if x is None:
                while x:
                    try:
                        open(x).read()
                    except OSError:
                        pass
    def inner(q):
        thread.start(q)
        return 5 if q and c or 7 else -3.5
    logger.info(True, 1, 0)

class A:
    def same(self):
        return run().open()

class B:
    def same(self, other):
        try:
            return other
        finally:
            sys.exit(0)
'''


def fact(facts, name):
    return next(f for f in facts["functions"] if f["name"] == name)


def test_python_facts():
    facts = extract.python_facts(SOURCE)
    assert [f["name"] for f in facts["functions"]] == ["outer", "inner", "same"]
    outer, inner, same = (fact(facts, n) for n in ("outer", "inner", "same"))
    assert (outer["start_line"], outer["end_line"], outer["param_count"], outer["max_nesting"]) == (6, 19, 3, 5)
    assert outer["magic_numbers"] == 4 and outer["risky_calls"] == 2 and outer["has_try"]
    assert (inner["param_count"], inner["max_nesting"], inner["magic_numbers"], inner["has_try"]) == (1, 0, 3, False)
    assert inner["risky_calls"] == 1  # "thread" holds "read"
    assert (same["start_line"], same["risky_calls"], same["has_try"], same["param_count"]) == (26, 0, True, 2)
    assert [(i["name"], i["line"]) for i in facts["imports"]] == [("p", 1), ("sys", 4), ("b", 2), ("d", 2)]
    assert facts["null_checks"] == 1 and facts["has_logging"]
    assert facts["complexity"] == 1 + 6 + 3 + 1  # with for if while try except, ifexp and or, try
    assert {"run", "open", "read", "start", "info", "exit"} == {c["plain"] for c in facts["calls"]}


def test_substring_call_signs():
    facts = extract.python_facts("def f():\n    thread.start()\n    spread()\n    blueprint()\n")
    assert facts["functions"][0]["risky_calls"] == 2 and facts["has_logging"]


def test_unparsable_files():
    assert extract.python_facts("def (") is None
    assert extract.python_facts("x = " + "(" * 5000) is None
    assert extract.python_facts("a\0b") is None
    assert extract.python_facts("")["functions"] == []


JS = """function one(a, b,) {
  if (a) {
  }
}
  const two = (x) => { return x; }
function three(a)
{
  function hidden() {
  }
}
export function four() {
}
var five = async (x) => {
}
let six = () => {
  const inner = (y) => {
  }
"""


def test_script_functions():
    found = extract.script_facts(JS)["functions"]
    got = [(f["name"], f["start_line"], f["end_line"], f["param_count"]) for f in found]
    assert got == [("one", 1, 4, 2), ("two", 5, 5, 1), ("three", 6, 6, 1), ("hidden", 8, 9, 0), ("six", 15, 17, 0)]


def test_script_imports():
    source = "\n\nimport a, { b as c, default as d } from 'x';\nimport * as X from \"y\";\nimport z from z;\nc(aa);\n"
    found = extract.script_facts(source)["imports"]
    assert [(i["name"], i["line"], i["used"]) for i in found] == [
        ("a", 1, False), ("b", 1, False), ("c", 1, False), ("d", 1, False), ("*", 4, False), ("X", 4, False)
    ]


def test_function_bodies():
    body = "".join(f"    x{n} = {n}  # note\n" for n in range(5))
    source = f"def long(a):\n{body}\n    \nlast = 1\ndef short(a):\n    return a\nconst data = {{\n" + "  a: 1,\n" * 4 + "}\nasync def gone(a):\n" + body
    got = extract.function_bodies(source)
    assert [(b["name"], b["line"], b["body"].count("\n") + 1) for b in got] == [("long", 1, 6), ("data", 12, 6)]
    assert "note" not in got[0]["body"]


def test_findings_of_python_and_script_files(spark, files):
    from auditspark.plans.scan import file_facts

    many = "".join(f"import m{n:02d}\n" for n in range(33)) + "m00.go()\n"
    dead = "".join(f"def lone_{n:02d}(aa):\n    return aa\n" for n in range(23)) + "def _p():\n    lone_00(1)\n"
    facts = file_facts(files({"s": {"imports.py": many, "dead.py": dead, "a.js": JS, "broken.py": "def ("}})).cache()
    found = rules.structure_findings(facts)
    count = {r["rule_id"]: r["count"] for r in found.groupBy("rule_id").count().collect()}
    assert count["UNUSED_IMPORT"] == 32 and count["DEAD_CODE_FUNCTION"] == 22
    capped = rules.python_file_findings(facts, rules.USUAL_UNUSED_IMPORTS, rules.USUAL_DEAD_FUNCTIONS)
    count |= {r["rule_id"]: r["count"] for r in capped.groupBy("rule_id").count().collect()}
    assert count["UNUSED_IMPORT"] == 30 and count["DEAD_CODE_FUNCTION"] == 20
    unused = [r.message for r in found.where("rule_id = 'UNUSED_IMPORT'").orderBy("seq2").collect()]
    assert "m01" in unused[0] and "m32" in unused[-1]
    named = [r.message for r in found.where("rule_id = 'DEAD_CODE_FUNCTION'").orderBy("seq2").collect()]
    assert "lone_01" in named[0] and "lone_22" in named[-1]
    assert count["DEAD_CODE_JS"] == 5
    assert "broken.py" not in {r.file_path for r in found.collect()}


def test_borders(spark):
    rows = [("s", "f", n, "good_name", 1, last, params, nest, magic, 1, tried, "def") for n, (last, params, nest, magic, tried) in enumerate(
        [(51, 6, 5, 4, False), (50, 5, 4, 3, True)])]
    table = spark.createDataFrame(rows, "scan_id string, file_path string, func_seq int, name string, start_line int, end_line int, "
                                  "param_count int, max_nesting int, magic_numbers int, risky_calls int, has_try boolean, snippet string")
    found = rules.python_function_findings(table).where(F.col("seq1") == 1)
    assert found.count() == 0
    first = [r.rule_id for r in rules.python_function_findings(table).orderBy("seq1", "seq2").collect()]
    assert first == ["LONG_FUNCTION", "TOO_MANY_PARAMETERS", "DEEP_NESTING", "MAGIC_NUMBERS", "MISSING_EXCEPTION_HANDLING"]


def test_script_measures(spark):
    blocks = ["{{}}}{{{", "x1 + 2 - 3.5 * -7 / 42 + .5 + a.6 + 0 + 1 - -1", "a ? b : c; if (x) {} switch"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, block string")
    rows = {r.i: r for r in rules.js_measures(df).collect()}
    assert rows[0].max_nesting == 3
    assert rows[1].magic_numbers == 4  # 2, 3.5, -7, 42
    assert rows[2].complexity == 4


def test_a_tree_is_walked_once_however_deep_its_functions_lie(monkeypatch):
    depth = 40
    lines = [f"{'  ' * n}def f{n}(a, b=3, *c):" for n in range(depth)]
    lines += ["  " * depth + text for text in ("if a is None and b:", "  for x in c:", "    with open(x) as y:", "      y = 7 + True - 9.5", "try: g(2)", "finally: pass")]
    source = "\n".join(lines) + "\n"
    listed = Counter()
    plain = ast.iter_child_nodes
    monkeypatch.setattr(ast, "iter_child_nodes", lambda node: (listed.update([id(node)]), plain(node))[1])
    facts = extract.python_facts(source)
    assert max(listed.values(), default=0) <= 1
    assert [f["name"] for f in facts["functions"]] == [f"f{n}" for n in range(depth)]
    assert [f["max_nesting"] for f in facts["functions"]] == [3] * depth
    assert [f["magic_numbers"] for f in facts["functions"]] == [3 + depth - n for n in range(depth)]
    assert [f["has_try"] for f in facts["functions"]] == [False] * (depth - 1) + [True]
    assert [f["risky_calls"] for f in facts["functions"]] == [0] * (depth - 1) + [1]
    assert (facts["null_checks"], facts["complexity"]) == (1, 6)


def test_a_later_function_of_a_name_takes_over_and_what_follows_counts_for_it():
    source = "def f():\n  def f(x):\n    if x: return 5\n  try: open(8)\n  finally: pass\ndef g(): return {**f, 'a': None}\nclass C:\n  def g(self, *, k=6): return [4 for _ in k if _]\n"
    facts = {f["name"]: f for f in extract.python_facts(source)["functions"]}
    assert list(facts) == ["f", "g"]
    assert (facts["f"]["start_line"], facts["f"]["max_nesting"], facts["f"]["magic_numbers"], facts["f"]["has_try"], facts["f"]["risky_calls"]) == (2, 1, 1, True, 1)
    assert (facts["g"]["start_line"], facts["g"]["param_count"], facts["g"]["magic_numbers"]) == (8, 2, 2)


def test_branch_words_and_comment_marks_follow_the_plain_patterns(spark):
    texts = ["if iff éif if_ ifé (if)for while\nwhile1 switch-catch caseif if", "cases case&&a a&&b a ?b x? y||z case if", "", "for", "forfor for\u00a0for", "# a", " \t# b", "x # c", "\u2003//d", "/ /", "\x1c* e", " /* f"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = frame.select("t", metrics.keyword_complexity(F.col("t")).alias("k"), metrics.js_complexity(F.col("t")).alias("j"), *[is_comment(F.lit(lang), F.col("t")).alias(lang) for lang in ("python", "java")]).collect()
    for r in found:
        assert r["k"] == len(re.findall(metrics.OTHER_BRANCHES, r["t"])) + 1 and r["j"] == len(re.findall(metrics.JS_BRANCHES, r["t"])) + 1, r
        assert r["python"] == bool(re.match(r"\s*#", r["t"])) and r["java"] == bool(re.match(r"\s*(//|/\*|\*)", r["t"])), r


def test_text_facts_are_those_of_the_column_functions(files):
    """What the workers tell from lines and words is what the column functions tell, on odd texts too."""
    odd = [
        "", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g\u2028h\u2029", "  # x\n\u3000# y\n#\n\u00a0// z\n/* a\n * b\n",
        "to\u017fend\nTODO\nmi todo el dia\nxtodo todo_ \u00e9todo todo\u00e9 FIXME", "api_\u212aey = 'abcdefg'\nAPI-KEY: \"1234567\"\nsecret = 'short'\npa\u017f\u017fword = 'longenough'",
        "\u0130f \u0131f if iff _if if_ \u00e9if if\u00e9 if(for)while:switch;catch case", "a ? b : c\na? b:c\na?b\nx&&y x && y x&&&&y ||z a||b a?  c a??b",
        "select 1 + f'x' from t\nDELETE %s WHERE\nselect from", "except:\nexcept : pass\nexcept Exception as e:\nexcept X: return  None\nexcept:\u00a0\n",
        "HTTP://a\nhttp://\u212a\nhttp:// x\nopen(p, 'w')\nOpen (p,\"W+\")\nFileWriter(x", "if user == 'root'\npassword ==x\nrequest.args input( request.forms",
        "a?.b !== null != null typeof x !== 'undefined' typeof  y!=\"undefined\"\nconsole.warn(1) xconsole.log(2) logger.x",
        "  " + "y" * 300 + " # TODO", "def f(:\n  eval (x) new Function(y) xeval(z) exec(md5(sha1 (hashlib.md5(", "\U0001f600 todo \U0001f600" * 99,
    ]
    names = ["a.py", "a.js", "a.ts", "a.java", "a.txt"]
    frame = files({"s": {f"{n}/{name}": content for n, content in enumerate(odd) for name in names}})
    made = plan.file_facts(frame)
    lang, content, split = F.col("language"), F.col("content"), text.split_lines(F.col("content"))
    script = lang.isin("javascript", "typescript")
    plain = frame.withColumn("language", text.language(F.col("file_path"))).select(
        "file_path", text.count_lines(content).alias("lines"), text.comment_lines(lang, split).alias("comment_lines"), text.line_at(split, 1).alias("first_line"),
        metrics.text_complexity(lang, content).alias("text_complexity"), (script & rules.js_has_logging(content)).alias("js_logging"),
        F.when(script, rules.null_check_count(content)).otherwise(0).alias("js_null_checks"), line_rules.line_hits(content).alias("line_hits"),
    )
    columns = [c for c in plain.columns if c != "text_complexity"]
    assert made.select(columns).sort("file_path").collect() == plain.select(columns).sort("file_path").collect()
    # a file that was parsed has a number of its own
    words = made.join(plain.select("file_path", F.col("text_complexity").alias("want")), "file_path")
    assert words.where("py IS NULL AND NOT text_complexity <=> want OR py IS NOT NULL AND text_complexity IS NOT NULL").count() == 0
    assert made.selectExpr("sum(size(line_hits)) AS n").first().n > 100


def test_lines_are_not_gone_through_by_column_functions(files, capsys):
    """Column functions over the elements of an array are interpreted one by one: the pass over texts is free of them."""
    plan.file_facts(files({"s": {"a.py": "x = 1"}})).explain("extended")
    assert "lambda" not in capsys.readouterr().out


def test_signs_of_a_text_are_told_by_the_workers_as_by_the_column_functions(files, capsys):
    odd = ["", "JWT", "OAuth authentiçation", "verify_ID_token", "x firebase_admin.auth", "authorizİe", "CORS allow_origins=['*']", 'allow_origins=["*"]cors', "cors allow_origins=[]",
           "debug = True", "DEBUG =\x1ctrue", "xdebug=true", "debug=trueé", "Debug = truE; _debug=true", "édebug=true", "request.args", "Request.Json schema", "input(x) BaseModel", "İnput( ınput(",
           "input( zod", "requeſt.form", "pyTest", "unittest test", "log logger", "LOGGING", "tests logg", "Koauth", "\U0001f600 debug=true \U0001f600"]
    frame = files({"s": {f"{n}.{suffix}": content for n, content in enumerate(odd) for suffix in ("py", "js", "txt")}})
    names = ["file_path", *metrics.text_signs(F.col("content"))]
    made = plan.file_facts(frame)
    assert made.select(names).sort("file_path").collect() == metrics.profile(frame).select(names).sort("file_path").collect()
    assert all(made.where(name).count() > 0 for name in names[1:])
    made.explain("extended")
    assert "Contains(lower(" not in (shown := capsys.readouterr().out) and "lower(content" not in shown
