import math
import random
import re
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from auditspark import dims
from auditspark.functions import text
from auditspark.operators import line_rules, metrics
from auditspark.sources import files as sources

ALPHABET = list("ab #/*\t.") + ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", " ", " ", "\xa0", "　", "é", "\U0001f600"]


def random_texts(n, seed, alphabet=ALPHABET, size=14):
    rng = random.Random(seed)
    return ["", "\n", "a\n", "\n\n"] + ["".join(rng.choices(alphabet, k=rng.randint(0, size))) for _ in range(n)]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(3)
    return [row[1] for row in sorted(df.select("i", expr.alias("x")).collect())]


def test_split_lines_equals_splitlines(spark):
    texts = random_texts(3000, 1)
    assert column(spark, texts, text.split_lines(F.col("v"))) == [t.splitlines() for t in texts]


def test_strip_and_snippet(spark):
    texts = random_texts(1000, 2)
    assert column(spark, texts, text.strip(F.col("v"))) == [t.strip() for t in texts]
    assert column(spark, ["  " + "é" * 300 + " "], text.snippet(F.col("v"))) == ["é" * 260]


def test_clean_line(spark):
    lines = [line for t in random_texts(2000, 3) for line in t.splitlines()]
    want = [re.sub(r"\s+", " ", re.sub(r"//.*$", "", re.sub(r"#.*$", "", line))).strip() for line in lines]
    assert column(spark, lines, text.clean_line(F.col("v"))) == want


def test_comment_test(spark):
    lines = [line for t in random_texts(1000, 4) for line in t.splitlines()]
    got = column(spark, lines, text.is_comment(F.lit("python"), F.col("v")))
    assert got == [line.strip().startswith("#") for line in lines]
    got = column(spark, lines, text.is_comment(F.lit("java"), F.col("v")))
    assert got == [line.strip().startswith(("//", "/*", "*")) for line in lines]


def test_suffix(spark):
    rng = random.Random(5)
    paths = ["".join(rng.choices("aB./_", k=rng.randint(1, 9))) for _ in range(2000)]
    paths = [p for p in paths if not p.endswith((".", "/")) and "//" not in p and "/." not in p and not p.startswith(("/", "."))]
    assert column(spark, paths, text.suffix(F.col("v"))) == [PurePosixPath(p).suffix.lower() for p in paths]
    assert column(spark, [".env", "a/.env", "x.TSX"], text.suffix(F.col("v"))) == ["", "", ".tsx"]


def test_rounding_is_pythons(spark):
    rng = random.Random(6)
    values = [2.675, 0.125, 1.005, 2.5, 3.5, 1301375.255] + [rng.uniform(0, 1000) for _ in range(2000)] + [n / 8 for n in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", text.py_round(F.col("v"), 2), text.py_round(F.col("v"), 0), F.rint("v")).collect()
    assert all(row[1] == round(row[0], 2) and row[2] == round(row[0], 0) == row[3] for row in rows)


def test_version_order(spark):
    def parts(v):
        numbers = [int(n) for n in re.findall(r"\d+", v)][:4] or [0]
        return numbers + [0] * (4 - len(numbers))

    rng = random.Random(7)
    versions = ["".join(rng.choices("0123.-rc", k=rng.randint(0, 8))) for _ in range(1500)]
    got = column(spark, versions, text.version_is_lower(F.col("v"), F.lit("1.2.3")))
    assert got == [parts(v) < parts("1.2.3") for v in versions]


def test_damaged_bytes_are_dropped(spark):
    rng = random.Random(8)
    payloads = [bytes(rng.choices([0x41, 0xC3, 0xA9, 0xFF, 0x80, 0xE2, 0x82, 0xAC], k=rng.randint(0, 12))) for _ in range(1500)]
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "i int, b binary")
    got = [r[1] for r in sorted(df.select("i", sources.clean_bytes(F.col("b"))).collect())]
    assert got == [p.decode("utf-8", errors="ignore") for p in payloads]
    cut = df.limit(1).select(sources.clean_bytes(F.lit(bytearray("aé".encode())), 2)).first()[0]
    assert cut == "a"


LINES = [
    'api_key = "abcdef1"', 'api-key: "abcde"', "étoken = 'abcdef1'", "token\xa0=\xa0'abcdef1'", "ſecret = 'abcdef1'", "my_secret = 'abcdef1'",
    "x = \"select a\" + b + ' from c'", "select %s where", "update f'x' from", "SELECT * FROM t", "os.system (c)", "subprocess.Popen(x)",
    "mysubprocess.run(x)", "éos.system(c)", "new Function('x')", "new  Function('x')", "evaluate(x)", "EVAL (x)", "hashlib.md5(x)", "sha1 (x)",
    "sha1sum(x)", "http://a", "HTTP://9", "http://-", "password == x", "password= =x", "if user  == 'root'", "if user == ''", "open(p, 'w')",
    "open(p, \"w+\")", "open(p, 'wb')", "reopen(p,'w')", "new FileWriter(f)", "except:", "except : ", "except: pass", "except Exception as e",
    "except ValueError: return  None", "except x: continue", "except x: passing", "request.args", "request.format", "input(", "todo", "TODOs", "XXX:",
    "a hack", "hacker", "éTODO", "TODOé", "", "ıf user == 'x'", "Kassword", "private_key='123456'", "passwd : '123456'",
]


def test_line_rules_equal_python_regex(spark):
    rng = random.Random(9)
    pieces = [p for line in LINES for p in re.split(r"(\W)", line) if p]
    lines = LINES + ["".join(rng.choices(pieces, k=rng.randint(2, 14))) for _ in range(3000)]
    for rule_id, pattern in dims.LINE_PATTERNS.items():
        want = [bool(re.search(pattern, line, re.IGNORECASE)) for line in lines]
        got = column(spark, lines, line_rules.matches(rule_id, F.col("v")))
        wrong = [(line, w) for line, w, g in zip(lines, want, got) if w != g]
        assert not wrong, (rule_id, wrong[:3])
        assert any(want), rule_id


def test_branch_counts_equal_python_regex(spark):
    rng = random.Random(10)
    pieces = ["if", "for", "case", "catch", "?", "? ", "&&", "||", " ", "a", "é", ".", "(", "\xa0", "_", "switch"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(3000)]
    got = column(spark, texts, metrics.js_complexity(F.col("v")))
    assert got == [1 + len(re.findall(metrics.JS_BRANCHES, t)) for t in texts]
    got = column(spark, texts, metrics.keyword_complexity(F.col("v")))
    assert got == [1 + len(re.findall(metrics.OTHER_BRANCHES, t)) for t in texts]


def test_maintainability(spark):
    grid = [(loc, cc, com) for loc in (1, 2, 10, 80, 81, 82, 500) for cc in (0, 1, 5, 30) for com in (0, 1, 7, 600)]
    df = spark.createDataFrame(grid, "l int, c int, m int")
    for loc, cc, com, got in df.select("*", metrics.maintainability(F.col("l"), F.col("c"), F.col("m"))).collect():
        c, ratio = max(cc, 1.0), min(com / loc, 1.0)
        raw = 171 - 5.2 * math.log(loc * c) - 0.23 * c - 16.2 * math.log(loc) + 50 * math.sin(math.sqrt(2.4 * ratio))
        assert abs(got - round(max(0.0, min(100.0, raw * 100 / 171)), 2)) < 0.011


def test_list_field(spark):
    values = ['["a", " b ", ""]', "a, b,,", "[broken", None, "  ", "[]"]
    assert column(spark, values, text.parse_list(F.col("v"))) == [["a", "b"], ["a", "b"], ["[broken"], [], [], []]


def test_stripping_looks_at_the_ends_of_a_text_only(spark):
    spaces = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    texts = ["", " ", "".join(spaces), "a b", *[f"{c}{d}x {c}y{d}{c}" for c in map(chr, [*range(1, 0x100), *range(0x1680, 0x1690), *range(0x180B, 0x1810), *range(0x2000, 0x2070), 0x3000, 0xFEFF]) for d in ("", " ", "\u2003")]]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.strip(F.col("t")).alias("s"))
    assert all(r.s == r.t.strip() for r in made.collect())
    assert "regexp" not in made._jdf.queryExecution().optimizedPlan().toString()
