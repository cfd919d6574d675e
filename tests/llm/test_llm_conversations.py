import hashlib
import random

import duckdb
import pytest

from auditspark.llm import conversations as c
from auditspark.llm import queries
from checks.compare import _rows


def plain(initials, faults):
    """Cost and least audit by going over all nodes from the last one back, with whole texts of letters."""
    lattice, n, best = c._Lattice(initials, faults), len(faults), {}
    for i in range(n, -1, -1):
        own = []
        for s in range(4):
            ways = [(0, "")] if i == n and s in (c.E, c.A) else []
            ways += [(step + best[j, t][0], letter + best[j, t][1]) for letter, j, t, step in lattice.after(i, s) if j > i]
            own.append(min(ways, default=(10**9, "")))
        for s in range(4):
            ways, t = [], s
            for k in range(5):
                ways.append((3 * k + own[t][0], "I" * k + own[t][1]))
                t = c.NEXT[t]
            best[i, s] = min(ways)
    return best[0, c.E]


def test_cheapest_edits_with_the_least_audit():
    draw = random.Random(3)
    for _ in range(4000):
        initials = draw.choices(["s", "u", "u", "a", "a", "x", "", " "], k=draw.randint(0, 14))
        faults = bytes(draw.choices([c.FINE, c.FINE, c.FINE, c.MUST_GO, c.CUT], k=len(initials)))
        assert c.cheapest(initials, faults) == plain(initials, faults)


def test_a_long_conversation_takes_time_in_proportion():
    draw = random.Random(4)
    initials = draw.choices("ua", k=60_000)
    cost, audit = c.cheapest(initials, bytes(len(initials)))
    assert sum(x != "I" for x in audit) == 60_000 and cost == sum({"R": 3, "I": 3, "D": 4}.get(x, 0) for x in audit)


SCHEMA = "conv_id long, turn long, role string, text string, kind long, cost long, audit string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def test_repaired_rows_and_digest(spark):
    rows = rows_of(spark, [(1, 0, "system", "Be good."), (1, 1, "assistant", "Hello."), (1, 2, "user", " \n"), (1, 3, "user", "Why"), (2, 0, "user", "Hi."), (2, 0, "user", "Hi.")])
    rows = c.filled(rows)
    found = c.edits(rows)
    first, second = sorted(found.collect(), key=lambda r: r.conv_id)
    assert (first.gaps, first.blank, first.duplicate, first.truncated, first.illegal) == (0, 1, 0, 1, 2)
    assert (first.cost, first.audit) == plain(["s", "a", "u", "u"], bytes([0, 0, c.MUST_GO, c.CUT]))
    assert (second.duplicate, second.audit, second.cost) == (1, "KDI", 7)
    kept = c.repaired_rows(rows, found).where("conv_id = 2").orderBy("place").collect()
    assert [(r.edit, r.role, r.text) for r in kept] == [("K", "user", "Hi."), ("I", "assistant", "")]
    digests = {r.conv_id: r.repaired_sha256 for r in c.digests(rows, found).collect()}
    assert digests[2] == hashlib.sha256(b"user:Hi.\nassistant:").hexdigest()


@pytest.fixture
def told(spark, tmp_path):
    def run(rows):
        rows_of(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        found = queries.QUERIES["op12_conversations"](spark, str(tmp_path))
        cursor = con.execute(queries.ORACLE["op12_conversations"])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(found.columns)
        return _rows(found.columns, found.collect()), _rows(names, cursor.fetchall())

    return run


def test_sql_gives_the_same_rows(told):
    draw = random.Random(5)
    texts = ["Yes.", "No", "Why?", "", " \t\n", "é 中文!", "A.\nB", "x" * 300_000 + ".", None, " "]
    rows = []
    for conv in [*range(60), None, -4]:
        turn = draw.choice([0, 5, -2])
        for _ in range(draw.randint(1, 12)):
            rows.append((conv, draw.choice([turn, turn, turn, None]), draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), draw.choice(texts[:7] + texts[8:])))
            turn += draw.choice([0, 1, 1, 1, 3])
    rows += [(500, k, ["user", "assistant"][k % 2], texts[7] if k == 3 else f"Line {k}.") for k in range(300)]
    got, want = told(rows)
    assert got == want


def test_empty_table(told):
    assert told([]) == ([], [])
