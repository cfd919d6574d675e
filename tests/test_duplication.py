"""Duplicates against plain Python models over all blocks and all pairs."""

import hashlib
import random
import time
from collections import defaultdict
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pytest

from auditspark.operators import duplication, extract


def model_blocks(tree):
    seen = defaultdict(list)
    for path in sorted(tree):
        lines = [" ".join(line.split("#")[0].split("//")[0].split()) for line in tree[path].splitlines()]
        lines = [line for line in lines if line]
        for at in range(len(lines) - 5):
            block = "\n".join(lines[at:at + 6])
            if len(block) >= 40:
                seen[hashlib.sha1(block.encode()).hexdigest()].append((path, at + 1))
    return {fp: places[:2] for fp, places in seen.items() if len({p for p, _ in places}) > 1}


def model_pairs(blocks, limit):
    out, seen = [], set()
    for left, right in combinations(blocks, 2):
        key = tuple(sorted([left[:2], right[:2]]))
        if key in seen:
            continue
        seen.add(key)
        ratio = SequenceMatcher(None, left[3], right[3]).ratio()
        if ratio >= 0.86:
            out.append((left[0], left[2], right[0], right[2], round(ratio, 9)))
            if len(out) >= limit:
                break
    return out


def pool(tree):
    return [(path, b["name"], b["line"], b["body"]) for path in sorted(tree) for b in extract.function_bodies(tree[path])]


def random_tree(seed, files=12, vocabulary=14):
    rng = random.Random(seed)
    words = [f"statement_{n} = call({n}, other)" for n in range(vocabulary)]
    tree = {}
    for n in range(files):
        lines = []
        for _ in range(rng.randint(1, 4)):
            lines.append(f"def f{rng.randint(0, 3)}(a):")
            base = [rng.choice(words[:4])] * 2 + rng.sample(words, 6)
            lines += [f"    {w}" + rng.choice(["", "  # x", " // y"]) for w in base[: rng.randint(4, 8)]]
        tree[f"d{n % 3}/f{n}.py"] = "\n".join(lines)
    return tree


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_equal_model(files, seed):
    scans = {f"s{n}": random_tree(seed * 10 + n, vocabulary=6) for n in range(4)}
    got = duplication.duplicate_blocks(files(scans)).collect()
    want = {
        (scan, fp, *a, *b) for scan, tree in scans.items() for fp, (a, b) in model_blocks(tree).items()
    }
    assert want and {(r.scan_id, r.fp, r.file_path, r.line, r.other_path, r.other_line) for r in got} == want


def test_own_blocks_are_those_of_the_column_functions(files, monkeypatch, capsys):
    """Blocks come out of the workers in batches of any size, are those of `fingerprints`, and lines are not gone through by column functions."""
    monkeypatch.setattr(duplication, "PLACES_AT_ONCE", 5)
    odd = "\r\n".join(["x = 1 # y", "\u3000z\u00a0 =\t\u00e9", "", "// only", "a\x0bb", "http://c", "\U0001f600 " * 9, "short"] * 3)
    tree = {"a.py": odd, "b.py": "", "c.py": odd + "\n" + "tail " * 9, "d.py": "\n".join("ab" for _ in range(30)), **random_tree(5, vocabulary=6)}
    frame = files({"s": tree, "t": {"n.py": None}})
    capsys.readouterr()
    duplication.duplicate_blocks(frame).explain("extended")
    assert "lambda" not in capsys.readouterr().out
    want = defaultdict(list)
    for r in duplication.shingles(frame.where("content IS NOT NULL")).sort("idx").collect():
        want[r.file_path, r.fp].append(r.idx)
    got = {(r.file_path, r.fp.hex()): [n for n in (r.first_idx, r.second_idx) if n is not None] for r in duplication.own_blocks(frame).collect()}
    assert len(got) > 30 and got == {key: places[:2] for key, places in want.items()}


def test_first_two_places_may_be_in_one_file(files):
    lines = "\n".join(f"value_{n} = {n}" for n in range(6))
    rows = duplication.duplicate_blocks(files({"s": {"a.py": lines + "\n" + lines, "b.py": lines}, "t": {"a.py": lines + "\n" + lines}})).collect()
    hit = [r for r in rows if r.line == 1]
    assert {r.scan_id for r in rows} == {"s"}
    assert [(r.file_path, r.line, r.other_path, r.other_line) for r in hit] == [("a.py", 1, "a.py", 7)]


def test_block_cap(files):
    text = "\n".join(f"some_value_{n} = {n}" for n in range(300))
    tree = files({"s": {"a.py": text, "b.py": text}})
    for limit, last in ((250, 250), (None, 295)):
        assert sorted(r.line for r in duplication.block_findings(tree, limit).collect()) == list(range(1, last + 1))


def pairs(spark, files, scans, **options):
    blocks = extract.function_blocks(files(scans)).repartition(5)
    out = defaultdict(list)
    for r in duplication.similar_functions(blocks, **options).orderBy("scan_id", "pair_rank").collect():
        out[r.scan_id].append((r.left_path, r.left_line, r.right_path, r.right_line, round(r.ratio, 9)))
    return out


@pytest.mark.parametrize("block_rows", [4, 1024])
@pytest.mark.parametrize("limit", [3, 120])
def test_similar_functions_equal_all_pairs(spark, files, block_rows, limit):
    scans = {f"s{n}": random_tree(n, files=20) for n in range(3)}
    got = pairs(spark, files, scans, limit=limit, block_rows=block_rows)
    for scan, tree in scans.items():
        want = model_pairs(pool(tree), limit)
        assert want and got[scan] == want


@pytest.mark.parametrize("block_rows", [16, 1024])
def test_many_copies_of_one_function(spark, files, block_rows):
    body = "def {name}(a):\n" + "".join(f"    step_{n} = a + {n}\n" for n in range(7))
    near = body.replace("step_3", "step_9")
    tree = {f"m{n:03d}.py": (near if n % 50 == 7 else body).format(name=f"f{n % 5}") for n in range(200)}
    got = pairs(spark, files, {"s": tree}, block_rows=block_rows)["s"]
    assert got == model_pairs(pool(tree), 120)


def test_no_limit_gives_all_pairs(spark, files):
    scans = {f"s{n}": random_tree(n + 40, files=60) for n in range(2)}
    got = pairs(spark, files, scans, limit=None, block_rows=8)
    for scan, tree in scans.items():
        want = model_pairs(pool(tree), 10**9)
        assert len(want) > 120 and got[scan] == want


def test_classes_links_and_totals(spark, files):
    """Representatives and membership say the same as all pairs."""
    tree = random_tree(77, files=40)
    blocks = extract.function_blocks(files({"s": tree})).cache()
    classes = duplication.function_classes(blocks).cache()
    links = duplication.class_links(classes, block_rows=8).cache()
    of = {(r.file_path, r.line): r for r in blocks.collect()}
    sha = {place: hashlib.sha1(r.body.encode()).hexdigest() for place, r in of.items()}
    want = {(sha[p[:2]], sha[p[2:4]]) for p in model_pairs(pool(tree), 10**9) if of[p[:2]].turn == of[p[2:4]].turn == 1}
    assert {(r.left_class, r.right_class) for r in links.collect()} == {w for w in want if w[0] != w[1]}
    rows = {r.class_id: r for r in duplication.similarity_classes(classes, links).collect()}
    for cid, r in rows.items():
        places = sorted(p for p, b in of.items() if b.turn == 1 and sha[p] == cid)
        assert (r.first_path, r.first_line) == places[0] and r.copies == len(places)
        assert r.links == len({x for w in want if cid in w for x in w} - {cid})
    total = duplication.similarity_totals(blocks, classes, links).first()
    assert (total.functions, total.bodies, total.copies) == (len(of), len(rows), sum(r.copies - 1 for r in rows.values()))
    assert total.links == len({frozenset(w) for w in want if w[0] != w[1]}) and total.linked_bodies == sum(r.links > 0 for r in rows.values())
    told = duplication.representative_pairs(blocks, classes, links).collect()
    assert len(told) == total.links + total.copies + duplication.twins(blocks).count()


def test_bounds_never_lose_a_pair():
    rng = random.Random(3)
    bodies = []
    for _ in range(60):
        base = "".join(rng.choices("abcdef\n =()", k=rng.randint(80, 320)))
        bodies.append(base)
        for _ in range(3):
            cut = list(base)
            for _ in range(rng.randint(1, len(base) // 5)):
                cut[rng.randrange(len(cut))] = rng.choice("abcxyz")
            bodies.append("".join(cut))
    letters, twos, chars = duplication._profiles(bodies)
    spelled = duplication._alphabet(bodies)
    for i in range(len(bodies) - 1):
        kept = set(duplication._candidates(i, letters, twos, chars).tolist())
        others = np.arange(i + 1, len(bodies))
        reaching = set(others[duplication._reaching(np.full(len(others), i), others, spelled, chars)].tolist())
        for j in range(i + 1, len(bodies)):
            if SequenceMatcher(None, bodies[i], bodies[j]).ratio() >= 0.86:
                assert j in kept and j in reaching


def test_subsequence_bound_is_exact():
    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for n, y in enumerate(b, 1):
                row[n] = last[n - 1] + 1 if x == y else max(last[n], row[n - 1])
        return row[-1]

    rng = random.Random(4)
    bodies = ["".join(rng.choices("abcd", k=rng.choice([1, 3, 30, 63, 64, 65, 128, 140]))) for _ in range(30)]
    bodies += [body[:20] + body[22:] + "a" for body in bodies] + ["\U0001f600" * 64, "\U0001f600" * 60 + "\ud800"]
    spelled, chars = duplication._alphabet(bodies), np.array([len(b) for b in bodies])
    ones, others = np.triu_indices(len(bodies), 1)
    want = [2 * longest(bodies[i], bodies[j]) >= 0.86 * (len(bodies[i]) + len(bodies[j])) for i, j in zip(ones, others)]
    assert any(want) and duplication._reaching(ones, others, spelled, chars).tolist() == want


def test_a_cell_of_few_long_bodies_takes_little_time():
    letters = np.array(list("abcdefgh =().\n"))
    bodies = ["".join(np.random.default_rng(n // 2).permutation(np.repeat(letters, 80))) + "x" * (n % 2) for n in range(12)]
    spelled, chars = duplication._alphabet(bodies), np.array([len(b) for b in bodies])
    ones, others = np.triu_indices(len(bodies), 1)
    few = duplication._longest_of_few(ones, others, spelled, chars)
    assert few.tolist() == duplication._longest_of_many(ones, others, spelled, chars).tolist()
    assert [few[(ones == n) & (others == n + 1)][0] == chars[n] for n in range(0, 12, 2)] == [True] * 6
    start = time.process_time()
    for n in range(0, 30, 3):
        duplication._reaching(ones[n:n + 3], others[n:n + 3], spelled, chars)
    assert time.process_time() - start < 0.4
