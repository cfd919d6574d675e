import itertools
import random

import numpy as np
import pytest

from auditspark.llm import near_dedup, setsketch
from auditspark.llm.components import components
from prose import prose


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_groups(rows):
    """Component of each row by comparing all pairs of different sets."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            parent[top(i)] = top(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(doc)
    return [(doc, len(sets[i]), min((d for d in ids[top(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(rows)]


def edited(text, share, seed):
    draw = random.Random(seed)
    return " ".join(w if draw.random() > share else f"new{draw.randrange(10**6)}" for w in text.split())


@pytest.fixture
def corpus():
    rows = [(i, prose(i, 70)) for i in range(30)]
    rows += [(100 + i, edited(rows[i % 10][1], share, i)) for i, share in enumerate([0.01, 0.02, 0.03, 0.04, 0.05, 0.08] * 12)]
    rows += [(300 + i, rows[3][1]) for i in range(40)] + [(400, "one two"), (401, "ONE\ttwo"), (402, "two one"), (403, ""), (404, None), (405, " \n")]
    return rows


@pytest.mark.parametrize("block,shingles", [(512, 2_000_000), (4, 2_000_000), (512, 300)])
def test_groups_are_those_of_all_pairs(spark, docs, corpus, monkeypatch, block, shingles):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    found = near_dedup.groups(docs(corpus)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(plain_groups(corpus))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_odd_rows_and_empty_tables(spark, docs, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = near_dedup.groups(odd).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=key) == sorted(plain_groups(rows), key=key)
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert near_dedup.groups(odd.limit(0)).count() == 0 == near_dedup.keep_one(odd.limit(0)).count()
    clash = docs([(1, prose(1)), (1, prose(2)), (2, prose(2))])
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.groups(clash).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_registers_are_mergeable_and_estimates_are_near():
    draw = np.random.default_rng(5)
    for n, shared in ((40, 30), (400, 300), (5000, 2500), (200, 0)):
        elements = draw.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
        left, right = elements[:n], elements[n - shared:]
        rows = setsketch.registers(np.concatenate([left, right, elements]), np.array([0, n, 2 * n, 4 * n - shared]))
        assert np.array_equal(np.maximum(rows[0], rows[1]), rows[2])
        guess = setsketch.estimate(rows[:1], rows[1:2], np.array([n]), np.array([n]))[0]
        assert abs(guess - shared / (2 * n - shared)) < 0.12
    assert not setsketch.registers(np.zeros(0, np.uint64), np.array([0, 0])).any()


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(2, 50)] + [(60, 60), (70, 71), (71, 70)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 141)}, **{k: 1 for k in range(1, 50)}, 70: 70, 71: 70}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_share_an_id_are_kept_by_their_texts(docs):
    a, b, near = prose(1, 200), prose(2, 200), prose(3, 200)
    rows = [(5, a), (3, b), (5, b), (7, near), (7, near + " end"), (None, a), (None, prose(4, 90)), (None, prose(5, 90)), (None, None), (None, None), (None, ""), (9, " "), (9, " ")]
    kept = near_dedup.keep_one(docs(rows)).collect()
    got = sorted(((r["doc_id"] or 0), r["text"] or "") for r in kept)
    sevens = [g for g in got if g[0] == 7]
    assert len(sevens) == 1 and sevens[0][1] in (near, near + " end")
    assert sorted(g for g in got if g[0] != 7) == sorted([(5, a), (3, b), (0, prose(4, 90)), (0, prose(5, 90)), (0, ""), (0, ""), (0, ""), (9, " "), (9, " ")])
