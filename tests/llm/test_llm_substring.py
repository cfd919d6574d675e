import random
import re

import pytest

from auditspark.llm import substring
from prose import prose

NEVER = float("inf")


def plain(rows):
    """(id, words, removed places) by all windows of all rows."""
    words = [(i, re.findall("[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - 12):
            g = tuple(w[k:k + 13])
            least[g] = min(least.get(g, NEVER), NEVER if i is None else i)
    out = []
    for i, w in words:
        own = NEVER if i is None else i
        gone = {k + j for k in range(len(w) - 12) if least[tuple(w[k:k + 13])] < own for j in range(13)}
        out.append((i, len(w), tuple(sorted(gone)), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def told(found):
    return sorted(((r.doc_id, r.n_words, tuple(k for s in r.repeats for k in range(s.first_word, s.last_word + 1)), r.text) for r in found.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_removes_what_all_windows_say(docs, seed):
    draw = random.Random(seed)
    passages = [prose(1000 + k, draw.randint(13, 40)) for k in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(i, draw.randint(0, 30))]
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passages).split()
            a = draw.randint(0, len(p) - 1)
            parts += [" ".join(p[a:a + draw.randint(5, 40)]), prose(draw.randint(0, 10_000), draw.randint(0, 9))]
        draw.shuffle(parts)
        rows.append((draw.choice([i, i, 60 - i]), draw.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(7, rows[3][1]), (None, rows[5][1]), (None, rows[5][1])]
    assert told(substring.without_repeats(docs(rows))) == plain(rows)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert told(substring.without_repeats(odd)) == plain(rows)


def test_repeats_are_maximal_and_name_their_source(docs):
    shared = prose(1, 30)
    rows = [(1, f"{prose(2, 9)} {shared} {prose(3, 4)}"), (2, f"x {shared} y {shared}"), (3, shared)]
    found = {r.doc_id: r for r in substring.without_repeats(docs(rows)).collect()}
    assert found[1].repeats == [] and found[1].text == " ".join(rows[0][1].split())
    assert [tuple(s) for s in found[2].repeats] == [(1, 30, 1), (32, 61, 1)] and found[2].text == "x y"
    assert [tuple(s) for s in found[3].repeats] == [(0, 29, 1)] and found[3].text == ""


def test_anchor_at_every_offset(docs):
    """A repeat of exactly the shortest length is found wherever the blocks of the first text begin."""
    shared = prose(5, 13)
    rows = [(10 + k, f"{prose(50 + k, k)} {shared} {prose(80 + k, 3)}") for k in range(14)] + [(100, f"a b c {shared} d")]
    assert {r[0]: r[2] for r in told(substring.without_repeats(docs(rows)))}[100] == tuple(range(3, 16))


def test_empty_table(docs):
    assert substring.without_repeats(docs([])).count() == 0


def test_one_passage_in_all_documents_is_sent_once_a_home(docs):
    """Keys that leave the homes grow with homes and words, not with pairs of documents."""
    shared = prose(9, 40)
    rows = [(i, f"{shared} {i}") for i in range(600)]
    found = told(substring.without_repeats(docs(rows)))
    assert sum(len(r[2]) for r in found) == 599 * 40
