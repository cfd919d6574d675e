import random
import re

import numpy as np
import pyarrow as pa
import pytest

from auditspark.llm import line_quality
from prose import WORDS, prose


def junk(draw):
    """A line that is no prose."""
    words = draw.choices(WORDS, k=draw.randint(4, 12))
    return draw.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * 9), " ".join("# " + w + " $$" for w in words)])


def line(draw):
    return prose(draw.randrange(10**9), draw.randint(4, 12))


@pytest.fixture(scope="module")
def trained(spark):
    draw, rows, labels = random.Random(1), [], []
    for i in range(240):
        good = i % 3 > 0
        # bad documents hold fine lines too, and some good ones a menu
        lines = [line(draw) for _ in range(draw.randint(6, 14))] + [junk(draw)] * (draw.random() < 0.1) if good else [junk(draw) if draw.random() < 0.75 else line(draw) for _ in range(10)]
        rows.append((i, "\n".join(lines), "x", 1, 0.5, 2, 3))
        labels.append((i, int(good), "y", "z", 0.1))
    documents = spark.createDataFrame(rows, "doc_id long, text string, rows string, label int, quality double, kind int, filled int")
    labelled = spark.createDataFrame([*labels, (None, 1, "", "", 0.0), (3, None, "", "", 0.0), (4, 7, "", "", 0.0)], "doc_id long, quality int, text string, rows string, score double")
    return documents, labelled, line_quality.train(documents, labelled)


def labels_of(text, model):
    return line_quality.content_lines(line_quality.Lines(next(line_quality.pieces(pa.array([text])))), model)


def test_planted_boilerplate_is_found_line_by_line(trained):
    """Recall and precision of boilerplate lines planted in good texts, with a field that was trained on labelled documents."""
    draw, hit, told, planted, mixed = random.Random(2), 0, 0, 0, 0
    for _ in range(300):
        lines = [(line(draw), True) for _ in range(draw.randint(6, 20))]
        for place in sorted({0, draw.randint(0, len(lines)), len(lines)}, reverse=True):
            lines[place:place] = [(junk(draw), False) for _ in range(draw.randint(0, 4))]
        want = np.array([good for _, good in lines])
        got = labels_of("\n".join(text for text, _ in lines), trained[2])
        hit, told, planted = hit + (~got & ~want).sum(), told + (~got).sum(), planted + (~want).sum()
        mixed += got.any() and not got.all()
    assert hit >= 0.95 * planted and hit >= 0.95 * told and mixed > 200


def test_fine_lines_of_bad_documents_are_content(trained):
    draw = random.Random(3)
    lines = [(line(draw), True) for _ in range(3)] + [(junk(draw), False) for _ in range(9)] + [(line(draw), True) for _ in range(3)]
    assert labels_of("\n".join(t for t, _ in lines), trained[2]).tolist() == [good for _, good in lines]


def test_counts_against_plain_ones(spark, trained):
    draw = random.Random(4)
    rows = []
    for i in range(150):
        own = [draw.choice([line(draw), junk(draw), "", " \t", "same line here", "same line here\r"]) for _ in range(draw.randint(0, 14))]
        rows.append((i, "\n".join(own)))
    rows += [(500, None), (500, None), (501, "\n" * 50_000 + "a\n" * 50_000), (502, "é中 " * 60), (503, " ".join(str(n) for n in range(49))), (504, " ".join(str(n) for n in range(50)))]
    rows += [(505, " ".join(["a b c"] * 2 + [str(n) for n in range(44)])), (505, " ".join(["a b c"] * 20))]
    found = line_quality.judged(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int"), trained[2]).collect()
    got = sorted(tuple(r)[:7] for r in found)
    want = []
    for i, text in rows:
        words = re.findall("[^\x20\x09-\x0D]+", text or "")
        threes = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        often = {w for w in set(threes) if threes.count(w) > 1} if len(threes) < 20_000 else set(threes)
        repeated = len({k + j for k, w in enumerate(threes) if w in often for j in range(3)})
        seen, again = set(), 0
        for one in (text or "").split("\n"):
            if re.search("[^\x20\x09-\x0D]", one):
                again += one in seen
                seen.add(one)
        failed = len(words) < 50 or 100 * repeated > 50 * len(words)
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, repeated, failed))
    assert got == sorted(want)
    assert all(not r["kept"] for r in found if r["base_failed"])


def test_a_share_of_exactly_one_half_is_kept(spark, trained, monkeypatch):
    monkeypatch.setattr(line_quality, "content_lines", lambda lines, model: np.arange(len(lines.rows)) % 2 == 0)
    piece = next(line_quality.pieces(pa.array(["ab cd\nef gh\nab c\nde f"])))
    lines = line_quality.Lines(piece)
    good = line_quality.content_lines(lines, None)
    assert np.bincount(lines.text, lines.size * good)[0] / lines.size.sum() == line_quality.CONTENT


def test_labels_of_lines_without_words_follow(trained):
    rows = np.column_stack([np.r_[np.zeros(20), np.ones(20)], np.ones(40)])
    kind, filled = np.r_[np.zeros(20, int), np.ones(20, int)], np.ones(40, bool)
    filled[[0, 5, 30]] = False
    label = line_quality.line_labels(rows, kind, filled, np.repeat([0, 1], 20))
    assert label.tolist() == kind.tolist()
    places, owner = line_quality.planted(np.repeat([0, 1], 20), label, kind)
    assert set(np.unique(owner)) == {0} and set(range(20, 40)) <= set(places.tolist())
    nothing = line_quality.planted(np.zeros(3, int), np.ones(3, int), np.ones(3, int))
    assert len(nothing[0]) == 0 == len(nothing[1])
