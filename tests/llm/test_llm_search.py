import random
import re

import numpy as np
import pyarrow as pa
import pytest

from auditspark.llm import decontaminate, licenses
from prose import prose


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def smith_waterman(a, b):
    best, row = 0, [0] * (len(a) + 1)
    for y in b:
        last = row[:]
        for i, x in enumerate(a):
            row[i + 1] = max(0, last[i] + (2 if x == y else -1), last[i + 1] - 1, row[i] - 1)
        best = max(best, max(row))
    return best


def test_alignment_is_smith_waterman():
    draw = np.random.default_rng(3)
    texts = [draw.integers(0, 6, n).astype(np.uint64) * np.uint64(4) for n in draw.integers(1, 40, 60)]
    items = [draw.integers(0, 6, n).astype(np.uint64) * np.uint64(4) for n in draw.integers(1, 15, 60)]
    score, end = decontaminate.align(texts, items)
    for t, i, s, e in zip(texts, items, score, end):
        assert s == smith_waterman(list(t), list(i))
        assert s == 0 or smith_waterman(list(t[:e + 1]), list(i)) == s


def copied(text, item):
    if len(item) < 3:
        return bool(item) and any(text[i:i + len(item)] == item for i in range(len(text)))
    return smith_waterman(text, item) >= len(item)


def _edit(text, share, seed):
    draw, out = random.Random(seed), []
    for w in text.split():
        x = draw.random()
        out += [] if x < share / 3 else [w, "extra"] if x < 2 * share / 3 else ["other"] if x < share else [w]
    return " ".join(out)


@pytest.fixture
def benchmark(spark):
    rows = [(i, prose(1000 + i, 36)) for i in range(12)] + [(50, "too short"), (51, None), (None, prose(2000, 30)), (3, prose(1003, 36))]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks_are_those_of_all_pairs(spark, docs, benchmark, monkeypatch):
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    rows = []
    for i in range(60):
        text = prose(i, 120)
        if i % 3 == 0:
            text = prose(i, 50) + "\n" + _edit(items[i % 12][1], (i % 4) * 0.1, i).upper() + "!\n" + text
        elif i % 3 == 1:
            text += " " + " ".join(items[i % 12][1].split()[:7]) + " " + prose(i + 500, 20)
        rows.append((i, text))
    rows += [(100 + i, prose(1001, 36)) for i in range(40)] + [(200, prose(2000, 30)), (200, prose(2000, 30))]
    rows += [(300, "a text that is Too, short"), (301, "too long and short"), (302, "short, too"), (303, "too short")]
    want = [(d, i) for d, text in rows for i in {x[0] for x in items}
            if any(k == i and copied(terms(text), terms(t)) for k, t in items)]
    key = lambda r: tuple((x is None, x) for x in r)
    for block in (5000, 4):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        found = decontaminate.leaks(docs(rows), benchmark).collect()
        assert sorted(((r["doc_id"], r["item_id"]) for r in found), key=key) == sorted(want, key=key)
        for r in found:
            text, best = dict(rows)[r["doc_id"]], [len(terms(t)) for k, t in items if k == r["item_id"]]
            assert 0.5 <= r["score"] <= 1 and 0 <= r["first_word"] <= r["last_word"] < len(terms(text)) and best
    clean = decontaminate.clean(docs(rows), benchmark)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _ in rows if d not in {w[0] for w in want})


def test_items_of_scripts_without_spaces_are_found_in_running_text(spark, docs):
    items = spark.createDataFrame([(1, "今天天气很好我们一起去公园散步吧"), (2, "สวัสดีครับวันนี้อากาศดี"), (3, "好"), (4, "..."), (5, "안녕하세요")], "item_id long, text string")
    texts = ["他说今天天气很好，我们一起去公园散步吧。然后他们走了", "明天下雨不去公园", "abcสวัสดีครับวันนี้อากาศดีdef", "그는 안녕하세요 말했다", "안녕하세요요", None, ""]
    found = decontaminate.leaks(docs(list(enumerate(texts))), items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(0, 1), (0, 3), (2, 2), (3, 5)]


def test_search_has_defined_results_for_odd_and_empty_tables(spark, docs, odd, benchmark):
    assert decontaminate.leaks(odd, benchmark).count() == 0
    clean = decontaminate.clean(odd, benchmark)
    assert clean.columns == odd.columns and clean.count() == 9
    assert decontaminate.leaks(odd, benchmark.limit(0)).count() == 0 and decontaminate.clean(odd, benchmark.limit(0)).count() == 9
    assert decontaminate.leaks(odd.limit(0), benchmark).count() == 0


def common_in_order(words, template):
    """Most different words of a template that stand in order in some block, by the plain table of longest common subsequences."""
    own, width, best = list(dict.fromkeys(template)), licenses.SPREAD * len(template), 0
    for a in range(len(words)):
        row = [0] * (len(own) + 1)
        for w in words[a:a + width]:
            last = row[:]
            for i, x in enumerate(own):
                row[i + 1] = last[i] + 1 if x == w else max(last[i + 1], row[i])
        best = max(best, row[-1])
    return best


@pytest.mark.parametrize("longest", [8, 30])
def test_license_join_is_exact(longest):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["the", "of"]
    templates = [(f"t{k}", " ".join(draw.choices(vocabulary, k=draw.randint(1, longest)))) for k in range(15)] + [("none", "")]
    texts = []
    for _ in range(150):
        words = draw.choices(vocabulary + ["zz", "yy"], k=draw.randint(0, 40))
        own = draw.choice(templates)[1].split()
        own = [w for w in own if draw.random() < 0.9]
        texts.append(draw.choice([" ", "\n", "\n # "]).join(words[:20] + own + words[20:]))
    for frequency in ({}, {int(licenses._hash([w]).view("int64")[0]): n for n, w in enumerate(vocabulary)}):
        index = licenses.Index.of(templates, frequency)
        found = [licenses._judge(p, index) for p in licenses.pieces(pa.array(texts))]
        labels, scores = [x for f in found for x in f["labels"]], [x for f in found for x in f["score"]]
        for text, label, score in zip(texts, labels, scores):
            met = {}
            for name, template in templates:
                n, most = len(set(template.split())), common_in_order(terms(text), template.split())
                if n and most >= 0.8 * n - 1e-9:
                    met[name] = most / n
            assert label == ",".join(sorted(met)) and score == max(met.values(), default=0)


def test_prose_next_to_a_notice_completes_no_template(spark, docs):
    rows = [(1, "und der Vertrag mit\nLicensed under the Apache License, Version 2.0"), (2, "Licensed under the Apache License, Version 2.0\nmit einem Wort: released"),
            (3, "Ce texte est sous la license des mit\nthe public under terms of the domain, released into use"), (4, "license the under mit released"),
            (5, "Released under " + "a lot of other words " * 3 + "the MIT license")]
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(docs(rows)).collect()} == {1: "template:apache", 2: "template:apache", 3: "", 4: "", 5: ""}


def test_many_templates_cost_their_hits():
    """A thousand templates that a text has nothing of take hardly longer than none."""
    import time

    draw = random.Random(6)
    templates = [(f"t{k}", " ".join(["the", "of"] + [f"q{draw.randint(0, 5000)}" for _ in range(10)])) for k in range(1000)]
    piece = next(licenses.pieces(pa.array([prose(i, 400) + " the of" * 20 for i in range(60)])))
    common = {int(x): 10**6 for x in licenses._hash(["the", "of"]).view("int64")}
    index, start = licenses.Index.of(templates, common), time.perf_counter()
    assert set(licenses._judge(piece, index)["labels"]) == {""} and time.perf_counter() - start < 1


def test_license_places_and_labels(spark, docs, odd):
    rows = [(1, "All rights reserved. CC-BY x\ncc by"), (2, "GENERAL Public\nLicense; all rights"), (3, "Released under the MIT License."), (4, "Licensed under CC BY-NC 4.0."), (5, "éall rights reserved")]
    found = {r["doc_id"]: r for r in licenses.scan(docs(rows)).collect()}
    assert (found[1]["n_base"], found[1]["first_word"], found[1]["last_word"], found[1]["base_labels"]) == (3, 0, 6, "cc-by,reserved")
    assert found[2]["base_labels"] == "gpl" and found[2]["score"] == 1 and found[2]["n_words"] == 5
    assert found[3]["labels"] == "template:mit" and found[3]["n_base"] == 0 and found[3]["first_word"] is None and found[3]["score"] == 1
    assert found[4]["labels"] == "cc-by,template:cc" and found[5]["n_base"] == 0
    odd_found = licenses.scan(odd).collect()
    assert len(odd_found) == 9 and all(r["labels"] == "" and r["score"] == 0 for r in odd_found)
    assert licenses.scan(odd.limit(0)).count() == 0 and licenses.scan(docs(rows), []).where("base_labels <> ''").count() == 3


def test_wrapped_license_notices_are_found(spark, docs):
    bsd = "# Redistribution and use in source and binary forms, with or without\n#\n# modification, are permitted provided that the following conditions are met:"
    mit = dict(licenses.PASSAGES[:3])["template:mit"].split()
    mit = "\n".join(" * " + " ".join(mit[i:i + 11]) for i in range(0, len(mit), 11))
    far = "redistribution and use in source and binary forms\n" + "one line of other words\n" * 9 + "are permitted"
    rows = [(1, "a b c\n" + bsd), (2, mit), (3, "redistribution and use in source"), (4, "and binary forms are permitted"), (5, far)]
    found = {r["doc_id"]: r["labels"] for r in licenses.scan(docs(rows)).collect()}
    assert found == {1: "template:bsd", 2: "template:mit", 3: "", 4: "", 5: ""}
