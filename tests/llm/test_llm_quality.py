import itertools
import re
import zlib

import numpy as np
import pyarrow as pa

from auditspark.llm import line_quality, preference
from auditspark.llm.samples import sample
from prose import prose


def _labelled(docs, spark):
    rows, labels = [], []
    for i in range(60):
        good = i % 3 > 0
        rows.append((i, prose(i, 90) if good else "\n".join(f"BUY!! NOW!! {w.upper()}!!" for w in prose(i, 60).split())))
        labels.append((i, int(good), 0))
    return docs(rows), spark.createDataFrame([*labels, (None, 1, 0), (999, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_pairwise_ranking_separates_the_held_out_fold(spark, docs):
    documents, labels = _labelled(docs, spark)
    found = preference.scored(documents, preference.train(documents, labels)).collect()
    assert len(found) == 60 and {r["held_out"] for r in found} == {True, False}
    assert all((r["predicted"] == 1) == (r["doc_id"] % 3 > 0) == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in found)
    kept = preference.kept(documents, preference.train(documents, labels))
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(60) if i % 3}


def test_ranking_is_fitted_on_every_labelled_row(spark, docs):
    rows = [(i, prose(i, 12 + i % 40) + " !" * (i % 7 * (i % 3)) + " 123 #" * (i % 5)) for i in range(3000)]
    quality = {i: int((i * 7919) % 11 > i % 3 * 3) for i, _ in rows}
    labels = spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int")
    model = preference.train(docs(rows), labels)
    learned = [(i, text) for i, text in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    found = preference.features(pa.array([text for _, text in learned]))
    good = np.array([quality[i] == 1 for i, _ in learned])
    assert min(good.sum(), (~good).sum()) > 500 and max(good.sum(), (~good).sum()) > 1000
    assert np.allclose(model["mean"], found.mean(axis=0)) and np.allclose(model["scale"], np.maximum(found.std(axis=0), 1e-6))
    plain = (found - model["mean"]) / model["scale"]
    raw = plain @ model["weights"]
    lose = 1 / (1 + np.exp(raw[good][:, None] - raw[~good][None, :]))
    slope = (lose.sum(axis=1) @ plain[good] - lose.sum(axis=0) @ plain[~good]) / lose.size - preference._RIDGE * model["weights"]
    assert np.abs(slope).max() < 1e-4 < np.abs(plain[good].mean(axis=0) - plain[~good].mean(axis=0)).max() / 100
    assert (raw < model["middle"]).sum() == (~good).sum()
    again = preference.train(docs(rows[::-1]).repartition(5), labels.repartition(3))
    assert np.array_equal(model["weights"], again["weights"]) and model["middle"] == again["middle"]


def test_values_at_a_rank_are_exact(spark):
    values = [0.0, 0.0, 1e-300, 1e-300, 1.0, 1.0 + 2e-16, 7.5, 7.5, 7.5, 1e9, -3.0]
    frame, order = spark.createDataFrame([(v,) for v in values], "raw double"), sorted(values)
    for rank in range(len(values) - 1):
        assert preference._ranked(frame, rank) == (order[rank], order[rank + 1])


def test_labels_of_the_held_out_fold_are_not_learned(spark, docs):
    documents, labels = _labelled(docs, spark)
    import zlib

    turned = spark.createDataFrame([(r["doc_id"], 1 - r["quality"] if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 else r["quality"], 0)
                                    for r in labels.collect() if r["doc_id"] is not None and r["quality"] is not None], labels.schema)
    one, two = preference.train(documents, labels), preference.train(documents, turned)
    assert np.array_equal(one["weights"], two["weights"]) and one["middle"] == two["middle"]


def test_ranking_has_defined_results_for_odd_and_empty_tables(spark, docs, odd):
    documents, labels = _labelled(docs, spark)
    model = preference.train(documents, labels)
    found = preference.scored(odd, model).collect()
    assert len(found) == 9 and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] == 5}) == 1
    assert preference.kept(odd, model).columns == odd.columns
    none = preference.train(documents, labels.limit(0))
    assert none is None and {r["predicted"] for r in preference.scored(documents, none).collect()} == {1}
    assert preference.scored(documents.limit(0), model).count() == 0


def test_samples_are_bounded_and_repeat(spark):
    many = spark.range(500).selectExpr("id AS doc_id", "id % 2 AS label")
    one, two = (sample(many, 20, 30).collect() for _ in range(2))
    assert one == two and len(one) == 30 and {sum(r["label"] == k for r in one) for k in (0, 1)} == {15}


def test_viterbi_and_expectations_match_all_sequences():
    draw = np.random.default_rng(1)
    text = np.array([0, 0, 0, 0, 1, 2, 2])
    emit, change = draw.normal(size=(7, 2)), draw.normal(size=(2, 2))
    states = line_quality.viterbi(emit, change, text)
    first, length = line_quality._chains(text)
    state, changes = line_quality._expected(emit, change, first, length)
    expected = np.zeros((2, 2))
    for t in range(3):
        own = np.flatnonzero(text == t)
        scores = {}
        for s in itertools.product((0, 1), repeat=len(own)):
            scores[s] = sum(emit[i, k] for i, k in zip(own, s)) + sum(change[a, b] for a, b in zip(s, s[1:]))
        assert tuple(states[own]) == max(scores, key=scores.get)
        total = sum(np.exp(v) for v in scores.values())
        for place, i in enumerate(own):
            assert np.isclose(state[i, 1], sum(np.exp(v) for s, v in scores.items() if s[place]) / total)
        for s, v in scores.items():
            for a, b in zip(s, s[1:]):
                expected[a, b] += np.exp(v) / total
    assert np.allclose(changes, expected)


def test_field_finds_boilerplate_lines():
    rows, text, label = [], [], []
    for i in range(20):
        lines = prose(i).split("\n") if i % 2 else ["HOME!! | MENU!! | LOGIN!!"] * 5
        piece = next(line_quality.pieces(pa.array(["\n".join(lines)])))
        found = line_quality.Lines(piece)
        rows.append(found.rows)
        text += [i] * len(lines)
        label += [i % 2] * len(lines)
    model = line_quality.fit(np.concatenate(rows), np.array(text), np.array(label))
    mixed = "MENU!! | HOME!! | TOP!!\n" * 6 + prose(99, 120)
    good = line_quality.content_lines(line_quality.Lines(next(line_quality.pieces(pa.array([mixed])))), model)
    assert good.tolist() == [False] * 6 + [True] * 10


def test_base_rule_and_verdict(spark, docs, odd):
    documents, labels = _labelled(docs, spark)
    model = line_quality.train(documents, labels)
    rows = {r["doc_id"]: r for r in line_quality.judged(documents, model).collect()}
    for r in documents.collect():
        found, words = rows[r["doc_id"]], re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        assert found["n_words"] == len(words) and found["word_chars"] == sum(map(len, words))
        assert found["n_symbols"] == len(re.findall(r"[#*$%&|<>]", r["text"]))
        assert found["kept"] == (r["doc_id"] % 3 > 0)
    found = line_quality.judged(odd, model).collect()
    assert len(found) == 9 and all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in found if r["doc_id"] in (1, 2, 3))
    assert [r["n_words"] for r in found if r["doc_id"] == 4] == [24_000]
    assert line_quality.judged(documents.limit(0), model).count() == 0
    none = line_quality.train(documents, labels.where("quality = 1"))
    assert none is None and all(r["content_share"] == 1 for r in line_quality.judged(documents, none).collect())
