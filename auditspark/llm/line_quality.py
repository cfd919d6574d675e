"""Content and boilerplate lines by a linear-chain conditional random field, and the documents that are kept by it.

Each line of a text has features of its words and signs. The field has the states content and boilerplate, a weight for
each feature and state, and weights for the change from line to line. The labels of a whole text come from Viterbi decoding. A
document is kept if it passes the base rule and if at least ``CONTENT`` of its word characters stand in content lines.

Training takes a bounded sample of labelled documents, at most ``RUN`` lines in a row of each. Lines have labels of their own: a
classifier of single lines is fitted to tell lines of good documents from lines of bad ones, and then says, in ``ROUNDS`` rounds, which
lines of a bad document are as good as any (content) and which of a good one are clearly not (boilerplate). Besides the texts as
they are, the field sees good texts with runs of boilerplate lines planted at the head, inside and at the foot, and
so learns where the state changes. It is trained by gradient ascent on the log-likelihood (forward-backward).

All texts of a batch are decoded together, line by line of the longest one; texts are sorted by their number of lines so
that short ones drop out.

A null or empty text has one empty line, no words, and fails the base rule. A share of exactly ``CONTENT`` is kept. Labels other than 0
and 1 are not learned from. Without labels, or with one kind only, every line is content. Rows that repeat have equal results. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.batches import in_batches, mix, pieces, prepare
from auditspark.llm.samples import sample, texts_of
from auditspark.llm.textstats import NAMES, SYMBOLS, Words, shares

#: labelled documents of each kind, and lines of each of them, that the field is trained on
PER_CLASS, RUN = 500, 40
#: rounds in which lines get labels of their own, and the chance of content below which a line of a good document is boilerplate
ROUNDS, CLEARLY = 3, 0.1
#: share of word characters in content lines from which a document is kept
CONTENT = 0.5
#: base rule: fewest words, and the percentage of words in repeated windows beyond which a text fails
LEAST_WORDS, MOST_REPEATED = 50, 50
STEPS, RATE, RIDGE = 150, 0.5, 1e-3
_FEATURES = len(NAMES) + 5


class Lines:
    """The lines of a piece: features, and the numbers that the base rule needs."""

    def __init__(self, piece):
        self.piece, self.words = piece, Words(piece)
        self.starts, self.ends, self.text = piece.lines()
        row = shares(self.words, self.starts, self.ends)
        low, high = np.searchsorted(self.words.starts, self.starts), np.searchsorted(self.words.starts, self.ends)
        self.filled = high > low
        hashes = piece.hashes(self.starts, self.ends)
        key = mix(hashes + self.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        self.again = np.zeros(len(key), bool)
        self.again[order[1:]] = key[order][1:] == key[order][:-1]
        self.again &= self.filled
        one = np.ones((len(row), 1))
        self.rows = np.hstack([row, np.sqrt(row[:, [2, 3, 8]]), self.again[:, None], one])
        letters = np.zeros(len(piece.data) + 1, np.int64)
        np.cumsum((piece.data & 0xC0) != 0x80, out=letters[1:])
        self.points = letters
        self.size = self._points_of_words(low, high)

    def _points_of_words(self, low, high):
        """Code points inside words ``low`` to ``high``."""
        size = self.points[self.words.ends] - self.points[self.words.starts]
        sums = np.concatenate([[0], np.cumsum(size)])
        return sums[high] - sums[low]

    def base(self) -> dict[str, np.ndarray]:
        n = self.piece.n
        of_text = np.searchsorted(self.words.text, np.arange(n + 1))
        return {
            "n_words": self.words.counts.astype(np.int64),
            "word_chars": self._points_of_words(of_text[:-1], of_text[1:]),
            "n_symbols": self.piece.counts(SYMBOLS[self.piece.data]),
            "n_dup_lines": np.bincount(self.text[self.again], minlength=n).astype(np.int64),
            "n_repeat_words": self.words.repeated().astype(np.int64),
        }


def _chains(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each sequence of lines begins, and its length, longest first."""
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(text)))
    order = np.argsort(-length, kind="stable")
    return first[order], length[order]


def viterbi(emit: np.ndarray, change: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The most likely state of each line; ``emit`` has a row of state scores for each line."""
    first, length = _chains(text)
    states = np.zeros(len(text), np.int8)
    if not len(first):
        return states
    back = np.zeros((len(text), 2), np.int8)
    best = emit[first].copy()
    for k in range(1, length[0]):
        n = int(np.searchsorted(-length, -k, "left"))
        step = best[:n, :, None] + change[None]
        came = step.argmax(axis=1)
        best[:n] = np.take_along_axis(step, came[:, None, :], axis=1)[:, 0] + emit[first[:n] + k]
        back[first[:n] + k] = came
    now = best.argmax(axis=1)
    states[first + length - 1] = now
    for k in range(length[0] - 1, 0, -1):
        n = int(np.searchsorted(-length, -k, "left"))
        place = first[:n] + k
        states[place - 1] = back[place, states[place]]
    return states


def _expected(emit, change, first, length):
    """State probabilities of each line, and the expected number of each change, by forward-backward."""
    ahead, after, scale = np.zeros_like(emit), np.zeros_like(emit), np.exp(change)
    weight = np.exp(emit - emit.max(axis=1, keepdims=True))
    ahead[first] = weight[first] / weight[first].sum(axis=1, keepdims=True)
    for k in range(1, length[0]):
        n = int(np.searchsorted(-length, -k, "left"))
        now = (ahead[first[:n] + k - 1] @ scale) * weight[first[:n] + k]
        ahead[first[:n] + k] = now / now.sum(axis=1, keepdims=True)
    after[first + length - 1] = 1
    changes = np.zeros((2, 2))
    for k in range(length[0] - 1, 0, -1):
        n = int(np.searchsorted(-length, -k, "left"))
        right = weight[first[:n] + k] * after[first[:n] + k]
        pair = ahead[first[:n] + k - 1][:, :, None] * scale[None] * right[:, None, :]
        changes += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        left = right @ scale.T
        after[first[:n] + k - 1] = left / left.sum(axis=1, keepdims=True)
    state = ahead * after
    return state / state.sum(axis=1, keepdims=True), changes


def fit(rows: np.ndarray, text: np.ndarray, label: np.ndarray) -> dict | None:
    """Train on lines with features ``rows``, their text numbers, and a label each: 1 content, 0 boilerplate."""
    if not len(rows) or label.min() == label.max():
        return None
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    mean[-1], scale[-1] = 0, 1
    rows = (rows - mean) / scale
    # both kinds weigh the same, whatever the sample holds of them
    mass = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum())
    first, length = _chains(text)
    truth = np.column_stack([label == 0, label == 1]).astype(float)
    inner = np.flatnonzero(text[1:] == text[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner], label[inner + 1]), 1)
    weights, change = np.zeros((rows.shape[1], 2)), np.zeros((2, 2))
    speed = [np.zeros_like(weights), np.zeros_like(change)]
    for _ in range(STEPS):
        state, changes = _expected(rows @ weights, change, first, length)
        slope = rows.T @ ((truth - state) * mass[:, None]) - RIDGE * weights
        turn = (seen - changes) / max(len(inner), 1) - RIDGE * change
        speed = [0.9 * s + g for s, g in zip(speed, (slope, turn))]
        weights, change = weights + RATE * speed[0], change + RATE * speed[1]
    return {"mean": mean, "scale": scale, "weights": weights, "change": change}


def content_lines(lines: Lines, model: dict | None) -> np.ndarray:
    """Is each line content?"""
    if model is None:
        return np.ones(len(lines.rows), bool)
    emit = (lines.rows - model["mean"]) / model["scale"] @ model["weights"]
    return viterbi(emit, model["change"], lines.text) == 1


def line_labels(rows: np.ndarray, kind: np.ndarray, filled: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A label for each line: 1 content, 0 boilerplate. ``kind`` is its document's; lines without words go with the line before."""
    label = kind.copy()
    for _ in range(ROUNDS):
        single = fit(rows[filled], np.arange(filled.sum()), label[filled])
        if single is None:
            break
        score = (rows - single["mean"]) / single["scale"] @ single["weights"]
        chance = 1 / (1 + np.exp(score[:, 0] - score[:, 1]))
        label = np.where(kind == 1, chance >= CLEARLY, chance >= 0.5).astype(kind.dtype)
    # the last line with words before each one, in its text
    last = np.maximum.accumulate(np.where(filled, np.arange(len(label)), -1))
    known = (last >= 0) & (text[np.maximum(last, 0)] == text)
    return np.where(known, label[np.maximum(last, 0)], kind)


def planted(text: np.ndarray, label: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines, as places among the given ones, and their texts: each good text with boilerplate at head, inside and foot, by chance."""
    draw = np.random.default_rng(1)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    bounds = list(zip(first, np.append(first[1:], len(text))))
    runs = [np.arange(a, b)[label[a:b] == 0] for a, b in bounds]
    runs = [r for r in runs if len(r)]
    places, owner = [], []
    for a, b in bounds if runs else ():
        if kind[a] != 1:
            continue
        cut = int(draw.integers(a, b + 1))
        some = [runs[draw.integers(len(runs))][:draw.integers(1, 7)] if draw.random() < 0.5 else np.zeros(0, np.int64) for _ in range(3)]
        chain = np.concatenate([some[0], np.arange(a, cut), some[1], np.arange(cut, b), some[2]]).astype(np.int64)
        owner.append(np.full(len(chain), len(places)))
        places.append(chain)
    return (np.concatenate(places), np.concatenate(owner)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def train(documents: DataFrame, labels: DataFrame) -> dict | None:
    """Fit on the lines of a bounded sample of labelled documents; of a long text a run of lines from a place drawn by its length."""
    prepare(documents.sparkSession)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1))

    def work(batch):
        label, out = batch.column("label").to_numpy(), []
        for piece in pieces(batch.column("text")):
            lines = Lines(piece)
            cut = np.searchsorted(lines.text, np.arange(piece.n + 1))
            mark = piece.counts(np.ones(len(piece.data), bool))
            for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                a += int(mark[i]) % max(1, b - a - RUN + 1)
                b = min(b, a + RUN)
                row = np.hstack([lines.rows[a:b, :-1], lines.filled[a:b, None]])
                out.append((int(label[piece.first + i]), row.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([y for _, y in out], pa.binary())], ["label", "rows"])

    found = in_batches(texts_of(sample(known, PER_CLASS, 2 * PER_CLASS), documents), work, "label int, rows binary")
    found = sorted((r["label"], bytes(r["rows"])) for r in found.toLocalIterator())  # at most 2 * PER_CLASS * RUN lines
    if not found:
        return None
    made = [np.frombuffer(x).reshape(-1, _FEATURES) for _, x in found]
    size = [len(m) for m in made]
    whole, text, kind = np.concatenate(made), np.repeat(np.arange(len(made)), size), np.repeat([k for k, _ in found], size)
    rows, filled = np.hstack([whole[:, :-1], np.ones((len(whole), 1))]), whole[:, -1] > 0
    if not filled.any() or kind[filled].min() == kind[filled].max():
        return None
    label = line_labels(rows, kind, filled, text)
    places, owner = planted(text, label, kind)
    return fit(np.vstack([rows, rows[places]]), np.concatenate([text, owner + len(made)]), np.concatenate([label, label[places]]))


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(documents: DataFrame, model: dict | None) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, n_boilerplate_lines, kept)``."""
    prepare(documents.sparkSession)

    def work(batch):
        parts = []
        for piece in pieces(batch.column("text")):
            lines = Lines(piece)
            found = lines.base()
            good = content_lines(lines, model)
            inside = np.bincount(lines.text, lines.size * good, piece.n)
            parts.append(np.column_stack([*(found[c] for c in COLUMNS), np.bincount(lines.text, ~good & lines.filled, piece.n), inside]))
        made = np.concatenate(parts)
        whole = made[:, :6].astype(np.int64)
        words, size, repeated = whole[:, 0], whole[:, 1], whole[:, 4]
        failed = (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)
        share = made[:, 6] / np.maximum(size, 1)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(whole[:, i]) for i in range(5)), pa.array(failed), pa.array(share), pa.array(whole[:, 5]), pa.array(~failed & (share >= CONTENT))],
            ["doc_id", *COLUMNS, "base_failed", "content_share", "n_boilerplate_lines", "kept"])

    schema = "doc_id long, " + "".join(f"{c} long, " for c in COLUMNS) + "base_failed boolean, content_share double, n_boilerplate_lines long, kept boolean"
    return in_batches(documents.select(F.col("doc_id").cast("long"), "text"), work, schema)
