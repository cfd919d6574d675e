"""Language of a text by averaged hashed subword embeddings and a linear softmax.

Subwords are runs of 2 to 4 characters of a lower-cased word with a mark on either side. Each is hashed to one of
``BUCKETS`` embeddings; a text is the average of all its subwords' embeddings, and a linear layer with softmax gives the
languages. Embeddings and layer are trained together by stochastic gradient descent in numpy on a bounded sample. A part
of the sample is set aside to fit the temperature of the softmax and the score below which a prediction is rejected.

A null text or one without a letter is ``und`` with score 0 and rejected. Very long texts count whole. Documents without a
language are not learned from. With no labelled document at all every prediction is ``und``; with one language it is that
one. A rejected prediction keeps its best language; the rejection is a column of its own. Rows that repeat are predicted
alike, and other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.batches import in_batches, mix, prepare
from auditspark.llm.samples import held_out, sample, texts_of

#: documents of each language, and of all, that are learned from
PER_LANGUAGE, TOTAL = 300, 3_000
BUCKETS = 1 << 13
WIDTH = 16
EPOCHS, RATE, BATCH = 12, 4.0, 32
#: share of right predictions on the part set aside that the rejection may cost
REJECTED = 0.01
UNKNOWN = "und"
#: characters that are worked on at a time
PIECE = 1 << 19

_tables: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Each code point to its lower-case letter, and all that are no letters to 0."""
    if not _tables:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables.append(table)
    return _tables[0]


def _pieces(texts: list):
    """(first text, folded code points with a 0 on either side of each text, where each text begins)."""
    first = 0
    while first < len(texts):
        end, size = first, 0
        while end < len(texts) and (end == first or size + len(texts[end] or "") < PIECE):
            size += len(texts[end] or "")
            end += 1
        part = [t or "" for t in texts[first:end]]
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        codes = np.frombuffer(("\0" + "\0".join(part) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        yield first, _fold()[codes], at
        first = end


def subwords(texts: list):
    """(first text, bucket of each subword, text of each subword) for pieces of the texts."""
    for first, codes, at in _pieces(texts):
        letter = codes > 0
        wide = codes.astype(np.uint64)
        hashed, begin = [], []
        key = wide[:-1] * np.uint64(0x9E3779B97F4A7C15) + wide[1:]
        # inner places of a subword must be letters; its first and last place may be the edge of a word
        fit = letter[:-1] | letter[1:]
        for length in (2, 3, 4):
            if length > 2:
                n = len(codes) - length + 1
                if n <= 0:
                    break
                key = mix(key[:n]) + wide[length - 1:]
                inner = letter[1:n + 1].copy()
                for step in range(2, length - 1):
                    inner &= letter[step:step + n]
                fit = inner
            place = np.flatnonzero(fit)
            hashed.append((mix(key[place] + np.uint64(length)) >> np.uint64(40)) % np.uint64(BUCKETS))
            begin.append(place)
        place = np.concatenate(begin)
        owner = np.minimum(np.searchsorted(at, place, "right") - 1, len(at) - 2)
        yield first, np.concatenate(hashed).astype(np.int64), owner, len(at) - 1


def _counts(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for _, bucket, owner, n in subwords(texts):
        order = np.lexsort((bucket, owner))
        cut = np.searchsorted(owner[order], np.arange(n + 1))
        for a, b in zip(cut[:-1], cut[1:]):
            out.append(np.unique(bucket[order[a:b]], return_counts=True))
    return out


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> dict | None:
    """Train on (language, buckets, counts) of each sampled text."""
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    draw = np.random.default_rng(10)
    rows = [rows[i] for i in draw.permutation(len(rows))]
    aside = rows[:len(rows) // 5] if len(rows) >= 10 else rows
    taught = rows[len(rows) // 5:] if len(rows) >= 10 else rows
    embed = draw.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    layer = np.zeros((WIDTH, len(languages)))
    steps, total = 0, EPOCHS * max(1, -(-len(taught) // BATCH))
    for _ in range(EPOCHS):
        order = draw.permutation(len(taught))
        for k in range(0, len(order), BATCH):
            rate = RATE * (1 - steps / total)
            steps += 1
            part = [taught[i] for i in order[k:k + BATCH]]
            means = np.array([(c / c.sum()) @ embed[b] for _, b, c in part])
            out = means @ layer
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out /= out.sum(axis=1, keepdims=True)
            out[np.arange(len(part)), [languages.index(r[0]) for r in part]] -= 1
            back = out @ layer.T
            layer -= rate / len(part) * means.T @ out
            for (_, b, c), g in zip(part, back):
                embed[b] -= np.outer(rate * c / c.sum(), g)
    logits = np.array([((c / c.sum()) @ embed[b]) @ layer for _, b, c in aside])
    truth = np.array([languages.index(r[0]) for r in aside])

    def chances(heat):
        e = np.exp((logits - logits.max(axis=1, keepdims=True)) / heat)
        return e / e.sum(axis=1, keepdims=True)

    heats = np.geomspace(1, 20, 40)
    heat = heats[np.argmin([-np.log(np.maximum(chances(h)[np.arange(len(truth)), truth], 1e-12)).mean() for h in heats])]
    best = chances(heat)
    right = best.max(axis=1)[best.argmax(axis=1) == truth]
    least = float(np.quantile(right, REJECTED)) if len(right) else 1.0
    return {"languages": languages, "table": (embed @ layer / heat).astype(np.float32), "least": least}


def train(documents: DataFrame) -> dict | None:
    """Fit on a bounded sample of the documents with a language outside the held-out fold."""
    prepare(documents.sparkSession)
    known = documents.select("doc_id", F.col("lang").alias("label")).where(~held_out())
    chosen = sample(known, PER_LANGUAGE, TOTAL)

    def work(batch):
        found = _counts(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([
            batch.column("label"), pa.array([b.tolist() for b, _ in found], pa.list_(pa.int32())), pa.array([c.tolist() for _, c in found], pa.list_(pa.int32()))],
            ["label", "buckets", "counts"])

    rows = in_batches(texts_of(chosen, documents), work, "label string, buckets array<int>, counts array<int>").toArrow()
    return fit(sorted(((r["label"], np.array(r["buckets"], np.int64), np.array(r["counts"], float)) for b in rows.to_batches() for r in b.to_pylist()),
                      key=lambda r: (r[0], len(r[1]), r[1].tolist(), r[2].tolist())))


def predict(texts: list, model: dict | None) -> tuple[list, np.ndarray, np.ndarray]:
    """Languages, scores and rejections of texts."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return names, scores, np.ones(len(texts), bool)
    table = model["table"]
    for first, bucket, owner, n in subwords(texts):
        counts = np.bincount(owner, minlength=n)
        logits = np.column_stack([np.bincount(owner, table[bucket, k], n) for k in range(table.shape[1])]) / np.maximum(counts, 1)[:, None]
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        best = chance.argmax(axis=1)
        for i in np.flatnonzero(counts):
            names[first + i], scores[first + i] = model["languages"][best[i]], chance[i, best[i]]
    return names, scores, scores < model["least"]


def predicted(documents: DataFrame, model: dict | None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` for every document."""
    prepare(documents.sparkSession)

    def work(batch):
        names, scores, rejected = predict(batch.column("text").to_pylist(), model)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)],
                                          ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return in_batches(documents.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text"), work,
                      "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
