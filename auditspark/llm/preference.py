"""Quality scores by Bradley-Terry pairwise ranking.

Every document labelled good is set against every one labelled bad. Scores are linear in features of the whole text, and
their weights maximise the likelihood that the better one wins: logistic loss on the feature differences of all pairs. The
decision is a quantile of the scores of the fitted rows: the share of bad ones among all of them. Scores are moved so that
this quantile is ``THRESHOLD``.

Spark computes the features of all labelled rows once, and then, for each Newton step, adds them up by class and cell of the
score. What a pair adds depends on its two scores alone, so that sums of cells give the sums of all pairs; within a cell, it
is taken as linear in the score. All that is added up are whole numbers: no order of the rows changes a result.

A null or empty text has the features of no words and a score of its own like any other. Labels other than 0 and 1, and
labels of unknown documents, are left out. Without both labels every document scores 0.85 and is kept. Rows that repeat
score alike. Other columns than those named pass through ``kept`` untouched and are read by nothing.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.batches import in_batches, pieces, prepare
from auditspark.llm.samples import held_out
from auditspark.llm.textstats import NAMES, Words, shares
from auditspark.session import stored

#: features of a text
WIDTH = len(NAMES) + 4
#: parts of a standard deviation that the fit tells apart
UNIT = 1 << 14
#: cells of the score, narrow around 0 and wider away from it
CELLS = 512
#: score from which a document is good
THRESHOLD = 0.7
_RIDGE = 1e-3


def features(column) -> np.ndarray:
    """A row for each text of an Arrow column."""
    rows = []
    for piece in pieces(column):
        words = Words(piece)
        row = shares(words, piece.at[:-1], piece.at[1:])
        repeated = words.repeated() / np.maximum(words.counts, 1)
        rows.append(np.column_stack([row, repeated, np.sqrt(row[:, 2]), np.sqrt(row[:, 3]), np.sqrt(row[:, 8])]))
    return np.concatenate(rows) if rows else np.zeros((0, WIDTH))


def _moments(rows: DataFrame) -> dict:
    """Rows of each label, and mean and scale of each feature."""
    one = [F.col("row")[k] for k in range(WIDTH)]
    sums = [F.sum(x.cast("decimal(20,12)")).alias(f"x{k}") for k, x in enumerate(one)]
    squares = [F.sum((x * x).cast("decimal(24,16)")).alias(f"xx{k}") for k, x in enumerate(one)]
    found = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), *sums, *squares).collect()}
    counts = [found[k]["n"] if k in found else 0 for k in (0, 1)]

    def mean_of(name):
        return Fraction(sum(Fraction(r[name]) for r in found.values())) / sum(counts)

    if not all(counts):
        return {"counts": counts}
    means = [mean_of(f"x{k}") for k in range(WIDTH)]
    spread = [float(max(mean_of(f"xx{k}") - m * m, 0)) for k, m in enumerate(means)]
    return {"counts": counts, "mean": np.array([float(m) for m in means]), "scale": np.maximum(np.sqrt(spread), 1e-6)}


def _rows(batch) -> np.ndarray:
    return np.asarray(batch.column("row").flatten()).reshape(-1, WIDTH)


def _cell_sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """By label and cell of the score: rows, sums of their features in units, sums of the products of each two.

    A task keeps one table of the sums and passes on what is not 0.
    """
    first, second = np.triu_indices(WIDTH)
    size = 1 + WIDTH + len(first)
    per_cell = 2 * np.arcsinh(1e4) / CELLS

    def run(batches):
        sums = np.zeros((2 * CELLS, size), np.int64)
        for batch in batches:
            units = np.rint((_rows(batch) - mean) / scale * UNIT).astype(np.int64)
            if len(units):
                raw = (units / UNIT * weights).sum(axis=1)
                cell = np.clip(np.floor(np.arcsinh(raw) / per_cell).astype(np.int64) + CELLS // 2, 0, CELLS - 1)
                cell += CELLS * np.asarray(batch.column("label")).astype(np.int64)
                order = np.argsort(cell, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(cell[order]) > 0])
                units = units[order]
                parts = np.column_stack([np.ones(len(units), np.int64), units, units[:, first] * units[:, second]])
                sums[cell[order][starts]] += np.add.reduceat(parts, starts, axis=0)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], ["at", "value"])

    found = rows.mapInArrow(run, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    sums = np.zeros(2 * CELLS * size)
    sums[found.column("at").to_numpy()] = found.column("value").to_numpy()
    return sums.reshape(2, CELLS, size)


def _slope_and_curve(sums: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean log-likelihood over all pairs of a good and a bad row, without the ridge.

    Rows of a cell differ a little from its mean score; the slope takes that in by the products of their features.
    """
    first, second = np.triu_indices(WIDTH)
    n, total, raw, products = [], [], [], []
    for side in (sums[0][sums[0][:, 0] > 0], sums[1][sums[1][:, 0] > 0]):
        n.append(side[:, 0])
        total.append(side[:, 1:1 + WIDTH] / UNIT)
        raw.append(total[-1] @ weights / n[-1])
        square = np.zeros((len(side), WIDTH, WIDTH))
        square[:, first, second] = square[:, second, first] = side[:, 1 + WIDTH:] / UNIT ** 2
        products.append(square)
    (bad_n, good_n), (bad, good), pairs = n, total, n[0].sum() * n[1].sum()
    lose = 1 / (1 + np.exp(np.clip(raw[1][:, None] - raw[0][None, :], -30, 30)))
    bend = lose * (1 - lose)
    inside = [square @ weights - side * score[:, None] for square, side, score in zip(products, total, raw)]
    slope = (lose @ bad_n) @ good - (good_n @ lose) @ bad - (bend @ bad_n) @ inside[1] - (good_n @ bend) @ inside[0]
    cross = good.T @ bend @ bad
    curve = np.tensordot(bend @ bad_n, products[1], 1) + np.tensordot(good_n @ bend, products[0], 1) - cross - cross.T
    return slope / pairs, curve / pairs


def _ranked(values: DataFrame, rank: int) -> tuple[float, float]:
    """The values of ``values(raw)`` at ``rank`` in order, counted from 0, and after it: counts of ever narrower ranges."""
    low, high = values.agg(F.min("raw"), F.max("raw")).first()
    left = rank
    while low < high:
        inside = values.where(F.col("raw").between(low, high))
        bucket = F.width_bucket("raw", F.lit(low), F.lit(high), F.lit(4096)).alias("bucket")
        for r in sorted(inside.groupBy(bucket).agg(F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high")).collect(), key=lambda r: r["low"]):
            if left < r["n"]:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
    upto, after = values.agg(F.count_if(F.col("raw") <= low), F.min(F.when(F.col("raw") > low, F.col("raw")))).first()
    return low, low if upto > rank + 1 or after is None else after


def fit(rows: DataFrame) -> dict | None:
    """Weights and the raw score at the threshold from all ``rows(label, row)``; None if one label has no rows."""
    known = _moments(rows)
    if not all(known["counts"]):
        return None
    mean, scale = known["mean"], known["scale"]
    weights = np.zeros(WIDTH)
    for _ in range(30):
        slope, curve = _slope_and_curve(_cell_sums(rows, mean, scale, weights), weights)
        step = np.linalg.solve(curve + _RIDGE * np.eye(WIDTH), slope - _RIDGE * weights)
        weights = weights + step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break

    def raw_scores(batch):
        return pa.RecordBatch.from_arrays([pa.array(((_rows(batch) - mean) / scale * weights).sum(axis=1))], ["raw"])

    at, after = _ranked(in_batches(rows, raw_scores, "raw double"), known["counts"][0] - 1)
    return {"mean": mean, "scale": scale, "weights": weights, "middle": (at + after) / 2}


def score(rows: np.ndarray, model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(rows), 0.85)
    raw = (rows - model["mean"]) / model["scale"] @ model["weights"] - model["middle"]
    return 1 / (1 + np.exp(-np.clip(raw + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def train(documents: DataFrame, labels: DataFrame) -> dict | None:
    """Fit on all labelled rows outside the held-out fold; texts become features before they meet their labels."""
    prepare(documents.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(~held_out() & F.col("label").isin(0, 1))

    def work(batch):
        rows = features(batch.column("text"))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * WIDTH), pa.array(rows.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "row"])

    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & ~held_out())
    return fit(stored(in_batches(read, work, "doc_id long, row array<double>").join(known, "doc_id").select("label", "row"), "features"))


def scored(documents: DataFrame, model: dict | None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document."""
    prepare(documents.sparkSession)

    def work(batch):
        values = score(features(batch.column("text")), model)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"])

    return in_batches(documents.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text"), work,
                      "doc_id long, held_out boolean, score double, predicted int")


def kept(documents: DataFrame, model: dict | None) -> DataFrame:
    """The rows of ``documents``, all columns, that score as good."""
    prepare(documents.sparkSession)
    if "text" not in documents.columns:
        raise ValueError("documents have no text")

    def work(batch):
        return batch.filter(pa.array(score(features(batch.column("text")), model) >= THRESHOLD))

    return in_batches(documents, work, documents.schema)
