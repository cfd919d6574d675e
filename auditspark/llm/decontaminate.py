"""Copies of benchmark items in training texts: rare n-gram seeds, then Smith-Waterman alignment.

1. All documents are counted for the word n-grams of the items: in how many documents does each stand?
2. An item's seeds are the rarer ones among its own n-grams. The rule compares an item's n-grams with each other, so an
   item that was copied into a third of all documents still has its seeds.
3. Wherever a document has a seed, the words around it are aligned with the item. Matches add 2, other pairs and gaps
   take 1; the best local score over twice the item's length is the score, and ``THRESHOLD`` of it makes a leak. Edited
   copies keep most matches, while passages that share one phrase with an item stay far below.

Items are the query set: they go to the tasks in blocks of about ``BLOCK`` items, one pass over the texts for each
block. Documents are never shuffled.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z have become a-z, so punctuation and case do not count; of scripts
that are written without spaces (``_alone``) each character is a word, so that their items have seeds inside running text. An
item of fewer words than a seed has its whole sequence as its one seed, and leaks wherever that stands. Null and empty
texts have no words and no leaks, and an item without words is in no document. Of places with equal scores the first is told. Rows that repeat
are reported as often as they occur; an item_id that repeats is reported once for a document, by its best score. Other
columns are not read, or pass through ``clean`` untouched.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.batches import in_batches, pieces, prepare, whole_windows, windows

SEED = 3
#: seeds are the n-grams of an item that stand in no more documents than this share of its n-grams
RARE = 0.75
THRESHOLD = 0.5
#: items that are searched for in one pass
BLOCK = 5_000
#: words that an edited copy may be longer on either side
SLACK = 12

TERM = np.ones(256, bool)
TERM[0x00:0x30] = TERM[0x3A:0x61] = TERM[0x7B:0x80] = False


class Items(NamedTuple):
    """A block of items: their words as hashes, sorted n-grams with the item and place of each, and how long n-grams are."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray
    widths: list[int]

    @staticmethod
    def of(ids: list, texts: list) -> Items:
        words, grams, item, place = [], [], [], []
        for piece in pieces(pa.array(texts, pa.string())):
            hashes, text = _words(piece)
            first = np.searchsorted(text, np.arange(piece.n + 1))
            sizes = np.diff(first)
            words += [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
            for width in range(1, SEED + 1):
                begin = whole_windows(text, width)
                own = sizes[text[begin]]
                begin = begin[own >= SEED] if width == SEED else begin[own == width]
                grams.append(windows(hashes, text, width)[begin])
                item.append(text[begin] + piece.first)
                place.append(begin - first[text[begin]])
        widths = sorted({min(len(w), SEED) for w in words if len(w)})
        return Items._sorted(ids, words, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, item, place)), widths)

    @staticmethod
    def _sorted(ids, words, grams, item, place, widths) -> Items:
        order = np.argsort(grams, kind="stable")
        grams = grams[order].astype(np.uint64)
        maybe = np.zeros(1 << 20, bool)
        maybe[grams >> np.uint64(44)] = True
        return Items(ids, words, grams, item[order], place[order], maybe, widths)

    def seeds(self, documents_with: dict[int, int]) -> Items:
        """Only the rarer n-grams of each item."""
        counts = np.array([documents_with.get(int(g), 0) for g in self.grams.view(np.int64)], np.int64)
        keep = np.zeros(len(counts), bool)
        for i in range(len(self.ids)):
            own = np.flatnonzero(self.item == i)
            if len(own):
                keep[own] = counts[own] <= np.sort(counts[own])[math.ceil(RARE * len(own)) - 1]
        return Items._sorted(self.ids, self.words, self.grams[keep], self.item[keep], self.place[keep], self.widths)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``grams`` that are known, and the first place of each in the sorted n-grams."""
        near = np.flatnonzero(self.maybe[grams >> np.uint64(44)])
        at = np.searchsorted(self.grams, grams[near])
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == grams[near][known]
        return near[known], at[known]


def _alone(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each character of a script without spaces: kana and Han, Thai and Lao, Burmese, Khmer."""
    lead = np.flatnonzero(data >= 0xE0)
    a, b = data[lead], data[lead + 1]
    alone = (a >= 0xE3) & (a <= 0xE9) | (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xF0) & (b >= 0xA0) & (b <= 0xAF)
    alone |= (a == 0xE1) & ((b >= 0x80) & (b <= 0x82) | (b == 0x9E) | (b == 0x9F))
    return lead[alone], lead[alone] + np.where(a[alone] == 0xF0, 4, 3)


def _words(piece) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word."""
    piece = piece.lowered()
    starts, ends, text = piece.spans(TERM)
    begin, end = _alone(piece.data)
    if len(begin):
        parts = np.union1d(starts, np.concatenate([begin, end[~np.isin(end, ends)]]))
        ends = np.minimum(ends[np.searchsorted(starts, parts, "right") - 1], np.append(parts[1:], len(piece.data)))
        starts, text = parts, piece.text_of(parts)
    return piece.hashes(starts, ends), text


def _terms(piece, widths: list[int]):
    """Words and texts, and the first word and hash of each n-gram of the lengths that the items need."""
    hashes, text = _words(piece)
    begin = [whole_windows(text, width) for width in widths]
    grams = [windows(hashes, text, width)[of] for width, of in zip(widths, begin)]
    return hashes, text, np.concatenate(begin), np.concatenate(grams)


def align(windows_: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each window with its item, and the window word at which it ends."""
    n, wide, tall = len(items), max(map(len, windows_)), max(map(len, items))
    text, item = np.zeros((n, wide), np.uint64), np.ones((n, tall), np.uint64)
    for i, (w, t) in enumerate(zip(windows_, items)):
        text[i, :len(w)] = w | np.uint64(2)
        item[i, :len(t)] = t | np.uint64(2)
    steps = np.arange(wide, dtype=np.int32)
    row, best, end = np.zeros((n, wide + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for k in range(tall):
        diagonal = row[:, :-1] + np.where(text == item[:, k:k + 1], 2, -1)
        reached = np.maximum(np.maximum(diagonal, row[:, 1:] - 1), 0)
        reached = np.maximum.accumulate(reached + steps, axis=1) - steps
        top = reached.argmax(axis=1)
        value = reached[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
        row[:, 1:] = reached
    return best, end


def _count(documents: DataFrame, items: Items) -> dict[int, int]:
    """In how many documents each n-gram of the block stands; at most one row per n-gram comes to the driver."""

    def work(batch):
        found = [np.zeros(0, np.int64)]
        for piece in pieces(batch.column("text")):
            _, text, begin, grams = _terms(piece, items.widths)
            near, at = items.hits(grams)
            pairs = np.unique(np.column_stack([text[begin[near]], at]), axis=0)
            found.append(pairs[:, 1])
        at, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(items.grams.view(np.int64)[at]), pa.array(n.astype(np.int64))], ["gram", "n"])

    counted = in_batches(documents.select("text"), work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counted.collect()}


def _passages(hashes, text, begin, grams, items):
    """(text, item, first word, end word) around the seeds of an item that stand near each other."""
    near, at = items.hits(grams)
    spread = [np.zeros((0, 3), np.int64)]
    while len(near):
        spread.append(np.column_stack([text[begin[near]], items.item[at], begin[near] - items.place[at]]))
        at = at + 1
        more = at < len(items.grams)
        more[more] = items.grams[at[more]] == grams[near][more]
        near, at = near[more], at[more]
    found = np.unique(np.concatenate(spread), axis=0)
    if not len(found):
        return
    size = np.array([len(w) for w in items.words])[found[:, 1]]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1]) | (found[1:, 2] - found[:-1, 2] > size[1:] // 2 + SLACK)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(found)) - 1
    edges = np.searchsorted(text, np.arange(text[-1] + 2))
    for a, b in zip(first, last):
        owner, item, start = found[a]
        low = max(edges[owner], start - SLACK)
        yield owner, item, low, min(edges[owner + 1], found[b, 2] + size[a] + SLACK)


def _leaks_of(column, items: Items) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, last word): the best place of each item in each text, if it is a leak."""
    out: dict[tuple[int, object], tuple] = {}
    for piece in pieces(column):
        hashes, text, begin, grams = _terms(piece, items.widths)
        if not len(begin):
            continue
        edges = np.searchsorted(text, np.arange(piece.n + 1))
        places = sorted(_passages(hashes, text, begin, grams, items), key=lambda p: len(items.words[p[1]]))
        for k in range(0, len(places), 128):
            part = places[k:k + 128]
            score, end = align([hashes[p[2]:p[3]] for p in part], [items.words[p[1]] for p in part])
            score = score / np.array([2 * len(items.words[p[1]]) for p in part])
            good = [i for i in range(len(part)) if score[i] >= THRESHOLD]
            if not good:
                continue
            ends = [part[i][2] + int(end[i]) for i in good]
            back = align([hashes[part[i][2]:e + 1][::-1] for i, e in zip(good, ends)], [items.words[part[i][1]][::-1] for i in good])[1]
            for i, e, b in zip(good, ends, back):
                owner, item = int(part[i][0]), int(part[i][1])
                key = (piece.first + owner, items.ids[item])
                row = (float(score[i]), int(e - b - edges[owner]), int(e - edges[owner]))
                if key not in out or (-row[0], row[1]) < (-out[key][0], out[key][1]):
                    out[key] = row
    return [(*key, *row) for key, row in out.items()]


def _blocks(documents: DataFrame, benchmark: DataFrame):
    """The items in blocks, each with its seeds."""
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    n = math.ceil(wanted.count() / BLOCK)
    for k in range(n):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        items = Items.of([r["item_id"] for r in rows], [r["text"] for r in rows])
        if len(items.grams):
            yield items.seeds(_count(documents, items))


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, score, first_word, last_word)`` for each item that a document holds a copy of."""
    prepare(documents.sparkSession)
    schema = "doc_id long, item_id long, score double, first_word long, last_word long"
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = documents.sparkSession.createDataFrame([], schema)
    for items in _blocks(slim, benchmark):

        def work(batch, items=items):
            found = _leaks_of(batch.column("text"), items)
            ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([ids, *(pa.array([f[i + 1] for f in found], kinds[i]) for i in range(4))],
                                              ["doc_id", "item_id", "score", "first_word", "last_word"])

        out = out.union(in_batches(slim, work, schema))
    return out


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, that hold no copy of an item."""
    prepare(documents.sparkSession)
    out = documents
    for items in _blocks(documents.select("text"), benchmark):

        def work(batch, items=items):
            keep = np.ones(batch.num_rows, bool)
            keep[[f[0] for f in _leaks_of(batch.column("text"), items)]] = False
            return batch.filter(pa.array(keep))

        out = in_batches(out, work, documents.schema)
    return out
