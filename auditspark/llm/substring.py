"""Repeated passages by fixed-block anchors: blocks are indexed, every rolling window probes, hits are extended.

A repeat of ``WIDTH`` words holds at least one whole block when each text is cut into blocks of ``BLOCK`` words that do
not overlap, as 2 * 7 - 1 = 13.

1. Texts are dealt to *homes* by a hash of id and text. A home turns its texts into keys: those of the blocks, which are
   the index, and those of all rolling windows of ``BLOCK`` words, which are the probes. Each key leaves a home once, however often
   it stands there, and goes to a *bucket*, a range of keys. A bucket answers which keys are *anchors*: a block in
   some text, and present in another document.
2. The home extends each anchor to both sides, to all windows of ``WIDTH`` words around it, and sends each such window once, with
   the smallest doc_id that it has there. Buckets answer with the smallest doc_id of all homes.
3. A window is a repeat if it stands in a document with a smaller doc_id. Neighbouring ones run together to the
   maximal repeat.

Pairs of places are never made: a passage that a third of all documents share costs a key for each home and word. Homes and
buckets are twice as many as the partitions of the shuffle, which are at least those of the scan, so that a home
holds the texts of half an input split. The texts are shuffled once for all three steps. Anchors are 48-bit keys: a false one
costs a needless extension. Windows are told apart by 96 bits of hash.

Words stay as they are. Nulls, empty texts and texts of fewer than ``WIDTH`` words repeat nothing. Rows that share a doc_id, ties,
do not take words from each other. A null doc_id counts as larger than all others. Columns other than the two named are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.batches import WORD, pieces, prepare, rolled, whole_windows
from auditspark.llm.packing import doubled, from_planes, from_sorted, run_starts, sorted_planes, planes
from auditspark.session import shuffle_partitions

#: words of the shortest repeat
WIDTH = 13
#: words of an index block; a repeat holds a whole one
BLOCK = (WIDTH + 1) // 2
#: bits of an anchor's key
KEY_BITS = 48
NO_ID = np.iinfo(np.int64).max

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

MESSAGE = "bucket int, home int, keys binary, checks binary, least binary, flags binary"
ALIGNED, SEVERAL = 1, 2


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


class _Texts:
    """Words of a piece of a home's texts, in texts that are long enough to hold a repeat or, on demand, in all."""

    def __init__(self, piece):
        self.piece = piece
        self.starts, self.ends, self.text = piece.spans(WORD)
        self.hashes = piece.hashes(self.starts, self.ends)
        self.counts = np.bincount(self.text, minlength=piece.n)
        self.first = np.cumsum(self.counts) - self.counts
        self.whole = whole_windows(self.text, WIDTH)

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and key of every rolling window of a block's width in texts that can hold a repeat."""
        begin = whole_windows(self.text, BLOCK)
        begin = begin[self.counts[self.text[begin]] >= WIDTH]
        return begin, rolled(self.hashes, BLOCK, BASES[0])[begin] >> np.uint64(64 - KEY_BITS)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Key and check of every window, for the begins in ``whole``."""
        check = rolled(self.hashes, WIDTH, BASES[2])[self.whole] >> np.uint64(32)
        return rolled(self.hashes, WIDTH, BASES[1])[self.whole], check.astype(np.uint32)


def _messages(home: int, bits: int, buckets: int, keys, checks, least, flags) -> pa.Table:
    """A row for each bucket that has keys; ``keys`` are sorted."""
    edges = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    rows = [(int(b), home, sorted_planes(keys[i:j]), None if checks is None else planes(checks[i:j]), None if least is None else planes(least[i:j]), flags[i:j].tobytes())
            for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
    return _table(rows)


def _table(rows) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 6
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], ["bucket", "home", "keys", "checks", "least", "flags"])


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    parts = [from_planes(x, kind) for x in table.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _sorted_keys(table: pa.Table) -> list[np.ndarray]:
    return [from_sorted(x) for x in table.column("keys").to_pylist()]


def _asked_keys(buckets: int):
    """Step 1 in a home: its distinct block and probe keys."""

    def ask(key, table):
        ids, found = _ids(table), []
        for piece in pieces(table.column("text")):
            texts = _Texts(piece)
            begin, keys = texts.probes()
            aligned = (begin - texts.first[texts.text[begin]]) % BLOCK == 0
            found.append((keys, aligned, ids[piece.first + texts.text[begin]]))
        keys, aligned, doc = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(keys, kind="stable")
        keys, aligned, doc = keys[order], aligned[order], doc[order]
        at = run_starts(keys)
        if not len(at):
            return _table([])
        several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        flags = ALIGNED * np.logical_or.reduceat(aligned, at) + SEVERAL * several
        return _messages(key[0].as_py(), KEY_BITS, buckets, keys[at], None, None, flags.astype(np.uint8))

    return ask


def _anchors(key, table):
    """Step 1 in a bucket: which keys are anchors, told to the homes that have them."""
    parts = _sorted_keys(table)
    home = np.repeat(table.column("home").to_numpy(), [len(p) for p in parts])
    keys, flags = np.concatenate(parts), _joined(table, "flags", np.uint8)
    order = np.argsort(keys, kind="stable")
    at = run_starts(keys[order])
    n = np.diff(np.append(at, len(keys)))
    seen = np.bitwise_or.reduceat(flags[order], at)
    live = (seen & ALIGNED > 0) & ((seen & SEVERAL > 0) | (n > 1))
    chosen = np.sort(order[np.repeat(live, n)])
    return _answers(key[0].as_py(), home[chosen], keys[chosen], None, None)


def _answers(bucket: int, home, keys, checks, least) -> pa.Table:
    """A row for each home; its keys are sorted within each home."""
    at = np.append(run_starts(home), len(home))
    return _table([(bucket, int(home[i]), sorted_planes(keys[i:j]), None if checks is None else planes(checks[i:j]), None if least is None else planes(least[i:j]), None)
                   for i, j in zip(at[:-1], at[1:])])


def _asked_windows(buckets: int):
    """Step 2 in a home: the windows around anchors, each with its smallest doc_id here."""

    def ask(key, texts_table, answers):
        if not answers.num_rows or not texts_table.num_rows:
            return _table([])
        live = np.sort(np.concatenate(_sorted_keys(answers)))
        ids, found = _ids(texts_table), []
        for piece in pieces(texts_table.column("text")):
            texts = _Texts(piece)
            begin, probes = texts.probes()
            near = np.zeros(len(texts.text) + WIDTH + 1, np.int64)
            at = np.minimum(np.searchsorted(live, probes), len(live) - 1)
            near[begin[live[at] == probes] + 1] = 1
            near = np.cumsum(near)
            around = near[texts.whole + (WIDTH - BLOCK + 1)] > near[texts.whole]
            keys, checks = texts.windows()
            found.append((keys[around], checks[around], ids[piece.first + texts.text[texts.whole[around]]]))
        keys, checks, doc = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((checks, keys))
        keys, checks, doc = keys[order], checks[order], doc[order]
        at = run_starts(keys, checks)
        if not len(at):
            return _table([])
        least = np.minimum.reduceat(doc, at)
        flags = SEVERAL * (least != np.maximum.reduceat(doc, at))
        return _messages(key[0].as_py(), 64, buckets, keys[at], checks[at], least, flags.astype(np.uint8))

    return ask


def _first_places(key, table):
    """Step 2 in a bucket: the smallest doc_id of each window, told to the homes that have a larger one too."""
    parts = _sorted_keys(table)
    home = np.repeat(table.column("home").to_numpy(), [len(p) for p in parts])
    keys, checks = np.concatenate(parts), _joined(table, "checks", np.uint32)
    own, flags = _joined(table, "least", np.int64), _joined(table, "flags", np.uint8)
    order = np.lexsort((checks, keys))
    at = run_starts(keys[order], checks[order])
    n = np.diff(np.append(at, len(keys)))
    least = np.empty_like(own)
    least[order] = np.repeat(np.minimum.reduceat(own[order], at), n)
    chosen = np.flatnonzero((least < own) | (flags & SEVERAL > 0))
    return _answers(key[0].as_py(), home[chosen], keys[chosen], checks[chosen], least[chosen])


REPEATS = "array<struct<first_word:int,last_word:int,seen_in:bigint>>"
RESULT = f"doc_id long, n_words long, repeats {REPEATS}, text string"


def _kept(texts: _Texts, removed: np.ndarray) -> pa.Array:
    """The words that are not removed, joined by single spaces, for each text."""
    piece, n = texts.piece, texts.piece.n
    stays = ~removed
    starts, ends, text = texts.starts[stays], texts.ends[stays], texts.text[stays]
    edge = np.zeros(len(piece.data) + 2, np.int8)
    edge[starts] = 1
    inner = np.zeros(len(text), bool)
    inner[:-1] = text[1:] == text[:-1]
    edge[ends + inner] -= 1  # with the byte after a word, unless it is the last one
    keep = np.cumsum(edge[:len(piece.data)]) > 0
    data = piece.data.copy()
    data[ends[inner]] = 0x20
    sizes = np.bincount(text, weights=ends - starts + inner, minlength=n).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data[keep].tobytes())).cast(pa.string())


def _cleaned(key, texts_table, answers):
    """Step 3 in a home: maximal repeats and what is left of each text."""
    ids, doc_id = _ids(texts_table), texts_table.column("doc_id").combine_chunks()
    seen_keys, seen_checks = np.concatenate([np.zeros(0, np.uint64), *_sorted_keys(answers)]), _joined(answers, "checks", np.uint32)
    order = np.lexsort((seen_checks, seen_keys))
    seen_keys, seen_checks, seen_least = seen_keys[order], seen_checks[order], _joined(answers, "least", np.int64)[order]
    out = []
    for piece in pieces(texts_table.column("text")):
        texts = _Texts(piece)
        n = len(texts.text)
        least = np.full(len(texts.whole), NO_ID)
        if len(seen_keys) and len(texts.whole):
            keys, checks = texts.windows()
            at, end = np.searchsorted(seen_keys, keys), np.searchsorted(seen_keys, keys, "right")
            while True:  # nearly always one step: windows that share a key but not a check are next to each other
                open_ = at < end
                hit = open_.copy()
                hit[open_] = seen_checks[at[open_]] == checks[open_]
                least[hit] = seen_least[at[hit]]
                at = np.where(hit, end, at + 1)
                if not (at < end).any():
                    break
        again = least < ids[piece.first + texts.text[texts.whole]]
        begin = texts.whole[again]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + WIDTH, -1)
        removed = np.cumsum(cover)[:n] > 0
        # runs of removed words of one text
        head = removed.copy()
        head[1:] &= ~removed[:-1] | (texts.text[1:] != texts.text[:-1])
        tail = removed.copy()
        tail[:-1] &= ~removed[1:] | (texts.text[1:] != texts.text[:-1])
        first, last = np.flatnonzero(head), np.flatnonzero(tail)
        source = least[again][np.searchsorted(begin, first)] if len(first) else np.zeros(0, np.int64)
        of = texts.text[first]
        spans = pa.StructArray.from_arrays([pa.array((first - texts.first[of]).astype(np.int32)), pa.array((last - texts.first[of]).astype(np.int32)), pa.array(source)],
                                           ["first_word", "last_word", "seen_in"])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=piece.n))]).astype(np.int32)
        out.append(pa.table([doc_id.slice(piece.first, piece.n), pa.array(texts.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), spans), _kept(texts, removed)],
                            ["doc_id", "n_words", "repeats", "text"]))
    return pa.concat_tables(out)


def without_repeats(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_words, repeats, text)`` for every row of ``documents(doc_id, text)``.

    ``text`` is what is left, joined by single spaces. ``repeats`` holds the removed runs of words, counted from 0, in order,
    each with the smallest doc_id where its first window stands.
    """
    spark = prepare(documents.sparkSession)
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(shuffle_partitions(spark), slim.rdd.getNumPartitions())
    n = doubled(parts)
    texts = slim.withColumn("home", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(parts, "home")
    of_home = texts.groupBy("home")
    keys = of_home.applyInArrow(_asked_keys(n), MESSAGE).groupBy("bucket").applyInArrow(_anchors, MESSAGE)
    windows = of_home.cogroup(keys.groupBy("home")).applyInArrow(_asked_windows(n), MESSAGE)
    places = windows.groupBy("bucket").applyInArrow(_first_places, MESSAGE)
    return of_home.cogroup(places.groupBy("home")).applyInArrow(_cleaned, RESULT)
