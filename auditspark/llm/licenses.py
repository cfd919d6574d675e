"""License notices: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A template is a row of different words, those of a notice in order. A block is a run of words of a text, at most ``SPREAD`` times as many as
the notice has; line breaks and comment signs are no words, so that a notice may wrap. A block meets a template if at least
``CONTAINED`` of the template's words stand in it in the template's order. So words of prose that happen to stand
near a notice do not complete another template. The join is exact:

- prefix: words are ordered by their frequency in the whole corpus, rare ones first. A block that meets a template of
  n words must hold one of its first n - needed + 1 words. An index leads from these words to their templates, so that only pairs of a
  text and a template that share one are looked at, however many templates there are.
- length: a pair whose text holds fewer of the template's words than are needed is dropped, and so is a block with fewer places.
- position: if the rarest word that a block holds is the template's word number i, at most n - i + 1 words are common. Blocks that
  cannot reach the number needed are dropped.

What is left is counted exactly, as the longest rising run of template places. Templates are the caller's table, a bounded one; the
corpus frequencies are those of its words only, and no text leaves its task.

Null and empty texts have no words, no places and score 0. A block that is repeated counts as often as it stands, and of equal
scores any one is the result. Rows that repeat have equal results; a template without words is never met. Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.batches import in_batches, pieces, prepare, whole_windows, windows

CONTAINED = 0.8
#: words of a block for each word of a notice
SPREAD = 2

# fixed values: phrases and their labels
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: notices in words of our own or of common use, and the labels that they give
TEMPLATES = [
    ("template:apache", "licensed under the apache license version"),
    ("template:bsd", "redistribution and use in source and binary forms are permitted"),
    ("template:cc", "licensed under cc by"),
    ("template:copyright", "copyright all rights reserved"),
    ("template:creative-commons", "licensed under a creative commons attribution license"),
    ("template:gpl", "licensed under the gnu general public license version"),
    ("template:mit", "released under the mit license"),
    ("template:mozilla", "subject to the terms of the mozilla public license"),
    ("template:public-domain", "released into the public domain"),
]

#: longer passages of notices, which fill several lines
PASSAGES = [
    ("template:gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                     "license as published by the free software foundation"),
    ("template:isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("template:mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                     "documentation files the software to deal in the software without restriction including without limitation the rights "
                     "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
                     "whom the software is furnished to do so subject to the following conditions"),
    ("template:warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the "
                          "warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("template:warranty", "this software is provided by the copyright holders and contributors as is and any express or implied warranties "
                          "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
                          "disclaimed"),
]

TERM = np.ones(256, bool)
TERM[0x00:0x30] = TERM[0x3A:0x61] = TERM[0x7B:0x80] = False


def _words(texts: list[str]) -> list[list[str]]:
    """Words of short ASCII texts of our own."""
    return [t.lower().split() for t in texts]


def _hash(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    piece = next(pieces(pa.array([" ".join(words)])))
    return piece.hashes(*piece.spans(TERM)[:2])


class Index(NamedTuple):
    """Template words as sorted hashes with their ranks, rare ones first, and the templates that lead from them.

    ``ranks`` of a template are sorted, ``order`` has the place in the notice of each of these, ``needed`` and ``width`` the least number of
    common words and the words of a block. ``heads`` are the prefix words of all templates, sorted, and ``owners`` their templates.
    """

    labels: list[str]
    words: np.ndarray
    rank: np.ndarray
    ranks: list[np.ndarray]
    order: list[np.ndarray]
    needed: list[int]
    width: list[int]
    heads: np.ndarray
    owners: np.ndarray

    @staticmethod
    def of(templates: list[tuple[str, str]], frequency: dict[int, int]) -> Index:
        listed = [_hash(w) for w in _words([t for _, t in templates])]
        words = np.unique(np.concatenate([np.zeros(0, np.uint64), *listed]))
        counts = np.array([frequency.get(int(w), 0) for w in words.view(np.int64)], np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, counts))] = np.arange(len(words))
        ranks, order, needed = [], [], []
        for own in listed:
            different, first = np.unique(own, return_index=True)
            place = np.argsort(np.argsort(first))
            of = rank[np.searchsorted(words, different)]
            ranks.append(np.sort(of))
            order.append(place[np.argsort(of)])
            needed.append(math.ceil(CONTAINED * len(different) - 1e-9))
        prefix = [r[:len(r) - n + 1] if len(r) else r for r, n in zip(ranks, needed)]
        heads = np.concatenate([np.zeros(0, np.int64), *prefix])
        owners = np.repeat(np.arange(len(prefix)), [len(p) for p in prefix])
        by = np.argsort(heads, kind="stable")
        return Index([name for name, _ in templates], words, rank, ranks, order, needed, [SPREAD * len(w) for w in listed], heads[by], owners[by])

    def rank_of(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each hash, all of template words."""
        return self.rank[np.searchsorted(self.words, hashes)]


def _lookup(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which hashes are among the sorted words; most are told apart by a table of their upper bits."""
    maybe = np.zeros(1 << 16, bool)
    maybe[words >> np.uint64(48)] = True
    near = np.flatnonzero(maybe[hashes >> np.uint64(48)])
    return near[np.isin(hashes[near], words)]


def frequencies(documents: DataFrame, templates: list[tuple[str, str]]) -> dict[int, int]:
    """How often each template word stands in all documents; one row per template word comes to the driver."""
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_hash(w) for w in _words([t for _, t in templates]))]))

    def work(batch):
        found = [np.zeros(0, np.uint64)]
        for piece in pieces(batch.column("text")):
            piece = piece.lowered()
            starts, ends, _ = piece.spans(TERM)
            hashes = piece.hashes(starts, ends)
            found.append(hashes[_lookup(hashes, known)])
        word, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    counted = in_batches(documents.select("text"), work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def _rising(places: list[int]) -> int:
    """Length of the longest strictly rising run of places, others left out."""
    ends: list[int] = []
    for p in places:
        at = bisect_left(ends, p)
        ends[at:at + 1] = [p]
    return len(ends)


def join(text: np.ndarray, place: np.ndarray, rank: np.ndarray, index: Index) -> list[tuple[int, int, int]]:
    """(text, template, most common words of a block) for every text with a block that meets the threshold.

    ``text``, ``place`` and ``rank`` are the places of template words, in order.
    """
    out: list[tuple[int, int, int]] = []
    low, high = np.searchsorted(index.heads, rank), np.searchsorted(index.heads, rank, "right")
    n = high - low
    owner = index.owners[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)]
    pairs = np.unique(np.repeat(text, n) * len(index.labels) + owner)
    begin, end = np.searchsorted(text, pairs // max(len(index.labels), 1)), np.searchsorted(text, pairs // max(len(index.labels), 1), "right")
    for pair, a, b in zip(pairs.tolist(), begin.tolist(), end.tolist()):
        i, t = divmod(pair, len(index.labels))
        own, needed = index.ranks[t], index.needed[t]
        at = np.searchsorted(own, rank[a:b])
        held = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == rank[a:b])
        if len(held) < needed:
            continue
        number, spots = at[held], place[a + held]
        last = np.searchsorted(spots, spots + index.width[t])
        rare = np.concatenate([[0], np.cumsum(number <= len(own) - needed)])
        starts = np.arange(len(held))
        # length, and position: a block has a word that leaves enough common ones
        starts = starts[(last - starts >= needed) & (rare[last] > rare[:-1])]
        order, most = index.order[t][number].tolist(), 0
        for k in starts.tolist():
            if most == len(own):
                break
            most = max(most, _rising(order[k:last[k]]))
        if most >= needed:
            out.append((i, t, most))
    return out


def _judge(piece, index: Index):
    piece = piece.lowered()
    starts, ends, text = piece.spans(TERM)
    hashes = piece.hashes(starts, ends)
    first = np.searchsorted(text, np.arange(piece.n + 1))
    spots = [np.zeros(0, np.int64)]
    labels: list[set] = [set() for _ in range(piece.n)]
    for phrase, label in PHRASES:
        words = _hash(phrase.split())
        begin = whole_windows(text, len(words))
        found = begin[windows(hashes, text, len(words))[begin] == windows(words, np.zeros(len(words)), len(words))[0]]
        for i in np.unique(text[found]):
            labels[i].add(label)
        spots.append(found)
    spots = np.sort(np.concatenate(spots))
    n_base = np.bincount(text[spots], minlength=piece.n)
    low, high = np.searchsorted(spots, first[:-1]), np.searchsorted(spots, first[1:]) - 1
    score = np.where(n_base > 0, 1.0, 0.0)
    base = [",".join(sorted(x)) for x in labels]

    known = _lookup(hashes, index.words) if len(index.words) else np.zeros(0, np.int64)
    for i, t, c in join(text[known], known, index.rank_of(hashes[known]), index):
        labels[i].add(index.labels[t])
        score[i] = max(score[i], c / len(index.ranks[t]))
    return {
        "n_words": np.diff(first), "n_base": n_base, "score": score, "base_labels": base,
        "first_word": [int(spots[l] - first[i]) if n_base[i] else None for i, l in enumerate(low)],
        "last_word": [int(spots[h] - first[i]) if n_base[i] else None for i, h in enumerate(high)],
        "labels": [",".join(sorted(x)) for x in labels],
    }


def scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES + PASSAGES) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every document.

    The score is the largest containment of a template in a block, and 1 where a phrase stands.
    """
    prepare(documents.sparkSession)
    index = Index.of(templates, frequencies(documents, templates))
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}

    def work(batch):
        parts = [_judge(piece, index) for piece in pieces(batch.column("text"))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([x for p in parts for x in p[c]], kind) for c, kind in kinds.items())], ["doc_id", *kinds])

    return in_batches(documents.select(F.col("doc_id").cast("long"), "text"), work,
                      "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
