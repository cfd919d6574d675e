"""Counts of words, signs and repeats in whole texts or in their lines, for all texts of a piece at once."""

from __future__ import annotations

import numpy as np

from auditspark.llm.batches import WORD, Piece, mix, whole_windows, windows


def _marks(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SYMBOLS = _marks(b"#*$%&|<>")
UPPER = _marks(bytes(range(0x41, 0x5B)))
LOWER = _marks(bytes(range(0x61, 0x7B)))
DIGITS = _marks(b"0123456789")
ALNUM = UPPER | LOWER | DIGITS
ALNUM[0x80:] = True
SHOUTS = _marks(b"!")
ENDS = _marks(b".?,;:")

#: what ``shares`` returns for each segment
NAMES = ("log_words", "word_length", "symbols", "shouts", "capitals", "digits", "bare_words", "ended_words", "same_words", "empty")


class Words:
    """The words of a piece and their hashes."""

    def __init__(self, piece: Piece):
        self.piece = piece
        self.starts, self.ends, self.text = piece.spans(WORD)
        self.hashes = piece.hashes(self.starts, self.ends)
        self.counts = np.bincount(self.text, minlength=piece.n)

    def repeated(self, width: int = 3) -> np.ndarray:
        """Per text, its words inside windows of ``width`` words that stand in it twice or more."""
        begin = whole_windows(self.text, width)
        owner = self.text[begin]
        key = mix(windows(self.hashes, self.text, width)[begin] + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(begin), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        marked = np.zeros(len(self.text), bool)
        for step in range(width):
            marked[begin[twice] + step] = True
        return np.bincount(self.text[marked], minlength=self.piece.n)


def shares(words: Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of ``NAMES`` for each segment of bytes; segments are in order, apart, and cut no word."""
    piece, data = words.piece, words.piece.data

    def inside(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=sums[1:])
        return sums[ends] - sums[starts]

    low, high = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    n = high - low

    def of_words(marked: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=sums[1:])
        return sums[high] - sums[low]

    alnum = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ALNUM[data], out=alnum[1:])
    bare = alnum[words.ends] == alnum[words.starts]
    same = np.zeros(len(words.text), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.text[1:] == words.text[:-1])
    ended = ENDS[data[words.ends - 1]] if len(words.ends) else np.zeros(0, bool)
    size, upper = inside(WORD), inside(UPPER)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(n, 1)
    return np.column_stack([
        np.log1p(n), np.log1p(size * per_word), inside(SYMBOLS) * per_byte, inside(SHOUTS) * per_byte,
        upper / np.maximum(upper + inside(LOWER), 1), inside(DIGITS) * per_byte, of_words(bare) * per_word,
        of_words(ended) * per_word, of_words(same) * per_word, n == 0]).astype(np.float64)
