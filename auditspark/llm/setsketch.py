"""SetSketch registers of word-shingle sets.

A register holds, on an exponential scale, the smallest of independent exponential values of a set's elements:
``1 - floor(log_b(minimum))`` between 0 and q + 1. Registers of a union are the larger ones of its parts, and two
registers are equal with about the Jaccard similarity of their sets, so that they can be banded like minimum hashes.
"""

from __future__ import annotations

import numpy as np

from auditspark.llm.batches import Piece, mix, whole_windows, windows

BASE = 1.001
RATE = 20.0
TOP = 65_534
BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
_STEP = 0x9E3779B97F4A7C15


def shingle_sets(piece: Piece, table: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Per text its distinct shingles as hashes, sorted, one text after the other; and where each text begins.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    starts, ends, text = piece.spans(table)
    hashes = piece.hashes(starts, ends)
    begin = whole_windows(text, width)
    found, owner = windows(hashes, text, width)[begin], text[begin]
    words = np.bincount(text, minlength=piece.n)
    for length in range(1, width):
        # a word count of its own keeps short sequences apart from each other and from full shingles
        first = np.flatnonzero(words[text] == length) if len(text) else np.zeros(0, np.int64)
        first = first[::length]
        if len(first):
            found = np.concatenate([found, mix(windows(hashes, text, length)[first] + np.uint64(length))])
            owner = np.concatenate([owner, text[first]])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    if len(found):
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(piece.n + 1))


def registers(elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers of each set ``elements[at[i]:at[i + 1]]``, as rows of 16-bit numbers; an empty set has zeros.

    Each element sends a Poisson stream of points, each to a register drawn at random, so that the first point of
    every register is an exponential value of its own. Points beyond a limit that all registers fall below with
    near certainty are not drawn; a set with a register still open is done again with a larger limit.
    """
    n = np.diff(at)
    out = np.zeros((len(n), REGISTERS), np.uint16)
    todo, factor = np.flatnonzero(n), np.log(REGISTERS) + 6
    while len(todo):
        owner = np.repeat(np.arange(len(todo)), n[todo])
        seed = np.concatenate([elements[at[i]:at[i + 1]] for i in todo])
        limit = (factor / (RATE * n[todo]))[owner]
        place = np.zeros(len(seed))
        slots, values, step = [], [], 0
        while len(seed):
            step += 1
            draw = mix(seed + np.uint64((_STEP * step) % (1 << 64)))
            place = place - np.log1p((draw >> np.uint64(24)).astype(np.float64) * -(2.0**-40)) / (RATE * REGISTERS)
            keep = place < limit
            seed, place, limit, owner, draw = seed[keep], place[keep], limit[keep], owner[keep], draw[keep]
            slots.append(owner * REGISTERS + (((draw & np.uint64(0xFFFFFF)) * np.uint64(REGISTERS)) >> np.uint64(24)).astype(np.int64))
            values.append(place)
        least = np.full(len(todo) * REGISTERS, np.inf)
        np.minimum.at(least, np.concatenate(slots), np.concatenate(values))
        least = least.reshape(len(todo), REGISTERS)
        done = np.isfinite(least).all(axis=1)
        level = np.floor(1 - np.log(np.maximum(least[done], 1e-300)) / np.log(BASE))
        out[todo[done]] = np.clip(level, 0, TOP + 1).astype(np.uint16)
        todo, factor = todo[~done], factor * 2
    return out


def bands(rows: np.ndarray) -> np.ndarray:
    """Per sketch one 64-bit key for each band of registers."""
    cut = rows.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_STEP), (len(rows), BANDS)).copy()
    for k in range(ROWS):
        keys = mix(keys + cut[:, :, k] * np.uint64(0xD1342543DE82EF95))
    return keys.view(np.int64)


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sets by maximum likelihood from all registers and the set sizes together.

    With shares u and v of the sizes, a left register is the larger one with probability p(u - v J), a right one
    with p(v - u J), where p(x) = -log_b(1 - x (b - 1) / b). The likelihood of the counts has one maximum over J.
    """
    more = (left > right).sum(axis=1).astype(float)
    less = (left < right).sum(axis=1).astype(float)
    same = left.shape[1] - more - less
    u = n_left / np.maximum(n_left + n_right, 1)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-12)

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        p, q = chance(u - v * j), chance(v - u * j)
        tiny = 1e-12
        return more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))

    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(24):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        up = likelihood(a) < likelihood(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2
