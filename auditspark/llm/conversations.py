"""Repair of the turn structure of conversations by the cheapest edits, found by Dijkstra's search from both ends.

A conversation is well formed if its roles are empty or ``s?(ua)+``, by initials. Its rows are read in the order of turns, and the
edit lattice has a node for each number of rows read and each state: nothing yet (E), after s, after u, after a.

    Keep (K)     0   the row's initial must be the next one of the pattern
    Rerole (R)   3   to user or assistant, as the pattern asks
    Delete (D)   4   the only way for blank rows and repeats
    Insert (I)   3   an empty user or assistant row, anywhere

A truncated row that stays costs 3 more. A forward heap starts before the first row and a reverse heap behind the last one. The heap
with the smaller top goes on until the tops together exceed the best crossing, so that every cheapest path
crosses from a settled forward node to a settled reverse node. No two edges of a node share a letter and no cheapest audit is
the beginning of another one; the least audit over all crossings is therefore read off by the least letter at
each node, without keeping texts of letters.

Rows are sorted by conversation and turn in the shuffle and stream through the tasks. A task holds about 100 bytes for each turn of the
conversation at hand, not its texts; these stream by once more when the edits are known. One conversation is one task's work, since its
repaired text is one digest.

Nulls in role and text are one space, hence such texts are blank. A null conv_id is a conversation of its own; null turns come
first. Rows with one turn are ordered by role, then by text, in UTF-8; equal rows are repeats. Very long texts need
no more than their own size. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.batches import prepare
from auditspark.session import shuffle_partitions

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

E, S, U, A = range(4)
#: state after a user or assistant row of the pattern
NEXT = (U, U, A, U)
#: states from which such a row leads to each state
BEFORE = ((), (), (E, S, A), (U,))
ROLE = {U: "user", A: "assistant"}
#: states after a kept row, by its initial
KEEP = {"s": {E: S}, "u": {E: U, S: U, A: U}, "a": {U: A}}

FINE, MUST_GO, CUT = 0, 1, 2


class _Lattice:
    """Edges of the lattice of rows with ``initials`` and ``faults``."""

    def __init__(self, initials: str, faults: bytes):
        self.initials, self.faults, self.n = initials, faults, len(faults)

    def after(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(letter, rows read, state, cost) of each edge that leaves a node."""
        if i < self.n:
            yield "D", i + 1, state, DELETE
        yield "I", i, NEXT[state], INSERT
        if i < self.n and self.faults[i] != MUST_GO:
            extra = TRUNCATED if self.faults[i] == CUT else 0
            kept = KEEP.get(self.initials[i], {}).get(state)
            if kept is not None:
                yield "K", i + 1, kept, extra
            yield "R", i + 1, NEXT[state], REROLE + extra

    def before(self, i: int, state: int) -> Iterator[tuple[int, int, int]]:
        """(rows read, state, cost) of each edge that enters a node."""
        for s in BEFORE[state]:
            yield i, s, INSERT
        if not i:
            return
        yield i - 1, state, DELETE
        if self.faults[i - 1] != MUST_GO:
            extra = TRUNCATED if self.faults[i - 1] == CUT else 0
            for s in BEFORE[state]:
                yield i - 1, s, REROLE + extra
            for s, kept in KEEP.get(self.initials[i - 1], {}).items():
                if kept == state:
                    yield i - 1, s, extra


FAR = 1 << 62


def cheapest(initials: str, faults: bytes) -> tuple[int, str]:
    """Cost and least audit of the cheapest edits of rows, given their roles' initials and their ``faults``."""
    lattice, n = _Lattice(initials, faults), len(faults)
    size = 4 * (n + 1)
    ahead, back = array("q", [FAR]) * size, array("q", [FAR]) * size
    from_start, from_end = bytearray(size), bytearray(size)
    settled = []
    ahead[E] = back[4 * n + E] = back[4 * n + A] = 0
    # nodes of equal cost leave the heaps in the order of rows, as only edges that read a row can be free
    forward, reverse = [(0, 0, E)], [(0, -n, E), (0, -n, A)]
    best = FAR
    while forward and reverse and forward[0][0] + reverse[0][0] <= best:
        if forward[0][0] <= reverse[0][0]:
            cost, i, state = heapq.heappop(forward)
            at = 4 * i + state
            if from_start[at]:
                continue
            from_start[at] = 1
            settled.append(at)
            best = min(best, cost + back[at])
            for _, j, s, step in lattice.after(i, state):
                if cost + step < ahead[4 * j + s]:
                    ahead[4 * j + s] = cost + step
                    best = min(best, cost + step + back[4 * j + s])
                    heapq.heappush(forward, (cost + step, j, s))
        else:
            cost, i, state = heapq.heappop(reverse)
            i = -i
            at = 4 * i + state
            if from_end[at]:
                continue
            from_end[at] = 1
            best = min(best, cost + ahead[at])
            for j, s, step in lattice.before(i, state):
                if cost + step < back[4 * j + s]:
                    back[4 * j + s] = cost + step
                    best = min(best, cost + step + ahead[4 * j + s])
                    heapq.heappush(reverse, (cost + step, -j, s))
    return best, _least_audit(lattice, ahead, back, from_start, from_end, settled, best)


def _least_audit(lattice, ahead, back, from_start, from_end, settled, best) -> str:
    """The least audit among all paths of cost ``best`` that cross from a settled forward to a settled reverse node."""
    marked, goals = bytearray(len(from_start)), (4 * lattice.n + E, 4 * lattice.n + A)

    def leads(at: int, edge) -> bool:
        """Whether an edge goes on along a cheapest path."""
        to, step = 4 * edge[1] + edge[2], edge[3]
        if from_end[to] and ahead[at] + step + back[to] == best:
            return True
        return bool(marked[to]) and ahead[at] + step == ahead[to]

    for at in reversed(settled):
        if ((from_end[at] or at in goals) and ahead[at] + back[at] == best) or any(leads(at, e) for e in lattice.after(at >> 2, at & 3)):
            marked[at] = 1
    audit, at = [], E
    while True:
        if at in goals and (ahead[at] == best if marked[at] else not back[at]):
            return "".join(audit)
        edges = lattice.after(at >> 2, at & 3)
        if marked[at]:
            edge = min(e for e in edges if leads(at, e))
        else:
            edge = min(e for e in edges if from_end[4 * e[1] + e[2]] and back[at] == e[3] + back[4 * e[1] + e[2]])
        audit.append(edge[0])
        at = 4 * edge[1] + edge[2]


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of each row that the edits of ``audit`` leave of ``rows``."""
    state = E
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            yield letter, ROLE[state], ""
            continue
        role, text = next(rows)
        if letter == "D":
            continue
        state = KEEP[role[0]][state] if letter == "K" else NEXT[state]
        yield letter, role if letter == "K" else ROLE[state], text


# --- tables -------------------------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"


def filled(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with one space for a null role or text."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *texts)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults made by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes out its ``[.!?]``, 3
    repeats it, 4 sets its role to user."""
    said = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    marked = filled(conversations).withColumn("fault", F.crc32(said.cast("binary")) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


ORDER = ["conv_id", "turn", "role", "text"]
FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = ("su", "ua", "au")


class _Open:
    """What is known of the conversation that streams by."""

    def __init__(self):
        self.initials, self.digests, self.blank, self.cut = [], [], [], []
        self.turns, self.low, self.high, self.illegal, self.end = 0, None, None, 0, None

    def add(self, turn, initials, digests, blank, cut) -> None:
        self.initials.append(initials)
        self.digests.append(digests)
        self.blank.append(blank)
        self.cut.append(cut)
        chain = initials if self.end is None else [self.end, *initials]
        self.illegal += sum(a + b not in LEGAL for a, b in zip(chain, chain[1:]))
        self.end = initials[-1]
        known = turn[turn != NO_TURN]
        if len(known):
            self.turns += int((np.diff(known) != 0).sum()) + (known[0] != self.high)
            self.low = known[0] if self.low is None else self.low
            self.high = known[-1]

    def found(self, conv_id) -> tuple:
        blank, cut = np.concatenate(self.blank), np.concatenate(self.cut)
        digests = np.concatenate(self.digests)
        first = np.zeros(len(digests), bool)
        first[np.unique(digests, return_index=True)[1]] = True
        again = ~first & ~blank
        cut = cut & first & ~blank
        faults = np.where(blank | again, MUST_GO, np.where(cut, CUT, FINE)).astype(np.uint8)
        cost, audit = cheapest([c for part in self.initials for c in part], faults.tobytes())
        gaps = 0 if self.low is None else int(self.high) - int(self.low) + 1 - int(self.turns)
        return conv_id, gaps, int(blank.sum()), int(again.sum()), int(cut.sum()), self.illegal, cost, audit


NO_TURN = np.iinfo(np.int64).min


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, int, object]]:
    """Begin, end and id of each run of rows of one conversation."""
    ids = batch.column("conv_id")
    same = ids.fill_null(0).to_numpy()
    null = ids.is_null().to_numpy(zero_copy_only=False)
    edge = np.flatnonzero((same[1:] != same[:-1]) | (null[1:] != null[:-1])) + 1
    bounds = [0, *edge.tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        yield a, b, ids[a].as_py()


def _in_order(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*columns)


def edits(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of each conversation of ``rows(conv_id, turn, role, text)``
    without nulls in role and text: numbers of faults, and the cheapest edits with the least audit."""
    prepare(rows.sparkSession)
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    noted = _in_order(rows.select(*ORDER), *ORDER).select(
        "conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), digest.alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))

    def run(batches):
        now, held = None, None
        for batch in batches:
            out = []
            turn = batch.column("turn").fill_null(int(NO_TURN)).to_numpy()
            initials = batch.column("initial").to_pylist()
            digests = np.array(batch.column("digest").to_pylist(), "V16")
            blank, cut = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("blank", "cut"))
            for a, b, conv_id in _segments(batch):
                if held is None or conv_id != now:
                    if held is not None:
                        out.append(held.found(now))
                    now, held = conv_id, _Open()
                held.add(turn[a:b], initials[a:b], digests[a:b], blank[a:b], cut[a:b])
            if out:
                yield _found_rows(out)
        if held is not None:
            yield _found_rows([held.found(now)])

    return noted.mapInArrow(run, FOUND)


def _found_rows(rows) -> pa.RecordBatch:
    names = [part.split()[0] for part in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name == "audit" else pa.int64()) for name, c in zip(names, zip(*rows))], names)


def _streams(batches) -> Iterator[tuple[object, str, Iterator[tuple[str, str]]]]:
    """(conv_id, audit, rows) of conversations, each of whose audit comes before its rows."""

    def flat():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")))

    waiting = flat()
    item = next(waiting, None)
    while item is not None:
        conv_id, audit = item[:2]
        following = [None]

        def rows():
            for found in waiting:
                if found[1] is not None:
                    following[0] = found
                    return
                yield found[2], found[3]

        own = rows()
        yield conv_id, audit, own
        for _ in own:  # rows that the reader left
            pass
        item = following[0]


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    marks = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    both = marks.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast("string").alias("audit")))
    return _in_order(both, "conv_id", "kind", "turn", "role", "text").select("conv_id", "audit", "role", "text")


def _chunks(rows: Iterator[tuple], schema: pa.Schema, rows_held: int = 1024, chars_held: int = 1 << 22):
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[-1])
        if len(held) == rows_held or chars >= chars_held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the rows of each repaired conversation, from 0, and the edit that each comes from."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        yield from _chunks(((conv_id, place, *row) for conv_id, audit, own in _streams(batches) for place, row in enumerate(repaired(audit, own))), schema)

    return _with_audits(rows, found).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of the lines ``role:text`` of each repaired conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def digest(audit, own):
        total = hashlib.sha256()
        for n, (_, role, text) in enumerate(repaired(audit, own)):
            total.update((b"\n" if n else b"") + f"{role}:{text}".encode())
        return total.hexdigest()

    def run(batches):
        yield from _chunks(((conv_id, digest(audit, own)) for conv_id, audit, own in _streams(batches)), schema)

    return _with_audits(rows, found).mapInArrow(run, "conv_id long, repaired_sha256 string")
