"""How far the sources of a language differ in their terms: sparse rows times a term-major index, after Gustavson.

1. One pass over the texts counts terms per (lang, source, term); a task adds up what it reads before it sends anything. A
   language keeps the terms of at least ``MIN_DOCUMENTS`` of its documents.
2. Each count becomes a smoothed share ``p`` in units of 1e-9. A term that a group lacks has the group's zero share.
3. The distance of two groups is the sum of ``|p - q|`` over all kept terms. The index of a language is cut by term into *cells* of
   about ``CELL`` entries, each for ``ROWS`` groups at a time. For a group, a cell goes through its terms, reads
   their postings and scatters into one dense accumulator over all peers. Terms that both groups have are put right there;
   terms that only one has come from sums over sorted shares, and terms that neither has from the two zero shares. A
   cell returns one array per group, and arrays of a group are added. No pair of postings ever leaves a task.

Nulls in ``text``, ``lang`` and ``source`` count as empty texts. Every (lang, source) that occurs is a group, with or without terms; a
language that keeps no term has distances of 0 and no terms. Equal values are ranked by name, in the order of UTF-8. Repeated rows
count each time. Other columns are not read. An empty table gives an empty result. Counts beyond 64 bits are not foreseen, and
products go through decimals, so that shares are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.batches import pieces, prepare
from auditspark.llm.packing import run_starts
from auditspark.llm.tables import compact

MIN_DOCUMENTS = 30
UNIT = 1_000_000_000
SMOOTHING = 5
#: terms of the report for each group
TOP_TERMS = 50
#: index entries of a cell, and groups that it serves at a time
CELL, ROWS = 1 << 16, 256
#: words that a task holds before it adds them up, and rows that it sends at a time
HELD, SENT = 1 << 20, 1 << 16

#: bytes of terms ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True

COUNTS = "lang string, source string, term string, n long, docs long"


class _Held:
    """Words of a task that are not added up yet."""

    def __init__(self, words: int):
        self.words, self.parts, self.size, self.bytes, self.groups, self.rows = words, [], 0, 0, {}, 0

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Take a batch, and give out counts whenever enough is held."""
        lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for piece in pieces(batch.column("text")):
            piece = piece.lowered()
            starts, ends, text = piece.spans(TERM)
            of = zip(lang[piece.first:piece.first + piece.n], source[piece.first:piece.first + piece.n])
            codes = np.array([self.groups.setdefault(g, len(self.groups)) for g in of], np.int32)
            place = (starts + self.bytes).astype(np.int32)
            self.parts.append((piece.data, place, (ends - starts).astype(np.int32), piece.hashes(starts, ends), codes[text], (self.rows + text).astype(np.int32)))
            self.size += len(starts)
            self.bytes += len(piece.data)
            self.rows += piece.n
            if self.size >= self.words:
                yield from self.counted()

    def counted(self) -> Iterator[pa.RecordBatch]:
        """Counts of all that is held, in batches of bounded size."""
        parts, groups = self.parts, list(self.groups)
        size = self.size
        self.__init__(self.words)
        if not size:
            return
        data = np.concatenate([p[0] for p in parts])
        starts, sizes, hashes, group, row = (np.concatenate([p[i] for p in parts]) for i in range(1, 6))
        del parts
        order = np.lexsort((group, hashes))  # keeps the order of rows
        hashes, group, row = hashes[order], group[order], row[order]
        at = run_starts(hashes, group)
        n = np.diff(np.append(at, len(order)))
        fresh = np.ones(len(order), np.int32)
        fresh[1:] = row[1:] != row[:-1]
        fresh[at] = 1
        docs, first, group = np.add.reduceat(fresh, at), order[at], group[at]
        del order, hashes, row, fresh
        names = [pa.array([g[i] for g in groups], pa.string()) for i in (0, 1)]
        for k in range(0, len(at), SENT):
            few = first[k:k + SENT]
            offsets = np.concatenate([[0], np.cumsum(sizes[few], dtype=np.int64)])
            taken = np.arange(offsets[-1]) + np.repeat(starts[few] - offsets[:-1], sizes[few])
            terms = pa.LargeStringArray.from_buffers(len(few), pa.py_buffer(offsets), pa.py_buffer(data[taken].tobytes())).cast(pa.string())
            of = pa.array(group[k:k + SENT])
            counts = [pa.array(x[k:k + SENT].astype(np.int64)) for x in (n, docs)]
            yield pa.RecordBatch.from_arrays([names[0].take(of), names[1].take(of), terms, *counts], ["lang", "source", "term", "n", "docs"])


def term_counts(documents: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: places and documents of each term."""
    words = HELD

    def run(batches):
        held = _Held(words)
        for batch in batches:
            yield from held.add(batch)
        yield from held.counted()

    return documents.select("lang", "source", "text").mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 5) / (total + 5 * terms)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    parts = F.struct((wide(n) + SMOOTHING) * F.lit(UNIT).cast("decimal(10,0)"), wide(total) + wide(terms) * SMOOTHING)
    return F.transform(F.array(parts.alias("x")), lambda x: F.call_function("div", x["col1"], x["col2"]))[0] + 1


def _tables(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups ``(lang, source, gid, size, p0, V)`` and entries ``(lang, source, term, p, q)``; sizes count a group's terms."""
    slim = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = compact(term_counts(slim), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("ln"), F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCUMENTS).drop("docs")
    entries = compact(counts.drop("docs").join(kept, ["lang", "term"]), "kept")
    per_group = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("size"))
    # each kept term has an entry in some group: its count in the language is the sum over groups
    per_lang = entries.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_distinct("term").alias("V"), F.count("*").alias("entries"))
    names = slim.select("lang", "source").distinct()
    order = Window.partitionBy("lang").orderBy("source")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = (names.withColumn("gid", F.row_number().over(order) - 1).join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
              .select("lang", "source", "gid", *[zero(c) for c in ("total", "size", "lang_total", "V", "entries")]))
    groups = compact(groups.withColumn("p0", F.when(F.col("V") > 0, share(F.lit(0), F.col("total"), F.col("V"))).otherwise(0)), "groups")
    shared = entries.join(groups.select("lang", "source", "gid", "total", "lang_total", "V", "entries"), ["lang", "source"])
    shares = shared.select("lang", "source", "gid", "term", "entries", share(F.col("n"), F.col("total"), F.col("V")).alias("p"),
                           share(F.col("ln"), F.col("lang_total"), F.col("V")).alias("q"))
    return groups, shares


def _cells_of(entries: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(entries / CELL)).cast("int")


def _blocks_of(peers: Column) -> Column:
    return F.ceil(peers / ROWS).cast("int")


def _accumulator(block_rows: int):
    """The work on a cell: for each of its groups, what the cell's terms add to the distance from every peer."""

    def accumulate(key, postings, dims):
        lang, block, cell = (k.as_py() for k in key)
        p0 = np.array(dims.column("p0s")[0].as_py(), np.int64)
        size, terms = np.array(dims.column("sizes")[0].as_py(), np.int64), dims.column("V")[0].as_py()
        rows = np.arange(block * block_rows, min((block + 1) * block_rows, len(p0)))
        out = np.zeros((len(rows), len(p0)), np.int64)
        if cell == 0:  # terms that neither has: all, less those of the one and those of the other; common ones are put right below
            out += (terms - size[rows, None] - size[None, :]) * np.abs(p0[rows, None] - p0[None, :])
        if postings.num_rows:
            term = postings.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
            order = np.lexsort((postings.column("gid").to_numpy(), term))
            term, gid, p = term[order], postings.column("gid").to_numpy()[order], postings.column("p").to_numpy()[order]
            begin = np.searchsorted(term, np.arange(term[-1] + 2))
            by_group = np.argsort(gid, kind="stable")
            edge = np.searchsorted(gid[by_group], np.arange(len(p0) + 1))
            for peer in range(len(p0)):  # a peer's own terms against the zero shares of the rows
                out[:, peer] += _distances(p[by_group[edge[peer]:edge[peer + 1]]], p0[rows])
            for i, row in enumerate(rows):
                mine = by_group[edge[row]:edge[row + 1]]
                out[i] += _distances(p[mine], p0)
                low, n = begin[term[mine]], begin[term[mine] + 1] - begin[term[mine]]
                at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
                own, peer, other = np.repeat(p[mine], n), gid[at], p[at]
                np.add.at(out[i], peer, np.abs(own - other) - np.abs(own - p0[peer]) - np.abs(p0[row] - other) + np.abs(p0[row] - p0[peer]))
        return pa.table([pa.array([lang] * len(rows), pa.string()), pa.array(rows.astype(np.int32)), pa.array(list(out), pa.list_(pa.int64()))], ["lang", "gid", "sums"])

    return accumulate


def _distances(shares: np.ndarray, points: np.ndarray) -> np.ndarray:
    """For each point, the sum of its distances from all shares."""
    ordered = np.sort(shares)
    sums = np.concatenate([[0], np.cumsum(ordered)])
    below = np.searchsorted(ordered, points)
    return points * below - sums[below] + (sums[-1] - sums[below]) - points * (len(ordered) - below)


def _added(key, table):
    """The arrays of a group from all cells, added up."""
    sums = table.column("sums").combine_chunks()
    total = sums.values.to_numpy().reshape(len(sums), -1).sum(axis=0)
    return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()), pa.array([total], pa.list_(pa.int64()))], ["lang", "gid", "sums"])


def distances(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for each ordered pair of different sources of a language."""
    place = ["lang", "block", "cell"]
    dims = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("gid", "p0", "size"))).alias("g"), F.max("V").alias("V"), F.max("entries").alias("entries"))
    slots = dims.select("lang", F.col("g.p0").alias("p0s"), F.col("g.size").alias("sizes"), "V", F.explode(F.sequence(F.lit(0), _cells_of(F.col("entries")) - 1)).alias("cell"), F.size("g").alias("peers"))
    slots = slots.withColumn("block", F.explode(F.sequence(F.lit(0), _blocks_of(F.col("peers")) - 1)))
    peers = groups.groupBy("lang").agg(F.count("*").alias("peers"))
    postings = (entries.select("lang", "gid", "term", "p", F.pmod(F.xxhash64("term"), _cells_of(F.col("entries"))).cast("int").alias("cell")).join(peers, "lang")
                .withColumn("block", F.explode(F.sequence(F.lit(0), _blocks_of(F.col("peers")) - 1))).select(*place, "gid", "term", "p"))
    partial = postings.groupBy(*place).cogroup(slots.select(*place, "p0s", "sizes", "V").groupBy(*place)).applyInArrow(_accumulator(ROWS), "lang string, gid int, sums array<bigint>")
    rows = partial.groupBy("lang", "gid").applyInArrow(_added, "lang string, gid int, sums array<bigint>").select("lang", "gid", F.posexplode("sums").alias("pid", "value")).where("gid <> pid")
    named = groups.select("lang", F.col("gid").alias("pid"), F.col("source").alias("item"))
    return rows.join(groups.select("lang", "gid", "source"), ["lang", "gid"]).join(named, ["lang", "pid"]).select("lang", "source", "item", "value")


def ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    numbered = rows.withColumn("rank", F.row_number().over(order))
    numbered = numbered if top is None else numbered.where(F.col("rank") <= top)
    return numbered.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")


def audit(documents: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` holds the distance from every other source of the language, part
    ``term`` the ``top`` terms whose share is highest above the language's."""
    prepare(documents.sparkSession)
    groups, entries = _tables(documents)
    over = entries.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return ranked(distances(groups, entries), "pair").unionByName(ranked(over, "term", top))
