"""Near-duplicate groups by SetSketch registers: bands, joint likelihood estimates, exact confirmation.

1. One pass over the texts makes each document's set of word shingles, a 64-bit key of the set, and band keys of its
   registers. Documents with equal sets are one node from here on, so exact copies cost nothing further.
2. Nodes that share a band key with another node are read once more for their registers and sets.
3. Each node is held against the smallest node of its buckets: one pair per node. This joins copies of one text.
4. Buckets whose nodes are still in different components are searched for all pairs across components. Buckets of
   more than ``BLOCK`` nodes or ``BLOCK_SHINGLES`` shingles are dealt out as pairs of blocks. Registers go first, and only nodes of a pair with a
   likely similarity are followed by their sets. A bucket returns links that connect it, never all its pairs.

Every link rests on the exact similarity of whole sets. A pair at the threshold misses all bands with a chance of
about 2e-6, and falls below ``LIKELY`` with about 1e-7.

Nulls, empty texts and texts without words have the empty set and stay alone. Rows that repeat count as copies; rows
that share a doc_id but not a text are separate documents, also in ``keep_one``. A null doc_id takes part, and is never the smallest.
Columns other than the two named are not read. Distinct sets are told apart by 64-bit keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm import setsketch
from auditspark.llm.batches import WORD, in_batches, mix, pieces, prepare
from auditspark.llm.components import components
from auditspark.llm.samples import fresh
from auditspark.llm.tables import compact
from auditspark.session import stored

WIDTH = 5
#: links have 100 * intersection >= PERCENT * union
PERCENT = 75
#: estimated similarity from which a pair is confirmed on its sets; over five standard errors below the threshold
LIKELY = 0.60
#: nodes of a block, and shingles of its nodes on average; two blocks are compared in one task
BLOCK = 512
BLOCK_SHINGLES = 2_000_000


def _keys(elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, 0 for the empty set."""
    sums = np.zeros(len(elements) + 1, np.uint64)
    np.cumsum(mix(elements + np.uint64(0x2545F4914F6CDD1D)), out=sums[1:])
    return np.where(np.diff(at) > 0, mix(sums[at[1:]] - sums[at[:-1]]), np.uint64(0)).view(np.int64)


def sketches(documents: DataFrame) -> DataFrame:
    """``(doc_id, mark, n_shingles, node, bands)``, where ``mark`` is a hash of the text; without a set, node and bands are null."""

    def work(batch):
        n, node, keys = [], [], []
        for piece in pieces(batch.column("text")):
            elements, at = setsketch.shingle_sets(piece.lowered(), WORD, WIDTH)
            n.append(np.diff(at))
            node.append(_keys(elements, at))
            keys.append(setsketch.bands(setsketch.registers(elements, at)))
        n, node, keys = np.concatenate(n), np.concatenate(node), np.concatenate(keys)
        offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, setsketch.BANDS, 0))]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[n > 0].ravel()))
        bands = pa.ListArray.from_buffers(pa.list_(pa.int64()), len(n), [None, bands.buffers()[1]], children=[bands.values])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("mark"), pa.array(n.astype(np.int64)), pa.array(node, mask=n == 0), bands],
            ["doc_id", "mark", "n_shingles", "node", "bands"])

    return in_batches(documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text"), work,
                      "doc_id long, mark long, n_shingles long, node long, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """``(node, n, registers, shingles)`` of ``texts(node, text)``."""

    def work(batch):
        node, n, rows, sets = [], [], [], []
        for piece in pieces(batch.column("text")):
            elements, at = setsketch.shingle_sets(piece.lowered(), WORD, WIDTH)
            node.append(_keys(elements, at))
            n.append(np.diff(at))
            rows += [r.tobytes() for r in setsketch.registers(elements, at)]
            sets += [elements[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        found = np.concatenate(node)
        # rows that share a doc_id with another text come along through the join
        ours = np.flatnonzero(found == batch.column("node").to_numpy())
        return pa.RecordBatch.from_arrays(
            [pa.array(found[ours]), pa.array(np.concatenate(n)[ours].astype(np.int64)), pa.array([rows[i] for i in ours], pa.binary()), pa.array([sets[i] for i in ours], pa.binary())],
            ["node", "n", "registers", "shingles"])

    return in_batches(texts, work, "node long, n long, registers binary, shingles binary")


def _linked(left: bytes, right: bytes) -> bool:
    a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(both) - common)


def _register_rows(column) -> np.ndarray:
    if not len(column):
        return np.zeros((0, setsketch.REGISTERS), np.uint16)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), setsketch.REGISTERS)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among ``pairs(a, b)``."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"), F.col("shingles").alias("sb"))
    sized = pairs.join(left.select("a", "na", "ra"), "a").join(right.select("b", "nb", "rb"), "b")

    def likely(batch):
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        j = setsketch.estimate(_register_rows(batch.column("ra")), _register_rows(batch.column("rb")), na, nb)
        keep = pa.array((j >= LIKELY) & (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)))
        return batch.select(["a", "b"]).filter(keep)

    def confirm(batch):
        keep = [_linked(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())]
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    chosen = in_batches(sized.select("a", "b", "na", "nb", "ra", "rb"), likely, "a long, b long")
    full = chosen.join(left.select("a", "sa"), "a").join(right.select("b", "sb"), "b")
    return in_batches(full.select("a", "b", "sa", "sb"), confirm, "a long, b long")


def _grouped(batches, names):
    """Batches cut so that the rows of a (key, p, q) stand together; rows must be sorted by these."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        marks = [rest.column(c).to_numpy() for c in names]
        last = np.ones(rest.num_rows, bool)
        for m in marks:
            last &= m == m[-1]
        cut = rest.num_rows - int(last.sum())
        if cut:
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _pairs_apart(table, names):
    """Row pairs of one group that are of different components, and of different blocks where the group has two."""
    marks = [table.column(c).to_numpy() for c in names]
    root, block = table.column("root").to_numpy(), table.column("block").to_numpy()
    p, q = table.column("p").to_numpy(), table.column("q").to_numpy()
    for d in range(1, table.num_rows):
        same = np.ones(table.num_rows - d, bool)
        for m in marks:
            same &= m[:-d] == m[d:]
        if not same.any():
            return
        keep = same & (root[:-d] != root[d:]) & ((p[d:] == q[d:]) | (block[:-d] != block[d:]))
        left = np.flatnonzero(keep)
        if len(left):
            yield left, left + d


GROUP = ["key", "p", "q"]


def _likely_partners(members: DataFrame) -> DataFrame:
    """Members with likely partners in their group: ``partners`` holds those of which this is the first row.

    A pair is told only by the first band that it shares.
    """

    def run(batches):
        for table in _grouped(batches, GROUP):
            rows, n = _register_rows(table.column("registers")), table.column("n").to_numpy()
            node, keys = table.column("node").to_numpy(), table.column("key").to_numpy()
            bands = setsketch.bands(rows)
            partners: dict[int, list[int]] = {}
            for left, right in _pairs_apart(table, GROUP):
                fit = 100 * np.minimum(n[left], n[right]) >= PERCENT * np.maximum(n[left], n[right])
                left, right = left[fit], right[fit]
                for k in range(0, len(left), 4096):
                    x, y = left[k:k + 4096], right[k:k + 4096]
                    j = setsketch.estimate(rows[x], rows[y], n[x], n[y])
                    x, y = x[j >= LIKELY], y[j >= LIKELY]
                    equal = bands[x] == bands[y]
                    first = bands[x][np.arange(len(x)), equal.argmax(axis=1)] == keys[x]
                    for a, b in zip(x[first].tolist(), y[first].tolist()):
                        partners.setdefault(a, []).append(int(node[b]))
                        partners.setdefault(b, [])
            if partners:
                chosen = sorted(partners)
                yield from table.select(["key", "p", "q", "block", "node", "root"]).take(pa.array(chosen)).append_column(
                    "partners", pa.array([partners[i] for i in chosen], pa.list_(pa.int64()))).combine_chunks().to_batches()

    return members.mapInArrow(run, "key long, p int, q int, block int, node long, root long, partners array<long>")


def _links_of_groups(members: DataFrame) -> DataFrame:
    """Links that connect the nodes of each group as far as exact similarity does."""

    def run(batches):
        for table in _grouped(batches, GROUP):
            marks = [table.column(c).to_numpy() for c in GROUP]
            change = np.ones(table.num_rows, bool)
            change[1:] = np.logical_or.reduce([m[1:] != m[:-1] for m in marks])
            node, root = table.column("node").to_pylist(), table.column("root").to_pylist()
            sets, partners = table.column("shingles"), table.column("partners").to_pylist()
            group, found, parent, place = -1, ([], []), {}, {}
            group_of = np.cumsum(change) - 1
            where = {(int(g), v): i for i, (g, v) in enumerate(zip(group_of, node))}

            def top(x):
                while parent.setdefault(x, x) != x:
                    x = parent[x]
                return x

            for i, others in enumerate(partners):
                if group_of[i] != group:
                    group, parent = group_of[i], {}
                for other in others:
                    k = where[int(group), other]
                    x, y = top(root[i]), top(root[k])
                    if x != y and _linked(sets[i].as_py(), sets[k].as_py()):
                        parent[x] = y
                        found[0].append(node[i])
                        found[1].append(node[k])
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def _dealt(df: DataFrame) -> DataFrame:
    """Rows of a group in one task, in order."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *GROUP).sortWithinPartitions(*GROUP, "node")


def _components_of(documents: DataFrame) -> DataFrame:
    """``(doc_id, mark, n_shingles, root, least)`` for every row: its component, and the smallest doc_id there; null without a set."""
    prepare(documents.sparkSession)
    made = stored(sketches(documents), "sketches")
    nodes = made.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    banded = compact(nodes.select("node", "doc_id", "n", F.explode("bands").alias("key")), "bands")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    buckets = banded.groupBy("key").agg(F.min("node").alias("lead"), blocks.alias("blocks"), F.count("*").alias("members"))
    buckets = compact(buckets.where("members > 1").drop("members"), "buckets")
    members = compact(banded.join(buckets, "key").select("key", "lead", "blocks", "node", "doc_id"), "members")

    # null-safe, as a node may have no doc_id
    wanted = members.select("node", F.col("doc_id").alias("id")).distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = wanted.join(texts, wanted["id"].eqNullSafe(texts["doc_id"])).select("node", "text")
    sets = stored(_sets(texts).dropDuplicates(["node"]), "sets")

    stars = members.where("node <> lead").groupBy("node").agg(F.min("lead").alias("b")).withColumnRenamed("node", "a")
    links = compact(_confirmed(stars, sets), "stars")
    roots = components(links)

    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    open_ = placed.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sides = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("p"), F.greatest("block", o).alias("q")))
    open_ = open_.select("key", "node", "root", "block", F.explode(sides).alias("s")).select("key", "s.p", "s.q", "block", "node", "root")
    likely = compact(_likely_partners(_dealt(open_.join(sets.select("node", "n", "registers"), "node"))), "likely")
    more = _links_of_groups(_dealt(likely.join(sets.select("node", "shingles"), "node")))
    roots = components(compact(links.union(more), "links"))

    slim = made.select("doc_id", "mark", "n_shingles", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    slim = compact(slim.select("doc_id", "mark", "n_shingles", "root"), "rooted")
    # written, so that a join on a root of very many rows can be split
    least = compact(slim.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    return slim.join(least, "root", "left")


def groups(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``documents(doc_id, text)``."""
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return (_components_of(documents).select("doc_id", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, that stay when one document of each group is kept.

    Decisions go by doc_id and text, so that rows which share a doc_id are told apart: of those with the smallest doc_id of a group one
    text stays. Rows without a word all stay.
    """
    known, mark = fresh("kept_id", documents.columns), fresh("kept_mark", documents.columns)
    chosen = (_components_of(documents).where(F.col("root").isNotNull() & F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("root")
              .agg(F.first("doc_id").alias(known), F.min("mark").alias(mark)).select(known, mark))
    bare = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = documents["doc_id"].cast("long").eqNullSafe(chosen[known]) & (F.xxhash64(documents["text"]) == chosen[mark])
    stays = documents.where(~bare).join(chosen, same, "left_semi")
    return stays.dropDuplicates(["doc_id", "text"]).unionByName(documents.where(bare))
