"""Repeated blocks of lines and similar functions within a scan."""

from __future__ import annotations

import sys
from difflib import SequenceMatcher
from hashlib import sha1
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark import schema
from auditspark.functions import text
from auditspark.session import shuffle_partitions, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Block size, shortest block text, report limits, similarity threshold.
WINDOW_LINES = 6
MIN_BLOCK_CHARS = 40
USUAL_BLOCK_REPORTS = 250
MAX_FUNCTION_REPORTS = 120
MIN_RATIO = 0.86
PLACES_AT_ONCE = 1 << 16

# --- blocks of six lines ------------------------------------------------------------------


def cleaned_lines(content: Column) -> Column:
    return F.filter(F.transform(text.split_lines(content), text.clean_line), lambda line: line != "")


def shingles(files: DataFrame) -> DataFrame:
    """``(scan_id, file_path, idx, fp)``: fingerprints of six cleaned lines, idx from 1."""
    one = files.select("scan_id", "file_path", F.explode(fingerprints(F.col("content"))).alias("m"))
    return one.select("scan_id", "file_path", F.col("m.idx").alias("idx"), F.col("m.fp").alias("fp"))


def fingerprints(content: Column) -> Column:
    """(fp, idx) of every block of a file, worked out inside its row; null for short files."""
    return text.let(cleaned_lines(content), _block_marks)


def _block_marks(cleaned: Column) -> Column:
    last = F.size(cleaned) - (WINDOW_LINES - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last))
    blocks = F.transform(
        starts,
        lambda i: F.struct(F.concat_ws("\n", F.slice(cleaned, i, F.lit(WINDOW_LINES))).alias("block"), i.alias("idx")),
    )
    long_enough = F.filter(blocks, lambda b: F.length(b["block"]) >= MIN_BLOCK_CHARS)
    return F.transform(long_enough, lambda b: F.struct(F.sha1(b["block"]).alias("fp"), b["idx"].alias("idx")))


def block_places(source: str) -> dict[bytes, list[int]]:
    """SHA-1 of each block of a text -> its first place and, if it is there again, its second one; as `fingerprints` has them."""
    cleaned = [line for line in (" ".join(raw.partition("#")[0].partition("//")[0].split()) for raw in source.splitlines()) if line]
    ends, spelled = [0, *accumulate(map(len, cleaned))], [line.encode() for line in cleaned]
    places = {}
    for n in range(len(cleaned) - WINDOW_LINES + 1):
        if ends[n + WINDOW_LINES] - ends[n] + WINDOW_LINES - 1 >= MIN_BLOCK_CHARS:
            found = places.setdefault(sha1(b"\n".join(spelled[n:n + WINDOW_LINES])).digest(), [])
            if len(found) < 2:
                found.append(n + 1)
    return places


def own_blocks(files: DataFrame) -> DataFrame:
    """``(scan_id, file_path, fp, first_idx, second_idx)``: distinct blocks of each file with their first and second place in it."""

    def run(batches):
        for batch in batches:
            rows, fps, firsts, seconds = [], [], [], []

            def made():
                columns = [batch.column(name).take(pa.array(rows, pa.int32())) for name in ("scan_id", "file_path")]
                columns += [pa.array(fps, pa.binary()), pa.array(firsts, pa.int32()), pa.array(seconds, pa.int32())]
                return pa.RecordBatch.from_arrays(columns, names=["scan_id", "file_path", "fp", "first_idx", "second_idx"])

            for row, source in enumerate(batch.column("content").to_pylist()):
                places = block_places(source) if source is not None else {}
                rows += [row] * len(places)
                fps += places
                firsts += [at[0] for at in places.values()]
                seconds += [at[1] if len(at) > 1 else None for at in places.values()]
                if len(rows) >= PLACES_AT_ONCE:
                    yield made()
                    rows, fps, firsts, seconds = [], [], [], []
            yield made()

    return files.select("scan_id", "file_path", "content").mapInArrow(run, "scan_id string, file_path string, fp binary, first_idx int, second_idx int")


def duplicate_blocks(files: DataFrame) -> DataFrame:
    """Fingerprints that occur in two files or more, with their first two occurrences.

    Each file first reduces its own repeats, so a row per (fingerprint, file) is left; of those only
    two per fingerprint are needed and each task passes on two at most, however many copies there are.
    """
    own = own_blocks(files)
    order = Window.partitionBy("scan_id", "fp").orderBy("file_path")
    two = own.withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2)
    place = F.struct("file_path", "first_idx", "second_idx")
    pairs = two.groupBy("scan_id", "fp").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("files"))
    in_first = F.col("a.second_idx").isNotNull()
    return pairs.where(F.col("files") > 1).select(
        "scan_id", F.lower(F.hex("fp")).alias("fp"),
        F.col("a.file_path").alias("file_path"), F.col("a.first_idx").alias("line"),
        F.when(in_first, F.col("a.file_path")).otherwise(F.col("b.file_path")).alias("other_path"),
        F.when(in_first, F.col("a.second_idx")).otherwise(F.col("b.first_idx")).alias("other_line"),
    )


def reported_blocks(blocks: DataFrame, limit: int | None = None) -> DataFrame:
    """The blocks of each scan; if given, the first ``limit`` in order of first occurrence."""
    if limit is None:
        return blocks
    order = Window.partitionBy("scan_id").orderBy("file_path", "line")
    return blocks.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)


def block_findings(files: DataFrame, limit: int | None = None) -> DataFrame:
    blocks = reported_blocks(duplicate_blocks(files), limit)
    message = F.concat(F.lit("The same lines stand at "), "other_path", F.lit(":"), F.col("other_line").cast("string"), F.lit("."))
    one = schema.finding(
        "DUPLICATION_BLOCK", line=F.col("line"), message=message, phase=schema.BLOCK_PHASE, seq1=F.col("line")
    )
    return schema.spread(blocks, F.array(one))


# --- similar functions --------------------------------------------------------------------
#
# A similarity self-join over the distinct bodies of each scan, without a limit.
#   1. Equal bodies are one class. Copies are told by membership and never paired with each other.
#   2. Scans with many classes are cut into blocks by length and a salt; two blocks meet in one cell, and blocks whose
#      lengths cannot reach the threshold never meet. Cells are bounded, and a scan of any size spreads over as many tasks
#      as it has cells.
#   3. In a cell, letter counts, letter-pair counts and then the longest common subsequence bound the ratio from above;
#      only pairs that pass are compared exactly. Nothing but links of similar bodies leaves the cell.
#   4. The report of the first pairs of a scan is read off members and links: as many left functions as the report has
#      rows are enough, and only those meet their partners.
#
# The ratio depends on which text comes first, so links are directed: a link from X to Y says that functions with body X are similar
# to later ones with body Y. A second function of one name in a file is compared with the first one only; a third with none.

LENGTH_STEP = 0.754  # a little below 0.86 / (2 - 0.86): shorter partners cannot reach the threshold
BLOCK_ROWS = 512
PAIRS_AT_ONCE = 8192
FEW_PAIRS = 512  # up to so many, whole numbers of Python are faster than arrays over the pairs
SALT_SPACE = 1 << 20
LINK_SCHEMA = "scan_id string, left_class string, right_class string, ratio double"
LINK_ARROW = pa.schema([("scan_id", pa.string()), ("left_class", pa.string()), ("right_class", pa.string()), ("ratio", pa.float64())])
PAIR_COLUMNS = ["scan_id", "left_path", "left_line", "left_name", "right_path", "right_line", "right_name", "ratio"]


def _counts(codes: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(codes & (size - 1), minlength=size).astype(np.int32)


def _profiles(bodies):
    """Letter and letter-pair counts, folded into few columns; folding can only raise an overlap."""
    codes = [np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for body in bodies]
    letters = np.stack([_counts(c, 64) for c in codes])
    pairs = np.stack([_counts(c[:-1] * 127 + c[1:], 2048) for c in codes])
    return letters, pairs, np.array([len(c) for c in codes])


def _candidates(i, letters, pairs, chars):
    """Rows after ``i`` whose ratio with row ``i`` can reach the threshold.

    With M matched of S characters in k runs, M is at most the letters in common. The runs hold
    M - k letter pairs in common, and k - 1 is at most the S - 2M unmatched characters, so
    3M <= common pairs + S + 1.
    """
    rest = np.arange(i + 1, len(chars))
    total = chars[i] + chars[rest]
    rest = rest[2 * np.minimum(letters[i], letters[rest]).sum(axis=1) >= MIN_RATIO * total]
    total = chars[i] + chars[rest]
    common = np.minimum(pairs[i], pairs[rest]).sum(axis=1)
    return rest[2 * (common + total + 1) >= 3 * MIN_RATIO * total]


def _alphabet(bodies) -> np.ndarray:
    """A row per body of its letters, numbered from 0 and filled up with a letter that no body has."""
    codes = [np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32) for body in bodies]
    letters, numbers = np.unique(np.concatenate(codes), return_inverse=True)
    rows = np.full((len(codes), max(map(len, codes))), len(letters), np.int32)
    rows[np.arange(rows.shape[1]) < np.array([len(c) for c in codes])[:, None]] = numbers
    return rows


def _reaching(ones: np.ndarray, others: np.ndarray, rows: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """For which pairs of rows the longest common subsequence allows the threshold; ``ones`` are in order.

    The matched runs lie in order in both texts, so the ratio is at most twice that length over the sum.
    """
    longest = (_longest_of_few if len(ones) <= FEW_PAIRS else _longest_of_many)(ones, others, rows, chars)
    return 2 * longest >= MIN_RATIO * (chars[ones] + chars[others])


def _longest_of_few(ones: np.ndarray, others: np.ndarray, rows: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Longest common subsequences pair by pair; the places of a letter in the one row are the bits of one number."""
    longest, texts, places, of = [], {}, {}, None
    for i, j in zip(ones.tolist(), others.tolist()):
        for n in (i, j):
            if n not in texts:
                texts[n] = rows[n, :chars[n]].tolist()
        if i != of:
            spelled, of = {}, i
            for at, letter in enumerate(texts[i]):
                spelled.setdefault(letter, []).append(at)
            places = {letter: sum(1 << at for at in ats) for letter, ats in spelled.items()}
        every = open_ = (1 << len(texts[i])) - 1
        for letter in texts[j]:
            if hit := open_ & places.get(letter, 0):
                open_ = ((open_ + hit) | (open_ - hit)) & every
        longest.append(len(texts[i]) - open_.bit_count())
    return np.array(longest, np.int64)


def _longest_of_many(ones: np.ndarray, others: np.ndarray, rows: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The same counted for all pairs at once, a letter of each other row and 64 places of each one at a time."""
    unique, of = np.unique(ones, return_inverse=True)
    words, letters = int(chars[unique].max()) // 64 + 1, int(rows.max()) + 1
    places = np.zeros((words, len(unique) * letters), np.uint64)
    for n, i in enumerate(unique):
        at = np.arange(chars[i])
        np.bitwise_or.at(places, (at >> 6, n * letters + rows[i, :chars[i]]), np.uint64(1) << (at & 63).astype(np.uint64))
    open_ = np.full((words, len(others)), np.iinfo(np.uint64).max, np.uint64)
    for letter in rows[others, :int(chars[others].max())].T:
        key, carry = of * letters + letter, None
        for w in range(words):
            now = open_[w]
            hit = now & places[w][key]
            total = now + hit
            over = total < now
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over
            open_[w] = total | (now ^ hit)
    size = chars[ones]
    longest = size.copy()
    for w in range(words):
        bits = np.clip(size - 64 * w, 0, 64).astype(np.uint64)
        inside = np.where(bits == 64, np.iinfo(np.uint64).max, (np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1))
        longest -= np.bitwise_count(open_[w] & inside)
    return longest


def _ratio(matchers: dict[str, SequenceMatcher], left: str, right: str) -> float:
    """The exact ratio; what the matcher notes of its second text is kept."""
    if right not in matchers:
        matchers[right] = SequenceMatcher(None, "", right)
    matchers[right].set_seq1(left)
    return matchers[right].ratio()


def links_in_cell(cell: pa.Table) -> pa.Table:
    """Directed links between the classes of one cell; most cells are small, so rows are plain tuples."""
    bodies, side = cell.column("body").to_pylist(), np.array(cell.column("side").to_pylist())
    letters, pairs, chars = _profiles(bodies)
    rows = list(zip(*[cell.column(name).to_pylist() for name in ("class_id", "body", "first_path", "first_line", "last_path", "last_line")]))
    crossing, scan = cell.column("crossing")[0].as_py(), cell.column("scan_id")[0].as_py()
    spelled = _alphabet(bodies)
    out, matchers = [], {}
    near = [_candidates(i, letters, pairs, chars) for i in range(len(rows))]
    ones, others = np.repeat(np.arange(len(rows)), [len(c) for c in near]), np.concatenate(near)
    if crossing:
        ones, others = ones[side[ones] != side[others]], others[side[ones] != side[others]]
    for k in range(0, len(ones), PAIRS_AT_ONCE):
        some = slice(k, k + PAIRS_AT_ONCE)
        fit = _reaching(ones[some], others[some], spelled, chars)
        for i, j in zip(ones[some][fit], others[some][fit]):
            for (left, left_body, *first, _, _), (right, right_body, _, _, *last) in ((rows[i], rows[j]), (rows[j], rows[i])):
                if first < last:
                    ratio = _ratio(matchers, left_body, right_body)
                    if ratio >= MIN_RATIO:
                        out.append((scan, left, right, ratio))
    return pa.table([[row[n] for row in out] for n in range(4)], schema=LINK_ARROW)


def _cells(classes: DataFrame, sizes: DataFrame, block_rows: int) -> DataFrame:
    """Each class once per cell it takes part in."""
    split = F.col("total") > block_rows
    step = F.when(split, F.col("step")).otherwise(F.lit(0))
    salts = lambda s: F.coalesce(F.element_at("salts", s), F.lit(0))
    own_salt = F.when(split, F.pmod(F.xxhash64("class_id"), salts(step))).otherwise(F.lit(0))
    near = F.when(split, F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).otherwise(F.array(F.lit(0)))

    def blocks_of(s):
        numbers = F.when(salts(s) > 0, F.sequence(F.lit(0).cast("bigint"), salts(s).cast("bigint") - 1))
        return F.transform(numbers, lambda t: s.cast("bigint") * SALT_SPACE + t)

    reach = F.when(split, F.flatten(F.array_compact(F.transform(near, blocks_of)))).otherwise(
        F.array(F.lit(0).cast("bigint"))
    )
    placed = classes.join(sizes, "scan_id").withColumn("own", step.cast("bigint") * SALT_SPACE + own_salt).withColumn("other", F.explode(reach))
    return placed.select(
        "scan_id", "class_id", "body", "first_path", "first_line", "last_path", "last_line",
        F.least("own", "other").alias("cell_a"), F.greatest("own", "other").alias("cell_b"),
        (F.col("own") != F.col("other")).alias("crossing"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )


def function_classes(blocks: DataFrame) -> DataFrame:
    """``(scan_id, class_id, copies, body, chars, first_path, first_line, last_path, last_line)`` of the distinct bodies of first
    functions, from `function_blocks`. Copies are added up before the shuffle."""
    place = F.struct("file_path", "line")
    firsts = blocks.where(F.col("turn") == 1).groupBy("scan_id", F.sha1("body").alias("class_id")).agg(
        F.count("*").alias("copies"), F.min("body").alias("body"), F.min("chars").alias("chars"), F.min(place).alias("first"), F.max(place).alias("last"))
    return firsts.select("scan_id", "class_id", "copies", "body", "chars", F.col("first.file_path").alias("first_path"), F.col("first.line").alias("first_line"),
                         F.col("last.file_path").alias("last_path"), F.col("last.line").alias("last_line"))


def class_links(classes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All links ``(scan_id, left_class, right_class, ratio)`` between different bodies of a scan."""
    stepped = classes.withColumn("step", F.floor(F.log(F.col("chars")) / F.lit(float(-np.log(LENGTH_STEP)))).cast("int"))
    per_step = stepped.groupBy("scan_id", "step").agg(F.count("*").alias("n"))
    entry = F.struct("step", F.ceil(F.col("n") / block_rows).cast("int"))  # a row per power of the step, under a hundred
    sizes = per_step.groupBy("scan_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(entry)).alias("salts")).where(F.col("total") > 1)
    place = ["scan_id", "cell_a", "cell_b"]
    cells = _cells(stepped, sizes, block_rows).repartition(shuffle_partitions(classes.sparkSession), *place)
    return cells.groupBy(*place).applyInArrow(links_in_cell, LINK_SCHEMA)


def twins(blocks: DataFrame) -> DataFrame:
    """Similar first and second functions of one name in a file, as pairs."""
    first = blocks.where(F.col("turn") == 1).select("scan_id", "file_path", "name", F.col("line").alias("left_line"), F.col("body").alias("left_body"))
    both = blocks.where(F.col("turn") == 2).join(first, ["scan_id", "file_path", "name"])

    def compare(batches):
        for batch in batches:
            ratios = [1.0 if a == b else SequenceMatcher(None, a, b).ratio() for a, b in zip(batch["left_body"], batch["body"])]
            yield batch[["scan_id", "file_path", "name", "left_line", "line"]].assign(ratio=ratios)

    judged = both.mapInPandas(compare, "scan_id string, file_path string, name string, left_line int, line int, ratio double").where(F.col("ratio") >= MIN_RATIO)
    path, name = F.col("file_path"), F.col("name")
    return judged.select("scan_id", path.alias("left_path"), "left_line", name.alias("left_name"), path.alias("right_path"), F.col("line").alias("right_line"),
                         name.alias("right_name"), "ratio")


def similarity_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``(scan_id, class_id, first_path, first_line, copies, links)``: each distinct body and how many others are similar to it."""
    ends = [links.select("scan_id", F.col(a).alias("class_id"), F.col(b).alias("other")) for a, b in (("left_class", "right_class"), ("right_class", "left_class"))]
    counted = ends[0].union(ends[1]).distinct().groupBy("scan_id", "class_id").agg(F.count("*").alias("links"))
    return classes.join(counted, ["scan_id", "class_id"], "left").select(
        "scan_id", "class_id", "first_path", "first_line", "copies", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def similarity_totals(blocks: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Beside the report, what a scan has in all: functions, distinct bodies, copies, bodies that are similar to another one, links."""
    rows = similarity_classes(classes, links).groupBy("scan_id").agg(
        F.count("*").alias("bodies"), F.sum(F.col("copies") - 1).alias("copies"), F.count_if(F.col("links") > 0).alias("linked_bodies"), (F.sum("links") / 2).cast("bigint").alias("links"))
    return blocks.groupBy("scan_id").agg(F.count("*").alias("functions")).join(rows, "scan_id")


def similar_functions(blocks: DataFrame, limit: int | None = MAX_FUNCTION_REPORTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The first ``limit`` pairs of similar functions of each scan, from ``function_blocks``; all pairs without a limit."""
    classes = stored(function_classes(blocks), "classes")
    return reported_pairs(blocks, classes, stored(class_links(classes, block_rows), "links"), limit)


def reported_pairs(blocks: DataFrame, classes: DataFrame, links: DataFrame, limit: int | None = MAX_FUNCTION_REPORTS) -> DataFrame:
    """Pairs of functions in report order, with ``pair_rank``.

    Every left function that has a partner gives a pair, so the first ``limit`` of these hold the first ``limit`` pairs. A function has
    a partner if the last function of some linked class comes after it.
    """
    own = classes.where("copies > 1").select("scan_id", F.col("class_id").alias("left_class"), F.col("class_id").alias("right_class"), F.lit(1.0).alias("ratio"))
    every = links.unionByName(own)
    members = blocks.where(F.col("turn") == 1).select("scan_id", F.sha1("body").alias("class_id"), "file_path", "line", "name")
    lasts = classes.select("scan_id", F.col("class_id").alias("right_class"), F.struct(F.col("last_path").alias("file_path"), F.col("last_line").alias("line")).alias("last"))
    reach = every.join(lasts, ["scan_id", "right_class"]).groupBy("scan_id", F.col("left_class").alias("class_id")).agg(F.max("last").alias("reach"))
    lefts = members.join(reach, ["scan_id", "class_id"]).where(F.struct("file_path", "line") < F.col("reach")).drop("reach")
    same_name = twins(blocks)
    if limit is not None:
        order = Window.partitionBy("scan_id").orderBy("file_path", "line")
        lefts = lefts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")
    one = lefts.select("scan_id", F.col("class_id").alias("left_class"), F.col("file_path").alias("left_path"), F.col("line").alias("left_line"), F.col("name").alias("left_name"))
    two = members.select("scan_id", F.col("class_id").alias("right_class"), F.col("file_path").alias("right_path"), F.col("line").alias("right_line"), F.col("name").alias("right_name"))
    met = one.join(every, ["scan_id", "left_class"]).join(two, ["scan_id", "right_class"]).where(F.struct("left_path", "left_line") < F.struct("right_path", "right_line"))
    pairs = met.select(*PAIR_COLUMNS).unionByName(same_name)
    order = Window.partitionBy("scan_id").orderBy("left_path", "left_line", "right_path", "right_line")
    ranked = pairs.withColumn("pair_rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("pair_rank") <= limit)


def representative_pairs(blocks: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """All that is similar without all pairs: a pair of first functions per link, each further copy with the first one, and twins.

    ``pair_rank`` counts within the left function. Two classes that are linked both ways give one pair, from the earlier one.
    """
    members = blocks.where(F.col("turn") == 1).select("scan_id", F.sha1("body").alias("class_id"), F.struct("file_path", "line").alias("place"), "name")
    first = F.struct(F.col("first_path").alias("file_path"), F.col("first_line").alias("line")).alias("place")
    heads = classes.select("scan_id", "class_id", first).join(members, ["scan_id", "class_id", "place"])
    one = heads.select("scan_id", F.col("class_id").alias("left_class"), F.struct("place", "name").alias("x"))
    two = heads.select("scan_id", F.col("class_id").alias("right_class"), F.struct("place", "name").alias("y"))
    linked = links.join(one, ["scan_id", "left_class"]).join(two, ["scan_id", "right_class"])
    low, high = F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right")
    forward = F.struct((F.col("x") < F.col("y")).alias("forward"), "ratio")
    between = linked.groupBy("scan_id", low, high).agg(F.max(forward)["ratio"].alias("ratio"))
    later = members.join(heads.select("scan_id", "class_id", F.struct("place", "name").alias("head")), ["scan_id", "class_id"]).where(F.col("place") != F.col("head.place"))
    copies = later.select("scan_id", F.struct("place", "name").alias("left"), F.col("head").alias("right"), F.lit(1.0).alias("ratio"))
    parts = [F.col(f"{s}.{c}").alias(f"{s}_{a}") for s in ("left", "right") for c, a in (("place.file_path", "path"), ("place.line", "line"), ("name", "name"))]
    pairs = between.unionByName(copies).select("scan_id", *parts, "ratio").select(*PAIR_COLUMNS).unionByName(twins(blocks))
    order = Window.partitionBy("scan_id", "left_path", "left_line").orderBy("right_path", "right_line")
    return pairs.withColumn("pair_rank", F.row_number().over(order))


def pair_confidence(ratio: Column) -> Column:
    return text.py_round(F.least(F.lit(99.0), F.lit(65.0) + ratio * F.lit(35.0)), 1)


def similarity_findings(pairs: DataFrame) -> DataFrame:
    percent = text.py_round(F.col("ratio") * 100, 1).cast("string")
    message = F.concat(F.lit("The function is "), percent, F.lit("% like "), "right_path", F.lit(":"), F.col("right_line").cast("string"), F.lit("."))
    one = schema.finding(
        "DUPLICATE_FUNCTION_SIMILARITY", line=F.col("left_line"), message=message, phase=schema.FUNCTION_PHASE,
        confidence=pair_confidence(F.col("ratio")), seq1=F.col("left_line"), seq2=F.col("pair_rank"),
    )
    return schema.spread(pairs.withColumnRenamed("left_path", "file_path"), F.array(one))
