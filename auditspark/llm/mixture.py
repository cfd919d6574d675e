"""Mixing sources to target weights by Pareto order sampling.

Targets: the words of all documents are shared among sources by weight. A target stops at ``MOST`` times its source's
words, and the excess is shared again by weight until none is above.

Copies: a source whose target is r times its words takes each document floor(r) times for certain. The words that are
then left to take are filled by a sample without replacement: a document's inclusion probability is c times its size, c
such that the expected words fit; documents that would reach 1 are certain too, and their words are taken off. The others are ranked by their random
odds divided by their inclusion odds, U / (1 - U) over p / (1 - p), and taken in this order. The sample's size is fixed in
words: a document is taken if at least half of it fits, so that a source misses its target by at most half a document.

Ranks are not sorted as a whole. The odds are cut into ``BUCKETS`` ranges, whose sums show per source the one range in
which the sample ends, and only that range is sorted. All steps are DataFrame operations.

U comes from the MD5 of the id, so that reruns agree. A null text has size 0; a document without words is never taken. A
null source is a source of its own, and the last. Rows that repeat are taken alike. A null doc_id has one U of its own.
An empty table gives no rows. Other columns are not read, or pass through ``mixed`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.samples import fresh
from auditspark.llm.tables import compact
from auditspark.session import stored

WORD = r"[^\x20\x09-\x0D]+"
#: weights of the sources in order, repeating
WEIGHTS = 3
#: times a source's words, and times a document
MOST = 3
BUCKETS = 4096
SEED = "mixture-1:"


def _key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def sizes(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, key, size)``: the words of each document, and its source as a text that is never null."""
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                            _words().alias("size"))
    return slim.withColumn("key", _key())


def targets(sized: DataFrame) -> DataFrame:
    """``(key, source_size, target)`` of each source."""
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    numbered = sources.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % WEIGHTS + 1)
    numbered = numbered.withColumn("top", MOST * F.col("source_size"))
    # in the order in which they reach their limits; each source's level counts those before it as limited
    order = Window.orderBy(F.col("top") / F.col("weight"), "key")
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
             - F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(rest)
    levels = numbered.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("top"))
    common = F.min(F.when(F.col("free"), F.struct(F.col("top") / F.col("weight"), "key", "level"))).over(
        Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("free"), common["level"] * F.col("weight")).otherwise(F.col("top").cast("double"))
    return levels.select("key", "source_size", target.cast("double").alias("target"))


def _rates(units: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with ``whole`` copies of all, ``rate`` c of the sample, the ``largest`` size that it draws from, and ``open`` words
    that it may take."""
    known = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    known = known.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    down = Window.partitionBy("key").orderBy(F.col("size").desc())
    up = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    counted = units.where("size > 0").groupBy("key", "size").agg(F.sum("m").alias("m")).join(known, "key")
    counted = (counted.withColumn("above", F.coalesce(F.sum(F.col("m") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("squares", F.sum((F.col("m") * F.col("size") * F.col("size")).cast("decimal(28,0)")).over(up).cast("double")))
    counted = counted.withColumn("rate", (F.col("left") - F.col("above")) / F.col("squares")).where(F.col("rate") * F.col("size") < 1)
    # the cut with the largest size: the documents above it are certain, and their words are no longer open
    best = counted.groupBy("key").agg(F.max_by(F.struct("rate", "above", "size"), "size").alias("b"))
    rated = known.join(best, "key", "left")
    return rated.select("key", "source_size", "target", "whole", F.coalesce("b.rate", F.lit(0.0)).alias("rate"),
                        F.coalesce("b.size", F.lit(0)).alias("largest"), (F.col("left") - F.coalesce("b.above", F.lit(0))).alias("open"))


def plan(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes of all rows, and for each distinct (doc_id, key, size) its ``copies``, ``source_size`` and ``target``."""
    sized = stored(sizes(documents), "sizes")
    units = sized.groupBy("doc_id", "key", "size").agg(F.count("*").alias("m"))
    sources = compact(targets(sized), "targets")
    rates = compact(_rates(units, sources), "rates")

    u = (F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    chance = F.col("rate") * F.col("size")
    odds = (u / (1 - u)) / (chance / (1 - chance))
    drawn = units.join(rates, "key").withColumn("certain", F.col("size") > F.col("largest"))
    drawn = drawn.withColumn("odds", F.when((F.col("size") > 0) & ~F.col("certain") & (chance > 0), odds))
    drawn = drawn.withColumn("bucket", F.floor(BUCKETS * F.col("odds") / (1 + F.col("odds"))))
    drawn = compact(drawn, "drawn")

    ranges = drawn.where("odds is not null").groupBy("key", "bucket", "open").agg(F.sum(F.col("m") * F.col("size")).alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("before", before).select("key", "bucket", "before", (F.col("before") + F.col("words") <= F.col("open")).alias("all_in"), (F.col("before") > F.col("open")).alias("all_out"))
    placed = drawn.join(ranges, ["key", "bucket"], "left")
    last = placed.where("odds is not null and not all_in and not all_out")
    in_order = Window.partitionBy("key").orderBy("odds", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("before") + F.coalesce(F.sum(F.col("m") * F.col("size")).over(in_order), F.lit(0))
    last = last.withColumn("extra", reached + F.col("m") * F.col("size") / 2 <= F.col("open"))
    rest = placed.where("odds is null or all_in or all_out").withColumn("extra", F.col("certain") | F.coalesce("all_in", F.lit(False)))
    decided = rest.unionByName(last)
    return sized, decided.select("doc_id", "key", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole") + F.col("extra").cast("long")).otherwise(F.lit(0)).alias("copies"))


def _matched(left: DataFrame, decided: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Join with the decisions on document, source and size, which ``names`` names in ``left``; and the decisions' names."""
    known = {c: fresh(f"mix_{c}", left.columns) for c in decided.columns}
    right = decided.select(*(F.col(c).alias(n) for c, n in known.items()))
    doc, key, size = names
    same = F.col(doc).eqNullSafe(F.col(known["doc_id"])) & (F.col(key) == F.col(known["key"])) & (F.col(size) == F.col(known["size"]))
    return left.join(right, same), known


def shares(documents: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every document."""
    sized, decided = plan(documents)
    found, known = _matched(sized.select("doc_id", "key", "size"), decided, ["doc_id", "key", "size"])
    return found.select("doc_id", "size", F.col(known["source_size"]).alias("source_size"), F.col(known["target"]).alias("target"),
                        (F.col("size") * F.col(known["copies"])).alias("taken"))


def mixed(documents: DataFrame) -> DataFrame:
    """The documents that the mix takes, all columns, with ``copies``, ``taken`` words and the source's ``target``.

    Columns of ``documents`` with these three names are replaced.
    """
    _, decided = plan(documents)
    own = documents.select(*(c for c in documents.columns if c.lower() not in ("copies", "taken", "target")))
    doc, key, size = names = [fresh(c, own.columns) for c in ("mix_id", "mix_source", "mix_words")]
    left = own.withColumns({doc: F.col("doc_id").cast("long"), key: _key(), size: _words()})
    found, known = _matched(left, decided.where("copies > 0"), names)
    return found.select(*own.columns, F.col(known["copies"]).alias("copies"), (F.col(size) * F.col(known["copies"])).alias("taken"), F.col(known["target"]).alias("target"))
