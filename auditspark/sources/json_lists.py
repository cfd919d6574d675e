"""Large JSON lists, read by byte ranges.

Spark's text source cuts a file at each ``}`` and so over many tasks. What a piece of text means depends on what comes before it: whether
it begins inside a string, and how many brackets are open. Both are worked out for either case within each piece and composed by
sums, first over the pieces of a byte range, then over the ranges of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.functions import text
from auditspark.operators.prefix import sum_before
from auditspark.session import stored

#: what may stand before an object: anything but an opening brace outside of strings
LEAD = r'(?s)^(?:[^{"]|"(?:[^"\\]|\\.)*+")*+'


def _opened(parts: Column, odd: int) -> Column:
    """Opening less closing brackets in every other part."""
    outside = F.array_join(F.filter(parts, lambda p, i: i % 2 == odd), "")
    length = lambda signs: F.length(outside) - F.length(F.translate(outside, signs, ""))
    return length("[{") - length("]")


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """``(file, item, text)``: the objects of each file that holds one JSON list, in order, as JSON texts.

    A file that is no list, or whose brackets or strings do not close, gives none. Elements that are no objects are skipped. Only the
    text of one object must fit into a row.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    pieces = raw.select("*", text.let(parts, lambda p: F.struct((F.size(p) - 1).alias("quotes"), _opened(p, 0).alias("outer"), _opened(p, 1).alias("inner"))).alias("c")).select(
        "file", "block", "at", "value", "c.*")
    pieces = stored(pieces, "pieces")  # numbers of rows are drawn once
    ends = pieces.groupBy("file").agg(F.max(F.struct("block", "at")).alias("last"), F.min(F.struct("block", "at", text.strip(F.col("value")).startswith("[").alias("list")))["list"].alias("list"))
    pieces = pieces.join(ends, "file").where("list")
    placed = sum_before(pieces, ["file"], "block", ["at"], "quotes", "before")
    inside, after = F.col("before") % 2 == 1, (F.col("before") + F.col("quotes")) % 2 == 1
    closes = (~after & (F.struct("block", "at") != F.col("last"))).cast("int")
    stepped = placed.withColumn("closes", closes).withColumn("unclosed", after).withColumn("step", F.when(inside, F.col("inner")).otherwise(F.col("outer")) - F.col("closes"))
    sound = stepped.groupBy("file").agg(F.sum("step").alias("open"), F.max_by("unclosed", F.struct("block", "at")).alias("cut")).where("open = 0 AND NOT cut").select("file")
    deep = sum_before(stepped.join(sound, "file", "left_semi"), ["file"], "block", ["at"], "step", "depth")
    marked = deep.withColumn("ends", F.when((F.col("closes") == 1) & (F.col("depth") + F.col("step") == 1), 1).otherwise(0))
    numbered = sum_before(marked, ["file"], "block", ["at"], "ends", "item")
    grouped = numbered.groupBy("file", "item").agg(F.max("ends").alias("ends"), F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("parts")).where("ends = 1")
    whole = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    return grouped.select("file", "item", F.regexp_replace(whole, LEAD, "").alias("text"))
