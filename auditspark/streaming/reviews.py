"""Issues and the answers of a late reviewer, as two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark import dims
from auditspark.operators import enrich


def reviewed(issues: DataFrame, responses: DataFrame, wait: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Issues with the answers applied, and ``answered``; an append stream.

    ``issues`` hold ``scan_id, issue_seq, sent_at`` and the answer columns, ``responses`` hold ``scan_id, issue_seq,
    answered_at, raw``. Both may come in any order within ``lateness``; rows that the watermark has passed are dropped.
    An answer counts from ``sent_at`` until ``wait`` later. An issue without one comes out unchanged once the watermark
    shows that none can come, so state is kept for ``wait`` and ``lateness`` only. An answer that is delivered again
    with its time counts once; other answers to one issue each give a row, as in the batch. Nulls in keys or times
    match nothing, and an issue without a time is never closed.
    """
    keys = {"scan_id": "r_scan_id", "issue_seq": "r_issue_seq"}
    own = {"raw": "i_raw"}  # a column of the issues by that name stays theirs
    answers = responses.withWatermark("answered_at", lateness).withColumnsRenamed(keys).select(*keys.values(), "answered_at", "raw")
    answers = answers.dropDuplicatesWithinWatermark([*keys.values(), "answered_at"])
    sent = issues.withColumnsRenamed(own).withWatermark("sent_at", lateness)
    same = [F.col(key) == F.col(other) for key, other in keys.items()]
    in_time = F.col("answered_at").between(F.col("sent_at"), F.col("sent_at") + F.expr(f"interval {wait}"))
    joined = sent.join(answers, [*same, in_time], "left_outer").withColumn("answered", F.col("answered_at").isNotNull())
    # only answers that met their issue are parsed, and state holds them as they came
    taken = enrich.take_answers(enrich.parse_answers(joined))
    return taken.drop(*keys.values(), "answered_at", "raw").withColumnsRenamed({there: name for name, there in own.items()})
