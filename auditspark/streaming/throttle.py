"""Request throttling: at most N accepted events per key in any W seconds.

Only accepted events count, so each verdict rests on earlier verdicts and a count over a window
would be wrong.
"""

from __future__ import annotations

import sys
from collections import deque

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditspark.session import shuffle_partitions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Accepted scan requests per user and window.
MAX_REQUESTS = 6
WINDOW_SECONDS = 60
MICROS = 1_000_000


def judge(times: np.ndarray, accepted: deque, limit: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Verdicts and waiting seconds for the sorted ``times`` (microseconds) of one key.

    ``accepted`` holds the accepted times before them and is brought up to date. While the window is
    full nothing changes until its oldest time leaves, so the events up to there are refused at once
    and the work follows the accepted events, not the refused ones.
    """
    allowed, retry = np.ones(len(times), bool), np.zeros(len(times), np.int32)
    at = 0
    while at < len(times):
        now = int(times[at])
        while accepted and accepted[0] < now - window:
            accepted.popleft()
        if len(accepted) < limit:
            accepted.append(now)
            at += 1
            continue
        stop = int(np.searchsorted(times, accepted[0] + window, side="right"))
        allowed[at:stop] = False
        wait = (window - (times[at:stop] - accepted[0])) / MICROS
        retry[at:stop] = np.maximum(1, wait).astype(np.int32)
        at = stop
    return allowed, retry


def _limits(max_requests: int, window_sec: int) -> tuple[int, int]:
    return max(1, max_requests), max(1, window_sec) * MICROS


def _placed(events: DataFrame, limit: int, window: int) -> DataFrame:
    """Adds ``calm``, ``segment`` and ``seeds`` to each event.

    Time is cut into slots as long as the window. In a calm slot, one that holds no more than
    ``limit`` events together with the slot before it, all events are accepted whatever came earlier.
    What follows a calm or empty slot depends on nothing older than that slot, so each run of slots
    that are not calm is a segment of its own, judged apart, with the events of the calm slot before
    it as accepted ``seeds``. Only one row per key and slot is sorted by key here.
    """
    slotted = events.withColumn("slot", F.floor(F.col("t") / window))
    counts = slotted.groupBy("user_key", "slot").agg(F.count("*").alias("n"))
    by_slot = Window.partitionBy("user_key").orderBy("slot")
    whole = by_slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    follows = F.coalesce(F.lag("slot").over(by_slot) == F.col("slot") - 1, F.lit(False))
    before = F.when(follows, F.lag("n").over(by_slot)).otherwise(0)
    noted = counts.withColumn("follows", follows).withColumn("calm", F.col("n") + before <= limit)
    carried = F.col("follows") & ~F.lag("calm").over(by_slot)
    begun = noted.withColumn("starts", (~F.col("calm") & ~F.coalesce(carried, F.lit(False))).cast("int"))
    next_starts = F.lead("follows").over(by_slot) & (F.lead("starts").over(by_slot) == 1)
    slots = begun.select(
        "user_key", "slot", "calm", F.sum("starts").over(whole).alias("segment"),
        (F.col("calm") & F.coalesce(next_starts, F.lit(False))).alias("seeds"),
    )
    return slotted.join(slots, ["user_key", "slot"]).select("user_key", "event_id", "t", "calm", "segment", "seeds")


VERDICT_SCHEMA = "user_key string, event_id bigint, t bigint, allowed boolean, retry_after_sec int"
VERDICT_COLUMNS = [part.split()[0] for part in VERDICT_SCHEMA.split(", ")]


def throttle(requests: DataFrame, max_requests: int = MAX_REQUESTS, window_sec: int = WINDOW_SECONDS) -> DataFrame:
    """Verdicts on ``requests(event_id, user_key, ts)`` in time order per key.

    Calm times are settled without leaving the JVM. The rest reaches the workers sorted and is judged
    in one pass that remembers at most ``max_requests`` times, so memory does not grow with the number
    of events of a key.
    """
    limit, window = _limits(max_requests, window_sec)
    timed = requests.select("user_key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    keys = ["user_key", "segment"]
    parts = shuffle_partitions(requests.sparkSession)
    placed = _placed(timed, limit, window)
    calm = placed.where("calm").select("user_key", "event_id", "t", F.lit(True).alias("allowed"), F.lit(0).alias("retry_after_sec"))
    segment = F.when(F.col("calm"), F.col("segment") + 1).otherwise(F.col("segment"))
    busy = placed.where(~F.col("calm") | F.col("seeds")).select(
        "user_key", "event_id", "t", segment.alias("segment"), F.col("calm").alias("seed")
    )
    ordered = busy.repartition(parts, *keys).sortWithinPartitions(*keys, "t", "event_id")

    def run(batches):
        current, accepted = None, deque()
        for batch in batches:
            times, seed = batch["t"].to_numpy(), batch["seed"].to_numpy()
            allowed, retry = np.ones(len(batch), bool), np.zeros(len(batch), np.int32)
            fresh = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
            edges = [*np.flatnonzero(fresh), len(batch)]
            for start, stop in zip(edges, edges[1:]):
                group = (batch["user_key"].iat[start], batch["segment"].iat[start])
                if group != current:
                    current, accepted = group, deque()
                allowed[start:stop], retry[start:stop] = judge(times[start:stop], accepted, limit, window)
            out = batch[["user_key", "event_id", "t"]].assign(allowed=allowed, retry_after_sec=retry)
            yield out[~seed]

    return calm.unionByName(ordered.mapInPandas(run, VERDICT_SCHEMA))


STATE_SCHEMA = "accepted array<bigint>, pending_t array<bigint>, pending_id array<bigint>, done bigint"


def throttle_stream(
    requests: DataFrame, max_requests: int = MAX_REQUESTS, window_sec: int = WINDOW_SECONDS, lateness: str = "1 minute"
) -> DataFrame:
    """The same verdicts on a stream.

    Events wait until the watermark passes them, so they are judged in time order; events older than
    what has been judged are dropped. State goes away once its key has been quiet for a window.
    """
    limit, window = _limits(max_requests, window_sec)

    def step(key, frames, state: GroupState):
        accepted, times, ids, done = state.get if state.exists else ([], [], [], -1)
        waiting = [(t, i) for t, i in zip(times, ids)]
        for frame in frames:
            waiting += [(t, i) for t, i in zip(frame["t"].tolist(), frame["event_id"].tolist()) if t > done]
        mark = state.getCurrentWatermarkMs() * 1000
        ready = sorted(item for item in waiting if item[0] <= mark)
        waiting = sorted(item for item in waiting if item[0] > mark)
        recent, times = deque(accepted), np.array([t for t, _ in ready], np.int64)
        verdicts = judge(times, recent, limit, window)
        rows = [(key[0], event, t, bool(ok), int(wait)) for (t, event), ok, wait in zip(ready, *verdicts)]
        if not waiting and (not recent or recent[-1] < mark - window):
            state.remove()
        else:
            state.update((list(recent), [t for t, _ in waiting], [i for _, i in waiting], max(done, mark)))
            wake = waiting[0][0] if waiting else recent[-1] + window
            state.setTimeoutTimestamp(max(wake, mark) // 1000 + 1)
        yield pd.DataFrame(rows, columns=VERDICT_COLUMNS)

    timed = requests.select(
        "user_key", "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
    ).withWatermark("ts", lateness)
    return timed.groupBy("user_key").applyInPandasWithState(
        step, VERDICT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
    )


CLOSING_KEY = "closing tick"


def with_closing_tick(requests: DataFrame, folder: str) -> DataFrame:
    """A stream with one more event far in the future, so that a run over all present input judges every event.

    The added event itself is never judged. ``folder`` takes the file that it is read from.
    """
    spark = requests.sparkSession
    schema = requests.select("event_id", "user_key", "ts").schema
    tick = spark.sql(f"SELECT -1 AS event_id, '{CLOSING_KEY}' AS user_key, TIMESTAMP_NTZ '2260-01-01' AS ts")
    tick.select(*(F.col(f.name).cast(f.dataType) for f in schema)).coalesce(1).write.parquet(folder)
    return requests.select("event_id", "user_key", "ts").unionByName(spark.readStream.schema(schema).parquet(folder))
