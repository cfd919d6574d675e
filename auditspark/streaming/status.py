"""Scan status as a fold over an event log."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditspark.operators import issues

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Closing operations, status after an operation, length of a stored error.
CLOSING = ("completed", "failed")
STATUS_AFTER = {"create": "queued", "running": "running", "progress": "running", "completed": "completed", "failed": "failed"}
ERROR_CHARS = 1200
CHUNK = 100_000


def clamp(progress: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), progress))


def _opening(events: DataFrame) -> DataFrame:
    """Adds ``gate``: the last operation before each row that opened or closed the scan.

    The log of a scan is cut into chunks of event numbers. Rows look back within their chunk, and
    one row per chunk hands the last such operation on, so no task sorts a whole log.
    """
    gate_op = F.when(F.col("op") != "progress", F.col("op"))
    chunked = events.withColumn("chunk", F.floor(F.col("seq") / CHUNK))
    ends = chunked.groupBy("scan_id", "chunk").agg(F.max_by(F.when(F.col("op") != "progress", F.col("op")), F.when(F.col("op") != "progress", F.col("seq"))).alias("end_op"))
    earlier = Window.partitionBy("scan_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("scan_id", "chunk", F.last("end_op", ignorenulls=True).over(earlier).alias("handed"))
    before = Window.partitionBy("scan_id", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    looked = chunked.withColumn("near", F.last(gate_op, ignorenulls=True).over(before))
    return looked.join(handed, ["scan_id", "chunk"]).withColumn("gate", F.coalesce("near", "handed"))


def status_fold(events: DataFrame) -> DataFrame:
    """Final status of each created scan from ``events(scan_id, seq, ts, op, progress, error)``.

    Progress after completion or failure is ignored; a restart is not.
    """
    op, seq = F.col("op"), F.col("seq")
    gated = _opening(events)
    counted = gated.where((op != "progress") | ~F.coalesce(F.col("gate").isin(*CLOSING), F.lit(False)))
    status = None
    for name, after in STATUS_AFTER.items():
        status = F.when(op == name, after) if status is None else status.when(op == name, after)
    progress = F.when(op == "create", 0).when(op == "completed", 100).when(op == "progress", clamp(F.col("progress")))

    def latest(value: Column, test: Column) -> Column:
        return F.max_by(value, F.when(test, seq))

    folded = counted.groupBy("scan_id").agg(
        F.max(F.when(op == "create", seq)).alias("created_seq"),
        F.max_by(status, seq).alias("status"),
        latest(progress, op.isin("create", "completed", "progress")).alias("progress"),
        F.max_by(F.col("ts"), seq).alias("updated_at"),
        F.max(F.when(op == "failed", seq)).alias("failed_seq"),
        latest(F.left("error", F.lit(ERROR_CHARS)), op == "failed").alias("last_error"),
    )
    error = F.when(F.col("failed_seq") > F.col("created_seq"), F.col("last_error")).alias("error")
    return folded.where(F.col("created_seq").isNotNull()).select("scan_id", "status", "progress", "updated_at", error)


def status_of(statuses: DataFrame, user: str | None = None, scan_id=None) -> DataFrame:
    """The statuses that the user may see, of one scan or of all."""
    seen = statuses.where(issues.visible_to(F.col("owner_uid"), user))
    return seen if scan_id is None else seen.where(F.col("scan_id") == scan_id)


def next_state(state: dict | None, op: str, progress, error) -> dict | None:
    """The status after one event; None while the scan has not been created. ``folded`` is held against this."""
    if op == "create":
        return {"status": "queued", "progress": 0, "error": None}
    if state is None or (op == "progress" and state["status"] in CLOSING):
        return state
    out = {**state, "status": STATUS_AFTER[op]}
    if op == "progress":
        out["progress"] = max(0, min(100, int(progress)))
    elif op == "completed":
        out["progress"] = 100
    elif op == "failed":
        out["error"] = None if error is None else str(error)[:ERROR_CHARS]
    return out


STATUS_SCHEMA = "scan_id string, status string, progress int, error string, last_seq bigint"
STATE_SCHEMA = "known binary, waiting binary"
#: seconds that a closed scan is remembered after its last event, in case it is restarted, and one that was left open
REMEMBERED, ABANDONED = 7 * 24 * 3600, 30 * 24 * 3600
#: scans are kept in this many groups by a hash, each of them one state and one Python call in a batch
BUCKETS = 4096

# Operations and statuses are numbers in the order of STATUS_AFTER; UNKNOWN stands for any other operation, NONE for a scan without a create event.
OPS, STATUSES = list(STATUS_AFTER), list(dict.fromkeys(STATUS_AFTER.values()))
CREATE, PROGRESS, COMPLETED, FAILED = (OPS.index(op) for op in ("create", "progress", "completed", "failed"))
UNKNOWN, NONE, FIRST = -1, -1, np.iinfo("int64").min
AFTER = np.array([STATUSES.index(status) for status in STATUS_AFTER.values()], "int8")
#: of each scan its settled status, the number of its last settled event and the latest time of these
KNOWN = pa.schema([("scan_id", pa.large_string()), ("status", pa.int8()), ("progress", pa.int32()), ("error", pa.large_string()),
                   ("last_seq", pa.int64()), ("newest_at", pa.int64())])
#: events that the watermark has not passed; ``scan`` is a row of the known scans
WAITING = pa.schema([("scan", pa.int32()), ("seq", pa.int64()), ("t", pa.int64()), ("op", pa.int8()), ("progress", pa.int32()), ("error", pa.large_string())])


def folded(now: tuple, scan: np.ndarray, op: np.ndarray, progress: np.ndarray, fault: np.ndarray) -> tuple:
    """``next_state`` over the events of many scans at once: status, progress and number of the error of each scan.

    Events are in the order of scan and ``seq``; ``now`` holds the three arrays as they are before. Where an index
    repeats, numpy's assignment leaves the last value, so that the last event of a scan decides.
    """
    status, percent, error = (values.copy() for values in now)
    place = np.arange(len(scan))
    begin = np.maximum.accumulate(np.where(np.diff(scan, prepend=-1) != 0, place, 0))
    closing, closed = [OPS.index(o) for o in CLOSING], [STATUSES.index(STATUS_AFTER[o]) for o in CLOSING]
    gate = np.maximum.accumulate(np.where(op != PROGRESS, place, -1))
    gate = np.concatenate([[-1], gate[:-1]])[: len(place)]
    shut = np.where(gate >= begin, np.isin(op[gate], closing), np.isin(status[scan], closed))
    created = (status[scan] != NONE) | (np.maximum.accumulate(np.where(op == CREATE, place, -1)) >= begin)
    counted = created & ~((op == PROGRESS) & shut)
    if (op[counted] == UNKNOWN).any():
        raise ValueError("an event of a created scan has an unknown operation")

    def put(values: np.ndarray, test: np.ndarray, new: np.ndarray) -> None:
        values[scan[test]] = new[test]

    put(status, counted, AFTER[op])
    put(percent, counted & np.isin(op, [CREATE, PROGRESS, COMPLETED]), np.select([op == CREATE, op == COMPLETED], [0, 100], progress))
    put(error, counted & np.isin(op, [CREATE, FAILED]), np.where(op == CREATE, -1, fault))
    return status, percent, error


def _unpacked(packed, schema: pa.Schema) -> list[pa.Array]:
    return pa.ipc.read_record_batch(pa.py_buffer(packed), schema).columns


def _packed(columns: list, schema: pa.Schema) -> bytes:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.record_batch(arrays, schema=schema).serialize().to_pybytes()


def _joined(parts: list, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([pa.array(part, kind, from_pandas=True) if not isinstance(part, pa.Array) else part for part in parts] or [pa.array([], kind)])


def _taken(texts: pa.Array, numbers: np.ndarray) -> pa.Array:
    return texts.take(pa.array(numbers, pa.int64(), mask=numbers < 0))


def status_stream(events: DataFrame, lateness: str = "10 minutes", remembered: int = REMEMBERED, abandoned: int = ABANDONED, buckets: int = BUCKETS) -> DataFrame:
    """The same fold on a stream, in update mode.

    Events of a scan may come in any order within ``lateness``. Those that the watermark has not passed are kept and
    folded anew in each batch, so that every status shown takes in all events so far in the order of ``seq``; what the
    watermark has passed is settled, and an event older than that is dropped. State goes ``remembered`` seconds after
    the last event of a closed scan and ``abandoned`` seconds after that of an open one, so that every scan's state ends; it is
    never kept for events without a create event that are settled. Scans are folded by groups, as a Python call costs
    far more than the events of one scan; ``buckets`` is part of the state and stays for the life of a stream.
    """

    def step(key, frames, state: GroupState):
        mark = state.getCurrentWatermarkMs() * 1000
        known = [pa.array([], f.type) for f in KNOWN]
        waiting = [pa.array([], f.type) for f in WAITING]
        if state.exists:
            known, waiting = (_unpacked(packed, schema) for packed, schema in zip(state.get, (KNOWN, WAITING)))
        parts = [] if state.hasTimedOut else list(frames)
        new = {c: _joined([part[c] for part in parts], WAITING.field(c).type) for c in WAITING.names[1:]}
        if new["seq"].null_count or new["t"].null_count:
            raise ValueError("an event without a number or a time has no place in the order")

        # scans are rows of the known ones, followed by those met for the first time
        ids = pa.concat_arrays([known[0], _joined([part["scan_id"] for part in parts], pa.large_string())]).dictionary_encode("encode")
        old, scans = len(known[0]), len(ids.dictionary)
        more = scans - old
        status, percent, last, newest_at = (
            np.concatenate([known[n].to_numpy(), np.full(more, blank, known[n].to_numpy().dtype)]) for n, blank in ((1, NONE), (2, 0), (4, FIRST), (5, 0))
        )
        arrived = ids.indices.to_numpy()[old:]
        # errors are numbers of texts: those of known scans, of waiting events and of new ones
        texts = pa.concat_arrays([known[3], waiting[5], new["error"]])
        error = np.concatenate([np.arange(old), np.full(more, -1)])

        scan = np.concatenate([waiting[0].to_numpy(), arrived])
        seq, t, op, progress = (np.concatenate([waiting[n].to_numpy(), new[c].to_numpy()]) for n, c in enumerate(WAITING.names[1:5], 1))
        fault = np.arange(old, old + len(scan))
        order = np.lexsort((seq, scan))
        order = order[seq[order] > last[scan[order]]]
        scan, seq, t, op, progress, fault = (values[order] for values in (scan, seq, t, op, progress, fault))
        now = status, percent, error

        if not state.hasTimedOut:
            shown, newest = folded(now, scan, op, progress, fault), last.copy()
            newest[scan] = seq
            seen = np.unique(arrived)
            seen = seen[shown[0][seen] != NONE]
            if len(seen):
                yield pd.DataFrame({
                    "scan_id": ids.dictionary.take(pa.array(seen)).to_pandas(), "status": np.array(STATUSES, object)[shown[0][seen]],
                    "progress": shown[1][seen], "error": _taken(texts, shown[2][seen]).to_pandas(), "last_seq": newest[seen],
                })

        # a scan's events are settled in their order, up to the first that the watermark has not passed
        place, ahead = np.arange(len(scan)), np.full(scans, len(scan))
        np.minimum.at(ahead, scan[t > mark], place[t > mark])
        past = place < ahead[scan]
        status, percent, error = folded(now, *(values[past] for values in (scan, op, progress, fault)))
        last[scan[past]] = seq[past]
        np.maximum.at(newest_at, scan[past], t[past])

        forgotten_at = newest_at + np.where(np.isin(status, [STATUSES.index(STATUS_AFTER[o]) for o in CLOSING]), remembered, abandoned) * 1_000_000
        open_events = ahead < len(scan)
        kept = open_events | ((status != NONE) & (forgotten_at > mark))
        if not kept.any():
            if state.exists:
                state.remove()
            return
        wake = forgotten_at
        wake[open_events] = t[ahead[open_events]]
        rows = pa.array(np.flatnonzero(kept))
        held = [ids.dictionary.take(rows), status[kept], percent[kept], _taken(texts, error[kept]), last[kept], newest_at[kept]]
        later = [(np.cumsum(kept) - 1)[scan[~past]], seq[~past], t[~past], op[~past], progress[~past], _taken(texts, fault[~past])]
        state.update((_packed(held, KNOWN), _packed(later, WAITING)))
        state.setTimeoutTimestamp(int(max(wake[kept].min(), mark)) // 1000 + 1)

    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    op, number = F.col("op"), F.lit(UNKNOWN)
    for n, name in enumerate(OPS):
        number = F.when(op == name, n).otherwise(number)
    error = F.when(op == "failed", F.left(F.col("error").cast("string"), F.lit(ERROR_CHARS)))
    scan_id = F.col("scan_id").cast("string")
    shaped = timed.select(
        F.pmod(F.xxhash64(scan_id), F.lit(buckets)).alias("bucket"), scan_id.alias("scan_id"), F.col("seq").cast("long").alias("seq"), number.cast("byte").alias("op"),
        clamp(F.col("progress")).cast("int").alias("progress"), error.alias("error"), "ts", F.unix_micros("ts").alias("t"),
    ).withWatermark("ts", lateness)
    return shaped.groupBy("bucket").applyInPandasWithState(
        step, STATUS_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.EventTimeTimeout
    )
