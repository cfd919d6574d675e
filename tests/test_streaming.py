import random
from collections import defaultdict, deque
from contextlib import nullcontext
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditspark import dims
from auditspark.session import uncounted
from auditspark.streaming import incremental, reviews, status, throttle

START = datetime(2024, 1, 1)


def model_throttle(events, limit, window):
    """events: (event_id, key, second); verdicts by event."""
    out, queues = {}, defaultdict(deque)
    for event, key, now in sorted(events, key=lambda e: (e[2], e[0])):
        queue = queues[key]
        while queue and queue[0] < now - window:
            queue.popleft()
        if len(queue) >= limit:
            out[event] = (False, int(max(1, window - (now - queue[0]))))
        else:
            queue.append(now)
            out[event] = (True, 0)
    return out


def frame(spark, events):
    rows = [(e, k, START + timedelta(seconds=s)) for e, k, s in events]
    return spark.createDataFrame(rows, "event_id bigint, user_key string, ts timestamp_ntz")


def random_events(seed, n=3000):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot"] * 6 + ["a", "b", "c"]), rng.choice([rng.randint(0, 4000), rng.randint(0, 400) * 10])) for i in range(n)]


@pytest.mark.parametrize("limit,window", [(6, 60), (1, 5), (0, 0), (3, 1000)])
def test_throttle_equals_model(spark, limit, window):
    events = random_events(limit + window)
    got = {r.event_id: (r.allowed, r.retry_after_sec) for r in throttle.throttle(frame(spark, events), limit, window).collect()}
    assert got == model_throttle(events, max(1, limit), max(1, window))


@pytest.mark.parametrize("limit,window", [(6, 60), (2, 20), (1, 5), (3, 7)])
def test_busy_and_quiet_stretches_of_one_key(spark, limit, window):
    rng = random.Random(limit)
    events, now = [], 0
    for n in range(2000):
        now += rng.choice([0, 1, 2]) if (n // 50) % 3 == 0 else rng.randint(0, 2 * window)
        events.append((n, "hot", now))
    df = frame(spark, events)
    got = {r.event_id: (r.allowed, r.retry_after_sec) for r in throttle.throttle(df, limit, window).collect()}
    assert len(got) == len(events) and got == model_throttle(events, limit, window)
    timed = df.select("user_key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    placed = throttle._placed(timed, limit, window * throttle.MICROS)
    assert placed.where("not calm").select("segment").distinct().count() > 3 and placed.where("calm").count() > 0


def run_stream(query):
    query.processAllAvailable()
    query.stop()


def test_throttle_stream_equals_model(spark, tmp_path):
    events = sorted(random_events(5, 600), key=lambda e: e[2])
    batches = [events[:200], events[200:450], events[450:], [(9999, "end", 10**6)], [(9998, "end", 10**6 + 1)]]
    source, sink = tmp_path / "in", tmp_path / "out"
    for n, batch in enumerate(batches):
        random.Random(n).shuffle(batch)
        frame(spark, batch).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("event_id bigint, user_key string, ts timestamp_ntz").parquet(str(source))
        out = throttle.throttle_stream(stream, 4, 60, "10 seconds")
        run_stream(
            out.writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(tmp_path / "cp")).start()
        )
    got = {r.event_id: (r.allowed, r.retry_after_sec) for r in spark.read.parquet(str(sink)).collect() if r.user_key != "end"}
    assert got == model_throttle(events, 4, 60)


def model_status(events):
    states = {}
    for scan, seq, op, progress, error in sorted(events, key=lambda e: e[1]):
        after = status.next_state(states.get(scan), op, progress, error)
        if after is not None:
            states[scan] = after
    return {scan: (s["status"], s["progress"], s["error"]) for scan, s in states.items()}


def random_log(seed, n=2500):
    rng = random.Random(seed)
    ops = ["create"] + ["running"] * 3 + ["progress"] * 8 + ["completed", "failed"]
    return [(rng.randint(1, 60), i, rng.choice(ops), rng.randint(-20, 130), f"e{i}" * 400) for i in range(n)]


LOG = "scan_id bigint, seq bigint, op string, progress int, error string"


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_status_fold_equals_model(spark, chunk, monkeypatch):
    monkeypatch.setattr(status, "CHUNK", chunk)
    log = random_log(chunk)
    df = spark.createDataFrame(log, LOG).withColumn("ts", F.timestamp_seconds("seq"))
    got = {r.scan_id: (r.status, r.progress, r.error) for r in status.status_fold(df).collect()}
    assert got == model_status(log)


def test_status_rules():
    state = status.next_state(None, "progress", 5, None)
    assert state is None
    state = status.next_state(None, "create", 0, None)
    assert state["status"] == "queued"
    state = status.next_state(state, "progress", 150, None)
    assert (state["status"], state["progress"]) == ("running", 100)
    state = status.next_state(status.next_state(state, "failed", 0, "x" * 2000), "progress", 7, None)
    assert (state["status"], state["progress"], len(state["error"])) == ("failed", 100, 1200)
    assert status.next_state(state, "running", 0, None)["status"] == "running"


TIMED_LOG = LOG + ", ts timestamp"


def timed(log):
    return [(*row, START + timedelta(seconds=row[1])) for row in log]


def run_status(spark, parts, folder, lateness="10 minutes", **options):
    """Latest shown status of each scan after one run per part."""
    latest, sizes = {}, []

    def keep(batch, _):
        for r in batch.collect():
            latest[int(r.scan_id)] = (r.status, r.progress, r.error)

    for n, part in enumerate(parts):
        spark.createDataFrame(part, TIMED_LOG).repartition(4).write.mode("append").parquet(str(folder / "in"))
        stream = status.status_stream(spark.readStream.schema(TIMED_LOG).parquet(str(folder / "in")), lateness, **options)
        query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return latest, sizes


@pytest.mark.parametrize("records", ["4096", "1"])
def test_status_stream_equals_model(spark, tmp_path, records):
    log = random_log(3, 600)
    mixed = sorted(timed(log), key=lambda e: random.Random(e[1]).random() * 40 + e[1] // 80 * 80)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        latest, _ = run_status(spark, (mixed[:250], mixed[250:400], mixed[400:]), tmp_path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    assert latest == model_status(log)


def test_status_stream_of_many_shuffled_events_equals_the_fold(spark, tmp_path):
    rng = random.Random(8)
    log, seq = [], 0
    for k in range(40):
        for scan in range(1500):
            log.append((scan, seq, "create" if k == 0 else rng.choice(["running", "progress", "progress", "completed", "failed"]), rng.randint(0, 99), None))
            seq += 1
    df = spark.createDataFrame(timed(log), TIMED_LOG)
    want = {int(r.scan_id): (r.status, r.progress, r.error) for r in status.status_fold(df).collect()}
    rng.shuffle(log)
    latest, _ = run_status(spark, [timed(log)], tmp_path, "1 day")
    assert len(log) == 60_000 and latest == want


@pytest.mark.parametrize("seed", range(4))
def test_folding_many_scans_at_once_equals_one_event_at_a_time(seed):
    rng = random.Random(seed)
    scans = [None, *({"status": s, "progress": 7, "error": "old"} for s in status.STATUSES)] * 12
    ops = status.OPS + (["progress"] * 4 if seed % 2 else [])
    events = sorted(((rng.randrange(len(scans)), rng.choice(ops), rng.randint(-20, 130)) for _ in range(200 * seed)), key=lambda e: e[0])
    now = [(-1, 0, 0) if s is None else (status.STATUSES.index(s["status"]), 7, 0) for s in scans]
    columns = [np.array([e[0] for e in events], int), np.array([status.OPS.index(e[1]) for e in events], int), np.array([max(0, min(100, e[2])) for e in events], int)]
    got = status.folded(tuple(np.array(c) for c in zip(*now)), *columns, np.arange(1, len(events) + 1))
    for n, (scan, op, progress) in enumerate(events, 1):
        scans[scan] = status.next_state(scans[scan], op, progress, str(n))
    for scan, code, progress, error in zip(scans, *got):
        want = None if scan is None else (scan["status"], scan["progress"], scan["error"])
        assert (None if code < 0 else (status.STATUSES[code], progress, {0: "old", -1: None}.get(error, str(error)))) == want


def test_scans_share_one_state_and_one_call_by_buckets(spark, tmp_path):
    log = [(scan, seq, op, progress, None if seq % 5 == 0 else f"\u00e4\u4e2d{seq}") for scan, seq, op, progress, _ in random_log(11, 900)]
    mixed = sorted(timed(log), key=lambda e: random.Random(e[1]).random() * 40 + e[1] // 80 * 80)
    latest, sizes = run_status(spark, (mixed[:300], mixed[300:301], mixed[301:]), tmp_path, buckets=7)
    assert latest == model_status(log) and max(sizes) == 7 < len(latest)


def test_unknown_operations_fail_and_scans_without_a_name_are_one(spark, tmp_path):
    start = spark.createDataFrame(timed([(None, 1, "create", 0, None), (None, 2, "failed", 0, "e" * 2000), (4, 3, "pause", 0, None)]), TIMED_LOG)
    start.write.parquet(str(tmp_path / "in"))
    got, read = [], lambda: spark.readStream.schema(TIMED_LOG).parquet(str(tmp_path / "in"))
    run = lambda: status.status_stream(read()).writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(b.collect())).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    assert [tuple(r) for r in got] == [(None, "failed", 0, "e" * 1200, 2)]
    spark.createDataFrame(timed([(4, 2, "create", 0, None)]), TIMED_LOG).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="unknown operation"):
        run()


def test_state_of_closed_scans_goes(spark, tmp_path):
    log = [(s, 2 * s, "create", 0, None) for s in range(20)] + [(s, 2 * s + 1, "completed" if s % 2 else "failed", 0, "e") for s in range(20)]
    late = [(99, 10**6, "progress", 1, None)]
    _, sizes = run_status(spark, (timed(log), timed(late), timed([(98, 10**6 + 1, "progress", 1, None)])), tmp_path, "10 seconds", remembered=60)
    assert sizes[0] == 20 and sizes[-1] <= 2


def test_state_of_scans_that_never_close_goes(spark, tmp_path):
    log = [(s, 3 * s + k, op, 10, None) for s in range(20) for k, op in enumerate(("create", "running", "progress"))]
    later = [(200 + n, 10**6 + n, "progress", 1, None) for n in range(2)]
    latest, sizes = run_status(spark, (timed(log), timed(later[:1]), timed(later[1:])), tmp_path, "10 seconds", abandoned=3600)
    assert latest == model_status(log) and sizes[0] == 20 and sizes[-1] <= 2


def test_new_files_are_scanned_once(spark, tmp_path):
    schema = "scan_id string, file_path string, content string"
    rows = [[("s", "a.py", "eval(x)\n# TODO")], [("s", "b.py", "password == x"), ("t", "c.py", "eval(x)")], [("s", "a.py", "import os\n"), ("u", "d.py", "")]]
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = incremental.scan_new_files(stream, str(tmp_path / "found"), str(tmp_path / "sums"), str(tmp_path / "cp"))
        query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "found"))
    hits = [(r.batch_id, r.rule_id) for r in found.collect()]
    assert sum(rule in ("EVAL_USAGE", "TODO_HACK_MARKER", "INSECURE_AUTH_LOGIC") for _, rule in hits) == 4 and (2, "UNUSED_IMPORT") in hits
    counts = {r.scan_id: r.asDict() for r in incremental.current_counts(spark, str(tmp_path / "sums")).collect()}
    # the new version of a.py replaces the findings of the old one
    assert counts["s"]["high"] == 1 and counts["t"]["high"] == 1 and sum(v for k, v in counts["u"].items() if k != "scan_id") == 0


def test_closing_tick_lets_a_run_judge_every_event(spark, tmp_path):
    events = random_events(9, 400)
    frame(spark, events).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id bigint, user_key string, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    out = throttle.throttle_stream(throttle.with_closing_tick(stream, str(tmp_path / "tick")), 3, 60, "10 seconds")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r.event_id: (r.allowed, r.retry_after_sec) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == model_throttle(events, 3, 60)


def test_late_answers_equal_the_batch_and_unanswered_issues_come_out(spark, tmp_path):
    at = lambda minute: START + timedelta(minutes=minute)
    old = {key: f"old {key}" for key in dims.ANSWER_KEYS}
    issue = lambda n, minute: ("s", n, at(minute), "code", *old.values())
    raw = lambda text: '{"refactored_code": "%s", "severity": ""}' % text
    issue_schema = "scan_id string, issue_seq bigint, sent_at timestamp, code_snippet string, " + ", ".join(f"{k} string" for k in old)
    answer_schema = "scan_id string, issue_seq bigint, answered_at timestamp, raw string"
    days = 24 * 60
    batches = [
        ([issue(1, 0), issue(2, 0), issue(3, 1), issue(4, 2)], [("s", 1, at(5), raw("one")), ("s", 5, at(6), raw("five")), ("s", 4, at(1), raw("early"))]),
        ([issue(5, 5)], [("s", 1, at(5), raw("one")), ("s", 2, at(61), raw("late")), (None, 3, at(7), raw("none")), ("t", 3, at(7), raw("other"))]),
        ([issue(8, days)], [("s", 9, at(days), raw("end"))]),
        ([issue(8, 2 * days)], [("s", 9, at(2 * days), raw("end"))]),
    ]
    sink, got = tmp_path / "out", []
    for n, (issues, answers) in enumerate(batches):
        spark.createDataFrame(issues, issue_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "issues"))
        spark.createDataFrame(answers, answer_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "answers"))
        out = reviews.reviewed(spark.readStream.schema(issue_schema).parquet(str(tmp_path / "issues")),
                               spark.readStream.schema(answer_schema).parquet(str(tmp_path / "answers")))
        writer = out.writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(tmp_path / "log"))
        writer.trigger(availableNow=True).start().awaitTermination()
        got.append(sorted((r.issue_seq, r.answered, r.refactored_code, r.after_code, r.severity) for r in spark.read.parquet(str(sink)).collect()))
    unanswered = lambda n: (n, False, "old refactored_code", "old refactored_code", "old severity")
    answered = lambda n, text: (n, True, text, text, "old severity")
    assert got[1] == [answered(1, "one"), answered(5, "five")]
    assert [r for r in got[3] if r[0] < 8] == [answered(1, "one"), unanswered(2), unanswered(3), unanswered(4), answered(5, "five")]


def test_only_answers_that_met_their_issue_are_parsed(spark, tmp_path):
    texts = ", ".join(f"{key} string" for key in dims.ANSWER_KEYS)
    schemas = {"issues": f"scan_id string, issue_seq bigint, sent_at timestamp, code_snippet string, raw string, {texts}",
               "answers": "scan_id string, issue_seq bigint, answered_at timestamp, raw string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    issues, answers = (spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}") for name, schema in schemas.items())
    out = reviews.reviewed(issues, answers)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "raw" in out.columns and "from_json" not in plan[plan.index("Join LeftOuter"):] and "from_json" in plan


def test_state_of_answers_is_kept_on_disk(spark, tmp_path):
    texts = [f"'old' {key}" for key in dims.ANSWER_KEYS]
    start = "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, id)"
    spark.range(200).selectExpr("'s' scan_id", "id issue_seq", f"{start} sent_at", "'code' code_snippet", *texts).write.parquet(str(tmp_path / "issues"))
    spark.range(200).selectExpr("'s' scan_id", "id issue_seq", f"{start} answered_at", """'{"severity": "low"}' raw""").write.parquet(str(tmp_path / "answers"))
    streams = [spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name)) for name in ("issues", "answers")]
    writer = reviews.reviewed(*streams).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("answered and severity = 'low'").count() == 200
    operators = [o for progress in query.recentProgress for o in progress["stateOperators"]]
    assert {o["operatorName"] for o in operators} == {"symmetricHashJoin", "dedupeWithinWatermark"}
    assert all(any(name.startswith("rocksdb") for name in o["customMetrics"]) for o in operators)


def test_streams_started_uncounted_count_no_state_rows(spark, tmp_path):
    key, sizes = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", []
    frame(spark, random_events(1, 50)).write.parquet(str(tmp_path / "in"))
    for n, scope in enumerate((nullcontext(), uncounted(spark))):
        stream = spark.readStream.schema("event_id bigint, user_key string, ts timestamp_ntz").parquet(str(tmp_path / "in"))
        writer = throttle.throttle_stream(stream, 3, 60, "10 seconds").writeStream.format("noop").option("checkpointLocation", str(tmp_path / f"cp{n}"))
        with scope:
            query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        assert spark.conf.get(key, "true") == "true"
    assert sizes[0] > 0 == sizes[1]
