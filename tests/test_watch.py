"""Streams with timers: what is noticed without input, and after a restart."""

import datetime as dt
import random
import time

import pytest

from ledgerlight.streaming import watch

READS, VERDICTS = "work_id string, at timestamp, listed boolean, consistent boolean", "slice string, at timestamp, verdict string"
T0 = dt.datetime(2024, 1, 1, 10, 0)


@pytest.fixture
def timed(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    watch.use_timers(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def started(spark, df, tmp_path, **trigger):
    return df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(**trigger).start(f"{tmp_path}/out")


def wait_for(spark, tmp_path, schema, test, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        rows = spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()
        if test(rows):
            return rows
        time.sleep(1)
    raise AssertionError(rows)


def test_timers_fire_without_input_and_after_a_restart(timed, tmp_path):
    schema = "work_id string, state string, at timestamp, by string"
    now = dt.datetime.now()
    put(timed, tmp_path / "in", [("a", now, True, True), ("b", now, False, True)], READS)
    run = lambda: started(timed, watch.watched(timed.readStream.schema(READS).parquet(str(tmp_path / "in")), silent_minutes=0.05, after_minutes=0.3, forget_minutes=9), tmp_path, processingTime="1 second")
    q = run()
    try:
        rows = wait_for(timed, tmp_path, schema, lambda rows: {(r.work_id, r.state, r.by) for r in rows} >= {("a", "missing", "silence"), ("b", "missing", "read")})
    finally:
        q.stop()
    assert not [r for r in rows if r.state == "retired" and r.work_id == "a"]
    q = run()  # no new input from here on
    try:
        rows = wait_for(timed, tmp_path, schema, lambda rows: {(r.work_id, r.state) for r in rows} >= {("a", "retired"), ("b", "retired")})
    finally:
        q.stop()
    assert sorted((r.work_id, r.state, r.by) for r in rows) == [("a", "missing", "silence"), ("a", "retired", "silence"), ("b", "missing", "read"), ("b", "retired", "silence")]


def test_reads_decide_by_their_own_time(timed, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    first = [("a", at(0), False, True), ("a", at(5), False, True), ("b", at(0), False, True), ("c", at(1), True, True), ("d", at(0), True, True), ("e", at(0), False, True)]
    second = [("a", at(12), False, True), ("b", at(12), False, False), ("b", at(13), True, True), ("c", at(14), True, True)]
    third = [("z", at(60), True, True)]
    stream = lambda: timed.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "0 seconds")
    for part in (first, second, third):
        put(timed, tmp_path / "in", part, READS)
        started(timed, watch.watched(stream(), silent_minutes=30, after_minutes=10, event_time=True), tmp_path, availableNow=True).awaitTermination()
    got = {(r.work_id, r.state, r.by) for r in timed.read.parquet(f"{tmp_path}/out").collect()}
    assert got >= {("a", "missing", "read"), ("a", "retired", "read"), ("b", "missing", "read"), ("b", "restored", "read"), ("d", "missing", "silence"), ("e", "missing", "read"), ("e", "retired", "silence")}
    assert not {("b", "retired", "read"), ("c", "retired", "silence"), ("z", "missing", "silence")} & got


def test_failures_are_queued_and_come_due(timed, tmp_path):
    schema = "slice string, lifecycle string, failures int, due_at timestamp, escalated boolean"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    parts = [[("ok", at(0), "ok"), ("once", at(0), "count"), ("thrice", at(0), "count")], [("thrice", at(1), "rows"), ("thrice", at(2), "rows")], [("once", at(3), "ok"), ("other", at(60), "ok")]]
    stream = lambda: timed.readStream.schema(VERDICTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "0 seconds")
    for part in parts:
        put(timed, tmp_path / "in", part, VERDICTS)
        started(timed, watch.attempts(stream(), event_time=True), tmp_path, availableNow=True).awaitTermination()
    rows = timed.read.schema(schema).parquet(f"{tmp_path}/out").collect()
    got = {(r.slice, r.lifecycle, r.failures, r.escalated) for r in rows}
    assert got >= {("once", "retry", 1, False), ("thrice", "retry", 1, False), ("thrice", "quarantined", 3, True), ("once", "live", 0, False), ("thrice", "due", 3, True)} and not any(r.slice in ("ok", "other") for r in rows)
    assert {r.due_at for r in rows if r.slice == "thrice" and r.lifecycle == "quarantined"} == {at(22)}


def test_figures_that_moved_are_those_of_the_batch(timed, tmp_path):
    from ledgerlight.streaming import ingest

    rng = random.Random(2)
    schema = "root string, level int, slice string, parent string, at timestamp, n bigint, total double"
    places = [(f"S{s}", 0, f"S{s}", None) for s in range(5)] + [(f"S{s}", 1, f"S{s}D{d}", f"S{s}") for s in range(5) for d in range(4)] + [(f"S{s}", 2, f"S{s}D{d}T{t}", f"S{s}D{d}") for s in range(5) for d in range(4) for t in range(3)]
    figures, seen, want = {p[2]: (5, 1.0) for p in places}, {}, set()
    for read in range(4):
        for p in places:
            if rng.random() < 0.3:
                figures[p[2]] = (rng.randrange(9), round(rng.random(), 3))
        rows = [(*p, T0 + dt.timedelta(hours=read), *figures[p[2]]) for p in places]
        frame = timed.createDataFrame(rows, schema)
        # in a batch: what each slice was when it was last compared
        last = timed.createDataFrame(list(seen.items()) or [("none", "none")], "slice string, signature string")
        levels = [frame.where(f"level = {k}") for k in range(3)]
        for k in range(3):
            found = ingest.changed_below(levels[: k + 1], [last] * (k + 1)).collect()
            want |= {(read, k, r.slice) for r in found}
        marks = {r.slice: r.signature for r in ingest.signatures(frame).collect()}
        seen |= {s: marks[s] for x, _, s in want if x == read}
        put(timed, tmp_path / "in", rows, schema)
        started(timed, watch.moved(timed.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path, availableNow=True).awaitTermination()
        got = {((r.at - T0).seconds // 3600, r.level, r.slice) for r in timed.read.parquet(f"{tmp_path}/out").collect()}
        assert got == want
    assert len(places) < len(want) < 4 * len(places)
