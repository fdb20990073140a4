import json

from pyspark.sql import functions as F

from ledgerlight.sources import readers, sinks
from ledgerlight.streaming import ingest


def test_report_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿"State","Cost ( ₹ )"\n"UP","1,200"\n,"9"\n', encoding="utf-8")
    df = readers.report_csv(spark, str(tmp_path / "a.csv"), "State")
    assert df.count() == 1 and readers.column_like(df, "state") == "State" and readers.column_like(df, "Cost") == df.columns[1]


def test_double_encoded_tiles_and_pages(spark, tmp_path):
    body = json.dumps(json.dumps([{"WORK_ID": 1, "AMT": "5"}, {"WORK_ID": 2, "AMT": "6"}]))
    empty = json.dumps(json.dumps([{"Total_Amt": "0"}]))
    df = spark.createDataFrame([("s1", body), ("s2", empty)], "slice string, body string")
    assert readers.tile_json(df, "WORK_ID:bigint,AMT:string").count() == 2
    (tmp_path / "p1.json").write_text(json.dumps({"total": 3, "offset": 0, "records": [{"a": 1}, {"a": 2}]}))
    (tmp_path / "p2.json").write_text(json.dumps({"total": 3, "offset": 2, "records": [{"a": 3}, {"a": 4}]}))
    assert sorted(r.a for r in readers.pages(spark, str(tmp_path), "a:bigint").collect()) == [1, 2, 3]


def test_router_and_first_source(spark):
    a, b = spark.range(5), spark.range(3, 9)
    assert readers.routed({"live": a, "csv": b}, ["live", "csv"], least_rows=6)[0] == "csv"
    won = readers.first_source_wins([a.withColumn("s", F.lit("a")), b.withColumn("s", F.lit("b"))], "id")
    assert won.count() == 9 and won.where("id = 4").first().s == "a"


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([("1", "UP", 5.0), ("2", "MP", 6.0)], "work_id string, state string, estimated_cost double")
    batch = spark.createDataFrame([("2", "MP", 7.0), ("3", "UP", 1.0)], "work_id string, state string, estimated_cost double")
    table, edits = sinks.upserted(t, batch, "work_id", "2024-01-01")
    assert [(r.field, r.old_value, r.new_value) for r in edits.collect()] == [("estimated_cost", "6", "7")] and table.count() == 3
    again, none = sinks.upserted(table, batch, "work_id", "2024-01-02")
    assert none.count() == 0 and sorted(map(tuple, again.collect())) == sorted(map(tuple, table.collect()))
    assert sinks.collisions(t, batch.withColumn("state", F.lit("X")), "work_id", "state").count() == 1


def test_partition_sink(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_all(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), path, "k")
    sinks.replace_partitions(spark.createDataFrame([(3, "b")], "v int, k string"), path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (3, "b")]


def test_removal_needs_two_reads(spark):
    known, listed = spark.createDataFrame([("a",), ("b",)], "work_id string"), spark.createDataFrame([("a",)], "work_id string")
    none = spark.createDataFrame([], "work_id string, first_missing_at timestamp")
    first = ingest.removals(listed, known, none, "2024-01-01 00:00:00")
    assert [(r.work_id, r.state) for r in first.collect()] == [("b", "missing")]
    state = lambda now, ok=True: {r.work_id: r.state for r in ingest.removals(listed, known, first, now, ok).collect()}
    assert state("2024-01-01 00:05:00") == {"b": "missing"} and state("2024-01-01 00:11:00") == {"b": "retired"} and state("2024-01-01 00:11:00", False) == {"b": "missing"}
    assert {r.state for r in ingest.removals(known, known, first, "2024-01-01 00:11:00").collect()} == {"restored"}


def test_windows(spark):
    events = spark.createDataFrame([("2024-01-01 00:01:00", 1, 2.0), ("2024-01-01 00:59:00", 1, 3.0), ("2024-01-01 02:00:00", 1, 4.0)], "ts string, user_id int, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in ingest.windowed(events, "1 hour").collect()) == [1, 2] and ingest.sessions(events, "30 minutes").count() == 3


def test_calls_give_errors_in_place_and_breaker_opens(spark):
    from ledgerlight.sources.remote import Breaker, called

    def call(row):
        if row["id"] % 3 == 0:
            raise ValueError("no")
        return str(row["id"])

    got = called(spark.range(9), call).collect()
    assert {r.id for r in got if r.error == "ValueError: no"} == {0, 3, 6} and all(r.body == str(r.id) for r in got if not r.error)
    b = Breaker(window=4)
    for ok in (True, False, False, False):
        b.record(ok, 0.0)
    assert not b.allows(59) and b.allows(60)
    b.record(False, 60.0)
    assert not b.allows(179) and b.allows(180)
    b.record(True, 180.0)
    assert b.allows(180) and b.pause == 60


def test_tile_cache_knows_its_place(spark, tmp_path):
    import gzip

    folder = tmp_path / "LS" / "UTTAR%20PRADESH" / "SITAPUR"
    folder.mkdir(parents=True)
    with gzip.open(folder / "completed.json.gz", "wt") as f:
        f.write('{"WORK_ID": 1}\n{"WORK_ID": 2}\n')
    got = readers.tile_cache(spark, str(tmp_path), "WORK_ID bigint").collect()
    assert len(got) == 2 and got[0].house == "LS" and got[0].constituency == "SITAPUR" and got[0].tile == "completed" and got[0].state.startswith("UTTAR")
