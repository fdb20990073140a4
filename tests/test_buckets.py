"""Tables in buckets: what is rewritten, what readers see, what a lost or second writer leaves."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlight.sources.buckets import BucketTable, Conflict
from ledgerlight.streaming import ingest

AT, SCHEMA = "2024-01-01", "work_id string, state string, estimated_cost double"


def rows(spark, n, cost=1.0):
    return spark.range(n).selectExpr("cast(id as string) as work_id", "'UP' as state", f"id + {cost}d as estimated_cost")


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")}


def content(df):
    return sorted(map(tuple, df.select("work_id", "state", "estimated_cost").collect()), key=str)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"))
    t.create(rows(spark, 2000), "work_id", 32)
    before = files(t.root)
    assert len(before) == 32
    batch = spark.createDataFrame([("7", "MP", 8.0), ("7", "MP", 9.0), ("new", "UP", 5.0)], SCHEMA)
    v = t.upsert(batch, AT)
    hit = {r[0] for r in spark.createDataFrame([("7",), ("new",)], "work_id string").select(F.pmod(F.xxhash64("work_id"), F.lit(32))).collect()}
    assert set(v.wrote) == hit and before < files(t.root) and len(files(t.root) - before) == len(hit)
    want = [r for r in content(rows(spark, 2000)) if r[0] != "7"] + [("7", "MP", 8.0), ("new", "UP", 5.0)]
    assert content(t.read()) == sorted(want, key=str) and content(t.read(0)) == content(rows(spark, 2000))
    assert {(r.work_id, r.field, r.old_value, r.new_value) for r in t.edits().collect()} == {("7", "state", "UP", "MP")}
    keys = spark.createDataFrame([("7",), ("11",), ("none",)], "work_id string")
    assert [r[0] for r in content(t.read_keys(keys))] == ["11", "7"]
    plan = t.read_keys(spark.createDataFrame([("7",)], "work_id string"))
    assert len({f for f in plan.inputFiles() if "/data/" in f}) == 1
    gone = t.remove(keys)
    assert content(t.read()) == sorted((r for r in want if r[0] not in ("7", "11")), key=str) and len(gone.wrote) <= 3
    t.vacuum(1)
    assert t.versions() == [2] and len(files(t.root)) == 32 and content(t.read()) == sorted((r for r in want if r[0] not in ("7", "11")), key=str)
    with pytest.raises(FileNotFoundError):
        t.read(0)


def test_new_columns_empty_batches_and_rows_without_key(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"))
    t.create(rows(spark, 5).limit(0), "work_id", 4)
    assert t.read().count() == 0 and t.upsert(rows(spark, 0), AT).wrote == []
    t.upsert(rows(spark, 20), AT)
    t.upsert(spark.createDataFrame([("3", "x")], "work_id string, letter_no string"), AT)
    got = {r.work_id: r for r in t.read().collect()}
    assert len(got) == 20 and got["3"].letter_no == "x" and got["3"].state is None and got["4"].letter_no is None and got["4"].state == "UP"
    with pytest.raises(ValueError, match="without work_id"):
        t.upsert(spark.createDataFrame([(None, "UP", 1.0)], SCHEMA), AT)
    with pytest.raises(Conflict):
        t.create(rows(spark, 1), "work_id")
    with pytest.raises(FileNotFoundError):
        BucketTable(spark, str(tmp_path / "none")).read()


def test_second_writer_and_lost_writer(spark, tmp_path, monkeypatch):
    a, b = (BucketTable(spark, str(tmp_path / "t")) for _ in "ab")
    a.create(rows(spark, 100), "work_id", 8)
    stale = b.version()
    a.upsert(spark.createDataFrame([("1", "A", 0.0)], SCHEMA), AT)
    with monkeypatch.context() as m:
        m.setattr(b, "version", lambda number=None: stale)
        with pytest.raises(Conflict):
            b.upsert(spark.createDataFrame([("2", "B", 0.0)], SCHEMA), AT)
    assert {r.state for r in a.read().where("work_id in ('1', '2')").collect()} == {"A", "UP"}
    with monkeypatch.context() as m:
        m.setattr(a, "_publish", lambda v: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            a.upsert(spark.createDataFrame([("3", "C", 0.0)], SCHEMA), AT)
    assert a.version().number == 1 and a.read().where("state = 'C'").count() == 0
    a.upsert(spark.createDataFrame([("4", "D", 0.0)], SCHEMA), AT)
    assert {r.work_id: r.state for r in a.read().where("state <> 'UP'").collect()} == {"1": "A", "4": "D"} and a.read().count() == 100
    seen = content(a.read()), sorted(map(str, a.edits().collect()))
    assert {r.work_id for r in a.edits().collect()} == {"1", "4"}
    gone = a.vacuum(1)
    assert any(f.startswith("edits/") for f in gone) and (content(a.read()), sorted(map(str, a.edits().collect()))) == seen and a.vacuum(1) == []


def test_streamed_upserts(spark, tmp_path):
    src, table = tmp_path / "in", BucketTable(spark, str(tmp_path / "t"))

    def run(data, checkpoint="cp"):
        if data:
            spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        q = ingest.start_upserts(spark, spark.readStream.schema(SCHEMA).parquet(str(src)), table.root, str(tmp_path / checkpoint), buckets=8)
        q.awaitTermination(120)
        return q

    run([("1", "UP", 5.0)])
    run([("1", "UP", 8.0), ("2", "MP", 1.0)])
    assert content(table.read()) == [("1", "UP", 8.0), ("2", "MP", 1.0)]
    assert [tuple(r) for r in table.edits().select("field", "old_value", "new_value").collect()] == [("estimated_cost", "5", "8")]
    # a batch that comes again changes nothing, and a stream of its own goes on with the table
    number = table.version().number
    table.upsert(spark.createDataFrame([("1", "XX", 0.0)], SCHEMA), AT, epoch=(str(tmp_path / "cp"), 1))
    assert table.version().number == number and content(table.read())[0] == ("1", "UP", 8.0)
    run([], "other")
    assert content(table.read()) == [("1", "UP", 8.0), ("2", "MP", 1.0)] or content(table.read()) == [("1", "UP", 5.0), ("2", "MP", 1.0)]
    # a table that is gone isn't started over from one batch
    os.rename(table.root, f"{table.root}-gone")
    with pytest.raises(Exception, match="is gone"):
        run([("3", "UP", 1.0)])
