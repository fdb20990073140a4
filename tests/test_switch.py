"""Switching all tables at once."""

import datetime as dt

import pytest
from pyspark.sql import DataFrame

from ledgerlight.sources.switch import Refused, Releases, switch

AT = dt.datetime(2024, 1, 1)


def old_tables(spark):
    works = spark.createDataFrame([("ES-1", "LS", "A"), ("ES-2", "RS", None), ("WS/3", "LS", "B"), ("ES-4", "LS", "C"), ("ES-4", "RS", None)], "work_id string, house string, constituency string")
    versions = [("ES-1", AT, "description", "a", "b", "2:9"), ("ES-2", AT, "description", "a", "b", None), ("ES-2", AT.replace(day=2), "house", "LS", "RS", None), ("ES-2", AT.replace(day=2), "category", "a", "b", None), ("WS/3", AT, "category", "x", "y", None), ("ES-4", AT, "category", "x", "y", "1:5"), ("ES-4", AT, "era", "x", "y", None), ("ES-8", AT, "era", "x", "y", None)]
    return {
        "works": works, "payments": spark.createDataFrame([("ES-1", 5.0)], "work_id string, amount double"), "versions": spark.createDataFrame(versions, "work_id string, observed_at timestamp, field string, old_value string, new_value string, shard_id string"),
        "retired": spark.createDataFrame([("ES-1", "2:9", "{}"), ("ES-7", "2:9", "{}")], "work_id string, shard_id string, record_json string"), "feedback": spark.createDataFrame([("F-1", "confirmed")], "case_id string, decision string"),
    }


def new_works(spark, *more):
    return spark.createDataFrame([("ES-LS-1", "LS", "A"), ("ES-RS-2", "RS", None), ("WS/3", "LS", "B"), ("ES-RS-4", "RS", None), *more], "work_id string, house string, constituency string")


def ids(df: DataFrame):
    return sorted(r.work_id for r in df.select("work_id").collect())


def test_all_tables_change_at_once(spark, tmp_path):
    r = Releases(spark, str(tmp_path / "r"))
    with pytest.raises(FileNotFoundError):
        r.current()
    old = old_tables(spark)
    # the first release is as it is, unscoped ids and all
    first = r._publish(str(tmp_path / "r/tables/first"), list(old))
    for name, df in old.items():
        df.write.parquet(f"{tmp_path}/r/tables/first/{name}")
    payments = spark.createDataFrame([("ES-LS-1", 6.0)], "work_id string, amount double")
    number = switch(r, new_works(spark), payments, portal=spark.createDataFrame([("LS", 2), ("RS", 2)], "house string, n int"))
    now = r.current()
    assert number == first + 1 and set(now) == set(old) and ids(now["works"]) == ["ES-LS-1", "ES-RS-2", "ES-RS-4", "WS/3"] and now["payments"].first().amount == 6.0
    # an occasion on which the house changed goes, so do edits of works that aren't there, and one whose house nothing tells
    assert {(v.work_id, v.field) for v in now["versions"].collect()} == {("ES-LS-1", "description"), ("ES-RS-2", "description"), ("WS/3", "category"), ("ES-RS-4", "category")}
    assert ids(now["retired"]) == ["ES-LS-7"] and now["feedback"].count() == 1
    assert r.back() == number + 1 and ids(r.current()["works"]) == ids(old["works"])


@pytest.mark.parametrize("more, payments, says", [
    ([("ES-9", "LS", "A")], "ES-LS-1", "without a house"), ([("WS/3", "LS", "B")], "ES-LS-1", "stands twice"), ([("WS/5", "RS", "D")], "ES-LS-1", "seats"), ([], "ES-LS-404", "payments of no work"), ([("WS/7", "LS", "A"), ("WS/8", "LS", "A")], "ES-LS-1", "number of works"),
])
def test_a_release_that_fails_a_check_changes_nothing(spark, tmp_path, more, payments, says):
    r = Releases(spark, str(tmp_path / "r"))
    good = {"works": new_works(spark), "payments": spark.createDataFrame([("ES-LS-1", 5.0)], "work_id string, amount double")}
    r.publish(good)
    with pytest.raises(Refused, match=says):
        switch(r, new_works(spark, *more), spark.createDataFrame([(payments, 5.0)], "work_id string, amount double"), portal=spark.createDataFrame([("LS", 2), ("RS", 2)], "house string, n int"))
    assert ids(r.current()["works"]) == ids(good["works"]) and len(r.notes()) == 1


def test_a_switch_lost_half_way_changes_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    r = Releases(spark, str(tmp_path / "r"))
    good = {"works": new_works(spark), "payments": spark.createDataFrame([("ES-LS-1", 5.0)], "work_id string, amount double")}
    r.publish(good)
    broken = good["payments"].withColumn("amount", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        switch(r, new_works(spark, ("WS/9", "LS", "Z")), broken)
    assert ids(r.current()["works"]) == ids(good["works"]) and r.current()["payments"].first().amount == 5.0
