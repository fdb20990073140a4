"""Read queries beside the case list: tiers of place, payments of a work, works of an agency, health and its notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same(c: str, value: str) -> Column:
    """Equal in any case; null equals the empty text."""
    return F.lower(F.coalesce(F.col(c), F.lit(""))) == value.lower()


def tier(case: DataFrame, column: str, value: str, state: str | None = None) -> DataFrame:
    """Cases of a constituency, district or state, in any case of letters."""
    rows = case.where(same(column, value))
    return rows.where(same("state", state)) if state else rows


def by_place(case: DataFrame, column: str) -> DataFrame:
    return case.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unattributed")).alias(column)).agg(F.count(F.lit(1)).alias("cases"))


def ministry(case: DataFrame, min_score: int = 0, shown: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the first ``shown`` cases, which is what the page shows; counts by state; counts by rule), all over cases of a score or more."""
    rows = case.where(F.col("score") >= min_score)
    rules = rows.select(F.explode("rules").alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("cases"))
    return rows.orderBy(F.desc("score"), "entity_type", "entity_id").limit(shown), by_place(rows, "state"), rules


def payment_summary(marked: DataFrame, works: DataFrame) -> DataFrame:
    """What a work's marked payments come to, beside its sanctioned amount."""
    rows = marked.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"), F.countDistinct(F.coalesce("vendor_id", "vendor_name")).alias("vendors"), F.count_if(F.col("status") == "Payment In-Progress").alias("in_progress"),
        F.min("paid_on").alias("first_paid_on"), F.max("paid_on").alias("last_paid_on"), F.count("days_after_completion").alias("after_completion"), F.count_if(F.col("repeats") > 1).alias("repeated"),
    )
    amount = works.groupBy("work_id").agg(F.max("sanctioned_amount").alias("sanctioned_amount"))
    return rows.join(amount, "work_id", "left").withColumn("share_of_sanctioned", F.when(F.col("sanctioned_amount") > 0, F.round(F.col("total") / F.col("sanctioned_amount"), 3)))


def agency_works(works: DataFrame, vendor_id: str | None = None, vendor_name: str | None = None) -> DataFrame:
    """Works of an agency, known by its id or by its name."""
    return works.where((F.col("vendor_id") == F.lit(vendor_id)) | (F.col("vendor_name") == F.lit(vendor_name)))


def reading_state(shards: DataFrame, watermarks: DataFrame, parity: DataFrame, works: DataFrame, key: str = "shard_id") -> DataFrame:
    """Every shard with its figures at the last read, the portal's totals and the rows here."""
    here = works.groupBy(key).agg(F.count(F.lit(1)).alias("here"))
    return shards.join(watermarks, key, "left").join(parity, key, "left").join(here, key, "left").withColumn("here", F.coalesce("here", F.lit(0)))


def stale_checks(groups: DataFrame, checks: DataFrame, key: str = "group_id") -> DataFrame:
    """Groups never checked, or checked before they last changed."""
    last = checks.groupBy(key).agg(F.max("checked_at").alias("checked_at"))
    return groups.join(last, key, "left").where("checked_at is null or checked_at < changed_at")


def first_examples(rows: DataFrame, keys, order, value: str, n: int = 5) -> DataFrame:
    """The first n values of each group: the limit is the feature; ranks are cut before they are gathered."""
    from pyspark.sql import Window

    keys = list(keys)
    cut = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n)
    return cut.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v")))), lambda x: x["v"]).alias("examples"))


def conditions(areas: DataFrame, now: str) -> DataFrame:
    """(condition, severity, areas, grace): what is wrong with the reading of areas at ``now``; conditions that hold nowhere are left out."""
    at = F.lit(now).cast("timestamp")
    older = lambda c, hours: F.col(c) < at - F.expr(f"interval {hours} hours")
    tests = [
        ("checks_stalled", "warning", 10, F.coalesce(older("fetched_at", 6), F.lit(True))), ("checks_failing", "warning", 30, F.col("consecutive_failures") >= 3),
        ("parity_differs", "warning", 120, F.col("exact") == 0), ("sweep_overdue", "warning", 60, F.coalesce(older("swept_at", 36), F.lit(True))), ("held_back", "critical", 5, F.col("lifecycle") == "quarantined"),
    ]
    hit = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(n).alias("condition"), F.lit(s).alias("severity"), F.lit(g).alias("grace"))) for n, s, g, test in tests])
    return areas.select(F.explode(F.array_compact(hit)).alias("c")).groupBy("c.condition", "c.severity", "c.grace").agg(F.count(F.lit(1)).alias("areas"))


def notices(holding: DataFrame, known: DataFrame, now: str, again_hours: int = 24) -> DataFrame:
    """(condition, severity, since, notify): conditions with the time since when they hold; a notice goes out after the grace, and once more each ``again_hours``.

    known: (condition, since, notified_at) as of the last time."""
    at = F.lit(now).cast("timestamp")
    rows = holding.join(known, "condition", "left").withColumn("since", F.coalesce("since", at))
    due = (F.col("since").cast("bigint") + F.col("grace") * 60 <= at.cast("bigint")) & (F.col("notified_at").isNull() | (F.col("notified_at").cast("bigint") + again_hours * 3600 <= at.cast("bigint")))
    return rows.select("condition", "severity", "since", F.coalesce(due, F.lit(False)).alias("notify"))
