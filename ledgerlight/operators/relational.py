"""Joins, roll-ups, windows and samples that the loaders and reports use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys, *order) -> DataFrame:
    """One row a key, the first in a total order."""
    keys = list(keys)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def payment_rollup(payments: DataFrame) -> DataFrame:
    """Total, number, last date and last status of each work's payments; the last by date, then number, then amount, then status."""
    last = F.max_by("status", F.struct("paid_on", "seq", "amount", "status"))
    return payments.groupBy("work_id").agg(F.sum("amount").alias("total_paid"), F.count(F.lit(1)).alias("payment_count"), F.max("paid_on").alias("last_payment_date"), last.alias("payment_status"))


def primary_vendor(payments: DataFrame) -> DataFrame:
    """The vendor with the largest total of each work; ties to the smallest name."""
    sums = payments.groupBy("work_id", "vendor_id", "vendor_name").agg(F.sum("amount").alias("vendor_total"))
    return sums.groupBy("work_id").agg(F.max_by(F.struct("vendor_id", "vendor_name", "vendor_total"), F.struct(F.round("vendor_total", 2), F.reverse("vendor_id"))).alias("v")).select("work_id", "v.*")


def main_agency(payments: DataFrame) -> DataFrame:
    """The agency named most often; ties to the first by name."""
    n = payments.where("implementing_agency is not null").groupBy("work_id", "implementing_agency").count()
    return first_of(n, ["work_id"], F.desc("count"), "implementing_agency").select("work_id", "implementing_agency")


def works_from_reports(recommended: DataFrame, sanctioned: DataFrame, completed: DataFrame, payments: DataFrame) -> DataFrame:
    """Recommended works with what the other reports know, each reduced to one row a work before it is joined."""
    one = lambda df, order: first_of(df, ["work_id"], order, *df.columns)
    return (
        recommended.join(one(sanctioned.select("work_id", "sanction_date", "sanctioned_amount"), "sanction_date"), "work_id", "left")
        .join(one(completed.select("work_id", "completion_date"), "completion_date"), "work_id", "left")
        .join(payment_rollup(payments), "work_id", "left").join(primary_vendor(payments), "work_id", "left")
    )


def joined_tiles(recommended: DataFrame, sanctioned: DataFrame, completed: DataFrame, paid: DataFrame) -> DataFrame:
    """Four reports on (portal_id, work_code), every row of each kept; in_* say which had it."""
    key = ["portal_id", "work_code"]
    frames = {"recommended": recommended, "sanctioned": sanctioned, "completed": completed, "paid": paid}
    long = None
    for name, df in frames.items():
        part = df.select(*key, F.lit(name).alias("tile"), F.col("amount"))
        long = part if long is None else long.unionByName(part)
    of = lambda t: F.col("tile") == t
    return long.groupBy(*key).agg(*[F.count_if(of(t)).cast("int").alias(f"in_{t}") for t in frames], F.max(F.when(of("sanctioned"), F.col("amount"))).alias("sanctioned_amount"), F.max(F.when(of("recommended"), F.col("amount"))).alias("estimated_cost"), F.sum(F.when(of("paid"), F.col("amount"))).alias("total_paid"))


def fund_positions(works: DataFrame, allocation: DataFrame) -> DataFrame:
    """Sums by (state, constituency, member, year), null keys kept, nothing summed is 0; the allocation is spread over a member's years."""
    rows = works.groupBy("state", "constituency", "mp_name", "fy").agg(F.coalesce(F.sum("sanctioned_amount"), F.lit(0.0)).alias("sanctioned"), F.coalesce(F.sum("expenditure"), F.lit(0.0)).alias("expenditure"), F.count(F.lit(1)).alias("works_count"))
    years = rows.groupBy("mp_name").agg(F.countDistinct("fy").alias("years"))
    rows = rows.join(years, rows["mp_name"].eqNullSafe(years["mp_name"])).drop(years["mp_name"])
    member = allocation.select(F.upper("mp_name").alias("_m"), "allocated")
    rows = rows.join(member, F.upper("mp_name") == F.col("_m"), "left").drop("_m").withColumn("released", F.col("allocated") / F.greatest("years", F.lit(1)))
    return rows.withColumn("utilization_pct", F.when(F.col("released") > 0, F.bround(100 * F.col("expenditure") / F.col("released"), 2)))


def numbered(payments: DataFrame) -> DataFrame:
    """seq within a work by content, from 1."""
    return payments.withColumn("seq", F.row_number().over(Window.partitionBy("work_id").orderBy("paid_on", "amount", "vendor_id", "vendor_name", "status")))


def duplicate_listings(rows: DataFrame, key, details) -> DataFrame:
    """listing_id: equal rows are one listing counted as times; other details under the same key get #2, #3 and so on."""
    key, details = list(key), list(details)
    n = rows.groupBy(*key, *details).agg(F.count(F.lit(1)).alias("times"))
    n = n.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(*details)))
    return n.withColumn("listing_id", F.concat(F.concat_ws("|", *key), F.when(F.col("k") > 1, F.concat(F.lit("#"), "k")).otherwise(""))).drop("k")


def missing(before: DataFrame, now: DataFrame, key) -> DataFrame:
    return before.join(now, key, "left_anti")


def changed_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with multiplicity."""
    return a.exceptAll(b).withColumn("side", F.lit("old")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))


def backfilled(new: DataFrame, old: DataFrame, key: str, columns) -> DataFrame:
    """The old value where there is one, else the new."""
    o = old.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return new.join(o, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in new.columns])


def payments_that_add_up(payments: DataFrame, works: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Payments of works whose recorded number and total they reproduce."""
    sums = payments.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s"))
    ok = sums.join(works.select("work_id", "payment_count", "total_paid"), "work_id").where((F.col("n") == F.col("payment_count")) & (F.abs(F.col("s") - F.col("total_paid")) <= tolerance))
    return payments.join(ok.select("work_id"), "work_id", "left_semi")


def stratified_sample(rows: DataFrame, stratum: str, score: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows of each stratum: the top half by score, the rest by a seeded hash, so that engines agree. The sample is the point of it."""
    top = F.row_number().over(Window.partitionBy(stratum).orderBy(F.desc(score), key))
    rest = F.row_number().over(Window.partitionBy(stratum, "is_top").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key))
    return rows.withColumn("is_top", top <= n // 2).withColumn("_r", rest).where(F.col("is_top") | (F.col("_r") <= n - n // 2)).drop("_r")


def tile_rollup(slices: DataFrame, *keys: str) -> DataFrame:
    """Counts and totals at every level, from all to the finest."""
    return slices.rollup(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.grouping_id().alias("level"))


def additivity(parents: DataFrame, children: DataFrame, key: str, tolerance: float = 1.0) -> DataFrame:
    """Parents whose children don't sum up to them."""
    sums = children.groupBy(key).agg(F.sum("n").alias("child_n"), F.sum("total").alias("child_total"))
    return parents.join(sums, key, "full").where((F.coalesce("n", F.lit(0)) != F.coalesce("child_n", F.lit(0))) | (F.abs(F.coalesce("total", F.lit(0.0)) - F.coalesce("child_total", F.lit(0.0))) > tolerance))


def growth_fit(points: DataFrame) -> DataFrame:
    """Log-log and linear fits of seconds against rows."""
    x, y = F.ln("rows"), F.ln("seconds")
    return points.agg(F.regr_slope(y, x).alias("exponent"), F.exp(F.regr_intercept(y, x)).alias("factor"), F.regr_slope("seconds", "rows").alias("slope"), F.regr_intercept("seconds", "rows").alias("intercept"))
