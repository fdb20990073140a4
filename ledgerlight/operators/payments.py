"""What the dates of payments say against their works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight import config
from ledgerlight.operators.findings import finding


def marked(payments: DataFrame, works: DataFrame) -> DataFrame:
    """Payments of known works with before_sanction, days_after_completion, year_end_week and repeats.

    Repeats are counted by an aggregate joined back, with nulls alike, so a hot key is combined before it moves."""
    dates = works.groupBy("work_id").agg(F.min("sanction_date").alias("sanction_date"), F.min("completion_date").alias("completion_date"))
    rows = payments.join(dates, "work_id")
    same = ["work_id", "paid_on", "amount", "vendor_id"]
    counts = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("repeats")).withColumnsRenamed({c: f"_{c}" for c in same})
    on = rows["work_id"] == counts["_work_id"]
    for c in same[1:]:
        on = on & rows[c].eqNullSafe(counts[f"_{c}"])
    rows = rows.join(counts, on).drop(*[f"_{c}" for c in same])
    after = F.datediff("paid_on", "completion_date")
    return rows.withColumns({"before_sanction": F.coalesce(F.col("paid_on") < F.col("sanction_date"), F.lit(False)), "days_after_completion": F.when(after > 0, after), "year_end_week": (F.month("paid_on") == 3) & (F.dayofmonth("paid_on") >= 25)})


def measured(payments: DataFrame, works: DataFrame, rule: dict = config.PAYMENTS) -> DataFrame:
    """work_id, early, late, again: what P-SEQ-01, P-LATE-01 and P-DUP-01 say of a work's payments, null where nothing; works of which none says anything are left out.

    Equal payments are one row with their number, and payments move once, to their work."""
    dates = works.groupBy("work_id").agg(F.min("sanction_date").alias("sanction_date"), F.min("completion_date").alias("completion_date"))
    rows = payments.select("work_id", "paid_on", "amount", "vendor_id").join(dates, "work_id")
    rows = rows.groupBy("work_id", "paid_on", "amount", "vendor_id", "sanction_date", "completion_date").agg(F.count(F.lit(1)).alias("n"))
    days = F.datediff("paid_on", "completion_date")
    early, late, again = F.col("paid_on") < F.col("sanction_date"), days > rule["late_days"], F.col("n") > 1
    total = lambda test, x: F.sum(F.when(test, x))
    rows = rows.groupBy("work_id").agg(
        total(early, F.col("n")).alias("n1"), total(early, F.col("amount") * F.col("n")).alias("a1"), F.min(F.when(early, F.col("paid_on"))).alias("first_paid"), total(late, F.col("n")).alias("n2"), total(late, F.col("amount") * F.col("n")).alias("a2"),
        F.max(F.when(late, days)).alias("days"), total(again, F.col("n")).alias("n3"), total(again, F.col("amount") * (F.col("n") - 1)).alias("repeated_amount"),
    ).where("n1 is not null or n2 is not null or n3 is not null")
    of = lambda n, *facts: F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("payments"), *facts))
    return rows.select("work_id", of("n1", F.col("a1").alias("amount"), "first_paid").alias("early"), of("n2", F.col("a2").alias("amount"), "days").alias("late"), of("n3", "repeated_amount").alias("again"))


def found(m: DataFrame, rule: dict = config.PAYMENTS) -> list[DataFrame]:
    """P-SEQ-01, P-LATE-01 and P-DUP-01 on what ``measured`` gives."""
    of = lambda c: m.where(F.col(c).isNotNull()).select("work_id", f"{c}.*")
    return [early_finding(of("early"), rule), late_finding(of("late"), rule), repeat_finding(of("again"), rule)]


def before_sanction(m: DataFrame, rule: dict = config.PAYMENTS) -> DataFrame:
    """P-SEQ-01"""
    rows = m.where("before_sanction").groupBy("work_id").agg(F.count(F.lit(1)).alias("payments"), F.sum("amount").alias("amount"), F.min("paid_on").alias("first_paid"))
    return early_finding(rows, rule)


def early_finding(rows: DataFrame, rule: dict) -> DataFrame:
    return finding(rows, "payments", rule["before"], "high", "work", "work_id", F.format_string("%d payments before sanction", "payments"), ("payments", "amount", "first_paid"))


def long_after(m: DataFrame, rule: dict = config.PAYMENTS) -> DataFrame:
    """P-LATE-01"""
    rows = m.where(F.col("days_after_completion") > rule["late_days"]).groupBy("work_id").agg(F.count(F.lit(1)).alias("payments"), F.sum("amount").alias("amount"), F.max("days_after_completion").alias("days"))
    return late_finding(rows, rule)


def late_finding(rows: DataFrame, rule: dict) -> DataFrame:
    return finding(rows, "payments", rule["late"], "low", "work", "work_id", F.format_string("%d payments, up to %d days after completion", "payments", "days"), ("payments", "amount", "days"))


def repeated(m: DataFrame, rule: dict = config.PAYMENTS) -> DataFrame:
    """P-DUP-01: the value of the repeats beyond the first decides the severity."""
    rows = m.where("repeats > 1").groupBy("work_id", "paid_on", "amount", "vendor_id").agg(F.max("repeats").alias("n"))
    rows = rows.groupBy("work_id").agg(F.sum("n").alias("payments"), F.sum(F.col("amount") * (F.col("n") - 1)).alias("repeated_amount"))
    return repeat_finding(rows, rule)


def repeat_finding(rows: DataFrame, rule: dict) -> DataFrame:
    return finding(rows, "payments", rule["repeated"], F.when(F.col("repeated_amount") >= rule["material"], "medium").otherwise("low"), "work", "work_id", F.format_string("%d payments repeat", "payments"), ("payments", "repeated_amount"))
