"""Sinks on Parquet tables: whole and partial replacement, upsert with an edit log, ledgers.

A table is a folder partitioned by one column. Writers replace whole partitions, so a failed write leaves other
partitions alone; there is one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields compared by an upsert.
TRACKED = ("state", "district", "constituency", "mp_name", "house", "category", "description", "work_type", "recommended_date", "sanction_date", "completion_date", "status", "estimated_cost", "sanctioned_amount", "expenditure", "ia_name", "vendor_name", "vendor_id", "total_paid", "payment_count", "fy", "letter_no", "work_category", "implementing_agency", "last_payment_date", "payment_status", "is_sc_constituency", "is_st_constituency", "term_start", "term_end", "era")


def replace_all(df: DataFrame, path: str, by: str | None = None) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path, partitionBy=by)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Only the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path, partitionBy=by)


def as_text(c):
    """Values as the edit log compares them: whole numbers without a decimal point, empty as null."""
    t = F.trim(F.col(c).cast("string"))
    return F.nullif(F.regexp_replace(t, r"\.0$", ""), F.lit(""))


def upserted(stored: DataFrame, batch: DataFrame, key: str, observed_at: str, tracked=TRACKED, owner: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, edits): batch rows replace stored ones of the same key; edits has a row for each field whose text changed, once.

    With owner, rows whose key another owner holds are left out, as ``collisions`` lists them."""
    if owner:
        held = collisions(stored, batch, key, owner).select(key).distinct()
        batch = batch.join(held, key, "left_anti")
    fields = [c for c in tracked if c in stored.columns and c in batch.columns]
    latest = batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in batch.columns if c != key]))).where("_n = 1").drop("_n")
    old = stored.select(F.col(key).alias("_k"), *[as_text(c).alias(f"_o_{c}") for c in fields])
    both = latest.join(old, latest[key] == F.col("_k"))
    edits = both.select(key, F.explode(F.array().cast("array<struct<field:string,old_value:string,new_value:string>>") if not fields else F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_o_{c}").alias("old_value"), as_text(c).alias("new_value")) for c in fields])).alias("e")).select(key, "e.*")
    edits = edits.where("not (old_value <=> new_value)").withColumn("observed_at", F.lit(observed_at).cast("timestamp"))
    table = stored.join(latest.select(key), key, "left_anti").unionByName(latest, allowMissingColumns=True)
    return table, edits


def collisions(stored: DataFrame, batch: DataFrame, key: str, owner: str) -> DataFrame:
    """Batch rows whose key another owner holds: not to be written."""
    return batch.join(stored.select(key, F.col(owner).alias("held_by")), key).where(~F.col(owner).eqNullSafe(F.col("held_by")))


def replaced_for(stored: DataFrame, new: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """Payments of the listed works come from new, all others stay."""
    return stored.join(listed.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def newest(ledger: DataFrame, entry: DataFrame, order: str, keep: int = 500) -> DataFrame:
    """The ledger with an entry more; the newest ``keep`` stay, which is what a ledger is for."""
    return ledger.unionByName(entry).orderBy(F.desc(order)).limit(keep)


def review_sheet(sample: DataFrame, path: str) -> None:
    sample.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def scored_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).where("verdict is not null")


def tile_cache(rows: DataFrame, root: str, keys=("house", "state", "constituency", "tile")) -> None:
    """Reports as compressed JSON in folders of their place; a place that is written again replaces its folder alone."""
    rows.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy(*keys).json(root)


def reviewed(feedback: DataFrame, path: str) -> None:
    """Appends decisions; what was decided before stays."""
    feedback.write.mode("append").parquet(path)


def switched(history: DataFrame, live: DataFrame, key: str = "work_id", scope: str = "live", table: str | None = None) -> DataFrame:
    """The corpus after a switch to a live source: its rows, with ids of their own scope, and those of history that it doesn't list, marked as such. Written as a whole where a table is given."""
    scoped = lambda c: F.concat(F.lit(f"{scope}:"), F.col(c).cast("string"))
    old = history.join(live.select(key).distinct(), key, "left_anti").withColumn("era", F.lit("historical"))
    out = live.withColumn("origin_id", F.col(key).cast("string")).withColumn(key, scoped(key)).unionByName(old.withColumn("origin_id", F.col(key).cast("string")).withColumn(key, F.col(key).cast("string")), allowMissingColumns=True)
    if table:
        replace_all(out, table)
    return out
