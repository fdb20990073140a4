"""The corpus that the registered queries run on, made of the order tables; and the same corpus as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions import scalar as S

CUTOFF, TODAY = "1998-01-01", "2002-06-30"
VERBS = ("Construction of", "Repair of", "Renovation of", "Maintenance of", "Building")
ASSETS = ("community hall", "temple", "road", "library", "mandir", "school rooms", "welcome gate", "drain", "church", "water tank")
PLACES = (" near temple no ", " at village ", " in ward ", " opposite church ")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def works(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    k = F.col("o_orderkey")
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    rec = F.to_date("o_orderdate")
    sanction = F.when(k % 5 != 0, F.date_add(rec, (k % 90).cast("int")))
    rows = rows.select(
        k.cast("string").alias("work_id"), F.col("r_name").alias("state"), F.col("n_name").alias("district"), F.concat(F.lit("C"), (F.col("c_custkey") % 40).cast("string")).alias("constituency"), F.col("c_name").alias("mp_name"),
        F.when(F.col("c_custkey") % 3 == 0, "RS").otherwise("LS").alias("house"), F.col("o_orderpriority").alias("category"), F.when(k % 9 == 0, "Repair and Renovation").when(k % 9 == 1, "Trust and Society").otherwise("Other").alias("work_category"),
        F.concat(pick(VERBS, F.floor(k / 10) % 5), F.lit(" "), pick(ASSETS, k % 10), pick(PLACES, F.floor(k / 50) % 4), (F.col("c_custkey") % 30).cast("string")).alias("description"),
        rec.alias("recommended_date"), sanction.alias("sanction_date"), F.when(F.col("o_orderstatus") == "F", F.date_add(sanction, (k * 7 % 700).cast("int"))).alias("completion_date"),
        F.when(k % 5 == 0, "Pending for Sanction").when(F.col("o_orderstatus") == "F", "Completed").otherwise("Sanction").alias("status"), (F.col("o_totalprice") * 10).alias("estimated_cost"),
        F.when(k % 5 != 0, F.col("o_totalprice") * (1000 + k % 7 * 10) / 100).alias("sanctioned_amount"), F.when(k % 5 != 0, F.col("o_totalprice") * (k % 11)).alias("expenditure"), F.concat("n_name", F.lit(" IDA")).alias("ia_name"),
        F.concat(F.lit("V"), (k % 500).cast("string")).alias("vendor_id"), F.concat(F.lit("Vendor "), (k % 480).cast("string")).alias("vendor_name"), (F.col("c_custkey") % 10 == 1).cast("int").alias("is_sc_constituency"), (F.col("c_custkey") % 10 == 2).cast("int").alias("is_st_constituency"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
    )
    return rows.withColumns({"era": S.era("recommended_date", CUTOFF), "fy": S.financial_year("sanction_date")})


def payments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("work_id"), F.col("l_linenumber").alias("seq"), F.to_date("l_shipdate").alias("paid_on"), F.col("l_extendedprice").alias("amount"), F.concat(F.lit("V"), F.col("l_suppkey").cast("string")).alias("vendor_id"),
        F.concat(F.lit("Vendor "), F.col("l_suppkey").cast("string")).alias("vendor_name"), F.concat(F.lit("Agency "), (F.col("l_suppkey") % 7).cast("string")).alias("implementing_agency"), F.col("l_linestatus").alias("status"),
    )


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each member and financial year."""
    rows = works(spark, sf).withColumn("fy", S.financial_year("recommended_date"))
    rows = rows.groupBy("state", "constituency", "mp_name", "fy").agg(F.sum("estimated_cost").alias("released"), F.coalesce(F.sum("expenditure"), F.lit(0.0)).alias("expenditure"))
    return rows.withColumns({"era": F.when(F.col("fy") >= "1998-99", "post2023").otherwise("pre2023"), "utilization_pct": F.lit(None).cast("double"), "sc_expenditure": F.col("expenditure") * 0.1, "st_expenditure": F.col("expenditure") * 0.09})


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Users' event values as observations of works."""
    return table(spark, sf, "events").select((F.col("user_id") % 150).cast("string").alias("work_id"), F.col("ts"), F.col("event_id"), F.col("event_type").alias("ia_name"), (F.round("value", 0) * 100_000).alias("sanctioned_amount"), F.round("value", 2).alias("total_paid"))


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _fy(c: str) -> str:
    y = f"year({c} - interval 3 month)"
    return f"(cast({y} as varchar) || '-' || lpad(cast(({y} + 1) % 100 as varchar), 2, '0'))"


WORKS_SQL = f"""
works0 as (select cast(o_orderkey as varchar) as work_id, o_orderkey as k, c_custkey as ck, r_name as state, n_name as district, 'C' || cast(c_custkey % 40 as varchar) as constituency, c_name as mp_name,
 case when c_custkey % 3 = 0 then 'RS' else 'LS' end as house, o_orderpriority as category, case when o_orderkey % 9 = 0 then 'Repair and Renovation' when o_orderkey % 9 = 1 then 'Trust and Society' else 'Other' end as work_category,
 {_list(VERBS)}[1 + (o_orderkey // 10) % 5] || ' ' || {_list(ASSETS)}[1 + o_orderkey % 10] || {_list(PLACES)}[1 + (o_orderkey // 50) % 4] || cast(c_custkey % 30 as varchar) as description,
 cast(o_orderdate as date) as recommended_date, case when o_orderkey % 5 <> 0 then cast(o_orderdate as date) + cast(o_orderkey % 90 as integer) end as sanction_date, o_orderstatus as st, o_totalprice as p,
 o_totalprice * 10 as estimated_cost, case when o_orderkey % 5 <> 0 then o_totalprice * (1000 + o_orderkey % 7 * 10) / 100 end as sanctioned_amount, case when o_orderkey % 5 <> 0 then o_totalprice * (o_orderkey % 11) end as expenditure, n_name || ' IDA' as ia_name,
 'V' || cast(o_orderkey % 500 as varchar) as vendor_id, 'Vendor ' || cast(o_orderkey % 480 as varchar) as vendor_name, cast(c_custkey % 10 = 1 as integer) as is_sc_constituency, cast(c_custkey % 10 = 2 as integer) as is_st_constituency
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
works as (select *, case when st = 'F' then sanction_date + cast(k * 7 % 700 as integer) end as completion_date, case when k % 5 = 0 then 'Pending for Sanction' when st = 'F' then 'Completed' else 'Sanction' end as status,
 case when recommended_date >= date '{CUTOFF}' then 'post2023' else 'pre2023' end as era, case when sanction_date is not null then {_fy('sanction_date')} end as fy, {_fy('recommended_date')} as rec_fy, coalesce(sanctioned_amount, estimated_cost) as cost from works0)"""
PAYMENTS_SQL = "payments as (select cast(l_orderkey as varchar) as work_id, l_linenumber as seq, cast(l_shipdate as date) as paid_on, l_extendedprice as amount, 'V' || cast(l_suppkey as varchar) as vendor_id, 'Vendor ' || cast(l_suppkey as varchar) as vendor_name, 'Agency ' || cast(l_suppkey % 7 as varchar) as implementing_agency, l_linestatus as status from lineitem)"
FLOWS_SQL = f"{WORKS_SQL}, flows as (select state, constituency, mp_name, rec_fy as fy, sum(estimated_cost) as released, coalesce(sum(expenditure), 0) as expenditure, case when rec_fy >= '1998-99' then 'post2023' else 'pre2023' end as era, constituency || '|' || state as member from works group by state, constituency, mp_name, rec_fy)"
