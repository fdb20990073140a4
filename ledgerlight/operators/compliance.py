"""Threshold, text and window rules on works and fund positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight import config
from ledgerlight.functions import scalar as S
from ledgerlight.operators.findings import finding


def enrich(works: DataFrame) -> DataFrame:
    """is_sanctioned by date, is_completed by listing or date; never by the stage's text."""
    listed = F.col("in_completed") > 0 if "in_completed" in works.columns else F.lit(False)
    return works.withColumns({"is_sanctioned": F.col("sanction_date").isNotNull(), "is_completed": F.coalesce(listed, F.lit(False)) | F.col("completion_date").isNotNull()})


def completion_norm(works: DataFrame, today: str, rule: dict = config.COMPLETION) -> DataFrame:
    """R-TIME-01"""
    end = F.when(F.col("completion_date").isNotNull(), F.col("completion_date")).otherwise(F.lit(today).cast("date"))
    rows = works.where("sanction_date is not null").withColumn("days", F.datediff(end, "sanction_date")).where(F.col("days") > rule["days"])
    return finding(rows, "compliance", rule["rule_id"], F.when(F.col("days") > rule["outer_days"], "high").otherwise("medium"), "work", "work_id", F.format_string("%d days since sanction", "days"), ("days",))


def word_pattern(terms, strict: bool = False) -> str:
    """Longest first. As the rules are written, the look-behind binds to the first term and the look-ahead to the last only; ``strict`` binds both to all."""
    every = "|".join(sorted(terms, key=len, reverse=True))
    return rf"(?i)(?<![a-z])(?:{every})(?![a-z])" if strict else rf"(?i)(?<![a-z]){every}(?![a-z])"


def prohibited(works: DataFrame, strict: bool = False) -> DataFrame:
    """R-PROH-01: an activity anywhere, or an asset that heads the description; landmarks are vetoed."""
    paragraph = lambda table, m: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.lower(m)]
    text = F.trim(F.coalesce("description", F.lit("")))
    asset, activity = word_pattern(config.ASSETS, strict), word_pattern(config.ACTIVITIES, strict)
    rows = works.select("work_id", text.alias("text")).where("text <> ''")
    rows = rows.withColumn("activity", F.nullif(F.regexp_extract("text", activity, 0), F.lit("")))
    tail = F.when(F.col("text").rlike(f"(?i){config.VERBS}"), F.regexp_replace("text", f"(?is)^.*?{config.VERBS}(.*)$", "$2")).otherwise(F.col("text"))
    head = F.regexp_replace(F.regexp_replace(tail, f"(?is){config.PLACE_WORDS}.*$", ""), r"^[ ,.\-:;()]+|[ ,.\-:;()]+$", "")
    rows = rows.withColumn("head", head).withColumn("asset", F.nullif(F.regexp_extract("head", asset, 0), F.lit("")))
    after = F.regexp_replace("head", f"(?s)^.*?(?:{asset})", "")
    words = lambda c: F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, r"^[ ,.\-:;()]+|[ ,.\-:;()]+$", ""))
    allowed = F.array(*map(F.lit, config.PERMISSIBLE))
    landmark = F.col("text").rlike(f"(?i){config.SECULAR}") | after.rlike(f"(?i){config.LOCATIVE}") | F.arrays_overlap(words(F.col("head")), allowed) | F.arrays_overlap(words(F.col("text")), allowed)
    rows = rows.withColumn("match_type", F.when(F.col("activity").isNotNull(), "activity").when(F.col("asset").isNotNull() & ~landmark, "asset")).where("match_type is not null")
    rows = rows.withColumn("matched", F.lower(F.coalesce("activity", "asset"))).withColumn("para", F.when(F.col("match_type") == "activity", paragraph(config.ACTIVITIES, F.col("matched"))).otherwise(paragraph(config.ASSETS, F.col("matched"))))
    return finding(rows, "compliance", "R-PROH-01", F.when(F.col("match_type") == "activity", "medium").otherwise("critical"), "work", "work_id", F.concat(F.lit("Indicates: "), "matched"), ("match_type", "matched", "para"))


def cost_limits(works: DataFrame, rule: dict = config.COST_CEILING) -> DataFrame:
    """R-COST-01 on works: under the least or over the most value, sanctioned works only."""
    rows = works.where("sanction_date is not null").withColumn("cost", S.cost()).where(f"cost > 0 and (cost < {rule['least']} or cost > {rule['most']})").withColumn("side", F.when(F.col("cost") < rule["least"], "below").otherwise("above"))
    return finding(rows, "compliance", rule["rule_id"], "low", "work", "work_id", F.concat("side", F.lit(" the limit")), ("cost", "side"), standalone=F.col("side") == "above")


def district_summary(marked: DataFrame, population: DataFrame, rule_id: str, least: int) -> DataFrame:
    """One finding for an authority with many marked works: its count against its population."""
    n = marked.where("ia_name is not null").groupBy("ia_name").agg(F.count(F.lit(1)).alias("works"), F.min("state").alias("state"))
    total = population.where("ia_name is not null").groupBy("ia_name").agg(F.count(F.lit(1)).alias("population"))
    rows = n.where(F.col("works") >= least).join(total, ["ia_name"]).withColumn("share", F.col("works") / F.col("population"))
    return finding(rows, "compliance", rule_id, "low", "agency", "ia_name", F.format_string("%d of %d works", "works", "population"), ("state", "works", "population", "share"))


def below_minimum_by_district(works: DataFrame, rule: dict = config.COST_CEILING) -> DataFrame:
    base = works.where("sanction_date is not null").withColumn("cost", S.cost()).where("cost > 0")
    return district_summary(base.where(F.col("cost") < rule["least"]), base, rule["rule_id"], rule["district_works"])


def pending(works: DataFrame) -> DataFrame:
    return works.where("sanction_date is null and status = 'Pending for Sanction'")


def waiting(works: DataFrame, today: str, rule: dict = config.SANCTION) -> DataFrame:
    rows = pending(works).where("recommended_date is not null")
    return rows.withColumn("waited", F.datediff(F.lit(today).cast("date"), "recommended_date")).where(F.col("waited") > rule["days"])


def sanction_waits(works: DataFrame, today: str, rule: dict = config.SANCTION) -> DataFrame:
    """R-SANC-01 on works; context, not a case of its own."""
    return finding(waiting(works, today, rule), "compliance", rule["rule_id"], "low", "work", "work_id", F.format_string("Waiting for %d days", "waited"), ("waited",), standalone=False)


def sanction_waits_by_district(works: DataFrame, today: str, rule: dict = config.SANCTION) -> DataFrame:
    """R-SANC-01: authorities with many works that wait too long, against all that wait."""
    return district_summary(waiting(works, today, rule), pending(works), rule["rule_id"], rule["district_works"])


def sanction_patterns(works: DataFrame, rule: dict = config.SANCTION) -> DataFrame:
    """R-SANC-02: authorities whose median time to sanction is over the limit."""
    rows = works.where("sanction_date is not null and recommended_date is not null and ia_name is not null").withColumn("days", F.datediff("sanction_date", "recommended_date")).where("days >= 0")
    rows = rows.groupBy("ia_name").agg(F.count(F.lit(1)).alias("works"), F.median("days").alias("median_days")).where((F.col("works") >= rule["pattern_works"]) & (F.col("median_days") > rule["days"]))
    return finding(rows, "compliance", rule["pattern_id"], "medium", "agency", "ia_name", F.format_string("Median of %.0f days over %d works", "median_days", "works"), ("works", "median_days"))


def yearly_cap(works: DataFrame, rule: dict, described: Column | None = None) -> DataFrame:
    """R-REPAIR-01 and R-TRUST-01: recommended value of a category a year and member over a cap."""
    named = F.coalesce(F.col("work_category") == rule["category"], F.lit(False))
    rows = works.withColumns({"named": named, "hit": named | (F.coalesce(described, F.lit(False)) if described is not None else F.lit(False))}).where("hit")
    rows = rows.withColumns({"year": F.coalesce(S.financial_year("recommended_date"), "fy"), "member": S.entity_key(), "value": F.coalesce(F.col("estimated_cost"), F.col("sanctioned_amount"))}).where("year is not null")
    rows = rows.groupBy("member", "year").agg(F.count(F.lit(1)).alias("works"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.when(F.col("named"), F.col("value"))), F.lit(0.0)).alias("named_total")).where(F.col("total") > rule["cap"])
    return finding(rows, "compliance", rule["rule_id"], F.when(F.col("named_total") > rule["cap"], "medium").otherwise("low"), "constituency", "member", F.format_string("%.0f in %s", "total", "year"), ("year", "works", "total"))


def repair_cap(works: DataFrame, rule: dict = config.REPAIR) -> DataFrame:
    return yearly_cap(works, rule, F.col("description").rlike(word_pattern(rule["words"])))


def trust_cap(works: DataFrame, rule: dict = config.TRUST) -> DataFrame:
    return yearly_cap(works, rule)


def area_shares(flows: DataFrame, rule: dict = config.SCST) -> DataFrame:
    """R-SCST-01, where area figures are there."""
    rows = flows.where("expenditure > 0").select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_expenditure").alias("spent"), F.lit(rule[k]).alias("least")) for k in ("sc", "st")])).alias("m")).select("*", "m.*")
    rows = rows.where("spent is not null").withColumn("share", 100 * F.col("spent") / F.col("expenditure")).where("share < least")
    return finding(rows, "compliance", rule["rule_id"], "high", "constituency", S.entity_key(), F.format_string("%s share %.1f%%", "kind", "share"), ("fy", "kind", "share"))


def reserved_shares(works: DataFrame, rule: dict = config.SCST_PROXY) -> DataFrame:
    """R-SCST-02: spend of reserved seats by state. Sanctioned amounts stand in only where no row at all has an expenditure."""
    any_spent = works.agg((F.count("expenditure") > 0).alias("any_spent"))
    rows = works.crossJoin(F.broadcast(any_spent)).where("(house is null or house = 'LS') and state is not null").withColumn("spent", F.coalesce(F.when(F.col("any_spent"), F.col("expenditure")).otherwise(F.col("sanctioned_amount")), F.lit(0.0)))
    kinds = ("sc", "st")
    rows = rows.groupBy("state").agg(F.sum("spent").alias("total"), *[F.sum(F.when(F.col(f"is_{k}_constituency") == 1, F.col("spent")).otherwise(0.0)).alias(f"{k}_spent") for k in kinds], *[F.countDistinct(F.when(F.col(f"is_{k}_constituency") == 1, F.col("constituency"))).alias(f"{k}_seats") for k in kinds])
    rows = rows.where(F.col("total") >= rule["least_spent"]).select("state", "total", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_spent").alias("spent"), F.col(f"{k}_seats").alias("seats"), F.lit(rule[k]).alias("least")) for k in kinds])).alias("m")).select("state", "total", "m.*")
    rows = rows.where(F.col("seats") >= rule["least_seats"]).withColumn("share", 100 * F.col("spent") / F.col("total")).where("share < least")
    return finding(rows, "compliance", rule["rule_id"], "medium", "agency", "state", F.format_string("%s share %.1f%%", "kind", "share"), ("kind", "seats", "share"))


def utilization_spikes(flows: DataFrame, today: str, rule: dict = config.SPIKE) -> DataFrame:
    """R-SPIKE-01: the first row over the spike whose preceding rows were all dormant; rows, not calendar years, as they come."""
    n = rule["years"]
    rows = flows.where(S.is_annual("fy") & S.year_ended("fy", today)).withColumn("member", S.entity_key())
    rows = rows.withColumn("util", F.coalesce("utilization_pct", F.when(F.col("released") > 0, 100 * F.col("expenditure") / F.col("released")))).where("util is not null")
    before = Window.partitionBy("member").orderBy("fy").rowsBetween(-n, -1)
    rows = rows.withColumns({"seen": F.count("util").over(before), "most": F.max("util").over(before), "dormant": F.avg("util").over(before)})
    base = F.when(F.col("dormant") == 0, 1.0).otherwise(F.col("dormant"))
    rows = rows.where((F.col("seen") == n) & (F.col("most") < rule["low"]) & (F.col("util") >= rule["spike"]) & (F.col("util") >= rule["ratio"] * base))
    rows = rows.withColumn("hit", F.row_number().over(Window.partitionBy("member").orderBy("fy"))).where("hit = 1")
    return finding(rows, "compliance", rule["rule_id"], "high", "constituency", "member", F.format_string("%.0f%% in %s after %.0f%%", "util", "fy", "dormant"), ("fy", "util", "dormant"))


def pileups(flows: DataFrame, rule: dict = config.PILEUP) -> DataFrame:
    """R-PILE-01"""
    rows = flows.withColumn("member", S.entity_key()).groupBy("member").agg(F.count(F.lit(1)).alias("years"), F.coalesce(F.sum("released"), F.lit(0.0)).alias("released"), F.coalesce(F.sum("expenditure"), F.lit(0.0)).alias("spent"))
    rows = rows.where((F.col("years") >= rule["years"]) & (F.col("released") > 0)).withColumn("util", 100 * F.col("spent") / F.col("released")).where(F.col("util") < rule["most_pct"])
    return finding(rows, "compliance", rule["rule_id"], "medium", "constituency", "member", F.format_string("%.0f%% used over %d years", "util", "years"), ("years", "util"))
