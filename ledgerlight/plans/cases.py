"""From findings to scored cases, and the queries on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight import config
from ledgerlight.functions import scalar as S
from ledgerlight.tables import drop, written

#: Actions up to which a catalogue is broadcast.
BROADCAST = 10_000


def weight() -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in config.WEIGHTS.items() for x in kv])[F.col("severity")], F.lit(0))


def cases(findings: DataFrame) -> DataFrame:
    """One row an entity with a finding that can stand alone; context and held findings add nothing to the score (0 to 100)."""
    rows = findings.withColumn("points", F.when(F.col("scored"), weight()).otherwise(0))
    # context never leads
    lead = F.struct("standalone", S.severity_rank("severity"), "points", "rule_id", "summary")
    out = rows.groupBy("entity_type", "entity_id").agg(
        F.max("standalone").alias("stands"), F.least(F.lit(100), F.sum("points")).cast("int").alias("score"), F.count(F.lit(1)).alias("n_findings"), F.array_sort(F.collect_set("rule_id")).alias("rules"),
        F.max_by("rule_id", lead).alias("primary_rule"), F.max_by("summary", lead).alias("primary_signal"), F.max_by("severity", S.severity_rank("severity")).alias("severity"), F.max(F.col("details")["actor"]).alias("actor"),
    ).where("stands").drop("stands")
    return out.withColumns({"case_id": S.hash_id("F-", F.concat_ws("|", "entity_type", "entity_id"), 10, upper=True), "alert": F.col("score") >= config.ALERT, "band": S.band("score")})


def known_by(*frames: DataFrame) -> list[str]:
    """What tells cases apart: their entity, where all frames have it. Ids of ten digits (case_id) come twice among millions of cases."""
    entity = ["entity_type", "entity_id"]
    return entity if all(set(entity) <= set(df.columns) for df in frames) else ["case_id"]


def added(case: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Cases with what another frame has of them, one row for each of its keys; nulls alike."""
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    return case.join(other.withColumnsRenamed({c: f"_{c}" for c in keys}), on, "left").drop(*[f"_{c}" for c in keys])


def contributions(findings: DataFrame, *, context: bool = False) -> DataFrame:
    """Points and share of each rule in its case; repeats of a rule are one row. With ``context``, findings that weigh nothing are
    listed too, with 0 points; a share of no points at all is NaN."""
    rows = findings if context else findings.where("scored")
    rows = rows.groupBy("entity_type", "entity_id", "rule_id").agg(F.sum(F.when(F.col("scored"), weight()).otherwise(0)).alias("points"), F.count(F.lit(1)).alias("times"))
    total = F.sum("points").over(Window.partitionBy("entity_type", "entity_id"))
    return rows.withColumn("share", F.when(total > 0, F.round(100 * F.col("points") / total, 1)).otherwise(float("nan")))


def rule_coverage(findings: DataFrame, rules: DataFrame, notes: DataFrame) -> DataFrame:
    """Every rule with its number of findings and entities: zero, or stood down with a reason."""
    n = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("entity_id").alias("entities"))
    out = rules.join(n, "rule_id", "left").join(notes, "rule_id", "left")
    return out.select("rule_id", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("entities", F.lit(0)).alias("entities"), "reason", F.when(F.col("reason").isNotNull(), "stood down").when(F.col("findings").isNull(), "no match").otherwise("ran").alias("state"))


def usable(df: DataFrame, *needed: str) -> dict[str, bool]:
    """Which columns are there with any value: what a rule needs to run at all. One aggregate."""
    have = [c for c in needed if c in df.columns]
    row = df.agg(*[(F.count(c) > 0).alias(c) for c in have]).first() if have else {}
    return {c: bool(c in have and row[c]) for c in needed}


def with_entities(case: DataFrame, works: DataFrame, retired: DataFrame | None = None) -> DataFrame:
    """Cases with their place, a short title and a label. A work's come from its record, or the last one where it is no longer listed;
    those of a member's seat and of an authority from the id."""
    place, text = ("state", "district", "constituency", "mp_name", "ia_name"), ("description", "category")
    meta = works.groupBy(F.col("work_id").alias("entity_id")).agg(*[F.min(F.struct(F.coalesce("recommended_date", F.lit("9999-12-31").cast("date")).alias("at"), F.col(c).alias("v")))["v"].alias(c) for c in (*place, *text)])
    # by the id alone, which is how the records lie after their aggregation
    out = case.join(meta.withColumnRenamed("entity_id", "_id"), (F.col("entity_type") == "work") & (F.col("entity_id") == F.col("_id")), "left").drop("_id")
    if retired is not None:
        old = retired.groupBy(F.col("work_id").alias("entity_id")).agg(F.max("record_json").alias("j")).withColumn("entity_type", F.lit("work"))
        out = out.join(old, ["entity_type", "entity_id"], "left").select(*[F.coalesce(F.col(c), F.get_json_object("j", f"$.{c}")).alias(c) if c in (*place, *text) else F.col(c) for c in out.columns])
    kind, eid = F.col("entity_type"), F.col("entity_id")
    seat, actor = (kind == "constituency") & eid.contains("|"), (kind == "agency") & eid.rlike("^(vendor|agency):")
    out = out.withColumns({
        "constituency": F.when(seat, F.substring_index(eid, "|", 1)).otherwise(F.col("constituency")), "state": F.when(seat, F.expr("substring(entity_id, locate('|', entity_id) + 1)")).otherwise(F.col("state")),
        "ia_name": F.when((kind == "agency") & ~actor, eid).otherwise(F.col("ia_name")),
    })
    name = F.initcap(F.coalesce("actor", F.expr("substring(entity_id, locate(':', entity_id) + 1)")))
    authority = F.when(F.upper("ia_name").contains("_IDA"), F.trim(F.substring_index("ia_name", "(", 1))).otherwise(F.col("ia_name"))
    title = F.when(kind == "work", S.short_title("description", "category")).when(kind == "constituency", F.coalesce("constituency", eid)).when(actor, F.substring(name, 1, 62)).otherwise(F.substring(F.initcap(authority), 1, 62))
    label = F.when(kind == "work", F.concat(F.lit("Work "), eid, F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" — "), F.substring("description", 1, 70))).otherwise("")))
    label = label.when(kind == "constituency", F.trim(F.concat(F.coalesce("constituency", eid), F.lit(" ("), F.coalesce("state", F.lit("")), F.lit(")"))))
    label = label.when(actor, F.concat(F.when(eid.startswith("vendor:"), "Vendor: ").otherwise("Implementing agency: "), name)).otherwise(F.concat(F.lit("District authority: "), F.initcap(authority)))
    return out.withColumns({"display_title": title, "entity_label": label}).drop(*text)


def seen(case: DataFrame, now: str, before: DataFrame | None = None, feedback: DataFrame | None = None) -> DataFrame:
    """Adds when each case was first seen and its latest decision; both outlive a new analysis. before: (case_id, first_seen), feedback: (case_id, id, decision),
    or with entity_type and entity_id instead of case_id."""
    out = case
    if before is not None:
        keys = known_by(case, before)
        out = added(out, before.groupBy(*keys).agg(F.min("first_seen").alias("first_seen")), keys)
    if feedback is not None:
        keys = known_by(case, feedback)
        out = added(out, feedback.groupBy(*keys).agg(F.max_by("decision", "id").alias("review_status")), keys)
    old = lambda c, kind, other: F.coalesce(F.col(c) if c in out.columns else F.lit(None).cast(kind), other)
    return out.withColumns({"first_seen": old("first_seen", "timestamp", F.lit(now).cast("timestamp")), "review_status": old("review_status", "string", F.lit("open"))})


def store(case: DataFrame, path: str) -> DataFrame:
    """Writes cases as the table that read queries go to: in ranges of place, so that files and row groups of other places are passed over.

    Ranges are found on a table, since looking for them works everything out that they are found on."""
    rows = written(case)
    rows.repartitionByRange("state", "district", "entity_id").sortWithinPartitions("state", "district", "entity_id").write.mode("overwrite").parquet(path)
    drop(rows)
    return case.sparkSession.read.schema(case.schema).parquet(path)


def neighbours(case: DataFrame) -> DataFrame:
    """Cases of the same authority and of the same state. Counts are aggregated first and joined back."""
    by_ia = case.where("ia_name is not null").groupBy("ia_name").agg(F.count(F.lit(1)).alias("authority_cases"))
    by_state = case.where("state is not null").groupBy("state").agg(F.count(F.lit(1)).alias("state_cases"))
    return case.join(by_ia, "ia_name", "left").join(by_state, "state", "left")


def confidence(case: DataFrame, areas: DataFrame, now: str, stale_hours: int = 36) -> DataFrame:
    """Why a case's data may be off: reasons from its area's reading state (by shard_id)."""
    rows = case.join(areas, "shard_id", "left")
    why = [
        F.when(F.col("fetched_at").isNull(), "never read"), F.when(F.col("fetched_at") < F.expr(f"timestamp'{now}' - interval {stale_hours} hours"), "stale"), F.when(F.col("exact") == 0, "figures differ from the portal"),
        F.when(F.col("consecutive_failures") > 0, "last reads failed"), F.when(F.col("lifecycle") == "quarantined", "held back"), F.when(F.col("awaiting_removal") > 0, "rows await removal"),
    ]
    return rows.withColumn("reasons", F.array_compact(F.array(*why))).withColumn("confidence", F.when(F.size("reasons") == 0, "high").when(F.size("reasons") == 1, "medium").otherwise("low"))


def contract_facts(works: DataFrame, payments: DataFrame) -> DataFrame:
    """Facts the rules rest on, measured again: (fact, value), in two aggregations and a join."""
    one = works.agg(
        F.count(F.lit(1)).alias("works"), F.countDistinct("work_id").alias("work_ids"), F.count("sanction_date").alias("sanctioned"), F.count("completion_date").alias("completed"), F.count_if(F.col("status") == "NA").alias("second_records"),
        F.count_if(F.col("completion_date") < F.col("sanction_date")).alias("completed_before_sanction"), F.count_if((F.col("completion_date").isNotNull()) & F.col("sanction_date").isNull()).alias("completed_unsanctioned"),
    )
    known = works.select("work_id").distinct()
    two = payments.agg(F.count(F.lit(1)).alias("payments"), F.countDistinct("work_id").alias("paid_works"))
    lost = payments.select("work_id").distinct().join(known, "work_id", "left_anti").agg(F.count(F.lit(1)).alias("payments_of_unknown_works"))
    row = one.crossJoin(two).crossJoin(lost)  # one row each
    return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, row.columns)), F.array(*[F.col(c).cast("bigint") for c in row.columns]))).alias("fact", "value"))


def last_review(case: DataFrame, feedback: DataFrame, before: DataFrame) -> DataFrame:
    """Keeps the latest decision, and when a case was first seen, across rewrites. Decisions and earlier cases are those of an entity, where they have entity_type and entity_id, else of a case_id."""
    keys, old = known_by(case, feedback), known_by(case, before)
    out = added(case, feedback.groupBy(*keys).agg(F.max_by("decision", "id").alias("review_status")), keys)
    return added(out, before.groupBy(*old).agg(F.min("first_seen").alias("seen_before")), old).withColumn("review_status", F.coalesce("review_status", F.lit("open")))


#: Cases of a gram up to which it always has its postings.
MANY = 100_000
#: What a search looks in.
SEARCHED = ("display_title", "entity_id", "entity_label", "primary_signal")


def filtered(case: DataFrame, *, states=(), districts=(), constituencies=(), entity_types=(), statuses=(), bands=(), rules=(), min_score: int | None = None, alert: bool | None = None, search: str | None = None) -> DataFrame:
    """AND of lists; search matches text as it is, with % and _ escaped, in any case of letters."""
    lists = (("state", states), ("district", districts), ("constituency", constituencies), ("entity_type", entity_types), ("review_status", statuses), ("band", bands))
    tests = [F.col(c).isin(*v) for c, v in lists if v]
    if rules:
        tests.append(F.exists("rules", lambda r: r.isin(*rules)))
    if min_score is not None:
        tests.append(F.col("score") >= min_score)
    if alert is not None:
        tests.append(F.col("alert") == alert)
    if search:
        pattern = "%" + search.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") + "%"
        tests.append(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in SEARCHED]))
    return case.where(reduce(lambda a, b: a & b, tests)) if tests else case


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters, in lower case; none of shorter texts."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(.{3}))"), 1))


def store_postings(case: DataFrame, path: str, many: int = MANY) -> DataFrame:
    """(gram, case_id) of what a search looks in, in ranges of grams, so that a search reads the row groups of its own grams only.

    A gram of more than ``many`` cases and an eighth of all of them tells few apart; it has one row, without a case."""
    held = F.array_distinct(F.concat(*[trigrams(F.col(c)) for c in SEARCHED]))
    times = case.select(F.explode(F.concat(held, F.array(F.lit(None).cast("string")))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    times = written(times)  # null: all cases
    total = times.where("gram is null").select(F.col("n").alias("cases"))
    # each case has some hundred grams, so few are in an eighth of all
    common = times.where("gram is not null").crossJoin(F.broadcast(total)).where((F.col("n") > many) & (8 * F.col("n") > F.col("cases"))).select("gram")
    known = F.broadcast(common.agg(F.collect_list("gram").alias("_common")))
    rows = case.crossJoin(known).select("case_id", F.explode(F.array_except(held, "_common")).alias("gram")).select("gram", "case_id")
    rows = written(rows.union(common.select("gram", F.lit(None).cast("string").alias("case_id"))))
    rows.repartitionByRange("gram", "case_id").sortWithinPartitions("gram", "case_id").write.mode("overwrite").parquet(path)
    drop(times, rows)
    return case.sparkSession.read.schema(rows.schema).parquet(path)


def searched(case: DataFrame, postings: DataFrame, text: str) -> DataFrame:
    """Cases that hold a text, as ``filtered`` finds them: those with all its trigrams, each then looked at. A text of one or two characters has none and is looked for everywhere,
    and so is one whose trigrams are all in too many cases to have postings."""
    low = text.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if grams:
        common = {r.gram for r in postings.where(F.col("gram").isin(*grams) & F.col("case_id").isNull()).collect()}
        grams = [g for g in grams if g not in common]
    if not grams:
        return filtered(case, search=text)
    # a case_id may stand for two cases
    ids = postings.where(F.col("gram").isin(*grams)).groupBy("case_id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(grams)).select("case_id")
    return filtered(case.join(ids, "case_id", "left_semi"), search=text)


ORDERS = {"risk": (F.desc, ("score",)), "risk_asc": (F.asc, ("score",)), "recent": (F.desc, ("first_seen",)), "state": (F.asc, ("state",))}


def page(case: DataFrame, order: str = "risk", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, at most 200 rows; ties by score, then by entity. An order that isn't known is that by risk."""
    by, columns = ORDERS.get(order, ORDERS["risk"])
    return case.orderBy(*map(by, columns), F.desc("score"), "entity_type", "entity_id").offset(offset).limit(min(limit, 200))


def stats(case: DataFrame) -> DataFrame:
    return case.agg(F.count(F.lit(1)).alias("cases"), F.count_if("alert").alias("alerts"), *[F.count_if(F.col("band") == b).alias(b.lower()) for b in ("High", "Medium", "Low")], F.round(F.avg("score"), 1).alias("mean_score"))


def by_place(case: DataFrame, *keys: str) -> DataFrame:
    return case.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("band") == "High").alias("high"), F.count_if("alert").alias("alerts"), F.round(F.avg("score"), 1).alias("mean_score"))


def rule_histogram(case: DataFrame, *keys: str) -> DataFrame:
    return case.select(*keys, F.explode("rules").alias("rule_id")).groupBy(*keys, "rule_id").agg(F.count(F.lit(1)).alias("cases"))


def facets(case: DataFrame, *columns: str) -> DataFrame:
    """(facet, value, n) for each column."""
    long = case.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f")).select("f.*")
    return long.where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def allowed_actions(catalogue: DataFrame, case: DataFrame, role: str) -> DataFrame:
    """Actions that a role may take on a case: by role, least score, and evidence the case has. Actions meet cases at each rule that is evidence for them, or at none.

    Rows name the case by its entity too, where it has one."""
    names = list(dict.fromkeys(["case_id", *known_by(case)]))
    none = F.array(F.lit(None).cast("string"))
    rows = catalogue.where(F.array_contains("roles", role)).select("action", "min_score", F.explode(F.when(F.size("evidence") == 0, none).otherwise(F.col("evidence"))).alias("rule"))
    few = rows.limit(BROADCAST + 1).count() <= BROADCAST
    held = case.select(*names, "score", F.explode(F.concat("rules", none)).alias("held"))
    return held.join(F.broadcast(rows) if few else rows, F.col("held").eqNullSafe(F.col("rule")) & (F.col("score") >= F.col("min_score"))).select(*names, "action").distinct()


def plan_errors(plan: DataFrame, allowed: DataFrame, most: int = 5) -> DataFrame:
    """(case_id, action, error) for the steps (case_id, step, action) of proposed plans: actions that the case doesn't allow, that come twice, or beyond ``most``."""
    ok = allowed.select("case_id", "action").distinct().withColumn("ok", F.lit(True))
    again = F.row_number().over(Window.partitionBy("case_id", "action").orderBy("step")) > 1
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("step"))
    rows = plan.withColumns({"again": again, "place": place}).join(ok, ["case_id", "action"], "left")
    error = F.when(F.col("ok").isNull(), "not allowed").when(F.col("again"), "twice").when(F.col("place") > most, "too many")
    return rows.select("case_id", "action", error.alias("error")).where("error is not null")


def in_script(text: str, script: str = "Devanagari", least: float = 0.5) -> Column:
    """Whether enough of a text's letters are of a script; texts without letters are not."""
    letters, own = F.length(F.regexp_replace(text, r"\P{L}", "")), F.length(F.regexp_replace(text, rf"[^\p{{Is{script}}}&&\p{{L}}]", ""))
    return F.coalesce((letters > 0) & (own >= least * letters), F.lit(False))


def planted(works: DataFrame, every: int, changes: dict[str, tuple[str, dict[str, Column]]], seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(works with planted cases, planted (pattern, rule_id, entity_id)): of every ``every`` works, chosen by a hash, one is changed for each pattern in turn.

    changes: pattern to (rule, new columns)."""
    at = F.pmod(F.xxhash64(F.lit(seed), "work_id"), F.lit(every * len(changes)))
    rows, marks = works.withColumn("_at", at), None
    for k, (pattern, (rule, columns)) in enumerate(changes.items()):
        rows = rows.withColumns({c: F.when(F.col("_at") == k * every, v).otherwise(F.col(c)) for c, v in columns.items()})
        part = works.where(at == k * every).select(F.lit(pattern).alias("pattern"), F.lit(rule).alias("rule_id"), F.col("work_id").alias("entity_id"))
        marks = part if marks is None else marks.unionByName(part)
    return rows.drop("_at"), marks


def unsupported_numbers(text: str, facts: str) -> Column:
    """Numbers in a text that its facts (array of strings) don't hold: the provenance guard."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d,]*\.?\d*)")), lambda x: F.regexp_replace(F.rtrim(x, F.lit(".")), ",", ""))
    return F.array_except(numbers, facts)


def has_banned(text: str, words) -> Column:
    return F.lower(text).rlike(r"\b(" + "|".join(words) + r")\b")


def precision(verdicts: DataFrame) -> DataFrame:
    """Share of confirmed cases of each rule, with its Wilson interval."""
    rows = verdicts.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "confirmed").alias("confirmed"))
    low, high = S.wilson("confirmed", "n")
    return rows.select("rule_id", "n", "confirmed", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


def planted_recall(planted: DataFrame, findings: DataFrame) -> DataFrame:
    """Planted (pattern, rule_id, entity_id) found or not, by pattern."""
    hits = findings.select("rule_id", "entity_id", F.lit(1).alias("hit")).distinct()
    return planted.join(hits, ["rule_id", "entity_id"], "left").groupBy("pattern", "rule_id").agg(F.count(F.lit(1)).alias("planted"), F.count("hit").alias("found"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))
