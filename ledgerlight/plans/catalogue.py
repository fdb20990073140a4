"""The registered queries: each operator on the demonstration corpus, whole tables, with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight import config
from ledgerlight.functions import scalar as S
from ledgerlight.operators import compliance, duplicates, network, payments, peers, relational, revisions
from ledgerlight.operators.findings import together
from ledgerlight.plans import cases, reads
from ledgerlight.session import shared_folder
from ledgerlight.sources import demo, readers, sinks, switch
from ledgerlight.sources.buckets import BucketTable
from ledgerlight.sources.demo import FLOWS_SQL, PAYMENTS_SQL, TODAY, WORKS_SQL
from ledgerlight.streaming import ingest
from ledgerlight.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 2) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


MARKED_SQL = f"""{WORKS_SQL},
g as (select state, category, era, count(*) as n, median(ln(1 + cost)) as med, median(cost) as median_cost, quantile_cont(cost, 0.975::double) as p_high from works where cost > 0 group by all having count(*) >= 8),
m as (select w.state, w.category, w.era, median(abs(ln(1 + cost) - med)) as mad from works w join g using (state, category, era) where cost > 0 group by all),
marked as (select w.*, g.n, g.median_cost, (ln(1 + cost) - med) / (1.4826::double * mad) as z, cost - median_cost as excess, 100 * (cost - median_cost) / median_cost as pct_above, mad, p_high from works w join g using (state, category, era) join m using (state, category, era) where cost > 0)"""


# ---------------------------------------------------------------- rules
@query("a_cost_01", f"with {MARKED_SQL} select work_id as entity_id, 'high' as severity, cast(n as bigint) as n, round(z, 4) as z from marked where abs(z) > 2.0::double")
def a_cost_01(spark, sf):
    """Two-sided at 2.0 here: the demonstration prices have no outlier at the rule's own threshold."""
    return rounded(peers.cost_outliers(demo.works(spark, sf), z=2.0, two_sided=True).select("entity_id", "severity", "n", "z"), "z", digits=4)


@query("a_cost_01_default", f"with {MARKED_SQL} select work_id as entity_id, case when cost / median_cost >= 20 then 'medium' else 'high' end as severity, cast(n as bigint) as n from marked where (case when mad > 0 then z > 2.5::double else cost > p_high end) and excess >= 100000 and pct_above >= 30")
def a_cost_01_default(spark, sf):
    return peers.cost_outliers(demo.works(spark, sf)).select("entity_id", "severity", "n")


@query("a_cost_events", """with e as (select event_id, event_type, user_id % 5 as u, ln(1 + value) as x from events where value > 0), g as (select event_type, u, median(x) as med, count(*) as n from e group by all), m as (select event_type, u, median(abs(x - med)) as mad from e join g using (event_type, u) group by all)
select event_id, round((x - med) / (1.4826::double * mad), 4) as z from e join g using (event_type, u) join m using (event_type, u) where n >= 8 and (x - med) / (1.4826::double * mad) > 1.5::double""")
def a_cost_events(spark, sf):
    rows = demo.table(spark, sf, "events").where("value > 0").withColumn("u", F.col("user_id") % 5)
    x = F.log1p("value")
    z = peers.robust_z(x)
    return rows.join(peers.robust_stats(rows, ("event_type", "u"), x, 8), ["event_type", "u"]).where(z > 1.5).select("event_id", F.round(z, 4).alias("z"))


@query("a_exp_01", f"""with {FLOWS_SQL}, x as (select *, ln(1 + expenditure) as x from flows where expenditure > 0), g as (select fy, era, count(*) as n, median(x) as med, avg(x) as mean, stddev_pop(x) as std from x group by all having count(*) >= 8), m as (select fy, era, median(abs(x - med)) as mad from x join g using (fy, era) group by all)
select member as entity_id, fy, round(case when mad > 0 then (x - med) / (1.4826::double * mad) when std > 0 then (x - mean) / std else 0 end, 4) as z from x join g using (fy, era) join m using (fy, era) where abs(case when mad > 0 then (x - med) / (1.4826::double * mad) when std > 0 then (x - mean) / std else 0 end) > 3""")
def a_exp_01(spark, sf):
    return rounded(peers.expenditure_outliers(demo.flows(spark, sf)).select("entity_id", "fy", "z"), "z", digits=4)


def paid_works(spark, sf):
    return demo.works(spark, sf).join(relational.payment_rollup(demo.payments(spark, sf)), "work_id", "left")


PAID_SQL = f"{WORKS_SQL}, {PAYMENTS_SQL}, rollup0 as (select work_id, sum(amount) as total_paid, count(*) as payment_count, max(paid_on) as last_payment_date, max_by(status, (paid_on, seq, amount, status)) as payment_status from payments group by work_id), paid as (select works.*, total_paid, payment_count from works left join rollup0 using (work_id))"


@query("a_peer_01", f"""with {PAID_SQL}, big as (select state, category, era from works group by all having count(*) >= 30),
l as (select work_id, state, category, era, unnest(['days_to_sanction', 'days_to_complete', 'paid_share', 'payment_count']) as measure, unnest([case when sanction_date - recommended_date >= 0 then ln(1 + (sanction_date - recommended_date)) end, case when completion_date - sanction_date >= 0 then ln(1 + (completion_date - sanction_date)) end, case when cost > 0 then total_paid / cost end, ln(1 + payment_count)]) as x from paid join big using (state, category, era)),
v as (select * from l where x is not null), g as (select state, category, era, measure, median(x) as med from v group by all having count(*) >= 30), m as (select state, category, era, measure, median(abs(x - med)) as mad from v join g using (state, category, era, measure) group by all having median(abs(x - med)) > 0),
h as (select work_id, measure from v join g using (state, category, era, measure) join m using (state, category, era, measure) where case when measure = 'paid_share' then (x - med) / (1.4826::double * mad) < -1.0::double else (x - med) / (1.4826::double * mad) > 1.0::double end)
select work_id as entity_id, count(*) as n_extreme, array_to_string(list_sort(list(measure)), ',') as measures from h group by work_id having count(*) >= 2""")
def a_peer_01(spark, sf):
    """At 1.0 here, so that the demonstration corpus has findings."""
    return peers.profile_outliers(paid_works(spark, sf), z=1.0).select("entity_id", "n_extreme", "measures")


@query("r_time_01", f"with {WORKS_SQL} select work_id as entity_id, cast(coalesce(completion_date, date '{TODAY}') - sanction_date as integer) as days, case when coalesce(completion_date, date '{TODAY}') - sanction_date > 548 then 'high' else 'medium' end as severity from works where coalesce(completion_date, date '{TODAY}') - sanction_date > 365")
def r_time_01(spark, sf):
    return compliance.completion_norm(demo.works(spark, sf), TODAY).select("entity_id", "days", "severity")


def _words(xs) -> str:
    """Alternation, longest first."""
    return "(" + "|".join(sorted(xs, key=len, reverse=True)) + ")"


def _loose(xs) -> str:
    """What the rule's own pattern matches, in SQL without look-around: the look-behind binds to the longest term, the look-ahead to the shortest."""
    first, *middle, last = sorted(xs, key=len, reverse=True)
    pattern = f"(?i)(?:^|[^a-z])({first})|({'|'.join(middle)})|({last})(?:[^a-z]|$)"
    return "lower(" + " || ".join(f"regexp_extract({{c}}, '{pattern}', {k})" for k in (1, 2, 3)) + ")"


def _paragraphs(table: dict, c: str) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


@query("r_prohibited", f"""with {WORKS_SQL}, t as (select work_id, description as text, {_loose(config.ACTIVITIES).format(c="description")} as act from works),
h as (select *, regexp_replace(regexp_replace(regexp_replace(text, '(?i)^(construction|renovation|repair|building)\\s*(of\\s+)?', ''), '(?i)\\b(at|near|opposite|in)\\b.*$', ''), '\\s+$', '') as head from t),
a as (select *, {_loose(config.ASSETS).format(c="head")} as asset, len(list_intersect(string_split_regex(lower(text), '\\s+'), [{', '.join(repr(p) for p in config.PERMISSIBLE)}])) > 0 as veto from h),
m as (select work_id, case when act <> '' then 'activity' else 'asset' end as match_type, case when act <> '' then act else asset end as matched from a where act <> '' or (asset <> '' and not veto))
select work_id as entity_id, match_type, matched, case match_type when 'activity' then {_paragraphs(config.ACTIVITIES, "matched")} else {_paragraphs(config.ASSETS, "matched")} end as para, case match_type when 'activity' then 'medium' else 'critical' end as severity from m""")
def r_prohibited(spark, sf):
    """R-PROH-01"""
    return compliance.prohibited(demo.works(spark, sf)).select("entity_id", "match_type", "matched", "para", "severity")


@query("r_prohibited_strict", f"""with {WORKS_SQL}, t as (select work_id, description as text, lower(regexp_extract(description, '(?i)(^|[^a-z]){_words(config.ACTIVITIES)}([^a-z]|$)', 2)) as act from works),
h as (select *, regexp_replace(regexp_replace(regexp_replace(text, '(?i)^(construction|renovation|repair|building)\\s*(of\\s+)?', ''), '(?i)\\b(at|near|opposite|in)\\b.*$', ''), '\\s+$', '') as head from t),
a as (select *, lower(regexp_extract(head, '(?i)(^|[^a-z]){_words(config.ASSETS)}([^a-z]|$)', 2)) as asset, len(list_intersect(string_split_regex(lower(text), '\\s+'), [{', '.join(repr(p) for p in config.PERMISSIBLE)}])) > 0 as veto from h)
select work_id as entity_id, case when act <> '' then 'activity' else 'asset' end as match_type, case when act <> '' then act else asset end as matched, case when act <> '' then 'medium' else 'critical' end as severity from a where act <> '' or (asset <> '' and not veto)""")
def r_prohibited_strict(spark, sf):
    return compliance.prohibited(demo.works(spark, sf), strict=True).select("entity_id", "match_type", "matched", "severity")


@query("r_cost_01", f"with {WORKS_SQL} select work_id as entity_id, round(cost, 2) as cost, case when cost < 250000 then 'below' else 'above' end as side, cost > 25000000 as standalone from works where sanction_date is not null and cost > 0 and (cost < 250000 or cost > 25000000)")
def r_cost_01(spark, sf):
    return rounded(compliance.cost_limits(demo.works(spark, sf)).select("entity_id", "cost", "side", "standalone"), "cost")


@query("r_cost_01_district", f"with {WORKS_SQL}, b as (select * from works where sanction_date is not null and cost > 0) select ia_name as entity_id, state, count(*) filter (cost < 250000) as works, count(*) as population, round(count(*) filter (cost < 250000) / count(*), 4) as share from b group by ia_name, state having count(*) filter (cost < 250000) >= 10")
def r_cost_01_district(spark, sf):
    return rounded(compliance.below_minimum_by_district(demo.works(spark, sf)).select("entity_id", "state", "works", "population", "share"), "share", digits=4)


@query("r_sanc_01", f"with {WORKS_SQL} select work_id as entity_id, cast(date '{TODAY}' - recommended_date as integer) as waited from works where sanction_date is null and status = 'Pending for Sanction' and date '{TODAY}' - recommended_date > 45")
def r_sanc_01(spark, sf):
    return compliance.sanction_waits(demo.works(spark, sf), TODAY).select("entity_id", "waited")


@query("r_sanc_01_district", f"with {WORKS_SQL} select ia_name as entity_id, count(*) filter (sanction_date is null and date '{TODAY}' - recommended_date > 45) as works, count(*) filter (sanction_date is null and status = 'Pending for Sanction') as population from works group by ia_name, state having count(*) filter (sanction_date is null and date '{TODAY}' - recommended_date > 45) >= 10")
def r_sanc_01_district(spark, sf):
    return compliance.sanction_waits_by_district(demo.works(spark, sf), TODAY).select("entity_id", "works", "population")


@query("r_sanc_02", f"with {WORKS_SQL} select ia_name as entity_id, count(*) as works, median(sanction_date - recommended_date)::double as median_days from works where sanction_date is not null group by ia_name having count(*) >= 20 and median(sanction_date - recommended_date) > 40")
def r_sanc_02(spark, sf):
    return compliance.sanction_patterns(demo.works(spark, sf), config.SANCTION | {"days": 40}).select("entity_id", "works", "median_days")


def _cap(rule: dict, hit: str) -> str:
    return f"""with {WORKS_SQL}, x as (select constituency || '|' || state as member, rec_fy as year, estimated_cost as v, work_category = '{rule['category']}' as named from works where {hit})
select member as entity_id, year, count(*) as works, round(sum(v), 2) as total, case when coalesce(sum(v) filter (named), 0) > {rule['cap']} then 'medium' else 'low' end as severity from x group by member, year having sum(v) > {rule['cap']}"""


@query("r_repair_01", _cap(config.REPAIR, "work_category = 'Repair and Renovation' or regexp_matches(description, '(?i)(^|[^a-z])(repair|renovation)([^a-z]|$)')"))
def r_repair_01(spark, sf):
    return rounded(compliance.repair_cap(demo.works(spark, sf)).select("entity_id", "year", "works", "total", "severity"), "total")


@query("r_trust_01", _cap(config.TRUST, "work_category = 'Trust and Society'"))
def r_trust_01(spark, sf):
    return rounded(compliance.trust_cap(demo.works(spark, sf)).select("entity_id", "year", "works", "total", "severity"), "total")


@query("r_scst_01", f"""with {FLOWS_SQL}, l as (select *, unnest(['sc', 'st']) as kind, unnest([expenditure * 0.1::double, expenditure * 0.09::double]) as spent, unnest([15.0::double, 7.5::double]) as least from flows where expenditure > 0)
select member as entity_id, fy, kind, round(100 * spent / expenditure, 2) as share from l where 100 * spent / expenditure < least""")
def r_scst_01(spark, sf):
    return rounded(compliance.area_shares(demo.flows(spark, sf)).select("entity_id", "fy", "kind", "share"), "share")


@query("r_scst_02", f"""with {WORKS_SQL}, x as (select *, coalesce(expenditure, 0) as spent from works where house = 'LS'), s as (select state, sum(spent) as total, sum(case when is_sc_constituency = 1 then spent else 0 end) as sc, sum(case when is_st_constituency = 1 then spent else 0 end) as st, count(distinct constituency) filter (is_sc_constituency = 1) as sc_seats, count(distinct constituency) filter (is_st_constituency = 1) as st_seats from x group by state),
l as (select state, total, unnest(['sc', 'st']) as kind, unnest([sc, st]) as spent, unnest([sc_seats, st_seats]) as seats, unnest([15.0::double, 7.5::double]) as least from s where total >= 50000000) select state as entity_id, kind, seats, round(100 * spent / total, 2) as share from l where seats >= 1 and 100 * spent / total < least""")
def r_scst_02(spark, sf):
    return rounded(compliance.reserved_shares(demo.works(spark, sf)).select("entity_id", "kind", "seats", "share"), "share")


@query("r_spike_01", f"""with {FLOWS_SQL}, x as (select member, fy, 100 * sum(expenditure) / sum(released) as util from flows group by member, fy), w as (select *, count(*) over p as seen, max(util) over p as most, avg(util) over p as dormant from x window p as (partition by member order by fy rows between 2 preceding and 1 preceding)),
h as (select *, row_number() over (partition by member order by fy) as hit from w where seen = 2 and most < 55 and util >= 56 and util >= 1.0::double * case when dormant = 0 then 1 else dormant end) select member as entity_id, fy, round(util, 2) as util, round(dormant, 2) as dormant from h where hit = 1""")
def r_spike_01(spark, sf):
    """With thresholds that the demonstration corpus meets; members are seats here."""
    f = demo.flows(spark, sf).groupBy("state", "constituency", "fy").agg(F.sum("released").alias("released"), F.sum("expenditure").alias("expenditure")).withColumns({"mp_name": F.lit(None).cast("string"), "utilization_pct": F.lit(None).cast("double")})
    return rounded(compliance.utilization_spikes(f, "2010-01-01", config.SPIKE | {"low": 55.0, "spike": 56.0, "ratio": 1.0}).select("entity_id", "fy", "util", "dormant"), "util", "dormant")


@query("r_pile_01", f"with {FLOWS_SQL} select member as entity_id, count(*) as years, round(100 * sum(expenditure) / sum(released), 2) as util from flows group by member having count(*) >= 3 and 100 * sum(expenditure) / sum(released) < 50")
def r_pile_01(spark, sf):
    return rounded(compliance.pileups(demo.flows(spark, sf)).select("entity_id", "years", "util"), "util")


def _network(key: str, kind: str, spread: bool, share: float = 0.5, works: str = "works") -> str:
    name = {"vendor_id": "vendor_name"}.get(key, key)
    actor = {"vendor_id": "trim(vendor_id)", "ia_name": "case when length(trim(ia_name)) > 3 then trim(ia_name) end"}.get(key, f"case when length(trim({key})) > 3 then upper(trim({key})) end")
    entity = "a.actor" if kind == "district_authority" else f"'{kind}:' || a.actor"
    return f"""with {MARKED_SQL}, {PAYMENTS_SQL}, ma0 as (select work_id, implementing_agency, count(*) as k from payments group by all), ma as (select work_id, implementing_agency from (select *, row_number() over (partition by work_id order by k desc, implementing_agency) as r from ma0) where r = 1),
named as (select works.*, implementing_agency from works left join ma using (work_id)), o as (select work_id from marked where abs(z) > 2.0::double), b as (select *, {actor} as actor, upper(trim({name})) as nm from {works}), tops as (select actor, nm from (select actor, nm, row_number() over (partition by actor order by count(*) desc, nm) as r from b where actor is not null group by actor, nm) where r = 1),
a as (select actor, count(*) as works, count(distinct district) as districts, count(distinct state) as states, count(o.work_id) as overruns, sum(cost) as total_value from b left join o using (work_id) where actor is not null group by 1 having count(*) >= 5)
select {entity} as entity_id, nm as actor, works, districts, states, overruns, round(total_value, 2) as total_value, case when {spread} and districts > 4 and overruns >= 2 and overruns / works >= {share}::double then 'high' else 'medium' end as severity from a join tops using (actor) where ({spread} and districts > 4) or (overruns >= 2 and overruns / works >= {share}::double)"""


@query("n_net_01_vendor", _network("vendor_id", "vendor", True))
def n_net_01_vendor(spark, sf):
    return rounded(network.actor_signals(demo.works(spark, sf), "vendor", z=2.0, two_sided=True).select("entity_id", "actor", "works", "districts", "states", "overruns", "total_value", "severity"), "total_value")


@query("n_net_01_authority", _network("ia_name", "district_authority", True, 0.01))
def n_net_01_authority(spark, sf):
    """With a share of 1 % here: the demonstration corpus has no authority at the rule's own half."""
    found = network.actor_signals(demo.works(spark, sf), "district_authority", rule=config.NETWORK | {"share": 0.01}, z=2.0, two_sided=True)
    return rounded(found.select("entity_id", "actor", "works", "districts", "states", "overruns", "total_value", "severity"), "total_value")


@query("n_net_01_agency", _network("implementing_agency", "agency", False, 0.01, "named"))
def n_net_01_agency(spark, sf):
    """Agencies named most often on a work's payments; with a share of 1 % here."""
    named = demo.works(spark, sf).join(relational.main_agency(demo.payments(spark, sf)), "work_id", "left")
    found = network.actor_signals(named, "agency", rule=config.NETWORK | {"share": 0.01}, z=2.0, two_sided=True)
    return rounded(found.select("entity_id", "actor", "works", "districts", "states", "overruns", "total_value", "severity"), "total_value")


def marked_payments(spark, sf):
    return payments.marked(demo.payments(spark, sf), demo.works(spark, sf))


PM_SQL = f"with {WORKS_SQL}, {PAYMENTS_SQL}, pm as (select p.*, w.sanction_date, w.completion_date, count(*) over (partition by p.work_id, paid_on, amount, p.vendor_id) as repeats from payments p join works w using (work_id))"


@query("p_seq_01", f"{PM_SQL} select work_id as entity_id, count(*) as payments, round(sum(amount), 2) as amount, min(paid_on) as first_paid from pm where paid_on < sanction_date group by work_id")
def p_seq_01(spark, sf):
    return rounded(payments.before_sanction(marked_payments(spark, sf)).select("entity_id", "payments", "amount", "first_paid"), "amount")


@query("p_late_01", f"{PM_SQL} select work_id as entity_id, count(*) as payments, round(sum(amount), 2) as amount, cast(max(paid_on - completion_date) as integer) as days from pm where paid_on - completion_date > 180 group by work_id")
def p_late_01(spark, sf):
    return rounded(payments.long_after(marked_payments(spark, sf)).select("entity_id", "payments", "amount", "days"), "amount")


@query("p_dup_01", """with p as (select cast(user_id as varchar) as work_id, cast(ts as date) as paid_on, round(value, 0) as amount, event_type as vendor_id from events), d as (select work_id, paid_on, amount, vendor_id, count(*) as n from p group by all having count(*) > 1)
select work_id as entity_id, cast(sum(n) as bigint) as payments, round(sum(amount * (n - 1)), 2) as repeated_amount from d group by work_id""")
def p_dup_01(spark, sf):
    p = demo.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("work_id"), F.to_date("ts").alias("paid_on"), F.round("value", 0).alias("amount"), F.col("event_type").alias("vendor_id"))
    w = p.select("work_id").distinct().withColumns({"sanction_date": F.lit(None).cast("date"), "completion_date": F.lit(None).cast("date")})
    return rounded(payments.repeated(payments.marked(p, w)).select("entity_id", "payments", "repeated_amount"), "repeated_amount")


@query("payment_marks", f"{PM_SQL} select work_id, seq, paid_on < sanction_date and sanction_date is not null as before_sanction, cast(case when paid_on - completion_date > 0 then paid_on - completion_date end as integer) as days_after_completion, month(paid_on) = 3 and day(paid_on) >= 25 as year_end_week, repeats from pm")
def payment_marks(spark, sf):
    return marked_payments(spark, sf).select("work_id", "seq", "before_sanction", "days_after_completion", "year_end_week", "repeats")


# ---------------------------------------------------------------- edit log
SNAP_SQL = "snap as (select cast(user_id % 150 as varchar) as work_id, ts, event_id, event_type as ia_name, round(value, 0) * 100000 as sanctioned_amount, round(value, 2) as total_paid from events)"
LOG_SQL = f"""{SNAP_SQL}, lagged as (select *, lag(ia_name) over w as ia0, lag(sanctioned_amount) over w as sa0, lag(total_paid) over w as tp0, row_number() over w as rn from snap window w as (partition by work_id order by event_id)),
log as (select work_id, ts as observed_at, event_id, 'ia_name' as field, ia0 as old_value, ia_name as new_value from lagged where rn > 1 and ia0 <> ia_name)"""


def edits(spark, sf):
    s = demo.snapshots(spark, sf)
    log = revisions.edit_log(s, ["work_id"], "event_id", ["ia_name", "sanctioned_amount", "total_paid"])
    return log.withColumn("event_id", F.col("observed_at")).drop("observed_at").join(s.select("event_id", F.col("ts").alias("observed_at")), "event_id")


def revision_rows(spark, sf):
    return revisions.with_occasion(edits(spark, sf), demo.works(spark, sf))


@query("edit_log", f"with {LOG_SQL} select work_id, event_id, old_value, new_value from log")
def edit_log(spark, sf):
    return edits(spark, sf).where("field = 'ia_name'").select("work_id", "event_id", "old_value", "new_value")


@query("v_ia_01", f"with {WORKS_SQL}, {LOG_SQL} select l.work_id as entity_id, l.old_value, l.new_value, l.observed_at from log l join works w using (work_id) where w.sanction_date < cast(l.observed_at as date)")
def v_ia_01(spark, sf):
    return revisions.agency_changes(revision_rows(spark, sf)).select("entity_id", "old_value", "new_value", "observed_at")


@query("v_amt_01", f"""with {WORKS_SQL}, {LOG_SQL} select l.work_id as entity_id, sa0 as old_amount, l.sanctioned_amount as new_amount, round(100 * (l.sanctioned_amount - sa0) / sa0, 2) as pct, case when l.sanctioned_amount > sa0 then 'medium' else 'low' end as severity, ts as observed_at from lagged l join works w using (work_id)
where rn > 1 and sa0 <> l.sanctioned_amount and sa0 > 0 and w.sanction_date < cast(ts as date) and abs(100 * (l.sanctioned_amount - sa0) / sa0) >= 10 and abs(l.sanctioned_amount - sa0) >= 100000""")
def v_amt_01(spark, sf):
    return rounded(revisions.amount_changes(revision_rows(spark, sf)).select("entity_id", "old_amount", "new_amount", "pct", "severity", "observed_at"), "pct")


@query("v_pay_01", f"with {LOG_SQL} select work_id as entity_id, round(tp0 - total_paid, 2) as reduction, ts as observed_at from lagged where rn > 1 and tp0 - total_paid >= 20")
def v_pay_01(spark, sf):
    return rounded(revisions.payment_reversals(revision_rows(spark, sf), config.REVISIONS | {"paid_abs": 20}).select("entity_id", "reduction", "observed_at"), "reduction")


@query("v_ven_01", f"with {LOG_SQL} select work_id as entity_id, old_value, new_value, 'medium' as severity from log")
def v_ven_01(spark, sf):
    rows = revision_rows(spark, sf).withColumn("field", F.when(F.col("field") == "ia_name", "vendor_name").otherwise(F.col("field")))
    return revisions.vendor_changes(rows).select("entity_id", "old_value", "new_value", "severity")


@query("v_rev_01", f"with {WORKS_SQL}, {LOG_SQL} select l.work_id as entity_id, 'district' as fields, l.observed_at from log l join works w using (work_id) where w.sanction_date < cast(l.observed_at as date)")
def v_rev_01(spark, sf):
    e = edits(spark, sf).withColumn("field", F.when(F.col("field") == "ia_name", "district").otherwise(F.col("field")))
    return revisions.place_changes(revisions.with_occasion(e, demo.works(spark, sf))).select("entity_id", "fields", "observed_at")


@query("v_freq_01", f"""with {WORKS_SQL}, {LOG_SQL}, c as (select work_id, count(distinct ts) as revisions from lagged where rn > 1 and (ia0 <> ia_name or sa0 <> sanctioned_amount) group by work_id), p as (select c.*, avg(revisions) over (partition by state, category) as a from c left join works using (work_id)) select work_id as entity_id, revisions, round(a, 2) as peer_average from p where revisions >= 3 and revisions >= 1.1::double * a and (select count(*) from c) >= 20""")
def v_freq_01(spark, sf):
    rule = config.REVISIONS | {"history_days": 5, "revised_works": 20, "times": 1.1}
    return rounded(revisions.frequent_revisions(revision_rows(spark, sf), rule).select("entity_id", "revisions", "peer_average"), "peer_average")


@query("v_list_01", "select cast(event_id as varchar) as entity_id, round(value, 2) as total_paid from events where value > 50")
def v_list_01(spark, sf):
    r = demo.table(spark, sf, "events").where("value > 50").select(F.col("event_id").cast("string").alias("work_id"), F.col("ts").alias("retired_at"), F.to_json(F.struct(F.col("value").alias("total_paid"))).alias("record_json"))
    return rounded(revisions.removed_after_payment(r).select("entity_id", "total_paid"), "total_paid")


# ---------------------------------------------------------------- duplicates
def part_works(spark, sf):
    """Parts as works: short descriptions with many near-copies."""
    p = demo.table(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("string").alias("work_id"), F.col("p_type").alias("state"), F.col("p_brand").alias("district"), F.lit("post2023").alias("era"), F.concat("p_name", F.lit(" for ward "), (F.col("p_size") % 3).cast("string"), F.lit(" of zone "), "p_brand").alias("description"), (F.col("p_partkey") % 4).cast("string").alias("mp_name"), F.col("p_retailprice").alias("sanctioned_amount"), F.col("p_retailprice").alias("estimated_cost"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))


PART_SQL = "pw as (select cast(p_partkey as varchar) as work_id, p_type as state, p_brand as district, p_name || ' for ward ' || cast(p_size % 3 as varchar) || ' of zone ' || p_brand as description from part)"
TFIDF_SQL = f"""with {PART_SQL}, t as (select state, district, lower(description) as text, count(*) as copies from pw where length(description) >= 15 group by all), w as (select state, district, text, ' ' || unnest(string_split(text, ' ')) || ' ' as w from t), n as (select unnest([3, 4, 5]) as n),
gr as (select state, district, text, substr(w, i, n) as gram from w, n, lateral (select unnest(generate_series(1, length(w) - n + 1)) as i)), tf as (select state, district, text, gram, count(*) as tf from gr group by all), nn as (select state, district, sum(copies) as nn from t group by all), df as (select state, district, gram, sum(copies) as df from tf join t using (state, district, text) group by all),
we as (select state, district, text, gram, tf * (ln((1 + nn) / (1 + df)) + 1) as w from tf join df using (state, district, gram) join nn using (state, district)), no as (select state, district, text, sqrt(sum(w * w)) as norm from we group by all), wn as (select state, district, text, gram, w / norm as w from we join no using (state, district, text))
select a.state, a.district, least(a.text, b.text) as text_a, greatest(a.text, b.text) as text_b, round(sum(a.w * b.w), 4) as cosine from wn a join wn b on a.state = b.state and a.district = b.district and a.gram = b.gram and a.text < b.text group by all having sum(a.w * b.w) >= 0.8::double"""


@query("d_dup_cosine", TFIDF_SQL)
def d_dup_cosine(spark, sf):
    texts = duplicates.block_texts(part_works(spark, sf))
    pairs = duplicates.similar_texts(texts, 0.8)
    name = lambda s: texts.select(F.col("text_id").alias(s), F.col("text").alias(f"_{s}"))
    return pairs.join(name("a"), "a").join(name("b"), "b").select("state", "district", F.least("_a", "_b").alias("text_a"), F.greatest("_a", "_b").alias("text_b"), F.round("cosine", 4).alias("cosine"))


@query("d_dup_01")
def d_dup_01(spark, sf):
    """All findings of the rule; its string measure has no SQL, so tests hold it against brute force."""
    found = duplicates.near_duplicates(part_works(spark, sf), rule=config.DUPLICATE | {"boilerplate_pct": 60.0, "specific": 2})
    return together(*found).select("entity_id", "severity", "summary", "standalone", "scored", "details")


@query("d_dup_02", f"""with {WORKS_SQL}, tk as (select work_id, unnest(list_distinct(regexp_extract_all(lower(description), '[a-z0-9]{{3,}}'))) as t from works), common as (select t from tk group by t having count(*) > (select count(*) from works) * 2.0 / 100), sp as (select w.work_id, count(tk.t) filter (tk.t not in (select t from common)) as n from works w left join tk using (work_id) group by w.work_id),
x as (select w.state, w.district, trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) as text, w.work_id from works w join sp using (work_id) where n < 3) select min(work_id) as entity_id, state, district, text, count(*) as works from x group by state, district, text having count(*) >= 2""")
def d_dup_02(spark, sf):
    return duplicates.generic_clusters(demo.works(spark, sf), config.GENERIC_CLUSTER | {"least": 2}).select("entity_id", "state", "district", "text", "works")


def photo_rows(spark, sf):
    h = F.md5((F.floor(F.col("l_orderkey") / 3)).cast("string").cast("binary"))
    return demo.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").cast("string").alias("work_id"), F.sha2((F.floor(F.col("l_orderkey") / 2)).cast("string").cast("binary"), 256).alias("sha256"), F.substring(h, 1, 16).alias("row_hash"), F.substring(h, 17, 16).alias("col_hash"), (F.col("l_orderkey") % 10 * 0 + F.floor(F.col("l_orderkey") / 30)).cast("string").alias("batch"))


@query("d_dup_photo", "with p as (select distinct cast(l_orderkey as varchar) as work_id, sha256(cast(l_orderkey // 2 as varchar)) as sha256 from lineitem where l_linenumber = 1), n as (select sha256, count(*) as works from p group by 1 having count(*) > 1) select work_id as entity_id, works, case when works = 2 then 'critical' else 'high' end as severity from p join n using (sha256)")
def d_dup_photo(spark, sf):
    return duplicates.shared_photos(photo_rows(spark, sf)).select("entity_id", "works", "severity")


@query("d_dup_photo_alike", "with p as (select distinct l_orderkey as k from lineitem where l_linenumber = 1) select least(cast(a.k as varchar), cast(b.k as varchar)) as a_work_id, greatest(cast(a.k as varchar), cast(b.k as varchar)) as b_work_id from p a join p b on a.k // 3 = b.k // 3 and a.k < b.k and a.k // 30 = b.k // 30 and a.k // 2 <> b.k // 2")
def d_dup_photo_alike(spark, sf):
    return duplicates.alike_photos(photo_rows(spark, sf), "batch").select("a_work_id", "b_work_id")


@query("photo_clusters", "with e as (select distinct l_orderkey as k from lineitem) select cast(k as bigint) as node, min(k) over (partition by k // 4) as cluster from (select k, count(*) over (partition by k // 4) as c from e) where c > 1")
def photo_clusters(spark, sf):
    k = demo.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("g", F.floor(F.col("k") / 4))
    nxt = F.lead("k").over(Window.partitionBy("g").orderBy("k"))
    return duplicates.clusters(k.select(F.col("k").alias("a"), nxt.alias("b")).where("b is not null"))


# ---------------------------------------------------------------- scalar functions
def docs(spark, sf):
    return demo.table(spark, sf, "documents")


@query("f_clean_text", "select doc_id, md5(trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g'))) as clean, md5(regexp_replace(replace(text, chr(160), ' '), '\\s+', '', 'g')) as squashed from documents")
def f_clean_text(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(S.clean_text("text").cast("binary")).alias("clean"), F.md5(S.squash("text").cast("binary")).alias("squashed"))


@query("f_work_code", "select o_orderkey, 'WS/MP' || cast(o_custkey as varchar) || '/' || cast(year(o_orderdate) as varchar) || '-' || cast(year(o_orderdate) + 1 as varchar) || '/' || cast(o_orderkey as varchar) as code, o_orderpriority as kind from orders")
def f_work_code(spark, sf):
    o = demo.table(spark, sf, "orders")
    label = F.format_string("WS/MP%d/%d-%d/%d - %s", "o_custkey", F.year("o_orderdate"), F.year("o_orderdate") + 1, "o_orderkey", "o_orderpriority")
    return o.select("o_orderkey", S.work_code(label).alias("code"), S.work_type(label).alias("kind"))


@query("f_district", "select n_nationkey, n_name as district from nation")
def f_district(spark, sf):
    return demo.table(spark, sf, "nation").select("n_nationkey", S.district_of(F.concat("n_name", F.lit(" (DISTRICT MAGISTRATE)"))).alias("district"))


@query("f_number", "select l_orderkey, l_linenumber, l_extendedprice as v from lineitem")
def f_number(spark, sf):
    return demo.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.lenient_number(F.concat(F.lit("Rs. "), F.format_number("l_extendedprice", 2)).substr(5, 40)).alias("v"))


@query("f_date", "select o_orderkey, cast(o_orderdate as date) as d from orders")
def f_date(spark, sf):
    as_text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd-MMM-yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MMM d, yyyy h:mm:ss a"))
    return demo.table(spark, sf, "orders").select("o_orderkey", S.lenient_date(as_text).alias("d"))


@query("f_reserved", "select c_custkey, cast(c_custkey % 3 = 0 as integer) as sc, cast(c_custkey % 3 = 1 as integer) as st from customer")
def f_reserved(spark, sf):
    label = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, " ( SC )").when(F.col("c_custkey") % 3 == 1, "(st)").otherwise(""))
    return demo.table(spark, sf, "customer").select("c_custkey", S.reserved(label, "SC").alias("sc"), S.reserved(label, "ST").alias("st"))


@query("f_financial_year", f"with {WORKS_SQL} select work_id, fy, rec_fy, era from works")
def f_financial_year(spark, sf):
    return demo.works(spark, sf).select("work_id", "fy", S.financial_year("recommended_date").alias("rec_fy"), "era")


@query("f_cost", f"with {WORKS_SQL} select work_id, round(cost, 2) as cost from works")
def f_cost(spark, sf):
    return demo.works(spark, sf).select("work_id", F.round(S.cost(), 2).alias("cost"))


@query("f_year_ended", f"with {WORKS_SQL}, y as (select distinct rec_fy as fy from works) select fy, true as annual, date '1999-06-01' > make_date(cast(substr(fy, 1, 4) as integer) + 1, 3, 31) as ended from y")
def f_year_ended(spark, sf):
    return demo.flows(spark, sf).select("fy").distinct().select("fy", S.is_annual("fy").alias("annual"), S.year_ended("fy", "1999-06-01").alias("ended"))


@query("f_entity_key", f"with {WORKS_SQL} select work_id, constituency || '|' || state as k from works")
def f_entity_key(spark, sf):
    return demo.works(spark, sf).select("work_id", S.entity_key().alias("k"))


@query("f_hash_id", "select c_custkey, 'F-' || upper(substr(sha1('work|' || c_name), 1, 10)) as id from customer")
def f_hash_id(spark, sf):
    return demo.table(spark, sf, "customer").select("c_custkey", S.hash_id("F-", F.concat(F.lit("work|"), "c_name"), 10, upper=True).alias("id"))


@query("f_tokens", "select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) as n_tokens, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+'))), ' ') as numbers from documents")
def f_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(S.tokens("text")).cast("bigint").alias("n_tokens"), F.array_join(S.locators("text"), " ").alias("numbers"))


@query("f_normal_text", "select doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) as h from documents")
def f_normal_text(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(S.normal_text("text").cast("binary")).alias("h"))


@query("f_haversine", "select c_custkey, round(2 * 6371.0::double * asin(sqrt(pow(sin((radians(lat + 0.01::double) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat + 0.01::double)) * pow(sin((radians(lon + 0.02::double) - radians(lon)) / 2), 2))), 4) as km from (select c_custkey, c_acctbal / 200 as lat, c_nationkey * 3.0::double as lon from customer)")
def f_haversine(spark, sf):
    c = demo.table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 200).alias("lat"), (F.col("c_nationkey") * 3.0).alias("lon"))
    return c.select("c_custkey", F.round(S.haversine_km("lat", "lon", F.col("lat") + 0.01, F.col("lon") + 0.02), 4).alias("km"))


HALF = "('0x' || substr({h}, {at}, 8))::bigint"


@query("f_hamming", "with h as (select c_custkey, md5(c_name) as a, md5(c_mktsegment) as b from customer) select c_custkey, cast(" + " + ".join(f"bit_count(xor({HALF.format(h='a', at=at)}, {HALF.format(h='b', at=at)}))" for at in (1, 9)) + " as integer) as bits from h")
def f_hamming(spark, sf):
    return demo.table(spark, sf, "customer").select("c_custkey", S.hamming_bits(F.substring(F.md5("c_name"), 1, 16), F.substring(F.md5("c_mktsegment"), 1, 16)).alias("bits"))




@query("f_money", "select o_orderkey, case when v >= 1e7 then printf('₹%.2f crore', v / 1e7) when v >= 1e5 then printf('₹%.2f lakh', v / 1e5) else '₹' || format('{:,.0f}', v) end as t from (select o_orderkey, floor(o_totalprice) * 100 + 1 as v from orders)")
def f_money(spark, sf):
    return demo.table(spark, sf, "orders").select("o_orderkey", S.money(F.floor("o_totalprice").cast("double") * 100 + 1).alias("t"))


@query("f_local_body", f"with {PAYMENTS_SQL} select work_id, seq, true as b from payments")
def f_local_body(spark, sf):
    return demo.payments(spark, sf).select("work_id", "seq", S.is_local_body(F.concat(F.lit("Gram Panchayat "), "vendor_name")).alias("b"))


@query("f_wilson", "select c_mktsegment, round((k / n + 1.96::double * 1.96 / (2 * n) - 1.96::double * sqrt(k / n * (1 - k / n) / n + 1.96::double * 1.96 / (4 * n * n))) / (1 + 1.96::double * 1.96 / n), 6) as low from (select c_mktsegment, count(*)::double as n, (count(*) filter (c_acctbal > 0))::double as k from customer group by 1)")
def f_wilson(spark, sf):
    c = demo.table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("k"))
    return c.select("c_mktsegment", F.round(S.wilson("k", "n")[0], 6).alias("low"))


@query("f_payload_hash", f"""with {PAYMENTS_SQL}, j as (select implementing_agency as slice, md5(to_json({{work_id: work_id, seq: seq, paid_on: paid_on, amount: amount, vendor_id: vendor_id, vendor_name: vendor_name, implementing_agency: implementing_agency, status: status}})::varchar) as h from payments)
select slice, sha256(concat_ws('|', count(*)::varchar, {", ".join(f"sum({HALF.format(h='h', at=at)})::varchar" for at in (1, 9, 17, 25))})) as payload, count(*) as n from j group by slice""")
def f_payload_hash(spark, sf):
    return ingest.payloads(demo.payments(spark, sf).withColumn("slice", F.col("implementing_agency")))


@query("f_fuzzy", None)
def f_fuzzy(spark, sf):
    from ledgerlight.functions.fuzzy import ratio_udf, token_set_udf

    p = demo.table(spark, sf, "part")
    return p.select("p_partkey", F.round(ratio_udf("p_name", "p_type"), 4).alias("ratio"), F.round(token_set_udf("p_name", F.concat("p_type", F.lit(" "), "p_name")), 4).alias("token_set"))


# ---------------------------------------------------------------- joins, aggregates, windows, sets
@query("g_payment_rollup", f"with {PAID_SQL} select work_id, round(total_paid, 2) as total_paid, payment_count, last_payment_date, payment_status from rollup0")
def g_payment_rollup(spark, sf):
    return rounded(relational.payment_rollup(demo.payments(spark, sf)), "total_paid")


@query("g_primary_vendor", f"with {PAYMENTS_SQL}, s as (select work_id, vendor_id, vendor_name, round(sum(amount), 2) as t from payments group by all) select work_id, vendor_id, vendor_name, t as vendor_total from (select *, row_number() over (partition by work_id order by t desc, reverse(vendor_id) desc) as n from s) where n = 1")
def g_primary_vendor(spark, sf):
    return rounded(relational.primary_vendor(demo.payments(spark, sf)), "vendor_total")


@query("g_main_agency", f"with {PAYMENTS_SQL}, s as (select work_id, implementing_agency, count(*) as n from payments group by all) select work_id, implementing_agency from (select *, row_number() over (partition by work_id order by n desc, implementing_agency) as k from s) where k = 1")
def g_main_agency(spark, sf):
    return relational.main_agency(demo.payments(spark, sf))


@query("j_works_from_reports", f"with {PAID_SQL} select work_id, sanction_date, round(sanctioned_amount, 2) as sanctioned_amount, completion_date, round(total_paid, 2) as total_paid, payment_count from paid")
def j_works_from_reports(spark, sf):
    w = demo.works(spark, sf)
    base = w.select("work_id", "recommended_date")
    out = relational.works_from_reports(base, w.where("sanction_date is not null").select("work_id", "sanction_date", "sanctioned_amount"), w.where("completion_date is not null").select("work_id", "completion_date"), demo.payments(spark, sf))
    return rounded(out.select("work_id", "sanction_date", "sanctioned_amount", "completion_date", "total_paid", "payment_count"), "sanctioned_amount", "total_paid")


@query("j_tiles", """with r as (select o_custkey as portal_id, o_orderpriority as work_code, o_totalprice as amount from orders), s as (select * from r where amount > 100000), c as (select * from r where amount > 400000), p as (select c_custkey as portal_id, 'none' as work_code, c_acctbal as amount from customer), u as (select *, 'r' as t from r union all select *, 's' from s union all select *, 'c' from c union all select *, 'p' from p)
select portal_id, work_code, cast(count(*) filter (t = 'r') as integer) as in_recommended, cast(count(*) filter (t = 's') as integer) as in_sanctioned, cast(count(*) filter (t = 'c') as integer) as in_completed, cast(count(*) filter (t = 'p') as integer) as in_paid, max(amount) filter (t = 's') as sanctioned_amount, max(amount) filter (t = 'r') as estimated_cost, round(sum(amount) filter (t = 'p'), 2) as total_paid from u group by all""")
def j_tiles(spark, sf):
    r = demo.table(spark, sf, "orders").select(F.col("o_custkey").alias("portal_id"), F.col("o_orderpriority").alias("work_code"), F.col("o_totalprice").alias("amount"))
    p = demo.table(spark, sf, "customer").select(F.col("c_custkey").alias("portal_id"), F.lit("none").alias("work_code"), F.col("c_acctbal").alias("amount"))
    return rounded(relational.joined_tiles(r, r.where("amount > 100000"), r.where("amount > 400000"), p), "total_paid")


@query("g_fund_positions", f"with {WORKS_SQL}, a as (select state, constituency, mp_name, fy, coalesce(sum(sanctioned_amount), 0) as sanctioned, coalesce(sum(expenditure), 0) as expenditure, count(*) as works_count from works group by all), y as (select mp_name, count(distinct fy) as years from a group by 1) select a.state, a.constituency, a.mp_name, a.fy, round(a.sanctioned, 2) as sanctioned, round(a.expenditure, 2) as expenditure, a.works_count, years, c_acctbal / greatest(years, 1) as released from a join y using (mp_name) left join customer on upper(c_name) = upper(a.mp_name)")
def g_fund_positions(spark, sf):
    alloc = demo.table(spark, sf, "customer").select(F.col("c_name").alias("mp_name"), F.col("c_acctbal").alias("allocated"))
    return rounded(relational.fund_positions(demo.works(spark, sf), alloc).select("state", "constituency", "mp_name", "fy", "sanctioned", "expenditure", "works_count", "years", "released"), "sanctioned", "expenditure")


@query("w_numbered", f"with {PAYMENTS_SQL} select work_id, paid_on, amount, cast(row_number() over (partition by work_id order by paid_on, amount, vendor_id, vendor_name, status) as integer) as seq from payments")
def w_numbered(spark, sf):
    return relational.numbered(demo.payments(spark, sf)).select("work_id", "paid_on", "amount", "seq")


@query("t_duplicate_listings", "with n as (select user_id, event_type, count(*) as times from events group by all), k as (select *, row_number() over (partition by user_id order by event_type) as k from n) select cast(user_id as varchar) || case when k > 1 then '#' || cast(k as varchar) else '' end as listing_id, event_type, times from k")
def t_duplicate_listings(spark, sf):
    return relational.duplicate_listings(demo.table(spark, sf, "events").withColumn("user_id", F.col("user_id").cast("string")), ["user_id"], ["event_type"]).select("listing_id", "event_type", "times")


@query("j_missing", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def j_missing(spark, sf):
    return relational.missing(demo.table(spark, sf, "orders").select("o_orderkey"), demo.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("j_known_payments", f"with {WORKS_SQL}, {PAYMENTS_SQL} select work_id, count(*) as n from payments where work_id in (select work_id from works where status = 'Completed') group by 1")
def j_known_payments(spark, sf):
    done = demo.works(spark, sf).where("status = 'Completed'").select("work_id")
    return demo.payments(spark, sf).join(done, "work_id", "left_semi").groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))


@query("x_changed_rows", "with a as (select o_custkey, o_orderpriority from orders where o_orderkey % 2 = 0), b as (select o_custkey, o_orderpriority from orders where o_orderkey % 2 = 1) select o_custkey, o_orderpriority, 'old' as side from (select * from a except all select * from b) union all select o_custkey, o_orderpriority, 'new' from (select * from b except all select * from a)")
def x_changed_rows(spark, sf):
    o = demo.table(spark, sf, "orders")
    side = lambda r: o.where(F.col("o_orderkey") % 2 == r).select("o_custkey", "o_orderpriority")
    return relational.changed_rows(side(0), side(1))


@query("s_backfilled", "select n.o_orderkey, coalesce(o.p, n.o_totalprice) as o_totalprice from orders n left join (select o_orderkey, case when o_orderkey % 2 = 0 then o_totalprice + 1 end as p from orders) o using (o_orderkey)")
def s_backfilled(spark, sf):
    o = demo.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    old = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") + 1))
    return relational.backfilled(o, old, "o_orderkey", ["o_totalprice"])


@query("s_payments_that_add_up", f"with {PAID_SQL}, ok as (select work_id from rollup0 where cast(work_id as bigint) % 3 <> 0) select work_id, seq from payments where work_id in (select work_id from ok)")
def s_payments_that_add_up(spark, sf):
    p = demo.payments(spark, sf)
    w = relational.payment_rollup(p).withColumn("total_paid", F.col("total_paid") + F.when(F.col("work_id").cast("bigint") % 3 == 0, 10).otherwise(0))
    return relational.payments_that_add_up(p, w).select("work_id", "seq")


@query("x_stratified_sample", f"""with {WORKS_SQL}, t as (select work_id, state, row_number() over (partition by state order by cost desc, work_id) <= 10 as is_top from works),
r as (select *, row_number() over (partition by state, is_top order by md5('7|' || work_id), work_id) as r from t) select work_id, state, is_top from r where is_top or r <= 10""")
def x_stratified_sample(spark, sf):
    return relational.stratified_sample(demo.works(spark, sf).withColumn("cost", S.cost()), "state", "cost", "work_id", 20).select("work_id", "state", "is_top")


@query("g_tile_rollup", "select house, category, sum(n)::bigint as n, round(sum(total), 2) as total, cast(grouping(house, category) as bigint) as level from (select case when o_custkey % 3 = 0 then 'RS' else 'LS' end as house, o_orderpriority as category, 1 as n, o_totalprice as total from orders) group by rollup (house, category)")
def g_tile_rollup(spark, sf):
    o = demo.table(spark, sf, "orders").select(F.when(F.col("o_custkey") % 3 == 0, "RS").otherwise("LS").alias("house"), F.col("o_orderpriority").alias("category"), F.lit(1).alias("n"), F.col("o_totalprice").alias("total"))
    return rounded(relational.tile_rollup(o, "house", "category"), "total")


@query("t_additivity", "with p as (select o_orderpriority as k, count(*) + cast(min(o_orderkey) % 2 as bigint) as n, sum(o_totalprice) as total from orders group by 1), c as (select o_orderpriority as k, count(*) as n, sum(o_totalprice) as t from orders group by 1) select p.k, p.n, c.n as child_n from p join c using (k) where p.n <> c.n or abs(p.total - c.t) > 1")
def t_additivity(spark, sf):
    o = demo.table(spark, sf, "orders").withColumn("k", F.col("o_orderpriority"))
    kids = o.groupBy("k", "o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    parents = o.groupBy("k").agg((F.count(F.lit(1)) + F.min("o_orderkey") % 2).alias("n"), F.sum("o_totalprice").alias("total"))
    return relational.additivity(parents, kids, "k").select("k", "n", "child_n")


@query("g_growth_fit", "select round(regr_slope(ln(y), ln(x)), 6) as exponent, round(regr_slope(y, x), 4) as slope from (select o_totalprice as y, o_orderkey + 1 as x from orders)")
def g_growth_fit(spark, sf):
    p = demo.table(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("rows"), F.col("o_totalprice").alias("seconds"))
    return relational.growth_fit(p).select(F.round("exponent", 6).alias("exponent"), F.round("slope", 4).alias("slope"))


# ---------------------------------------------------------------- cases and read queries
_NOISY = {0: "description || ' as per  attached list'", 1: "'Under MPLADS funds ' || description", 2: "'balance work'", 3: "description || ' - Work Order No. 7/2 - ' || description", 4: "'  ,'"}
_CASES = " ".join(f"when {k} then {v}" for k, v in _NOISY.items())


def all_findings(spark, sf):
    w, p = demo.works(spark, sf), marked_payments(spark, sf)
    return together(compliance.completion_norm(w, TODAY), compliance.cost_limits(w), compliance.sanction_waits(w, TODAY), payments.before_sanction(p), payments.long_after(p))


def _title(text: str, category: str) -> str:
    """The short title in SQL."""
    tidy = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'), ' .,-–—')"
    t = tidy(f"regexp_replace({tidy(text)}, '(?i)\\b({'|'.join(config.NOISE)})\\b', '', 'g')")
    t = f"(case when length({t}) < 8 then trim(regexp_replace(coalesce({category}, ''), '\\s+', ' ', 'g')) else {t} end)"
    cut = f"rtrim(regexp_replace(substr({t}, 1, 62), ' [^ ]*$', ''), ' .,-–—')"
    return f"(case when {t} = '' then 'Untitled work' when length({t}) > 62 then upper(substr({cut}, 1, 1)) || substr({cut}, 2) || '…' else upper(substr({t}, 1, 1)) || substr({t}, 2) end)"


FINDINGS_SQL = PM_SQL + f""", f as (select work_id as e, 'R-TIME-01' as r, case when coalesce(completion_date, date '{TODAY}') - sanction_date > 548 then 'high' else 'medium' end as s, true as alone, cast(coalesce(completion_date, date '{TODAY}') - sanction_date as varchar) || ' days since sanction' as m from works where coalesce(completion_date, date '{TODAY}') - sanction_date > 365
 union all select work_id, 'R-COST-01', 'low', cost > 25000000, case when cost < 250000 then 'below' else 'above' end || ' the limit' from works where sanction_date is not null and cost > 0 and (cost < 250000 or cost > 25000000)
 union all select work_id, 'R-SANC-01', 'low', false, 'Waiting for ' || cast(date '{TODAY}' - recommended_date as varchar) || ' days' from works where sanction_date is null and date '{TODAY}' - recommended_date > 45
 union all select work_id, 'P-SEQ-01', 'high', true, cast(count(*) as varchar) || ' payments before sanction' from pm where paid_on < sanction_date group by work_id
 union all select work_id, 'P-LATE-01', 'low', true, cast(count(*) as varchar) || ' payments, up to ' || cast(max(paid_on - completion_date) as varchar) || ' days after completion' from pm where paid_on - completion_date > 180 group by work_id),
pts as (select *, case when not alone then 0 else case s when 'critical' then 40 when 'high' then 25 when 'medium' then 12 else 5 end end as w from f),
ca as (select e as entity_id, cast(least(100, sum(w)) as integer) as score, count(*) as n_findings, list_sort(list_distinct(list(r))) as rules, max_by(m, (alone, w, r, m)) as primary_signal from pts group by e having bool_or(alone)),
cas as (select ca.*, score >= 40 as alert, case when score >= 70 then 'High' when score >= 40 then 'Medium' else 'Low' end as band, state, district, constituency, mp_name, ia_name, primary_signal, {_title("description", "category")} as display_title, 'Work ' || entity_id || ' — ' || substr(description, 1, 70) as entity_label from ca join works on work_id = entity_id)"""


_stored: dict[tuple, DataFrame] = {}
_postings: dict[tuple, DataFrame] = {}


def new_folder(spark, what: str) -> str:
    """A folder for a table that goes with the application."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored_cases(spark, sf):
    """Builds the case table that the read queries go to."""
    out = cases.store(cases.seen(cases.with_entities(cases.cases(all_findings(spark, sf)), demo.works(spark, sf)), TODAY), new_folder(spark, "cases"))
    _stored[_corpus_key(spark, sf)] = out
    _postings.pop(_corpus_key(spark, sf), None)
    return out


def all_postings(spark, sf):
    """What searches in the stored cases read first, built once for them."""
    key = _corpus_key(spark, sf)
    if key not in _postings:
        _postings[key] = cases.store_postings(all_cases(spark, sf), new_folder(spark, "postings"))
    return _postings[key]


def _corpus_key(spark, sf) -> tuple:
    """An application and the files of the corpus as they are now: a table that is written again is another one."""
    fs = spark._jvm.org.apache.hadoop.fs
    found = []
    for t in ("orders", "customer", "nation", "region", "lineitem"):
        top = fs.Path(f"{sf}/{t}.parquet")
        files = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return spark.sparkContext.applicationId, tuple(sorted(found))


def all_cases(spark, sf):
    """The stored case table, built once for an application and corpus."""
    return _stored.get(_corpus_key(spark, sf)) or stored_cases(spark, sf)


@query("store_cases", f"{FINDINGS_SQL} select entity_id, score, state, district, mp_name from cas")
def store_cases(spark, sf):
    return stored_cases(spark, sf).select("entity_id", "score", "state", "district", "mp_name")


@query("e_cases", f"{FINDINGS_SQL} select entity_id, score, n_findings, array_to_string(rules, ',') as rules, alert, band from cas")
def e_cases(spark, sf):
    return cases.cases(all_findings(spark, sf)).select("entity_id", "score", "n_findings", F.array_join("rules", ",").alias("rules"), "alert", "band")


@query("e_contributions", f"{FINDINGS_SQL}, c as (select e, r, sum(w) as points, count(*) as times from pts group by all) select e as entity_id, r as rule_id, cast(points as bigint) as points, times, round(100 * points / sum(points) over (partition by e), 1) as share from c")
def e_contributions(spark, sf):
    return cases.contributions(all_findings(spark, sf), context=True).select("entity_id", "rule_id", "points", "times", "share")


@query("e_rule_coverage", f"{FINDINGS_SQL}, rl as (select unnest(['R-TIME-01', 'R-COST-01', 'R-SANC-01', 'P-SEQ-01', 'P-LATE-01', 'V-FREQ-01']) as rule_id) select rule_id, count(e) as findings, count(distinct e) as entities, case when rule_id = 'V-FREQ-01' then 'short history' end as reason, case when rule_id = 'V-FREQ-01' then 'stood down' when count(e) = 0 then 'no match' else 'ran' end as state from rl left join f on r = rule_id group by rule_id")
def e_rule_coverage(spark, sf):
    rules = spark.createDataFrame([(r,) for r in ("R-TIME-01", "R-COST-01", "R-SANC-01", "P-SEQ-01", "P-LATE-01", "V-FREQ-01")], "rule_id string")
    return cases.rule_coverage(all_findings(spark, sf), rules, spark.createDataFrame([("V-FREQ-01", "short history")], "rule_id string, reason string"))


@query("e_neighbours", f"{FINDINGS_SQL} select entity_id, count(*) over (partition by ia_name) as authority_cases, count(*) over (partition by state) as state_cases from cas")
def e_neighbours(spark, sf):
    return cases.neighbours(all_cases(spark, sf)).select("entity_id", "authority_cases", "state_cases")


@query("e_contract_facts", f"""with {WORKS_SQL}, {PAYMENTS_SQL} select unnest(['works', 'work_ids', 'sanctioned', 'completed', 'second_records', 'completed_before_sanction', 'completed_unsanctioned', 'payments', 'paid_works', 'payments_of_unknown_works']) as fact,
unnest([(select count(*) from works), (select count(distinct work_id) from works), (select count(sanction_date) from works), (select count(completion_date) from works), 0, (select count(*) from works where completion_date < sanction_date), 0, (select count(*) from payments), (select count(distinct work_id) from payments), 0]) as value""")
def e_contract_facts(spark, sf):
    return cases.contract_facts(demo.works(spark, sf), demo.payments(spark, sf))


@query("q_cases_page", f"{FINDINGS_SQL} select entity_id, score, band from cas where state in ('ASIA', 'EUROPE') and score >= 20 and list_contains(rules, 'R-TIME-01') order by score desc, entity_id limit 50 offset 10")
def q_cases_page(spark, sf):
    """One page of a case list: the limit is the feature."""
    found = cases.filtered(all_cases(spark, sf), states=("ASIA", "EUROPE"), rules=("R-TIME-01",), min_score=20)
    return cases.page(found, limit=50, offset=10).select("entity_id", "score", "band")


@query("q_search", f"{FINDINGS_SQL} select entity_id, display_title, entity_label, primary_signal, score from cas where entity_id ilike '%01%' or display_title ilike '%01%' or entity_label ilike '%01%' or primary_signal ilike '%01%'")
def q_search(spark, sf):
    return cases.filtered(all_cases(spark, sf), search="01").select("entity_id", "display_title", "entity_label", "primary_signal", "score")


@query("q_search_postings", f"{FINDINGS_SQL} select entity_id, display_title, score from cas where entity_id ilike '%LIBRARY in ward 1%' or display_title ilike '%LIBRARY in ward 1%' or entity_label ilike '%LIBRARY in ward 1%' or primary_signal ilike '%LIBRARY in ward 1%'")
def q_search_postings(spark, sf):
    """A search that reads postings and then the cases they name."""
    return cases.searched(all_cases(spark, sf), all_postings(spark, sf), "LIBRARY in ward 1").select("entity_id", "display_title", "score")


@query("q_cases_by_state", f"{FINDINGS_SQL} select entity_id, state, score from cas where constituency in ('C7', 'C8', 'C9') order by state, score desc, entity_id limit 200")
def q_cases_by_state(spark, sf):
    """One page of another order: the limit is the feature."""
    found = cases.filtered(all_cases(spark, sf), constituencies=("C7", "C8", "C9"), entity_types=("work",), statuses=("open",))
    return cases.page(found, "state", limit=200).select("entity_id", "state", "score")


@query("f_short_title", f"with {WORKS_SQL}, t as (select *, case k % 7 {_CASES} else description end as d from works) select work_id, {_title('d', 'category')} as title from t")
def f_short_title(spark, sf):
    text = F.expr(f"case cast(work_id as bigint) % 7 {_CASES} else description end")
    return demo.works(spark, sf).withColumn("d", text).select("work_id", S.short_title("d", "category").alias("title"))


@query("q_stats", f"{FINDINGS_SQL} select count(*) as cases, count(*) filter (alert) as alerts, count(*) filter (band = 'High') as high, count(*) filter (band = 'Medium') as medium, count(*) filter (band = 'Low') as low, round(avg(score), 1) as mean_score from cas")
def q_stats(spark, sf):
    return cases.stats(all_cases(spark, sf))


@query("q_by_state", f"{FINDINGS_SQL} select state, district, count(*) as cases, count(*) filter (band = 'High') as high, count(*) filter (alert) as alerts, round(avg(score), 1) as mean_score from cas group by all")
def q_by_state(spark, sf):
    return cases.by_place(all_cases(spark, sf), "state", "district")


@query("q_rule_histogram", f"{FINDINGS_SQL}, u as (select state, unnest(rules) as rule_id from cas) select state, rule_id, count(*) as cases from u group by all")
def q_rule_histogram(spark, sf):
    return cases.rule_histogram(all_cases(spark, sf), "state")


@query("q_facets", f"{FINDINGS_SQL} select 'state' as facet, state as value, count(*) as n from cas group by all union all select 'band', band, count(*) from cas group by all")
def q_facets(spark, sf):
    return cases.facets(all_cases(spark, sf), "state", "band")


@query("q_agency_works", f"with {WORKS_SQL} select work_id, vendor_id from works where vendor_id = 'V7' or vendor_name = 'Vendor 9'")
def q_agency_works(spark, sf):
    return reads.agency_works(demo.works(spark, sf), "V7", "Vendor 9").select("work_id", "vendor_id")


@query("q_district", f"{FINDINGS_SQL} select entity_id, score from cas where lower(district) = 'nation_2' and lower(state) = 'asia'")
def q_district(spark, sf):
    return reads.tier(all_cases(spark, sf), "district", "Nation_2", "asia").select("entity_id", "score")


@query("q_ministry_page", f"{FINDINGS_SQL} select entity_id, score from cas where score >= 20 order by score desc, entity_id limit 200")
def q_ministry_page(spark, sf):
    """The first 200 cases: the limit is the page's."""
    return reads.ministry(all_cases(spark, sf), 20)[0].select("entity_id", "score")


@query("q_ministry_states", f"{FINDINGS_SQL} select state, count(*) as cases from cas where score >= 20 group by state")
def q_ministry_states(spark, sf):
    return reads.ministry(all_cases(spark, sf), 20)[1]


@query("q_payment_summary", f"""{PM_SQL} select work_id, count(*) as count, round(sum(amount), 2) as total, count(distinct vendor_id) as vendors, count(*) filter (status = 'F') as in_progress, min(paid_on) as first_paid_on, max(paid_on) as last_paid_on, count(case when paid_on - completion_date > 0 then 1 end) as after_completion, count(*) filter (repeats > 1) as repeated,
(select round(max(sanctioned_amount), 2) from works w where w.work_id = pm.work_id) as sanctioned_amount, round(sum(amount) / (select max(sanctioned_amount) from works w where w.work_id = pm.work_id), 2) as share from pm group by work_id""")
def q_payment_summary(spark, sf):
    p = demo.payments(spark, sf).withColumn("status", F.when(F.col("status") == "F", "Payment In-Progress").otherwise(F.col("status")))
    out = reads.payment_summary(payments.marked(p, demo.works(spark, sf)), demo.works(spark, sf))
    return rounded(out.withColumn("share", F.col("total") / F.col("sanctioned_amount")).drop("share_of_sanctioned"), "total", "sanctioned_amount", "share")


@query("e_last_review", f"{FINDINGS_SQL}, fb as (select cast(o_orderkey as varchar) as e, max_by(o_orderstatus, l_linenumber::bigint * 1000000000 + l_partkey) as d from orders join lineitem on l_orderkey = o_orderkey group by 1) select entity_id, coalesce(d, 'open') as review_status from cas left join fb on e = entity_id")
def e_last_review(spark, sf):
    c = cases.cases(all_findings(spark, sf))
    o, li = demo.table(spark, sf, "orders"), demo.table(spark, sf, "lineitem")
    fb = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.lit("work").alias("entity_type"), F.col("o_orderkey").cast("string").alias("entity_id"), F.col("o_orderstatus").alias("decision"), (F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey")).alias("id"))
    return cases.last_review(c, fb, c.select("entity_type", "entity_id", F.lit("2024-01-01").alias("first_seen"))).select("entity_id", "review_status")


@query("e_precision", """with v as (select o_orderpriority as rule_id, count(*)::double as n, (count(*) filter (o_orderstatus = 'F'))::double as k from orders group by 1), w as (select *, 1.96::double as z, k / n as p from v)
select rule_id, n::bigint as n, k::bigint as confirmed, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 4) as low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 4) as high from w""")
def e_precision(spark, sf):
    v = demo.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("rule_id"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("refuted").alias("verdict"))
    return cases.precision(v)


@query("e_planted_recall", f"{FINDINGS_SQL} select 'late' as pattern, 'R-TIME-01' as rule_id, count(*) as planted, count(f.e) as found, round(count(f.e) / count(*), 4) as recall from works left join (select e from f where r = 'R-TIME-01') f on f.e = work_id where sanction_date is not null")
def e_planted_recall(spark, sf):
    w = demo.works(spark, sf).where("sanction_date is not null").select(F.lit("late").alias("pattern"), F.lit("R-TIME-01").alias("rule_id"), F.col("work_id").alias("entity_id"))
    return cases.planted_recall(w, all_findings(spark, sf))


# ---------------------------------------------------------------- ingestion and streams
@query("t_upsert", "with b as (select o_orderkey as work_id, o_orderpriority as category, case when o_orderkey % 4 = 0 then o_totalprice + 1 else o_totalprice end as v0 from orders where o_orderkey % 2 = 0) select work_id, 'sanctioned_amount' as field from b where work_id % 4 = 0")
def t_upsert(spark, sf):
    o = demo.table(spark, sf, "orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("sanctioned_amount"))
    batch = o.where("work_id % 2 = 0").withColumn("sanctioned_amount", F.col("sanctioned_amount") + F.when(F.col("work_id") % 4 == 0, 1).otherwise(0))
    return sinks.upserted(o, batch, "work_id", "2024-01-01")[1].select("work_id", "field")


@query("t_upsert_table", "select o_orderkey as work_id, round(case when o_orderkey % 4 = 0 then o_totalprice + 1 else o_totalprice end, 2) as sanctioned_amount from orders")
def t_upsert_table(spark, sf):
    """The table after an upsert, read through its newest version."""
    o = demo.table(spark, sf, "orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_totalprice").alias("sanctioned_amount"))
    batch = o.where("work_id % 2 = 0").withColumn("sanctioned_amount", F.col("sanctioned_amount") + F.when(F.col("work_id") % 4 == 0, 1).otherwise(0))
    return rounded(upserted_table(spark, o, batch).read(), "sanctioned_amount")


def upserted_table(spark, rows, *batches):
    """A table in buckets that goes with the application."""
    t = BucketTable(spark, new_folder(spark, "table"))
    t.create(rows, "work_id", 16)
    for b in batches:
        t.upsert(b, "2024-01-01")
    return t


@query("t_upsert_edits", "select o_orderkey as work_id, 'sanctioned_amount' as field, 2::bigint as times from orders where o_orderkey % 12 = 0 union all select o_orderkey, 'sanctioned_amount', 1 from orders where (o_orderkey % 4 = 0) <> (o_orderkey % 3 = 0)")
def t_upsert_edits(spark, sf):
    """Edits of two upserts that follow each other; a row that comes as it is leaves none."""
    o = demo.table(spark, sf, "orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_totalprice").alias("sanctioned_amount"))
    more = lambda every, by: o.withColumn("sanctioned_amount", F.col("sanctioned_amount") + F.when(F.col("work_id") % every == 0, by).otherwise(0))
    first = more(4, 1)
    second = first.where("work_id % 3 = 0").withColumn("sanctioned_amount", F.col("sanctioned_amount") + 5)
    return upserted_table(spark, o, first.where("work_id % 2 = 0"), second).edits().groupBy("work_id", "field").agg(F.count(F.lit(1)).alias("times"))


@query("t_changed_slices", "select o_orderpriority as slice, count(*) as n from orders group by 1 having min(o_orderkey) % 2 = 1")
def t_changed_slices(spark, sf):
    p = demo.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.min("o_orderkey").alias("k"))
    last = ingest.signatures(p.withColumn("n", F.col("n") + F.col("k") % 2))
    return ingest.changed_slices(p, last).select("slice", "n")


@query("t_changed_below", "with c as (select n_name as slice, r_name as parent, n_nationkey from nation join region on n_regionkey = r_regionkey) select slice from c where n_nationkey % 2 = 1 and parent in (select r_name from region where r_regionkey % 2 = 1)")
def t_changed_below(spark, sf):
    """Regions with odd numbers moved, and nations with odd numbers; only those below are found."""
    n, r = demo.table(spark, sf, "nation"), demo.table(spark, sf, "region")
    top = r.select(F.col("r_name").alias("slice"), F.col("r_regionkey").alias("k"), F.lit(1).alias("n"), F.lit(1.0).alias("total"))
    low = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("slice"), F.col("r_name").alias("parent"), F.col("n_nationkey").alias("k"), F.lit(1).alias("n"), F.lit(1.0).alias("total"))
    last = [ingest.signatures(x.withColumn("n", F.col("n") + F.col("k") % 2)) for x in (top, low)]
    return ingest.changed_below([top, low], last).select("slice")


@query("t_touched", f"with {WORKS_SQL}, ch as (select * from works where k % 1000 = 1) select work_id from works where (state, district, category) in (select (state, district, category) from ch)")
def t_touched(spark, sf):
    w = demo.works(spark, sf)
    return ingest.touched(w, w.where("cast(work_id as bigint) % 1000 = 1"), ("state", "district", "category")).select("work_id")


@query("t_queued", "select n_name as slice, n_nationkey % 4 >= 3 as escalated, (5 * pow(2, n_nationkey % 4 - 1))::bigint as minutes from nation where n_nationkey % 4 > 0")
def t_queued(spark, sf):
    state = demo.table(spark, sf, "nation").select(F.col("n_name").alias("slice"), (F.col("n_nationkey") % 4).alias("failures"))
    q = ingest.queued(state, "2024-01-01 00:00:00")
    return q.select("slice", "escalated", ((F.col("due_at").cast("bigint") - F.lit("2024-01-01 00:00:00").cast("timestamp").cast("bigint")) / 60).cast("bigint").alias("minutes"))


@query("s_fund_flows", "select c_name as constituency, round(c_acctbal * 10000000, 2) as released, round(c_acctbal * 10000000, 2) - round(c_custkey * 10000000, 2) as expenditure, 'LS' as house from customer")
def s_fund_flows(spark, sf):
    raw = demo.table(spark, sf, "customer").select(F.col("c_name").alias("Seat"), F.col("c_acctbal").alias("Rel"), F.col("c_custkey").alias("Left"))
    out = readers.fund_flows(raw, {"constituency": "Seat", "released": "Rel", "unspent": "Left"}, source="old", house="LS", fy="2015-16", unit="crore")
    return out.select("constituency", "released", "expenditure", "house")


@query("s_switched", "select 'live:' || cast(o_orderkey as varchar) as work_id, null as era from orders where o_orderkey % 2 = 0 union all select cast(o_orderkey as varchar), 'historical' from orders where o_orderkey % 6 = 3")
def s_switched(spark, sf):
    o = demo.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("work_id"), "o_totalprice", F.col("o_orderkey").alias("k"))
    return sinks.switched(o.where("k % 3 = 0"), o.where("k % 2 = 0")).select("work_id", "era")


@query("s_carried_edits", """with w as (select 'ES-' || o_orderkey as work_id, case when o_custkey % 3 = 0 then 'RS' else 'LS' end as house, o_orderkey as k from orders),
v as (select 'ES-' || l_orderkey as work_id, l_shipdate as seen_at, case when l_linenumber = 1 then 'house' else 'category' end as field, l_returnflag as new_value, case when l_linenumber % 2 = 0 then '2:x' end as shard, l_orderkey as k from lineitem),
clean as (select * from v where (work_id, seen_at) not in (select (work_id, seen_at) from v where field = 'house')), r as (select distinct 'ES-' || case when shard = '2:x' then 'LS' else house end || '-' || v.k as work_id, seen_at, field, new_value, shard from clean v join w using (work_id))
select work_id, field, count(*) as n from r where work_id in (select 'ES-' || house || '-' || k from w where k % 5 <> 0) group by all""")
def s_carried_edits(spark, sf):
    """The edit log under the ids of a new corpus, without occasions on which one work was written over another."""
    o, li = demo.table(spark, sf, "orders"), demo.table(spark, sf, "lineitem")
    house = F.when(F.col("o_custkey") % 3 == 0, "RS").otherwise("LS")
    old = o.select(F.concat(F.lit("ES-"), "o_orderkey").alias("work_id"), house.alias("house"))
    v = li.select(F.concat(F.lit("ES-"), "l_orderkey").alias("work_id"), F.col("l_shipdate").alias("observed_at"), F.when(F.col("l_linenumber") == 1, "house").otherwise("category").alias("field"), F.col("l_returnflag").alias("new_value"), F.when(F.col("l_linenumber") % 2 == 0, "2:x").alias("shard_id"))
    new = o.where("o_orderkey % 5 <> 0").select(F.concat(F.lit("ES-"), house, F.lit("-"), "o_orderkey").alias("work_id"))
    return switch.carried({"works": old, "versions": v}, new)["versions"].groupBy("work_id", "field").agg(F.count(F.lit(1)).alias("n"))


@query("e_plan_errors", "select o_custkey as case_id, o_orderpriority as action, case when o_orderpriority = '5-LOW' then 'not allowed' else 'twice' end as error from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as n from orders) where o_orderpriority = '5-LOW' or n > 1")
def e_plan_errors(spark, sf):
    plan = demo.table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("step"), F.col("o_orderpriority").alias("action"))
    return cases.plan_errors(plan, plan.where("action <> '5-LOW'").select("case_id", "action"), most=10**6)


@query("e_health", "select 'checks_failing' as condition, 'warning' as severity, count(*) as areas from nation where n_nationkey % 5 >= 3 union all select 'parity_differs', 'warning', count(*) from nation where n_nationkey % 2 = 0 union all select 'checks_stalled', 'warning', count(*) from nation where n_nationkey % 7 = 0")
def e_health(spark, sf):
    k = F.col("n_nationkey")
    at = F.lit("2024-01-01 23:00:00").cast("timestamp")
    areas = demo.table(spark, sf, "nation").select(F.col("n_name").alias("shard_id"), F.when(k % 7 != 0, at).alias("fetched_at"), at.alias("swept_at"), (k % 5).alias("consecutive_failures"), (k % 2).alias("exact"), F.lit("live").alias("lifecycle"))
    return reads.conditions(areas, "2024-01-02 00:00:00").select("condition", "severity", "areas")


@query("t_gates", "select n_name as slice, case when n_nationkey % 5 = 0 then 'contract' when n_nationkey % 5 = 1 then 'emptied' when n_nationkey % 5 = 2 then 'collapsed' when n_nationkey % 5 = 3 then 'count' else 'ok' end as verdict from nation")
def t_gates(spark, sf):
    k = F.col("n_nationkey") % 5
    n = demo.table(spark, sf, "nation").select(F.col("n_name").alias("slice"), F.when(k == 1, 0).when(k == 2, 5).otherwise(100).alias("rows"), F.when(k == 3, 90).when(k == 1, 0).when(k == 2, 5).otherwise(101).alias("stated"), F.when(k == 0, 2).otherwise(0).alias("missing_fields"))
    return ingest.gated(n, n.select("slice", F.lit(100).alias("rows"))).select("slice", "verdict")


@query("t_lifecycle", "select n_name as slice, case when n_nationkey % 2 = 0 then 0 else n_nationkey % 4 + 1 end as failures, case when n_nationkey % 2 = 0 then 'live' when n_nationkey % 4 + 1 >= 3 then 'quarantined' else 'retry' end as lifecycle from nation")
def t_lifecycle(spark, sf):
    n = demo.table(spark, sf, "nation").withColumn("slice", F.col("n_name"))
    return ingest.lifecycle(n.select("slice", (F.col("n_nationkey") % 4).alias("failures")), n.select("slice", F.when(F.col("n_nationkey") % 2 == 0, "ok").otherwise("count").alias("verdict")))


@query("t_removals", "select o_orderkey as work_id, case when o_orderkey % 4 = 1 then 'retired' else 'missing' end as state from orders where o_orderkey % 2 = 1 union all select o_orderkey, 'restored' from orders where o_orderkey % 6 = 0")
def t_removals(spark, sf):
    o = demo.table(spark, sf, "orders").select(F.col("o_orderkey").alias("work_id"))
    waiting = o.where("work_id % 6 = 0 or work_id % 4 = 1").withColumn("first_missing_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return ingest.removals(o.where("work_id % 2 = 0"), o, waiting, "2024-01-01 00:20:00").select("work_id", "state")


@query("t_parity", f"with {PAYMENTS_SQL} select implementing_agency as k, count(*) + (substr(implementing_agency, 8) = '3')::int as n, count(*) as our_n, substr(implementing_agency, 8) <> '3' and substr(implementing_agency, 8) <> '5' as exact from payments group by 1")
def t_parity(spark, sf):
    p = demo.payments(spark, sf).withColumn("k", F.col("implementing_agency"))
    portal = p.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    portal = portal.withColumns({"n": F.col("n") + (F.col("k") == "Agency 3").cast("int"), "total": F.col("total") + F.when(F.col("k") == "Agency 5", 7).otherwise(0)})
    return ingest.parity(p, portal, "k").select("k", "n", "our_n", "exact")


@query("t_tumbling", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def t_tumbling(spark, sf):
    return rounded(ingest.windowed(demo.table(spark, sf, "events"), "1 hour", None, "10 minutes", "event_type").select("start", "event_type", "n", "total"), "total")


@query("t_sliding", "with w as (select value, unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) as start from events) select start, count(*) as n, round(sum(value), 2) as total from w group by 1")
def t_sliding(spark, sf):
    return rounded(ingest.windowed(demo.table(spark, sf, "events"), "1 hour", "30 minutes").select("start", "n", "total"), "total")


@query("t_sessions", "with l as (select *, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from l) select user_id, min(ts) as start, count(*) as n, round(sum(value), 2) as total from s group by user_id, s")
def t_sessions(spark, sf):
    return rounded(ingest.sessions(demo.table(spark, sf, "events"), "6 hours").select("user_id", "start", "n", "total"), "total")


@query("s_mapped_source", "select 'S-' || cast(c_custkey as varchar) as work_id, upper(c_name) as mp_name, round(c_acctbal * 100, 2) as sanctioned_amount, 'demo' as source from customer")
def s_mapped_source(spark, sf):
    m = readers.mapped(demo.table(spark, sf, "customer"), {"work_id": "c_custkey", "mp_name": "c_name", "sanctioned_amount": "c_acctbal"}, source="demo", id_prefix="S-", amount_scale=100.0, amounts=["sanctioned_amount"], upper=["mp_name"])
    return rounded(m, "sanctioned_amount")


@query("s_united", "select 'a' as source, cast(c_custkey as varchar) as work_id from customer union all select 'b', cast(s_suppkey as varchar) from supplier")
def s_united(spark, sf):
    a = demo.table(spark, sf, "customer").select(F.col("c_custkey").alias("work_id"), F.lit("a").alias("source"))
    b = demo.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("work_id"), F.lit("b").alias("source"), F.col("s_name").alias("other"))
    return readers.united(a, b).select("source", "work_id")


@query("s_text_fields", "select doc_id, nullif(trim(regexp_extract(text, '(\\+?[0-9]+ \\([0-9]{3}\\) [0-9]{3}-[0-9]{4})', 1)), '') as phone, length(text) < 40 as needs_ocr from documents")
def s_text_fields(spark, sf):
    return readers.fields_of_text(docs(spark, sf), "text", {"phone": r"(\+?[0-9]+ \([0-9]{3}\) [0-9]{3}-[0-9]{4})"}).select("doc_id", "phone", "needs_ocr")


@query("s_freshness", "select r_name as k, (select count(*) from nation where n_regionkey = r_regionkey) as here, 10 as n, round(100 * (select count(*) from nation where n_regionkey = r_regionkey) / 10, 1) as pct from region")
def s_freshness(spark, sf):
    n = demo.table(spark, sf, "nation").join(demo.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("k"))
    return readers.freshness(n, demo.table(spark, sf, "region").select(F.col("r_name").alias("k"), F.lit(10).alias("n")), "k")


@query("s_replaced_payments", f"with {PAYMENTS_SQL} select work_id, count(*) as n from (select work_id from payments where cast(work_id as bigint) % 3 <> 0 union all select work_id from payments where cast(work_id as bigint) % 3 = 0 and seq = 1) group by 1")
def s_replaced_payments(spark, sf):
    p = demo.payments(spark, sf)
    listed = p.where("cast(work_id as bigint) % 3 = 0").select("work_id")
    return sinks.replaced_for(p, p.where("cast(work_id as bigint) % 3 = 0 and seq = 1"), "work_id", listed).groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))


@query("s_ledger", "select event_id from events order by event_id desc limit 500")
def s_ledger(spark, sf):
    """The newest 500 entries: the limit is the feature."""
    e = demo.table(spark, sf, "events").select("event_id")
    last = e.agg(F.max("event_id").alias("event_id"))
    return sinks.newest(e.join(last, "event_id", "left_anti"), last, "event_id")


def whole_analysis(spark, sf, part):
    """A part of the analysis, written; what the analysis kept for it is let go."""
    from ledgerlight.plans.analysis import analysed

    corpus = demo_corpus(spark, sf)
    try:
        return written(part(analysed(corpus, TODAY)))
    finally:
        corpus.release()


def demo_corpus(spark, sf):
    from ledgerlight.plans.analysis import Corpus

    return Corpus(paid_works(spark, sf), demo.payments(spark, sf), demo.flows(spark, sf), edits(spark, sf))


@query("analysis_coverage")
def analysis_coverage(spark, sf):
    """Every rule with its findings, or the reason why it stood down."""
    return whole_analysis(spark, sf, lambda a: a.coverage)


@query("analysis")
def analysis(spark, sf):
    """Every module over the whole corpus, folded into cases."""
    return whole_analysis(spark, sf, lambda a: a.cases.select("entity_type", "entity_id", "score", "n_findings", F.array_join("rules", ",").alias("rules"), "alert", "band", "primary_rule"))


CHANGED = "cast(work_id as bigint) % 997 = 3"


def changed_corpus(spark, sf):
    """(works before, the corpus after, ids): of every 997 works some cost three times as much, some have moved or have other names, some are gone."""
    before = demo_corpus(spark, sf)
    k = F.col("work_id").cast("bigint")
    hit = F.expr(CHANGED)
    after = before.works.where(~hit | (k % 4 != 3)).withColumns({
        "sanctioned_amount": F.when(hit & (k % 4 == 0), F.col("sanctioned_amount") * 3).otherwise(F.col("sanctioned_amount")), "district": F.when(hit & (k % 4 == 1), F.lit("NATION_9")).otherwise(F.col("district")),
        "vendor_id": F.when(hit & (k % 4 == 2), F.lit("V7")).otherwise(F.col("vendor_id")), "description": F.when(hit & (k % 4 == 2), F.lit("Construction of welcome gate at village 7")).otherwise(F.col("description")),
    })
    from ledgerlight.plans.analysis import Corpus

    return before, Corpus(after, before.payments, before.flows, before.versions), before.works.where(hit).select("work_id")


@query("analysis_after_change")
def analysis_after_change(spark, sf):
    """An analysis brought up to date after a change; tests hold it against one of everything."""
    from ledgerlight.plans import incremental

    before, after, ids = changed_corpus(spark, sf)
    history = incremental.History(spark, new_folder(spark, "analysis"))
    incremental.run_whole(history, before, TODAY)
    found = incremental.run_update(history, before.works, after, ids, TODAY).cases
    return found.select("entity_type", "entity_id", "score", "n_findings", F.array_join("rules", ",").alias("rules"), "alert", "band", "primary_rule")


# ---------------------------------------------------------------- more of the read and text surface
@query("j_enrich", f"with {WORKS_SQL} select work_id, sanction_date is not null as is_sanctioned, completion_date is not null or cast(work_id as bigint) % 50 = 0 as is_completed from works")
def j_enrich(spark, sf):
    w = demo.works(spark, sf)
    listing = w.select("work_id", (F.col("work_id").cast("bigint") % 50 == 0).cast("int").alias("in_completed"))
    return compliance.enrich(w.join(listing, "work_id", "left")).select("work_id", "is_sanctioned", "is_completed")


@query("j_shards", """with sh as (select n_name as shard_id, n_nationkey as k from nation), wm as (select n_name as shard_id, count(*) as listed from customer join nation on c_nationkey = n_nationkey where n_nationkey % 2 = 0 group by 1), pa as (select n_name as shard_id, sum(s_acctbal) as total from supplier join nation on s_nationkey = n_nationkey group by 1)
select shard_id, listed, round(total, 2) as total, (select count(*) from customer where c_nationkey = k) as here from sh left join wm using (shard_id) left join pa using (shard_id)""")
def j_shards(spark, sf):
    n, c, s = (demo.table(spark, sf, t) for t in ("nation", "customer", "supplier"))
    shards = n.select(F.col("n_name").alias("shard_id"), "n_nationkey")
    of = lambda df, key: df.join(shards, F.col(key) == F.col("n_nationkey"))
    marks = of(c, "c_nationkey").where("n_nationkey % 2 = 0").groupBy("shard_id").agg(F.count(F.lit(1)).alias("listed"))
    parity = of(s, "s_nationkey").groupBy("shard_id").agg(F.round(F.sum("s_acctbal"), 2).alias("total"))
    return reads.reading_state(shards.select("shard_id"), marks, parity, of(c, "c_nationkey").select("shard_id"))


@query("j_stale_checks", "select o_orderkey as group_id from orders left join (select l_orderkey, max(l_shipdate) as checked_at from lineitem where l_linenumber < 3 group by 1) on l_orderkey = o_orderkey where checked_at is null or checked_at < o_orderdate")
def j_stale_checks(spark, sf):
    groups = demo.table(spark, sf, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_orderdate").alias("changed_at"))
    checks = demo.table(spark, sf, "lineitem").where("l_linenumber < 3").select(F.col("l_orderkey").alias("group_id"), F.col("l_shipdate").alias("checked_at"))
    return reads.stale_checks(groups, checks).select("group_id")


@query("g_value_counts", f"with {WORKS_SQL} select 'era' as facet, era as value, count(*) as n from works group by era union all select 'house', house, count(*) from works group by house union all select 'status', status, count(*) from works group by status")
def g_value_counts(spark, sf):
    return cases.facets(demo.works(spark, sf), "era", "house", "status")


@query("g_distincts", f"with {WORKS_SQL} select vendor_name, count(distinct vendor_id) as ids, count(distinct district) as districts, count(distinct state) as states, min(house) as first_house, round(avg(case when status = 'Completed' then 1 else 0 end), 4) as done_share from works group by vendor_name")
def g_distincts(spark, sf):
    w = demo.works(spark, sf)
    return w.groupBy("vendor_name").agg(F.countDistinct("vendor_id").alias("ids"), F.countDistinct("district").alias("districts"), F.countDistinct("state").alias("states"), F.min("house").alias("first_house"), F.round(F.avg((F.col("status") == "Completed").cast("int")), 4).alias("done_share"))


@query("g_first_examples", f"with {WORKS_SQL}, r as (select ia_name, work_id, row_number() over (partition by ia_name order by cost desc, work_id) as n from works) select ia_name, string_agg(work_id, ',' order by n) as examples from r where n <= 5 group by ia_name")
def g_first_examples(spark, sf):
    w = reads.first_examples(demo.works(spark, sf).withColumn("cost", S.cost()), ["ia_name"], (F.desc("cost"), "work_id"), "work_id")
    return w.select("ia_name", F.array_join("examples", ",").alias("examples"))


@query("o_oldest_first", "select n_name as slice, cast(row_number() over (order by case when n_nationkey % 3 = 0 then null else n_nationkey end nulls first, n_name) as integer) as place from nation")
def o_oldest_first(spark, sf):
    """25 slices, so one window is fine here."""
    n = demo.table(spark, sf, "nation").select(F.col("n_name").alias("slice"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey")).alias("last_read"))
    return ingest.oldest_first(n).select("slice", F.row_number().over(Window.orderBy(F.asc_nulls_first("last_read"), "slice")).alias("place"))


@query("e_confidence", """with a as (select n_name as shard_id, case when n_nationkey % 5 = 0 then null else timestamp '2024-01-01' + n_nationkey * interval 12 hour end as fetched_at, n_nationkey % 2 as exact, n_nationkey % 3 as consecutive_failures from nation),
r as (select shard_id, list_filter([case when fetched_at is null then 'never read' end, case when fetched_at < timestamp '2024-01-10' - interval 36 hour then 'stale' end, case when exact = 0 then 'figures differ from the portal' end, case when consecutive_failures > 0 then 'last reads failed' end], lambda x: x is not null) as reasons from a)
select shard_id, array_to_string(reasons, ',') as reasons, case when len(reasons) = 0 then 'high' when len(reasons) = 1 then 'medium' else 'low' end as confidence from r""")
def e_confidence(spark, sf):
    k = F.col("n_nationkey")
    a = demo.table(spark, sf, "nation").select(F.col("n_name").alias("shard_id"), F.when(k % 5 != 0, F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, n_nationkey * 12)")).alias("fetched_at"), (k % 2).alias("exact"), (k % 3).alias("consecutive_failures"), F.lit("live").alias("lifecycle"), F.lit(0).alias("awaiting_removal"))
    return cases.confidence(a.select("shard_id"), a, "2024-01-10 00:00:00").select("shard_id", F.array_join("reasons", ",").alias("reasons"), "confidence")


@query("e_allowed_actions", f"{FINDINGS_SQL} select entity_id, 'request records' as action from cas where score >= 20 union all select entity_id, 'hold payment' from cas where score >= 40 and list_contains(rules, 'P-SEQ-01')")
def e_allowed_actions(spark, sf):
    catalogue = spark.createDataFrame([("request records", ["district", "state"], 20, []), ("hold payment", ["district"], 40, ["P-SEQ-01"]), ("order inquiry", ["state"], 40, [])], "action string, roles array<string>, min_score int, evidence array<string>")
    c = cases.cases(all_findings(spark, sf))
    return cases.allowed_actions(catalogue, c, "district").select("entity_id", "action")


@query("e_number_guard", "select o_orderkey, o_orderkey % 2 = 1 as unsupported from orders")
def e_number_guard(spark, sf):
    o = demo.table(spark, sf, "orders").select("o_orderkey", F.format_string("%d works over %d days.", F.lit(7), F.lit(365) + F.col("o_orderkey") % 2).alias("text"), F.array(F.lit("7"), F.lit("365")).alias("facts"))
    return o.select("o_orderkey", (F.size(cases.unsupported_numbers("text", "facts")) > 0).alias("unsupported"))


@query("f_template", f"with {WORKS_SQL} select work_id, 'Work ' || work_id || ' is ' || format('{{:,}}', date '{TODAY}' - sanction_date) || ' days past its sanction.' as en from works where sanction_date is not null")
def f_template(spark, sf):
    from ledgerlight.functions.templates import rendered

    w = demo.works(spark, sf).where("sanction_date is not null").withColumn("days", F.datediff(F.lit(TODAY).cast("date"), "sanction_date"))
    return w.select("work_id", rendered("late", "en").alias("en"))


@query("w_top_k", "select user_id, event_id, k from (select user_id, event_id, cast(row_number() over (partition by user_id order by value desc, event_id) as integer) as k from events) where k <= 5")
def w_top_k(spark, sf):
    """Five neighbours each: the limit is the feature."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return demo.table(spark, sf, "events").select("user_id", "event_id", k.alias("k")).where("k <= 5")


@query("w_group_transform", "select l_orderkey, l_linenumber, count(*) over (partition by l_orderkey) as n, median(l_quantity) over (partition by l_orderkey) as med from lineitem")
def w_group_transform(spark, sf):
    li = demo.table(spark, sf, "lineitem")
    g = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.median("l_quantity").alias("med"))
    return li.join(g, "l_orderkey").select("l_orderkey", "l_linenumber", "n", "med")


@query("t_unchanged", "select o_orderpriority as slice from orders group by 1 having min(o_orderkey) % 2 = 0")
def t_unchanged(spark, sf):
    o = demo.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("slice"), "o_orderkey", "o_totalprice", F.col("o_custkey").alias("Sno"))
    seen = ingest.payloads(o)
    odd = o.groupBy("slice").agg((F.min("o_orderkey") % 2).alias("odd"))
    seen = seen.join(odd, "slice").select("slice", F.when(F.col("odd") == 0, F.col("payload")).otherwise("other").alias("payload"))
    return ingest.unchanged(o, seen).select("slice")


@query("a_isolation")
def a_isolation(spark, sf):
    w = demo.works(spark, sf).select("work_id", "state", "category", S.cost().alias("cost"), F.datediff("sanction_date", "recommended_date").cast("double").alias("days")).where("days is not null")
    return peers.isolation_scores(w, ["state", "category"], ["cost", "days"]).select("work_id", F.round("isolation", 4).alias("isolation"))


@query("g_payee_villages")
def g_payee_villages(spark, sf):
    p = demo.payments(spark, sf).select(F.col("implementing_agency").alias("batch"), F.concat(F.lit("GP "), "vendor_name").alias("name"))
    return duplicates.payee_villages(p)


@query("x_sample")
def x_sample(spark, sf):
    """A seeded tenth: sampling is the feature."""
    return demo.table(spark, sf, "orders").select("o_orderkey").sample(0.1, 7)
