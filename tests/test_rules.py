import datetime as dt
import os
import random

from pyspark.sql import functions as F

from ledgerlight import config
from ledgerlight.operators import compliance, duplicates, network, payments, peers, revisions
from ledgerlight.operators.findings import finding, together
from ledgerlight.plans import analysis, cases
from ledgerlight.sources.readers import conformed

DAY = dt.date
BASE = {"state": "UP", "district": "SITAPUR", "constituency": "SITAPUR", "mp_name": "SHRI A", "house": "LS", "category": "Community hall", "work_category": "Other", "description": "Construction of community hall at Rampur village", "era": "post2023", "fy": "2025-26", "recommended_date": DAY(2025, 6, 1), "sanction_date": DAY(2025, 7, 1), "status": "Sanction", "estimated_cost": 500000.0, "sanctioned_amount": 500000.0, "ia_name": "SITAPUR IDA"}
TODAY = "2026-09-13"


def works(spark, *rows):
    from pyspark.sql import types as T

    from ledgerlight.sources.readers import WORKS

    schema = T.StructType(WORKS.fields)
    out = [tuple({**BASE, "work_id": f"W{i}", **r}.get(f.name) for f in schema) for i, r in enumerate(rows)]
    return conformed(spark.createDataFrame(out, schema))


def found(df):
    return {r.entity_id: r for r in df.collect()}


def test_completion_and_cost(spark):
    w = works(spark, {}, {"sanction_date": DAY(2025, 9, 30)}, {"sanction_date": DAY(2024, 1, 1)}, {"sanction_date": None}, {"completion_date": DAY(2025, 8, 1)}, {"sanctioned_amount": 100000.0}, {"sanctioned_amount": 3e7})
    late = found(compliance.completion_norm(w, TODAY))
    assert late["W0"].severity == "medium" and late["W2"].severity == "high" and not {"W1", "W3", "W4"} & set(late)
    cost = found(compliance.cost_limits(w))
    assert set(cost) == {"W5", "W6"} and not cost["W5"].standalone and cost["W6"].standalone


def test_prohibited_terms(spark):
    texts = {
        "Construction of temple": "critical", "Construction of community hall near Hanuman temple": None, "Construction of Saraswati Shishu Mandir": None, "Hanuman mandir ke pas nirman": None, "Maintenance of pump": "medium",
        "Construction of temple road": None, "Construction of welcome gate at Rampur": "critical", "Purchase of idol": "critical",
    }
    w = works(spark, *[{"description": t} for t in texts])
    got = found(compliance.prohibited(w))
    for i, (t, sev) in enumerate(texts.items()):
        assert (got[f"W{i}"].severity if f"W{i}" in got else None) == sev, t
    loose = works(spark, {"description": "Construction of templeton block"}, {"description": "Construction of temple"})
    assert set(found(compliance.prohibited(loose))) >= {"W1"} and set(found(compliance.prohibited(loose, strict=True))) == {"W1"}


def test_cost_outlier_and_flat_group(spark):
    rng = random.Random(1)
    rows = [{"sanctioned_amount": 500000.0 + rng.randrange(-20000, 20000)} for _ in range(30)] + [{"sanctioned_amount": 2e6}, {"sanctioned_amount": 2e7}]
    got = found(peers.cost_outliers(works(spark, *rows)))
    assert set(got) == {"W30", "W31"} and got["W30"].severity == "high" and got["W31"].severity == "medium"
    flat = found(peers.cost_outliers(works(spark, *[{} for _ in range(40)], {"sanctioned_amount": 9e5})))
    assert set(flat) == {"W40"}


def test_caps_and_flows(spark):
    w = works(spark, *[{"work_category": "Repair and Renovation", "estimated_cost": 3e6} for _ in range(2)], *[{"description": "Repair of school wall", "estimated_cost": 3e6, "mp_name": "B", "constituency": "B"} for _ in range(2)])
    got = found(compliance.repair_cap(w))
    assert got["SITAPUR|UP"].severity == "medium" and got["B|UP"].severity == "low"
    years = ["2020-21", "2021-22", "2022-23", "2023-24"]
    rows = [("S1", y, 100.0, e) for y, e in zip(years, (10, 20, 80, 90))] + [("S2", y, 100.0, 50) for y in years] + [("S3", y, 100.0, e) for y, e in zip(years, (0, 0, 70, 5))]
    f = spark.createDataFrame([("UP", s, "M", y, r, float(e), None, "post2023", 0.1 * e, 0.2 * e) for s, y, r, e in rows], "state string, constituency string, mp_name string, fy string, released double, expenditure double, utilization_pct double, era string, sc_expenditure double, st_expenditure double")
    spikes = found(compliance.utilization_spikes(f, "2025-01-01"))
    assert set(spikes) == {"S1|UP", "S3|UP"} and spikes["S1|UP"].fy == "2022-23"
    assert set(found(compliance.pileups(f))) == {"S3|UP"}
    assert {r.kind for r in compliance.area_shares(f).collect()} == {"sc"}


def test_network_marks_concentration(spark):
    rows = [{"vendor_id": "V1", "vendor_name": "A", "district": f"D{i}"} for i in range(6)] + [{"vendor_id": "V2", "vendor_name": "B"} for _ in range(20)] + [{"vendor_id": "V3", "vendor_name": "C", "sanctioned_amount": 5e6} for _ in range(5)]
    got = found(network.actor_signals(works(spark, *rows), "vendor"))
    assert set(got) >= {"vendor:V1"} and "vendor:V2" not in got and got["vendor:V1"].districts == 6


def test_payments(spark):
    w = works(spark, {}, {"completion_date": DAY(2025, 8, 1)}, {}, {})
    p = spark.createDataFrame([("W0", DAY(2025, 6, 1), 1e5, "V"), ("W1", DAY(2026, 6, 1), 1e5, "V"), ("W2", DAY(2025, 9, 1), 2e5, "V"), ("W2", DAY(2025, 9, 1), 2e5, "V"), ("W3", DAY(2026, 3, 28), 5.0, None), ("W3", DAY(2026, 3, 28), 5.0, None), ("X", DAY(2020, 1, 1), 1.0, "V")], "work_id string, paid_on date, amount double, vendor_id string")
    m = payments.marked(p, w)
    assert set(found(payments.before_sanction(m))) == {"W0"} and set(found(payments.long_after(m))) == {"W1"}
    again = found(payments.repeated(m))
    assert again["W2"].severity == "medium" and again["W3"].severity == "low" and m.where("year_end_week").count() == 2 and m.count() == 6


def test_edit_log(spark):
    w = works(spark, {}, {}, {"sanction_date": None}, {})
    t = dt.datetime(2025, 9, 1, 10)
    rows = [("W0", t, "description", "Hall", "Road"), ("W0", t, "ia_name", "A", "a "), ("W1", t, "sanctioned_amount", "500000", "900000"), ("W1", t, "sanction_date", None, "2025-07-01"), ("W2", t, "ia_name", "A", "B"), ("W3", t, "sanctioned_amount", "900000", "500000"), ("W3", t, "vendor_name", "X", "Y"), ("W3", t, "total_paid", "5000", "100"), ("W3", t, "district", None, "Z")]
    v = revisions.with_occasion(spark.createDataFrame(rows, "work_id string, observed_at timestamp, field string, old_value string, new_value string"), w)
    assert set(found(revisions.place_changes(v))) == {"W0"} and found(revisions.agency_changes(v)) == {}
    assert {k: r.severity for k, r in found(revisions.amount_changes(v)).items()} == {"W3": "low"}
    assert found(revisions.vendor_changes(v))["W3"].severity == "medium" and found(revisions.payment_reversals(v))["W3"].reduction == 4900
    retired = spark.createDataFrame([("W9", '{"total_paid": 500}', "2026-01-01"), ("W8", "{}", "2026-01-01")], "work_id string, record_json string, retired_at string")
    assert set(found(revisions.removed_after_payment(retired))) == {"W9"}


def test_duplicates(spark):
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima", "mike"]
    rng = random.Random(3)
    rows = [{"description": "Construction of " + " ".join(rng.sample(words, 4)) + f" {''.join(rng.choice('qwxyz') for _ in range(6))} yard", "district": f"D{i % 4}"} for i in range(60)]
    same = "Construction of zephyr quartz obelisk pavilion ward 7"
    rows += [{"description": same}, {"description": same, "mp_name": "SHRI B"}, {"description": same.replace("7", "8")}, {"description": same, "sanctioned_amount": 900000.0, "estimated_cost": 900000.0, "mp_name": "SHRI C"}]
    w = works(spark, *rows)
    rule = config.DUPLICATE | {"boilerplate_pct": 20.0}
    pairs = duplicates.classified(duplicates.candidate_pairs(w, rule), w, rule=rule)
    got = {(r.a, r.b): r["class"] for r in pairs.collect()}
    assert got.get(("W60", "W61")) == "held" and got.get(("W60", "W63")) == "cleared" and not any("W62" in k for k in got)
    found_ = together(*duplicates.near_duplicates(w, rule=rule))
    assert found_.where("not scored").count() == found_.count() >= 2
    vague = works(spark, *[{"description": "Construction of road"} for _ in range(9)])
    assert duplicates.generic_clusters(vague).first().works == 9
    photos = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y"), ("D", "y"), ("E", "y"), ("F", "z")], "work_id string, sha256 string")
    assert {r.entity_id: r.severity for r in duplicates.shared_photos(photos).collect()} == {"A": "critical", "B": "critical", "C": "high", "D": "high", "E": "high"}
    towns = duplicates.payee_villages(spark.createDataFrame([("b", "GP BAMHANI"), ("b", "gp bamhani"), ("b", "GP KARELI")], "batch string, name string"))
    assert len({r.village for r in towns.collect()}) == 2


def test_cases_fold_and_score(spark):
    w = works(spark, {"sanction_date": DAY(2024, 1, 1), "sanctioned_amount": 3e7, "estimated_cost": 3e7}, {"sanctioned_amount": 1e5})
    f = together(compliance.completion_norm(w, TODAY), compliance.cost_limits(w))
    got = {r.entity_id: r for r in cases.cases(f).collect()}
    assert got["W0"].score == 30 and got["W0"].rules == ["R-COST-01", "R-TIME-01"] and got["W0"].primary_rule == "R-TIME-01" and got["W1"].score == 12
    shuffled = cases.cases(f.orderBy(F.rand(3)))
    assert {r.entity_id: r.score for r in shuffled.collect()} == {k: r.score for k, r in got.items()}
    all_, notes = analysis.findings(analysis.Corpus(w), TODAY)
    assert notes["P-SEQ-01"] == "no payments" and all_.count() >= f.count()


def test_allowed_actions_of_a_long_catalogue(spark):
    case = spark.createDataFrame([("F-1", 50, ["P-SEQ-01"]), ("F-2", 10, ["A-COST-01"])], "case_id string, score int, rules array<string>")
    for n in (3, 10_003):
        catalogue = spark.range(n).selectExpr("concat('act ', id) as action", "array('district') as roles", "20 as min_score", "if(id % 2 = 0, array(), array('P-SEQ-02')) as evidence")
        got = cases.allowed_actions(catalogue, case, "district").collect()
        assert {r.action for r in got} == {f"act {i}" for i in range(0, n, 2)} and {r.case_id for r in got} == {"F-1"} and len(got) == (n + 1) // 2


def test_context_adds_nothing_to_scores(spark):
    """By hand: 40 + 12 count; a low cost (context) and a held pair don't, and a case of context alone isn't one."""
    facts = [
        ("W0", "R-PROH-01", "critical", True, True), ("W0", "R-TIME-01", "medium", True, True), ("W0", "R-COST-01", "low", False, True), ("W0", "D-DUP-01", "low", True, False),
        ("W1", "R-SANC-01", "low", False, True), ("W2", "R-TIME-01", "high", True, True), ("W2", "R-COST-01", "critical", False, True),
    ]
    df = spark.createDataFrame(facts, "work_id string, rule string, severity string, standalone boolean, scored boolean")
    f = together(*[finding(df.where(F.col("rule") == r), "x", r, F.col("severity"), "work", "work_id", F.concat(F.lit("S "), "rule"), standalone=F.col("standalone"), scored=F.col("scored")) for r in ("R-PROH-01", "R-TIME-01", "R-COST-01", "D-DUP-01", "R-SANC-01")])
    got = {r.entity_id: r for r in cases.cases(f).collect()}
    assert {k: (r.score, r.alert, r.n_findings, r.primary_rule, r.primary_signal) for k, r in got.items()} == {"W0": (52, True, 4, "R-PROH-01", "S R-PROH-01"), "W2": (25, False, 2, "R-TIME-01", "S R-TIME-01")}
    assert {(r.entity_id, r.rule_id, r.points) for r in cases.contributions(f).collect()} == {("W0", "R-PROH-01", 40), ("W0", "R-TIME-01", 12), ("W2", "R-TIME-01", 25)}


def test_contributions_list_context_with_no_points(spark):
    """By hand: every finding is in a row, repeats counted; context and held ones have 0 points and don't move the shares of others."""
    facts = [
        ("W0", "R-PROH-01", "high", True, True), ("W0", "R-TIME-01", "medium", True, True), ("W0", "R-COST-01", "low", False, True), ("W0", "D-DUP-01", "medium", True, False), ("W0", "D-DUP-01", "medium", True, True),
        ("W1", "R-SANC-01", "low", False, True),
    ]
    df = spark.createDataFrame(facts, "work_id string, rule string, severity string, standalone boolean, scored boolean")
    f = finding(df, "x", F.col("rule"), F.col("severity"), "work", "work_id", "S", standalone=F.col("standalone"), scored=F.col("scored"))
    got = {(r.entity_id, r.rule_id, r.points, r.times, str(r.share)) for r in cases.contributions(f, context=True).collect()}
    assert got == {("W0", "R-PROH-01", 25, 1, "51.0"), ("W0", "R-TIME-01", 12, 1, "24.5"), ("W0", "R-COST-01", 0, 1, "0.0"), ("W0", "D-DUP-01", 12, 2, "24.5"), ("W1", "R-SANC-01", 0, 1, "nan")}


def test_actors_are_told_apart(spark):
    rows = [{"vendor_name": n, "district": f"D{i}"} for i, n in enumerate(["Acme Works ", "acme works", "ACME WORKS", "Acme Works", "Acme works", "xyz", "XYZ", "XYZ", "XYZ", "XYZ"])]
    rows += [{"implementing_agency": a, "sanctioned_amount": 9e6} for a in ("Rural dept", "RURAL DEPT", "rural dept")] + [{"implementing_agency": "Other Dept", "sanctioned_amount": 4e5 + 9e3 * i} for i in range(20)]
    rows += [{"ia_name": "Big_IDA", "district": f"D{i}", "category": "School bus"} for i in range(6)]
    w = works(spark, *rows).withColumn("vendor_id", F.lit(None).cast("string"))
    rule = config.NETWORK | {"least_works": 3}
    vendor = found(network.actor_signals(w, "vendor", rule))
    assert set(vendor) == {"vendor:ACME WORKS"} and vendor["vendor:ACME WORKS"].districts == 5  # by name, as no work has an id; names of three letters tell nothing apart
    agency = found(network.actor_signals(w, "agency", rule))
    assert set(agency) == {"agency:RURAL DEPT"} and agency["agency:RURAL DEPT"].severity == "medium"
    authority = found(network.actor_signals(w, "district_authority", rule))
    assert authority["Big_IDA"].severity == "low" and authority["Big_IDA"].actor == "BIG_IDA"  # buses are supplied nationally
    ids = works(spark, *[{"vendor_id": f"V{i // 6}", "vendor_name": "Acme Works", "district": f"D{i}"} for i in range(12)], {"vendor_id": None, "vendor_name": "Acme Works"})
    assert {k: r.same_name for k, r in found(network.actor_signals(ids, "vendor", rule)).items()} == {"vendor:V0": 1, "vendor:V1": 1}


def test_findings_of_an_authority_make_one_case(spark):
    waits = [{"sanction_date": None, "status": "Pending for Sanction", "recommended_date": DAY(2025, 1, 1), "ia_name": "X_IDA", "district": f"D{i}"} for i in range(12)]
    fresh = [{"sanction_date": None, "status": "Pending for Sanction", "recommended_date": DAY(2026, 9, 1), "ia_name": "X_IDA"} for _ in range(4)]
    w = works(spark, *waits, *fresh, *[{"ia_name": "X_IDA"} for _ in range(9)])
    summary = found(compliance.sanction_waits_by_district(w, TODAY))["X_IDA"]
    assert (summary.works, summary.population, summary.share) == (12, 16, 0.75)
    f = together(compliance.sanction_waits_by_district(w, TODAY), network.actor_signals(w, "district_authority"))
    (case,) = cases.with_entities(cases.cases(f), w).collect()
    assert case.entity_id == "X_IDA" and case.rules == ["N-NET-01", "R-SANC-01"] and case.score == 17 and case.ia_name == "X_IDA" and case.entity_label == "District authority: X_ida"


def test_pages_of_the_stored_table(spark, tmp_path):
    w = works(spark, {"sanction_date": DAY(2024, 1, 1)}, {"sanction_date": DAY(2024, 2, 1), "state": "MP"}, {"sanctioned_amount": 3e7, "state": None}, {"sanction_date": DAY(2025, 9, 1), "description": "x"})
    c = cases.with_entities(cases.cases(together(compliance.completion_norm(w, TODAY), compliance.cost_limits(w))), w)
    before = spark.createDataFrame([(c.where("entity_id = 'W1'").first().case_id, dt.datetime(2020, 1, 1))], "case_id string, first_seen timestamp")
    feedback = spark.createDataFrame([(before.first().case_id, 1, "open"), (before.first().case_id, 2, "confirmed")], "case_id string, id int, decision string")
    stored = cases.store(cases.seen(c, TODAY, before, feedback), str(tmp_path / "cases"))
    ids = lambda df: [r.entity_id for r in df.collect()]
    by_score = sorted(((-r.score, r.entity_id) for r in c.collect()))
    assert ids(cases.page(stored)) == ids(cases.page(stored, "no such order")) == [e for _, e in by_score]
    assert ids(cases.page(stored, "risk_asc")) == [e for s, e in sorted((-s, e) for s, e in by_score)]
    assert ids(cases.page(stored, "recent"))[-1] == "W1" and ids(cases.page(stored, "state"))[:2] == ["W2", "W1"]
    assert ids(cases.filtered(stored, statuses=("confirmed",))) == ["W1"] and set(ids(cases.filtered(stored, constituencies=("SITAPUR",), entity_types=("work",)))) == set(ids(stored))
    assert ids(cases.filtered(stored, search="COMMUNITY HALL at", states=("MP",))) == ["W1"] and ids(cases.filtered(stored, search="days_since")) == [] and len(ids(cases.filtered(stored, search="DAYS since"))) == 4


def test_searches_by_postings(spark, tmp_path):
    texts = ["Hall at Rampur", "HALL AT RAMPUR 100%", "road_7 at Rampur", "Rämpur ghat", "a", None, "aaa aaaa", "ha", "at Rampur, a hall"]
    rows = [(f"F-{i}", t, f"E{i}", None, "seen " * 3 if i % 2 else None) for i, t in enumerate(texts)]
    case = spark.createDataFrame(rows, "case_id string, display_title string, entity_id string, entity_label string, primary_signal string")
    postings = cases.store_postings(case, str(tmp_path / "p"))
    assert postings.groupBy("gram", "case_id").count().where("count > 1").count() == 0
    for text in ("hall at", "RAMPUR", "100%", "road_7", "d_7", "ämp", "aaaa", "aaaaa", "a", "%", "seen s", "nowhere", "E3", "e 3"):
        ids = lambda df: sorted(r.case_id for r in df.collect())
        want = sorted(i for i, *found in rows if any(x and text.lower() in x.lower() for x in found))
        assert ids(cases.searched(case, postings, text)) == ids(cases.filtered(case, search=text)) == want, text
    plan = cases.searched(case, postings, "rampur")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [IsNotNull(gram), In(gram" in plan or "In(gram" in plan


def cases_of_one_id(spark):
    """Three cases, of which two have the same ten digits as their id, as a few dozen have among nine million works."""
    facts = [("196515", "P-SEQ-01", "critical"), ("196515", "R-TIME-01", "high"), ("1045638", "R-TIME-01", "high"), ("7", "R-TIME-01", "low")]
    df = spark.createDataFrame(facts, "work_id string, rule string, severity string")
    c = cases.cases(finding(df, "x", F.col("rule"), F.col("severity"), "work", "work_id", "S"))
    assert len({r.case_id for r in c.collect()}) == 2
    return c


def test_actions_of_cases_of_one_id(spark):
    catalogue = spark.createDataFrame([("request", ["district"], 20, []), ("hold", ["district"], 40, ["P-SEQ-01"])], "action string, roles array<string>, min_score int, evidence array<string>")
    got = [(r.entity_id, r.action) for r in cases.allowed_actions(catalogue, cases_of_one_id(spark), "district").collect()]
    assert sorted(got) == [("1045638", "request"), ("196515", "hold"), ("196515", "request")]


def test_reviews_of_cases_of_one_id(spark):
    c = cases_of_one_id(spark)
    feedback = spark.createDataFrame([("work", "196515", 1, "open"), ("work", "196515", 3, "refuted"), ("work", "1045638", 2, "confirmed")], "entity_type string, entity_id string, id int, decision string")
    before = spark.createDataFrame([("work", "196515", dt.datetime(2020, 1, 1)), ("work", "1045638", dt.datetime(2021, 1, 1))], "entity_type string, entity_id string, first_seen timestamp")
    want = {"196515": ("refuted", 2020), "1045638": ("confirmed", 2021)}
    rows = cases.last_review(c, feedback, before).where("entity_id <> '7'").collect()
    assert len(rows) == 2 and {r.entity_id: (r.review_status, r.seen_before.year) for r in rows} == want
    rows = cases.seen(c, TODAY, before, feedback).collect()
    assert len(rows) == 3 and {r.entity_id: (r.review_status, r.first_seen.year) for r in rows} == want | {"7": ("open", int(TODAY[:4]))}
    # where only ids are known, they count, and rows stay single
    rows = cases.last_review(c, spark.createDataFrame([], "case_id string, id int, decision string"), c.select("case_id", F.lit(dt.datetime(2020, 1, 1)).alias("first_seen"))).collect()
    assert len(rows) == 3


def test_an_analysis_moves_payments_once_and_leaves_nothing(spark):
    rng = random.Random(5)
    w = works(spark, *[{"completion_date": rng.choice([None, DAY(2025, 8, 1)]), "sanction_date": rng.choice([None, DAY(2025, 7, 1)])} for _ in range(40)])
    rows = [(f"W{rng.randrange(45)}", DAY(2025, 5, 1) + dt.timedelta(days=60 * rng.randrange(12)), rng.choice([5.0, 2e5, None]), rng.choice(["V", None])) for _ in range(300)]
    p = spark.createDataFrame(rows, "work_id string, paid_on date, amount double, vendor_id string")
    marked = payments.marked(p, w)
    texts = lambda frames: sorted(str((r.rule_id, r.entity_id, r.severity, r.summary, sorted(r.details.items()))) for r in together(*frames).collect())
    want = texts([payments.before_sanction(marked), payments.long_after(marked), payments.repeated(marked)])
    measured = payments.measured(p, w)
    assert texts(payments.found(measured)) == want and len({x.split(",")[0] for x in want}) == 3
    joined = payments.measured(p.hint("merge"), w)._jdf.queryExecution().executedPlan().toString()
    assert joined.count("Exchange hashpartitioning") <= 2  # payments and works, each by work
    corpus = analysis.Corpus(w, p)
    found_, _ = analysis.findings(corpus, TODAY)
    assert texts([found_.where("agent = 'payments'")]) == want
    tables = [df.__dict__["_table"].removeprefix("file://") for df in corpus.kept]
    assert tables and all(os.path.isdir(t) for t in tables) and not spark._jsc.getPersistentRDDs()
    corpus.release()
    assert not any(os.path.isdir(t) for t in tables)


def test_grams_of_most_cases_have_no_postings(spark, tmp_path):
    """Searches find the same with and without postings of common grams, also where two cases have one id."""
    rows = [(f"F-{i // 2}", f"Hall {'at' if i % 3 else 'near'} Rampur {i}", f"E{i}", None, "seen" if i % 20 else "quartz \U0001d400b") for i in range(40)]
    case = spark.createDataFrame(rows, "case_id string, display_title string, entity_id string, entity_label string, primary_signal string")
    postings = cases.store_postings(case, str(tmp_path / "p"), many=10)
    common = {r.gram for r in postings.where("case_id is null").collect()}
    assert {"ram", "hal", "see"} <= common and "qua" not in common
    assert postings.where(F.col("gram") == "ram").count() == 1 and postings.where(F.col("gram") == "qua").count() == 2
    for text in ("rampur", "RAMPUR 3", "quartz", "near rampur 3", "\U0001d400b", "hall at rampur 17", "e39", "nowhere"):
        ids = lambda df: sorted(r.entity_id for r in df.collect())
        want = sorted(e for _, *found in rows for e in [found[1]] if any(x and text.lower() in x.lower() for x in found))
        assert ids(cases.searched(case, postings, text)) == want, text


def test_villages_by_the_plain_way():
    """The heads that bounds leave, against a comparison with every head."""
    from ledgerlight.functions import fuzzy

    rng = random.Random(6)
    parts = ["GP", "gp", "Gram", "Panchayat", "panchayt", "Rampur", "Rampura", "Karéli", "kareli", "Vendor", "1", "12", "123", "1234", "Bamhani", "a", "  "]
    names = sorted({" ".join(rng.choice(parts) for _ in range(rng.randrange(5))) for _ in range(500)} | {f"GP Vendor {rng.randrange(10**5)}" for _ in range(300)} | {"", "é", "x y z"})
    for least in (90.0, 75.0, 100.0):
        heads, want = [], []
        for i, name in enumerate(names):
            k = next((h for h in heads if fuzzy.token_set_ratio(name.lower(), names[h].lower()) >= least), None)
            if k is None:
                heads.append(i)
            want.append(i if k is None else k)
        assert duplicates.first_near(names, least) == want


def test_villages_of_many_names_compare_few(monkeypatch):
    from ledgerlight.functions import fuzzy

    calls, plain = [], fuzzy.token_set_ratio
    monkeypatch.setattr(fuzzy, "token_set_ratio", lambda a, b: calls.append(1) or plain(a, b))
    names = sorted(f"GP Vendor {k}" for k in range(10_000, 24_000, 7))
    assert len(set(duplicates.first_near(names, 90.0))) > 100 and len(calls) < len(names) * 30  # all heads so far would be some hundreds each
