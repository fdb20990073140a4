"""An analysis brought up to date, against one of everything."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerlight.plans import analysis, incremental
from tests.test_rules import works

TODAY, LATER = "2026-09-13", "2026-12-01"
WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima", "mike", "oscar", "papa", "quebec"]


def record(rng, i):
    rec = dt.date(2025, 1, 1) + dt.timedelta(days=rng.randrange(400))
    sanctioned = rng.random() < 0.7
    sanction = rec + dt.timedelta(days=rng.choice([5, 20, 30, 90, 200])) if sanctioned else None
    done = sanction + dt.timedelta(days=rng.randrange(20, 500)) if sanctioned and rng.random() < 0.5 else None
    cost = round(5e5 * rng.lognormvariate(0, 0.15) * (rng.choice([6, 30]) if rng.random() < 0.06 else 1) * (0.3 if rng.random() < 0.1 else 1), 2)
    seat = rng.randrange(6)
    g = rng.randrange(14)
    rare = " ".join(f"{w}{chr(97 + g)}" for w in ("zeb", "zor", "zun", "zil"))
    text = rng.choice(["Construction of temple", "Maintenance of pump house east", f"Construction of {' '.join(rng.sample(WORDS, 4))} yard"] + [f"Construction of {rare} hall"] * 3 + ["Construction of road here"] * 2)
    seat = g % 6 if rare in text else seat
    return {
        "work_id": f"W{i}", "state": rng.choice(["UP", "MP"]), "district": rng.choice(["D1", "D2", "D3", "D4", "D5", "D6"]), "constituency": f"S{seat}", "mp_name": f"SHRI {seat}", "category": rng.choice(["Hall", "Road"]), "era": rng.choice(["post2023", None]),
        "work_category": rng.choice(["Repair and Renovation", "Trust and Society", "Other"]), "description": text, "recommended_date": rec, "sanction_date": sanction, "completion_date": done, "status": "Sanction" if sanctioned else "Pending for Sanction",
        "estimated_cost": cost * 3, "sanctioned_amount": cost if sanctioned else None, "expenditure": cost * rng.random() * 100, "total_paid": cost * rng.random() if done else None, "payment_count": rng.randrange(9) if done else None, "ia_name": f"{rng.choice('ABC')}_IDA",
        "vendor_id": rng.choice([None, "V1", "V2", "V3", "V4"]), "vendor_name": rng.choice(["Acme", "Bolt Works", "Cable"]), "is_sc_constituency": int(seat == 0), "is_st_constituency": int(seat == 1),
    }


def corpus(spark, rows, extra=()):
    rng = random.Random(8)
    pay, edits = [], []
    for i in range(len(rows)):
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            pay.append((f"W{i}", dt.date(2025, 3, 1) + dt.timedelta(days=rng.randrange(500)), 1e5 * rng.randrange(1, 4), rng.choice(["V1", "V2"]), rng.choice(["GP Bamhani", "gp  bamhani", "Acme"]), "X"))
        if rng.random() < 0.3:
            at = dt.datetime(2026, 1, 1 + rng.randrange(28), 10)
            edits += [(f"W{i}", at, "sanctioned_amount", "500000", "900000"), (f"W{i}", at, "vendor_name", "Acme", "Bolt"), (f"W{i}", at, "ia_name", "A_IDA", "B_IDA"), (f"W{i}", at, "total_paid", "9000", "100")][: rng.randrange(1, 5)]
    p = spark.createDataFrame(pay + list(extra), "work_id string, paid_on date, amount double, vendor_id string, vendor_name string, implementing_agency string")
    v = spark.createDataFrame(edits, "work_id string, observed_at timestamp, field string, old_value string, new_value string")
    flows = spark.createDataFrame([("UP", f"S{s}", "M", f"20{y}-{y + 1}", 100.0, float(5 * y % 97), None, "post2023", 1.0, 20.0) for s in range(6) for y in range(18, 24)], "state string, constituency string, mp_name string, fy string, released double, expenditure double, utilization_pct double, era string, sc_expenditure double, st_expenditure double")
    return analysis.Corpus(works(spark, *rows), p, flows, v)


def shown(kept):
    """What an analysis says, without the order of sums in details."""
    findings = sorted(tuple(r) for r in kept.findings.select("rule_id", "entity_type", "entity_id", "severity", "summary", "standalone", "scored").collect())
    columns = sorted(set(kept.cases.columns) - {"rules"})
    return findings, sorted((tuple(map(str, r)) for r in kept.cases.select(*columns, F.array_join("rules", ",")).collect()))


def test_updates_equal_whole_runs(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [record(rng, i) for i in range(260)]
    history = incremental.History(spark, str(tmp_path / "a"))
    before = corpus(spark, rows)
    first = incremental.run_whole(history, before, TODAY)
    assert {r.rule_id for r in first.findings.select("rule_id").distinct().collect()} >= {"A-COST-01", "R-COST-01", "R-SANC-01", "R-PROH-01", "R-TIME-01", "R-REPAIR-01", "D-DUP-01", "D-DUP-02", "N-NET-01", "P-SEQ-01", "V-AMT-01"}

    # another day comes, and works change in every way: amounts, places, names, texts, dates; some go and some are new, and one is paid again
    changed = rng.sample(range(260), 12)
    after = [dict(r) for r in rows]
    for n, i in enumerate(changed):
        after[i] |= {**record(rng, i)} if n < 5 else [{"sanctioned_amount": 9e6, "sanction_date": dt.date(2025, 9, 1)}, {"district": "D1", "state": None}, {"vendor_id": "V9"}, {"description": "Construction of welcome gate at Rampur"}, {"ia_name": "Z_IDA"}, {"constituency": "S9"}, {"era": "pre2023"}][n - 5]
    gone, new = [i for i in range(260) if i not in changed][:3], [record(rng, 300 + i) for i in range(3)]
    after = [r for i, r in enumerate(after) if i not in gone] + new
    paid = [(f"W{changed[0]}", dt.date(2025, 1, 1), 3e5, "V1", "Acme", "X")] * 2
    ids = spark.createDataFrame([(f"W{i}",) for i in (*changed, *gone, 300, 301, 302)], "work_id string")
    now = corpus(spark, after, paid)
    second = incremental.run_update(history, before.works, now, ids, LATER)
    assert second.number == 1 and second.looked_at["work"] == 18 and second.looked_at["cost"] < 260
    whole = incremental.run_whole(incremental.History(spark, str(tmp_path / "b")), corpus(spark, after, paid), LATER)
    assert shown(second) == shown(whole) != shown(first)
    for t in ("cost", "profile", "overruns", "words"):
        columns = sorted(whole.frames[t].columns)
        assert sorted(map(str, second.frames[t].select(*columns).collect())) == sorted(map(str, whole.frames[t].select(*columns).collect())), t
    assert shown(history.read(0)) == shown(first)

    # a column without any value left: rules stand down, and all runs anew
    calls = []
    monkeypatch.setattr(incremental, "run_whole", lambda *args: calls.append(args))
    incremental.run_update(history, now.works, corpus(spark, [{**r, "work_category": None} for r in after], paid), ids, LATER)
    assert len(calls) == 1
