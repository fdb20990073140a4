"""Reads, notices, switch-over, paged sources, keyed streams and duplicates by brute force."""

import datetime as dt
import json
import math
import random
import re
import threading
from collections import Counter, defaultdict
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import functions as F

from ledgerlight import config
from ledgerlight.functions.fuzzy import token_set_ratio
from ledgerlight.operators import duplicates
from ledgerlight.operators.findings import together
from ledgerlight.plans import analysis, cases, reads
from ledgerlight.sources import readers, remote, sinks
from ledgerlight.streaming import ingest
from tests.test_rules import TODAY, works

AT = "2024-01-02 00:00:00"


def test_tiers_and_ministry(spark):
    case = spark.createDataFrame([("work", f"W{i}", i, s, d, "Seat", rules) for i, (s, d, rules) in enumerate([("UP", "Agra", ["A"]), ("up", "AGRA", ["A", "B"]), (None, None, ["B"]), ("MP", "Agra", ["A"])])], "entity_type string, entity_id string, score int, state string, district string, constituency string, rules array<string>")
    assert {r.entity_id for r in reads.tier(case, "district", "agra", "Up").collect()} == {"W0", "W1"}
    assert reads.tier(case, "constituency", "SEAT").count() == 4
    shown, states, rules = reads.ministry(case, 1, shown=2)
    assert [r.entity_id for r in shown.collect()] == ["W3", "W2"]
    assert {(r.state, r.cases) for r in states.collect()} == {("up", 1), ("unattributed", 1), ("MP", 1)} and {(r.rule_id, r.cases) for r in rules.collect()} == {("A", 2), ("B", 2)}


def test_health_and_notices(spark):
    t = dt.datetime(2024, 1, 1, 23, 0)
    areas = spark.createDataFrame([("a", t, t, 0, 1, "live"), ("b", t - dt.timedelta(days=3), None, 3, 0, "quarantined")], "shard_id string, fetched_at timestamp, swept_at timestamp, consecutive_failures int, exact int, lifecycle string")
    found = reads.conditions(areas, AT)
    assert {(r.condition, r.areas) for r in found.collect()} == {(c, 1) for c in ("checks_stalled", "checks_failing", "parity_differs", "sweep_overdue", "held_back")}
    known = spark.createDataFrame([("held_back", t, None), ("parity_differs", t, None), ("checks_stalled", t, t), ("sweep_overdue", t - dt.timedelta(days=2), t - dt.timedelta(days=2))], "condition string, since timestamp, notified_at timestamp")
    assert {r.condition for r in reads.notices(found, known, AT).where("notify").collect()} == {"held_back", "sweep_overdue"}


def test_plans_scripts_and_planting(spark):
    plan = spark.createDataFrame([("c", 1, "x"), ("c", 2, "x"), ("c", 3, "y"), ("c", 4, "z")], "case_id string, step int, action string")
    allowed = spark.createDataFrame([("c", "x"), ("c", "y")], "case_id string, action string")
    assert {(r.action, r.error) for r in cases.plan_errors(plan, allowed, most=2).collect()} == {("x", "twice"), ("y", "too many"), ("z", "not allowed")}
    texts = spark.createDataFrame([("सड़क का काम",), ("road work",), ("", ), (None,)], "t string")
    assert [r.ok for r in texts.select(cases.in_script("t").alias("ok")).collect()] == [True, False, False, False]
    w = works(spark, *[{} for _ in range(200)])
    changed, marks = cases.planted(w, 10, {"gate": ("R-PROH-01", {"description": F.lit("Construction of welcome gate")}), "dear": ("R-COST-01", {"sanctioned_amount": F.lit(9e7)})})
    kinds = Counter(r.pattern for r in marks.collect())
    assert set(kinds) == {"gate", "dear"} and 5 <= sum(kinds.values()) <= 40
    found, _ = analysis.findings(analysis.Corpus(changed), TODAY)
    recall = {r.pattern: r.recall for r in cases.planted_recall(marks, found).collect()}
    assert recall == {"gate": 1.0, "dear": 1.0}


def test_past_fund_flows(spark):
    raw = spark.createDataFrame([("up ", "2.5", "0.5"), ("mp", "x", "1")], "State string, Rel string, Left string")
    got = {r.state: r for r in readers.fund_flows(raw, {"state": "State", "released": "Rel", "unspent": "Left", "district": "No such"}, source="old", house="LS", fy="2015-16", unit="crore").collect()}
    assert got["UP"].released == 2.5e7 and got["UP"].expenditure == 2e7 and got["UP"].utilization_pct == 80.0 and got["MP"].expenditure is None and got["UP"].row_id != got["MP"].row_id


def test_paged_source(spark):
    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            body = json.dumps({"total": 23, "records": [{"id": i, "name": f"n{i}"} for i in range(q["offset"], min(30, q["offset"] + q["limit"]))]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(readers.PagedJson)
    df = spark.read.format("paged_json").schema("id int, name string").option("url", f"http://127.0.0.1:{server.server_port}/?limit={{limit}}&offset={{offset}}").option("page", "5").load()
    assert sorted(tuple(r) for r in df.collect()) == [(i, f"n{i}") for i in range(23)] and df.rdd.getNumPartitions() == 5
    server.shutdown()


def test_calls_are_tried_again_behind_a_breaker(spark):
    rows = spark.range(30).coalesce(1)

    def call(row):
        if row["id"] % 3 == 0:
            raise ValueError("no")
        return str(row["id"])

    got = {r.id: (r.body, r.error) for r in remote.called(rows, call, 2, wait=lambda s: None, tries=2).collect()}
    assert got[1] == ("1", None) and got[3] == (None, "ValueError: no") and len(got) == 30


def test_cache_switch_and_collisions(spark, tmp_path):
    rows = spark.createDataFrame([("LS", "UP", "A", "works", "1"), ("LS", "UP", "B", "works", "2")], "house string, state string, constituency string, tile string, body string")
    sinks.tile_cache(rows, f"{tmp_path}/cache")
    sinks.tile_cache(rows.where("constituency = 'B'").withColumn("body", F.lit("3")), f"{tmp_path}/cache")
    assert {(r.constituency, r.body) for r in spark.read.schema("body string, house string, state string, constituency string, tile string").json(f"{tmp_path}/cache").collect()} == {("A", "1"), ("B", "3")}
    old = spark.createDataFrame([("1", "x"), ("2", "y")], "work_id string, category string")
    live = spark.createDataFrame([("2", "z"), ("3", "w")], "work_id string, category string")
    now = sinks.switched(old, live, table=f"{tmp_path}/works")
    assert {(r.work_id, r.origin_id, r.era) for r in now.collect()} == {("live:2", "2", None), ("live:3", "3", None), ("1", "1", "historical")} and spark.read.parquet(f"{tmp_path}/works").count() == 3
    stored = spark.createDataFrame([("1", "x", "us")], "work_id string, category string, source string")
    batch = spark.createDataFrame([("1", "q", "them"), ("5", "r", "them")], "work_id string, category string, source string")
    assert {r.work_id: r.category for r in sinks.upserted(stored, batch, "work_id", AT, owner="source")[0].collect()} == {"1": "x", "5": "r"}
    for d in ("open", "closed"):
        sinks.reviewed(spark.createDataFrame([("c", d)], "case_id string, decision string"), f"{tmp_path}/reviews")
    assert spark.read.parquet(f"{tmp_path}/reviews").count() == 2


def test_levels_are_compared_below_what_moved(spark):
    level = lambda rows: spark.createDataFrame(rows, "slice string, parent string, n bigint, total double")
    before = [level([("IN", None, 10, 1.0)]), level([("UP", "IN", 4, 1.0), ("MP", "IN", 6, 1.0)]), level([("A", "UP", 2, 1.0), ("B", "UP", 2, 1.0), ("C", "MP", 6, 1.0)])]
    now = [level([("IN", None, 11, 1.0)]), level([("UP", "IN", 5, 1.0), ("MP", "IN", 6, 1.0)]), level([("A", "UP", 3, 1.0), ("B", "UP", 2, 1.0), ("C", "MP", 9, 1.0)])]
    last = [ingest.signatures(b) for b in before]
    assert [r.slice for r in ingest.changed_below(now, last).collect()] == ["A"]  # C moved without its state: not asked
    assert ingest.changed_below(before, last).count() == 0


def test_recompute_where_something_changed(spark):
    w = works(spark, {}, {"district": "OTHER"}, {"district": "OTHER"}, {"district": None}, {"district": None})
    scope = ingest.touched(w, spark.createDataFrame([("W1",), ("W3",)], "work_id string"), ("state", "district"))
    assert {r.work_id for r in scope.collect()} == {"W1", "W2", "W3", "W4"}
    found = spark.createDataFrame([("W0", "R"), ("W1", "R"), ("W2", "R")], "entity_id string, rule_id string")
    assert {(r.entity_id, r.rule_id) for r in ingest.recomputed(found, spark.createDataFrame([("W2", "S")], "entity_id string, rule_id string"), scope).collect()} == {("W0", "R"), ("W2", "S")}
    assert ingest.due("2024-01-01T05:00", "2024-01-01T04:00", "2024-01-01T08:00") and not ingest.due("2024-01-01T05:00", "2024-01-01T04:00", "2024-01-01T06:00") and ingest.due("2024-01-01T05:00", None, "2024-01-01T06:00") and not ingest.due(None, None, "2024-01-01T06:00")
    state = spark.createDataFrame([("a", 0), ("b", 1), ("c", 3)], "slice string, failures int")
    assert {(r.slice, r.due_at.hour * 60 + r.due_at.minute, r.escalated) for r in ingest.queued(state, AT).collect()} == {("b", 5, False), ("c", 20, True)}


def test_removals_on_a_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 10, 0) + dt.timedelta(minutes=m)
    rows = [("a", at(0), False, True), ("a", at(5), False, True), ("a", at(12), False, True), ("b", at(0), False, True), ("b", at(12), False, False), ("b", at(13), True, True), ("c", at(1), True, True)]
    for i, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, "work_id string, read_at timestamp, listed boolean, consistent boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("work_id string, read_at timestamp, listed boolean, consistent boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = ingest.watched(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    assert {(r.work_id, r.state) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", "missing"), ("a", "retired"), ("b", "missing"), ("b", "restored")}


def brute_pairs(rows, rule):
    """Pairs (a, b) past all gates, from the definition."""
    df_all = Counter(t for r in rows for t in set(re.findall("[a-z0-9]{3,}", r["description"].lower())))
    common = {t for t, c in df_all.items() if 100 * c / len(rows) > rule["boilerplate_pct"]}
    blocks = defaultdict(list)
    for r in rows:
        blocks[r["state"], r["district"]].append(r)
    out = {}
    for block in blocks.values():
        tf = []
        for r in block:
            c = Counter()
            for w in r["description"].lower().split():
                p = f" {w} "
                c.update(p[i : i + n] for n in (3, 4, 5) for i in range(len(p) - n + 1))
            tf.append(c)
        df = Counter(g for c in tf for g in c)
        vec = []
        for c in tf:
            v = {g: k * (math.log((1 + len(block)) / (1 + df[g])) + 1) for g, k in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            vec.append({g: x / norm for g, x in v.items()})
        for i, a in enumerate(block):
            near = sorted(((-round(sum(x * vec[j].get(g, 0) for g, x in vec[i].items()), 9), b["work_id"], b) for j, b in enumerate(block) if i != j), key=lambda t: t[:2])[: rule["neighbours"]]
            for cos, _, b in near:
                ta, tb = ({t for t in re.findall("[a-z0-9]{3,}", x["description"].lower())} - common for x in (a, b))
                n = rule["specific"]
                if -cos >= rule["cosine"] and len(ta) >= n and len(tb) >= n and len(ta & tb) >= n and set(re.findall(r"\d+", a["description"])) == set(re.findall(r"\d+", b["description"])) and token_set_ratio(a["description"].lower(), b["description"].lower()) >= rule["fuzzy"]:
                    out[tuple(sorted((a["work_id"], b["work_id"])))] = -cos
    return out


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima"]
    rows = []
    for i in range(150):
        base = f"Construction of {' '.join(rng.sample(words, 5))} yard {rng.choice(['one', 'two'])}"
        for _ in range(rng.choice([1, 1, 2, 3])):
            rows.append(base if rng.random() < 0.5 else base.replace("yard", rng.choice(["yards", "yard", "ward 7"])))
    rows = [{"description": t, "district": f"D{rng.randrange(4)}", "work_id": f"W{i}", "state": "UP"} for i, t in enumerate(rows)]
    rule = config.DUPLICATE | {"boilerplate_pct": 90.0}
    w = works(spark, *rows)
    got = {(r.a, r.b): r.cosine for r in duplicates.candidate_pairs(w, rule).collect()}
    want = brute_pairs(rows, rule)
    assert len(want) > 50 and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    tiny = {(r.a, r.b): round(r.cosine, 9) for r in duplicates.nearest_texts(duplicates.block_texts(duplicates.described(w)), 5, 0.75, shard=7, chunk=9).collect()}
    assert tiny == {(r.a, r.b): round(r.cosine, 9) for r in duplicates.nearest_texts(duplicates.block_texts(duplicates.described(w)), 5, 0.75).collect()}


def test_batches_villages_records_and_photos(spark):
    same = "Construction of zephyr quartz obelisk pavilion"
    rows = [{"description": same, "letter_no": f"L{i % 2}", "vendor_name": "Builder", "sanctioned_amount": 5e5 if i < 3 else 9e5} for i in range(4)]  # a batch of four
    rows += [{"work_id": "ES-1", "description": "Laying of crimson falcon harbour bridge", "status": "NA", "mp_name": "SHRI Z", "in_recommended": 1}, {"work_id": "WS/1", "description": "Laying of crimson falcon harbour bridge", "mp_name": "Shri  Z", "in_recommended": 0}]
    rows += [{"description": "Repair of marble lantern orchard fountain", "mp_name": m} for m in ("A", "B")]  # held
    w = works(spark, *rows).withColumn("in_recommended", (F.col("work_id") != "WS/1").cast("int"))
    payments = spark.createDataFrame([("W0", "GP Bamhani"), ("W1", "gp  bamhani"), ("W3", "GP Kareli")], "work_id string, vendor_name string")
    photos = spark.createDataFrame([("W0", "p"), ("W1", "p"), ("W2", "q"), ("W6", "r"), ("W7", "r")], "work_id string, sha256 string")
    rule = config.DUPLICATE | {"boilerplate_pct": 90.0}
    found = together(*duplicates.near_duplicates(w, payments, photos, rule)).collect()
    batch = {r.entity_id: r for r in found if "batch_size" in r.details}
    assert set(batch) == {"W0", "W1", "W2", "W3"} and [k for k, r in batch.items() if r.standalone] == ["W0"]
    assert batch["W0"].details["batch_size"] == "4" and batch["W0"].details["batch_letters"] == "2" and batch["W2"].details.get("payee") is None and "bamhani" in batch["W1"].details["payee"].lower() and not any(r.scored for r in batch.values())
    on_file = {(r.entity_id, r.severity, r.scored) for r in found if "cluster" in r.details}
    assert on_file == {("W0", "critical", True), ("W1", "critical", True)}
    pairs = {(r.entity_id, r.details["pair"]): (r.details["class"], r.severity, r.scored) for r in found if "pair" in r.details}
    assert pairs[("ES-1", "WS/1")] == ("record", "low", False) and pairs[("W6", "W7")] == ("held", "critical", True) == pairs[("W7", "W6")]
    assert not {("W0", "W1"), ("W0", "W2")} & set(pairs)  # on one photo file; in the batch only
    found = together(*duplicates.near_duplicates(w, payments, None, rule)).collect()
    pairs = {(r.entity_id, r.details["pair"]): r.details for r in found if "pair" in r.details}
    assert pairs[("W0", "W1")]["class"] == "held" and "bamhani" in pairs[("W0", "W1")]["payee"].lower() and ("W0", "W2") not in pairs


def test_photos_of_held_pairs(spark):
    rows = [{"description": f"Repair of marble{x} lantern{x} orchard{x} fountain{x}", "mp_name": m, "completion_date": dt.date(2026, 1, 1) if x != "e" else None} for x in "abcde" for m in ("A", "B")]
    photos = [("W0", "p", "0f" * 8, "f0" * 8), ("W1", "q", "0f" * 7 + "0e", "f0" * 8), ("W2", "r", "00" * 8, "00" * 8), ("W3", "s", "ff" * 8, "00" * 8), ("W4", "t", "00" * 8, "00" * 8), ("W6", "u", "01" * 8, "00" * 8), ("W7", "u", "01" * 8, "00" * 8), ("W8", "v", "00" * 8, "00" * 8)]
    photos = spark.createDataFrame(photos, "work_id string, sha256 string, row_hash string, col_hash string")
    found = {r.entity_id: r for r in together(*duplicates.near_duplicates(works(spark, *rows), None, photos, config.DUPLICATE | {"boilerplate_pct": 90.0})).collect() if "pair" in r.details}
    assert {k: (r.details["photo_check"], r.severity, r.scored) for k, r in found.items() if k in ("W0", "W2", "W4", "W6", "W8")} == {"W0": ("look_alike", "low", False), "W2": ("different_photos", "low", False), "W4": ("no_photo", "low", False), "W6": ("same_file", "critical", True), "W8": ("not_completed", "low", False)}
    assert found["W0"].details["photo_bits"] == "1" and found["W0"].summary.endswith("their photos look alike")
