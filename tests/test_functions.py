import random

from pyspark.sql import functions as F

from ledgerlight.functions import fuzzy
from ledgerlight.functions import scalar as S


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_text_and_numbers(spark):
    lit = F.lit
    assert one(spark, S.clean_text(lit("  a  b\n c "))) == "a b c" and one(spark, S.clean_text(lit("  "))) is None
    assert one(spark, S.squash(lit(" a b "))) == "ab"
    assert one(spark, S.work_code(lit("WS/MP12/2023-2024/77 - Road"))) == "WS/MP12/2023-2024/77"
    assert one(spark, S.work_type(lit("WS/MP12/2023-2024/77 - Road"))) == "Road" and one(spark, S.work_type(lit("NA-Hall"))) == "Hall"
    assert one(spark, S.district_of(lit("SITAPUR(DISTRICT MAGISTRATE)"))) == "SITAPUR"
    assert one(spark, S.lenient_number(lit("Rs 1,234.50"))) in (1234.5, None) and one(spark, S.lenient_number(lit("57,64,99"))) == 576499 and one(spark, S.lenient_number(lit("-"))) is None
    for text in ("05-Mar-2024", "Mar 5, 2024 01:02:03 PM", "2024-03-05"):
        assert str(one(spark, S.lenient_date(lit(text)))) == "2024-03-05", text
    assert one(spark, S.lenient_date(lit("soon"))) is None
    assert one(spark, S.reserved(lit("HAJO ( SC )"), "SC")) == 1 and one(spark, S.reserved(lit("HAJO"), "SC")) == 0


def test_years_and_keys(spark):
    date = lambda s: F.lit(s).cast("date")
    assert one(spark, S.financial_year(date("2024-03-31"))) == "2023-24" and one(spark, S.financial_year(date("2024-04-01"))) == "2024-25"
    assert one(spark, S.financial_year(date("1999-05-01"))) == "1999-00"
    assert one(spark, S.era(date("2023-04-01"))) == "post2023" and one(spark, S.era(date("2023-03-31"))) == "pre2023" and one(spark, S.era(F.lit(None).cast("date"))) == "unknown"
    assert one(spark, S.is_annual(F.lit("2024-25"))) and one(spark, S.is_annual(F.lit("1999-00"))) and not one(spark, S.is_annual(F.lit("2019-24")))
    assert one(spark, S.year_ended(F.lit("2024-25"), "2025-04-01")) and not one(spark, S.year_ended(F.lit("2024-25"), "2025-03-31"))
    row = spark.createDataFrame([(" ", "A B", None)], "constituency string, mp_name string, state string").select(S.entity_key()).first()[0]
    assert row == "A B|NA"


def test_hamming_and_distance(spark):
    rng = random.Random(1)
    rows = [(f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()) for a, b in ((rng.getrandbits(64), rng.getrandbits(64)) for _ in range(50))]
    got = spark.createDataFrame(rows, "a string, b string, n int").select(S.hamming_bits("a", "b").alias("x"), "n").collect()
    assert all(r.x == r.n for r in got)
    assert abs(one(spark, S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 111.195) < 0.01


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_ratios():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        if a or b:
            assert abs(fuzzy.ratio(a, b) - 200 * lcs(a, b) / (len(a) + len(b))) < 1e-9
    assert fuzzy.token_set_ratio("road at rampur", "rampur road at") == 100
    assert fuzzy.token_set_ratio("road", "hall") < 60


def test_titles_and_money(spark):
    assert one(spark, S.money(F.lit(12_500_000.0))) == "₹1.25 crore" and one(spark, S.money(F.lit(250_000.0))) == "₹2.50 lakh"
    cases = [
        ("construction of " + "community hall " * 9, None, "Construction of community hall community hall community hall…"), ("  road,  as per attached list - ", "Roads", "Roads"), ("Under MPLADS funds building of wall", None, "Building of wall"),
        ("balance work", None, "Untitled work"), (None, None, "Untitled work"), (None, "  street   lights", "Street lights"), ("hall work order no. 12/7 at Rampur", "x", "Hall at Rampur"), ("ghat\u00a0 at Rampur.", "x", "Ghat at Rampur"),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, d string, c string")
    assert [r.t for r in df.orderBy("i").select(S.short_title("d", "c").alias("t")).collect()] == [c[2] for c in cases]
