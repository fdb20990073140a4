"""Scalar functions as Column expressions; all stay in whole-stage code where Spark has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlight import config


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def clean_text(c) -> Column:
    """No-break spaces as spaces, runs of white space as one, trimmed; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(F.translate(col(c), " ", " "), r"\s+", " ")), F.lit(""))


def squash(c) -> Column:
    return F.nullif(F.regexp_replace(F.translate(col(c), " ", " "), r"\s+", ""), F.lit(""))


def work_code(c) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"^(WS/MP\d+/\d{4}-\d{4}/\d+)", 1), F.lit(""))


def work_type(c) -> Column:
    """What follows the work code, or NA-."""
    return F.nullif(F.trim(F.regexp_extract(col(c), r"^(?:WS/MP\d+/\d{4}-\d{4}/\d+|NA)\s*-?\s*(.*)$", 1)), F.lit(""))


def district_of(c) -> Column:
    return F.nullif(F.trim(F.regexp_extract(col(c), r"^([^(]*)", 1)), F.lit(""))


def lenient_number(c) -> Column:
    return F.regexp_replace(col(c), r"[^0-9.\-]", "").try_cast("double")


def lenient_date(c) -> Column:
    c = F.trim(col(c))
    return F.coalesce(F.try_to_date(c, "dd-MMM-yyyy"), F.try_to_timestamp(c, F.lit("MMM d, yyyy h:mm:ss a")).cast("date"), F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "dd/MM/yyyy"))


def reserved(c, kind: str) -> Column:
    return F.upper(col(c)).rlike(rf"\(\s*{kind}\s*\)").cast("int")


def financial_year(c) -> Column:
    """April to March as 2024-25."""
    start = F.year(F.add_months(col(c), -3))
    return F.when(col(c).isNotNull(), F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0")))


def era(c, cutoff: str = config.ERA_CUTOFF) -> Column:
    return F.when(col(c).isNull(), "unknown").when(col(c) >= F.lit(cutoff).cast("date"), "post2023").otherwise("pre2023")


def cost(sanctioned="sanctioned_amount", estimated="estimated_cost") -> Column:
    return F.coalesce(col(sanctioned), col(estimated))


def is_annual(fy) -> Column:
    """One year after the other; the end may have two digits."""
    fy = col(fy)
    first, last = F.substring(fy, 1, 4).try_cast("int"), F.regexp_extract(fy, r"-(\d{2,4})$", 1).try_cast("int")
    return fy.rlike(r"^\d{4}-\d{2,4}$") & (F.pmod(last - first, F.lit(100)) == 1)


def year_ended(fy, today) -> Column:
    """Whether 31 March of the end year has passed."""
    fy = col(fy)
    first, tail = F.substring(fy, 1, 4).try_cast("int"), F.regexp_extract(fy, r"-(\d{2,4})$", 1)
    end = F.when(F.length(tail) == 2, (F.floor(first / 100) * 100 + tail.try_cast("int") + F.when(tail.try_cast("int") < first % 100, 100).otherwise(0)).cast("int")).otherwise(tail.try_cast("int"))
    return F.lit(today).cast("date") > F.make_date(end, F.lit(3), F.lit(31))


def entity_key(seat="constituency", member="mp_name", state="state") -> Column:
    return F.concat_ws("|", F.coalesce(blank_to_null(seat), blank_to_null(member), F.lit("NA")), F.coalesce(blank_to_null(state), F.lit("NA")))


def hash_id(prefix: str, c, n: int, upper: bool = False) -> Column:
    h = F.substring(F.sha1(col(c).cast("binary")), 1, n)
    return F.concat(F.lit(prefix), F.upper(h) if upper else h)


def tokens(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9]{3,})")))


def locators(c) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"(\d+)"))))


def normal_text(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def folded(c) -> Column:
    return F.nullif(F.lower(F.regexp_replace(F.trim(col(c)), r"\s+", " ")), F.lit(""))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p, q = F.radians(col(lat1)), F.radians(col(lat2))
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a))


def hamming_bits(a, b) -> Column:
    """Differing bits of 16-digit hex hashes, in halves of 32 bits."""
    half = lambda c, at: F.conv(F.substring(col(c), at, 8), 16, 10).cast("bigint")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def short_title(c, category=None, most: int = 62) -> Column:
    """A description without noise phrases, cut at a space, capitalised; the category where too little is left, "Untitled work" where that is missing too."""
    ends = r"^[ .,\-–—]+|[ .,\-–—]+$"
    tidy = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " ")), ends, "")
    t = tidy(F.regexp_replace(tidy(col(c)), rf"(?i)\b({'|'.join(config.NOISE)})\b", ""))
    other = F.trim(F.regexp_replace(F.coalesce(col(category), F.lit("")), r"(?U)\s+", " ")) if category is not None else F.lit("")
    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  x is worked out once, however often f names it
    large = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2**31 - 2))
    cut = lambda t: F.regexp_replace(F.regexp_replace(F.substring(t, 1, most), r" [^ ]*$", ""), r"[ .,\-–—]+$", "")
    shown = lambda t: F.when(t == "", "Untitled work").when(F.length(t) > most, F.concat(once(cut(t), large), F.lit("…"))).otherwise(large(t))
    return once(once(t, lambda x: F.when(F.length(x) < 8, other).otherwise(x)), shown)


def money(c) -> Column:
    v = col(c)
    return F.when(v >= 1e7, F.format_string("₹%.2f crore", v / 1e7)).when(v >= 1e5, F.format_string("₹%.2f lakh", v / 1e5)).otherwise(F.concat(F.lit("₹"), F.format_number(v, 0)))


def band(score) -> Column:
    out = None
    for least, name in config.BANDS:
        out = F.when(col(score) >= least, name) if out is None else out.when(col(score) >= least, name)
    return out.otherwise("Low")


def wilson(k, n, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a share; (0, 1) where there is nothing to go by."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, mid - half).otherwise(0.0), F.when(n > 0, mid + half).otherwise(1.0)


def payload_hash(rows: Column) -> Column:
    """Names a group's rows in any order; an aggregate of sums, so no group is gathered: SHA-256 of their number and of the sums of the four parts of each row's MD5."""
    h = F.md5(F.to_json(rows).cast("binary"))
    sums = [F.sum(F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")).cast("string") for at in (1, 9, 17, 25)]
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256)


def severity_rank(c) -> Column:
    return F.array_position(F.array(*map(F.lit, config.SEVERITIES)), col(c)).cast("int")


def is_local_body(c) -> Column:
    return F.lower(col(c)).rlike(config.LOCAL_BODY)
