"""Readers: report CSVs, mapped sources, paged and nested JSON, text extracts."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerlight.functions import scalar as S

_TYPES = {"string": T.StringType(), "date": T.DateType(), "double": T.DoubleType(), "int": T.IntegerType()}
_COLUMNS = (
    "work_id string, source string, era string, state string, district string, constituency string, mp_name string, house string, category string, description string, recommended_date date, sanction_date date, completion_date date, status string, "
    "estimated_cost double, sanctioned_amount double, expenditure double, ia_name string, vendor_name string, work_type string, total_paid double, payment_count int, last_payment_date date, payment_status string, is_sc_constituency int, is_st_constituency int, "
    "lat double, lon double, fy string, work_category string, letter_no string, term_start date, term_end date, implementing_agency string, vendor_id string"
)
WORKS = T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in _COLUMNS.split(", "))])


def report_csv(spark: SparkSession, path: str, total_column: str | None = None) -> DataFrame:
    """All columns as text, names cleaned of marks and no-break spaces; the grand-total row, which has no state, goes."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).csv(path)
    df = df.toDF(*[re.sub(r"\s+", " ", c.replace("﻿", "").replace(" ", " ")).strip() for c in df.columns])
    return df.where(S.clean_text(total_column).isNotNull()) if total_column else df


def column_like(df: DataFrame, *names: str) -> str | None:
    """The first column of that name in any case, else one that holds a name."""
    low = {c.lower(): c for c in df.columns}
    exact = next((low[n.lower()] for n in names if n.lower() in low), None)
    return exact or next((c for n in names for c in df.columns if n.lower() in c.lower()), None)


def conformed(df: DataFrame, schema: T.StructType = WORKS) -> DataFrame:
    """The canonical columns; missing ones are null, bad values too."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def mapped(df: DataFrame, fields: dict[str, str], *, source: str, id_prefix: str | None = None, amount_scale: float = 1.0, amounts: Iterable[str] = (), upper: Iterable[str] = (), era_date: str | None = None) -> DataFrame:
    """A declared source: fields maps canonical names to the source's. Ids are prefixed, or made of the row's content; equal ids are one row."""
    cols = {to: S.clean_text(F.col(f"`{name}`").cast("string")) for to, name in fields.items()}
    cols |= {a: S.lenient_number(f"`{fields[a]}`") * amount_scale for a in amounts}
    cols |= {u: F.upper(cols[u]) for u in upper}
    out = df.select(*[c.alias(n) for n, c in cols.items()]).withColumn("source", F.lit(source))
    if id_prefix and "work_id" in fields:
        out = out.withColumn("work_id", F.concat(F.lit(id_prefix), "work_id"))
    else:
        out = out.withColumn("work_id", F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).cast("binary")))
    if era_date:
        out = out.withColumn("era", S.era(S.lenient_date(era_date)))
    return one_each(out, "work_id")


def one_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key; rows that tie follow their contents, so the choice is the same each time."""
    from ledgerlight.operators.relational import first_of

    return first_of(df.withColumn("_row", F.to_json(F.struct(*df.columns))), [key], *order, "_row").drop("_row")


def united(*frames: DataFrame) -> DataFrame:
    """Canonical union of sources."""
    out = conformed(frames[0])
    for f in frames[1:]:
        out = out.unionByName(conformed(f))
    return out


def first_source_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """Union in which an id comes from the earliest source that has it."""
    out = None
    for i, f in enumerate(frames):
        part = f.withColumn("_source", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return one_each(out, key, "_source").drop("_source")


def pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved pages of a paged JSON service: records of every page up to its stated total."""
    df = spark.read.schema(f"total bigint, offset bigint, records array<struct<{schema}>>").json(path, multiLine=True)
    rows = df.select("total", "offset", F.posexplode("records").alias("i", "r"))
    return rows.where(F.coalesce("offset", F.lit(0)) + F.col("i") < F.coalesce("total", F.lit(2**62))).select("r.*")


class PagedJson(DataSource):
    """A JSON service that gives its records in pages: ``spark.dataSource.register(PagedJson)``, then ``format("paged_json")`` with a schema.

    Options: url (with {limit} and {offset}), page (records a page), and total, where the service doesn't state it on its first page.
    Each page is a partition of its own, read by the task that asks for it; what lies beyond the stated total is left out."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PageReader(dict(self.options), schema)


class _Page(InputPartition):
    def __init__(self, offset: int, limit: int) -> None:
        self.offset, self.limit = offset, limit


class _PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.url, self.page, self.total, self.names = options["url"], int(options.get("page", 1000)), options.get("total"), [(f.name, f.dataType.typeName()) for f in schema]

    def asked(self, offset: int, limit: int) -> dict:
        import json
        from urllib.request import urlopen

        with urlopen(self.url.format(limit=limit, offset=offset), timeout=60) as answer:
            return json.load(answer)

    def partitions(self) -> list[_Page]:
        total = int(self.total) if self.total else int(self.asked(0, 1).get("total") or 0)
        return [_Page(at, min(self.page, total - at)) for at in range(0, total, self.page)]

    def read(self, partition: _Page):
        as_given = {"string": str, "double": float, "long": int, "integer": int, "boolean": bool}
        for record in self.asked(partition.offset, partition.limit).get("records", [])[: partition.limit]:
            yield tuple(None if record.get(n) is None else as_given.get(t, lambda x: x)(record[n]) for n, t in self.names)


def fund_flows(df: DataFrame, fields: dict[str, str], *, source: str, house: str, fy: str, unit: str = "rupee") -> DataFrame:
    """Published fund positions of a past regime: amounts in crore, lakh or rupees become rupees; expenditure that isn't published is what was released less what is unspent."""
    scale = {"rupee": 1.0, "lakh": 1e5, "crore": 1e7}[unit]
    amounts = ("entitlement", "released", "expenditure", "recommended", "sanctioned", "unspent")
    have = {to: name for to, name in fields.items() if name in df.columns}
    cols = {to: (F.round(S.lenient_number(f"`{name}`") * scale, 2) if to in amounts else S.clean_text(F.col(f"`{name}`").cast("string"))) for to, name in have.items()}
    if "state" in cols:
        cols["state"] = F.upper(cols["state"])
    out = df.select(*[c.alias(n) for n, c in cols.items()])
    if "expenditure" not in cols and {"released", "unspent"} <= set(cols):
        out = out.withColumn("expenditure", F.col("released") - F.col("unspent"))
    out = out.drop("unspent").withColumns({"house": F.lit(house), "fy": F.lit(fy), "era": F.lit("pre2023"), "source": F.lit(source)})
    if {"released", "expenditure"} <= set(out.columns):
        out = out.withColumn("utilization_pct", F.when(F.col("released") > 0, F.round(100 * F.col("expenditure") / F.col("released"), 2)))
    return out.withColumn("row_id", F.concat(F.lit(f"{source}-"), F.sha1(F.to_json(F.struct(*out.columns)).cast("binary"))))


def tile_json(df: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """Reports whose JSON is a JSON string once more; a lone total is an empty report."""
    text = F.coalesce(F.from_json(F.concat(F.lit('{"x":'), F.col(body), F.lit("}")), "x string")["x"], F.col(body))
    rows = df.select(*[c for c in df.columns if c != body], F.from_json(text, f"array<struct<{schema},Total_Amt:string>>").alias("rows"))
    return rows.select(*[c for c in rows.columns if c != "rows"], F.explode("rows").alias("r")).where("r.Total_Amt is null").select(*[c for c in rows.columns if c != "rows"], "r.*").drop("Total_Amt")


def watermarks(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Figures as "57,64,99" to double."""
    return df.withColumns({c: S.lenient_number(c) for c in columns})


def tile_cache(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Cached reports <house>/<state>/<constituency>/<tile>.json.gz, with their place from the path."""
    df = spark.read.schema(schema).json(f"{root}/*/*/*/*.json.gz").withColumn("_p", F.split(F.input_file_name(), "/"))
    at = lambda i: F.url_decode(F.element_at("_p", i))
    return df.withColumns({"house": at(-4), "state": at(-3), "constituency": at(-2), "tile": F.regexp_replace(at(-1), r"\.json\.gz$", "")}).drop("_p")


def fields_of_text(df: DataFrame, text: str, patterns: dict[str, str], least: int = 40) -> DataFrame:
    """The first group of each pattern from extracted text; short texts need character recognition first."""
    return df.select("*", *[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")).alias(n) for n, p in patterns.items()], (F.length(F.coalesce(F.col(text), F.lit(""))) < least).alias("needs_ocr"))


def routed(candidates: dict[str, DataFrame | None], order: Iterable[str], least_rows: int = 200) -> tuple[str | None, DataFrame | None, list[dict]]:
    """The first source with enough rows, and a ledger of what was tried."""
    ledger: list[dict] = []
    for name in order:
        df = candidates.get(name)
        enough = df is not None and df.limit(least_rows).count() >= least_rows
        ledger.append({"source": name, "used": enough, "reason": None if enough else "absent" if df is None else f"fewer than {least_rows} rows"})
        if enough:
            return name, df, ledger
    return None, None, ledger


def freshness(local: DataFrame, portal: DataFrame, key: str) -> DataFrame:
    """Rows here as a share of the portal's count, by key."""
    n = local.groupBy(key).agg(F.count(F.lit(1)).alias("here"))
    return portal.join(n, key, "left").select(key, F.coalesce("here", F.lit(0)).alias("here"), "n", F.when(F.col("n") > 0, F.round(100 * F.coalesce("here", F.lit(0)) / F.col("n"), 1)).alias("pct"))
