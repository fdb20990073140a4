"""Switching to a corpus that was built anew: what can't be fetched again is carried over under its new ids, and all tables change at once.

A release is a version of all tables together. It is written beside the one in use, checked, and published by one small file, so readers
see the old tables or the new ones and never some of each; a release that fails a check, or is lost half-way, changes nothing. Going back
publishes an earlier release again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.tables import delete, folders, get_text, put_text

#: Fields by which a work is known: where one changes, one work was written over another.
IDENTITY = ("house", "state", "constituency")


def scoped(work_id, shard_id, house) -> Column:
    """Ids of recommendations with their house, as it follows from the place of the read or from the work: ES-7 is ES-LS-7 or ES-RS-7. Other ids stay."""
    col = lambda c: c if isinstance(c, Column) else F.col(c)
    own = F.when(F.coalesce(col(shard_id), F.lit("")).startswith("2:"), "LS").when(F.coalesce(col(shard_id), F.lit("")).startswith("1:"), "RS").otherwise(col(house))
    return F.when(col(work_id).rlike(r"^ES-\d+$") & own.isNotNull(), F.concat(F.lit("ES-"), own, F.substring(col(work_id), 3, 2**31 - 3))).otherwise(col(work_id))


def id_map(works: DataFrame) -> DataFrame:
    """(work_id, house) of an old corpus; a work id that stands for several houses tells none."""
    return works.groupBy("work_id").agg(F.when(F.countDistinct("house") == 1, F.min("house")).alias("house"))


def rekeyed(rows: DataFrame, houses: DataFrame) -> DataFrame:
    """Rows of an old corpus under the new ids. rows: work_id, and shard_id where it is known."""
    shard = F.col("shard_id") if "shard_id" in rows.columns else F.lit(None).cast("string")
    out = rows.join(houses.select(F.col("work_id").alias("_w"), F.col("house").alias("_house")), F.col("work_id") == F.col("_w"), "left")
    return out.withColumn("work_id", scoped("work_id", shard, "_house")).select(*rows.columns)


def carried(old: dict[str, DataFrame], works: DataFrame) -> dict[str, DataFrame]:
    """What goes over from an old corpus to new works: the edit log without occasions on which one work was written over another, and without
    works that are no longer there; works retired before that are not back; and all decisions."""
    houses, known = id_map(old["works"]), works.select("work_id").distinct()
    out = {}
    if "versions" in old:
        v = old["versions"]
        clash = v.where(F.col("field").isin(*IDENTITY)).select(F.col("work_id").alias("_w"), F.col("observed_at").alias("_at")).distinct()
        clean = v.join(clash, (v["work_id"] == F.col("_w")) & (v["observed_at"] == F.col("_at")), "left_anti")
        out["versions"] = rekeyed(clean, houses).join(known, "work_id", "left_semi").dropDuplicates()
    if "retired" in old:
        out["retired"] = rekeyed(old["retired"], houses).join(known, "work_id", "left_anti")
    if "feedback" in old:
        out["feedback"] = old["feedback"]
    return out


def failures(tables: dict[str, DataFrame], portal: DataFrame | None = None, tolerance: float = 0.005) -> DataFrame:
    """(check, detail) of what speaks against a release: ids that stand twice, recommendations without a house, payments and edits of works that
    aren't there, seats of the upper house, and numbers of works apart from the portal's (house, n) by more than ``tolerance``."""
    w = tables["works"]
    named = lambda df, check, detail: df.select(F.lit(check).alias("check"), detail.cast("string").alias("detail"))
    found = [
        named(w.groupBy("work_id").count().where("count > 1"), "id stands twice", F.col("work_id")),
        named(w.where(F.col("work_id").startswith("ES-") & ~F.col("work_id").rlike(r"^ES-(LS|RS)-\d+$")), "recommendation without a house", F.col("work_id")),
        named(w.where("house = 'RS' and constituency is not null").groupBy().count().where("count > 0"), "upper house with seats", F.col("count")),
    ]
    found += [named(tables[t].join(w, "work_id", "left_anti").select("work_id").distinct(), f"{t} of no work", F.col("work_id")) for t in ("payments", "versions") if t in tables]
    if portal is not None:
        ours = w.groupBy("house").agg(F.count(F.lit(1)).alias("_n"))
        apart = portal.join(ours, "house", "full").where(F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("_n", F.lit(0))) > tolerance * F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)))
        found.append(named(apart, "number of works", F.concat_ws(" ", "house", "_n", "n")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


class Refused(RuntimeError):
    """A release that failed its checks."""


class Releases:
    """The releases of a corpus in a folder; the newest note says which folder of tables is in use."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def notes(self) -> list[dict]:
        found = [(int(n), get_text(self.spark, f"{self.root}/notes/{n}/note.json")) for n in folders(self.spark, f"{self.root}/notes")]
        return [json.loads(text) | {"number": n} for n, text in sorted(found) if text is not None]

    def _publish(self, folder: str, tables: list[str]) -> int:
        number = max([n["number"] for n in self.notes()], default=-1) + 1
        put_text(self.spark, f"{self.root}/notes/{number:06}/note.json", json.dumps({"folder": folder, "tables": tables}))
        return number

    def publish(self, tables: dict[str, DataFrame], portal: DataFrame | None = None) -> int:
        """Writes all tables, checks what was written, and puts them in use. Otherwise what is in use stays so."""
        folder = f"{self.root}/tables/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        against = failures(self._read(folder, list(tables)), portal).limit(20).collect()  # as many as a person reads
        if against:
            delete(self.spark, [folder])
            raise Refused("; ".join(f"{r.check}: {r.detail}" for r in against))
        return self._publish(folder, list(tables))

    def _read(self, folder: str, tables: list[str]) -> dict[str, DataFrame]:
        return {t: self.spark.read.parquet(f"{folder}/{t}") for t in tables}

    def current(self) -> dict[str, DataFrame]:
        found = self.notes()
        if not found:
            raise FileNotFoundError(f"{self.root} has no release")
        return self._read(found[-1]["folder"], found[-1]["tables"])

    def back(self) -> int:
        """Puts the release in use again that was before this one."""
        found = self.notes()
        before = [n for n in found if n["folder"] != found[-1]["folder"]]
        if not before:
            raise FileNotFoundError(f"{self.root} has no earlier release")
        return self._publish(before[-1]["folder"], before[-1]["tables"])


def switch(releases: Releases, works: DataFrame, payments: DataFrame, flows: DataFrame | None = None, portal: DataFrame | None = None) -> int:
    """Puts newly built works, payments and fund positions in use, with what is carried over from the release in use."""
    old = releases.current()
    new = {"works": works, "payments": payments} | ({"flows": flows} if flows is not None else {})
    return releases.publish(new | carried(old, works), portal)
